"""Report relations. Each is a DataFrame to be written with ``df.write``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import or_zero, parse_float, sum_money
from cargoledger.operators import quality
from cargoledger.operators.allocation import (
    ITEM_KEY,
    admitted,
    allocate_by_invoice,
    allocate_by_shipment,
    failed_shipments,
    shipment_totals,
)
from cargoledger.operators.distribution import SLICE_ROWS, SPAN, balanced_join, number_rows
from cargoledger.operators.parties import first_invoices
from cargoledger.operators.tariff import catalog_report, classify_items, translate_live_items


def aforo(
    items: DataFrame,
    bl: DataFrame,
    invoices: DataFrame,
    glossary: DataFrame,
    catalog: DataFrame,
    invoice_span: int = SPAN,
    item_span: int = SPAN,
    level: str = "shipment",
) -> DataFrame:
    """Customs declaration: one row per item, numbered through all invoices of a shipment.

    ``level`` names the freight rule: shares of the shipment's FOB, or of every invoice's, as
    applied right before a report is made from the form.

    Three joins bring item numbers, shipment shares, and texts with tariff codes to the items. Each
    takes its key counts from the item table itself, so no join re-plans an earlier one.
    """
    key = ["shipment_id", *ITEM_KEY]
    numbered = number_rows(
        items,
        "shipment_id",
        "invoice_idx",
        "item_idx",
        ties=[F.col("quantity")],
        name="Item",
        outer_span=invoice_span,
        inner_span=item_span,
    )
    shared, live = shares(numbered, bl, invoices, level, items)
    shared = shared.withColumn("_raw", F.col("description")).withColumn("_live", live)
    coded = classify_items(shared, items, glossary, catalog, key)
    fob, freight = F.col("fob_value"), F.col("freight_proportional")
    live = F.col("_live")
    text = F.when(live, F.col("description_es")).otherwise(F.col("_raw"))
    insurance = fob * fv.INSURANCE_RATE
    duty, selective, tax = fv.DUTY_RATES
    return coded.select(
        "shipment_id",
        "Item",
        F.col("quantity").alias("Bultos"),
        F.coalesce(text, F.lit(fv.NO_DESCRIPTION)).alias("Contenido"),
        F.lit(fv.NO_BRAND).alias("Marca"),
        fob.alias("Fob"),
        freight.alias("Flete"),
        insurance.alias("Seg"),
        (or_zero(fob) + or_zero(freight) + or_zero(insurance)).alias("CIF"),
        F.lit("").alias("Peso"),
        F.lit("").alias("Aduana"),
        F.when(live, F.col("tariff_code")).otherwise(fv.PENDING_CODE).alias("Posicion Arancelaria"),
        F.lit(duty).alias("DAI"),
        F.lit(selective).alias("SELECTIVO"),
        F.lit(tax).alias("ISV"),
    )


def shares(
    items: DataFrame, bl: DataFrame, invoices: DataFrame, level: str, base: DataFrame | None = None
) -> tuple[DataFrame, Column]:
    """Items with their freight under a rule, and whether their shipment was translated.

    A shipment with a failed invoice is not translated; by shipment it is not allocated either.
    """
    if level == "shipment":
        return allocate_by_shipment(items, bl, invoices, base=base), F.col("fob_value").isNotNull()
    if level == "invoice":
        header = bl.join(failed_shipments(invoices), "shipment_id", "left")
        return allocate_by_invoice(items, header, invoices, ("invoice_failed",), base), ~F.coalesce(
            "invoice_failed", F.lit(False)
        )
    raise ValueError(f"level is 'shipment' or 'invoice', not {level!r}")


def reported_items(
    items: DataFrame, bl: DataFrame, invoices: DataFrame, glossary: DataFrame, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Items of admitted shipments with their translations; one failed invoice leaves all of its shipment's untranslated."""
    header = admitted(bl, invoices).select("shipment_id").join(failed_shipments(invoices), "shipment_id", "left")
    held = balanced_join(items, header, ["shipment_id"], ITEM_KEY, how="inner", slice_rows=slice_rows)
    live = ~F.coalesce("invoice_failed", F.lit(False))
    return translate_live_items(held, items, glossary, ["shipment_id", *ITEM_KEY], live).drop("invoice_failed")


def deva(items: DataFrame) -> DataFrame:
    """Price list of ``reported_items``; its total is quantity times unit price, not the stated total."""
    return items.select(
        "shipment_id",
        *ITEM_KEY,
        F.coalesce("part_number", F.lit(fv.NO_PART_NUMBER)).alias("CODIGO DE BARRAS"),
        F.coalesce("description_es", F.lit("")).alias("DESCRIPCION COMERCIAL"),
        F.lit(fv.NO_BRAND).alias("MARCA"),
        F.lit(fv.NO_BRAND).alias("MODELO/ESTILO"),
        F.lit(fv.ORIGIN_COUNTRY).alias("PAIS DE ORIGEN"),
        F.col("quantity").alias("UNIDADES"),
        F.col("unit_price").alias("PRECIO UNITARIO"),
        (or_zero(F.col("quantity")) * or_zero(F.col("unit_price"))).alias("TOTAL"),
    )


def translation(items: DataFrame) -> DataFrame:
    """Descriptions of ``reported_items`` before and after translation."""
    return items.select(
        "shipment_id",
        *ITEM_KEY,
        F.coalesce("description_original", F.lit("")).alias("DESCRIPCION INGLES"),
        F.coalesce("description_es", F.lit("")).alias("DESCRIPCION ESPAÑOL"),
    )


def label_rows(df: DataFrame, keys: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    """One row per label and value, in order, for every input row."""
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(pairs)
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def invoice_summary(items: DataFrame, bl: DataFrame, invoices: DataFrame) -> DataFrame:
    """Shipment summary, one row per shipment; see ``invoice_summary_rows`` for label and value rows.

    ``bl`` carries exporter_details. A shipment without invoices reads N/A and zeros.
    """
    first = first_invoices(invoices.select("shipment_id", "invoice_idx", "invoice_number", "invoice_date"))
    totals = shipment_totals(items)
    header = bl.select(
        "shipment_id", F.col("exporter_details.name").alias("supplier"), "packages_count", "gross_weight"
    )
    joined = header.join(first.drop("invoice_idx"), "shipment_id", "left").join(totals, "shipment_id", "left")
    return joined.select(
        "shipment_id",
        F.coalesce("invoice_number", F.lit("N/A")).alias("invoice_number"),
        F.coalesce("invoice_date", F.lit("N/A")).alias("invoice_date"),
        F.coalesce("supplier", F.lit("N/A")).alias("supplier"),
        F.coalesce("packages_count", F.lit(0)).alias("packages"),
        or_zero(F.col("gross_weight")).alias("weight"),
        *[or_zero(F.col(c)).alias(c) for c in ("fob", "freight", "insurance", "cif")],
    )


def invoice_summary_rows(summary: DataFrame) -> DataFrame:
    """Label rows of the summary: texts in ``text``, counts and amounts in ``amount``."""
    texts = ["invoice_number", "invoice_date", "supplier"]
    amounts = ["packages", "weight", "fob", "freight", "insurance", "cif"]
    values = [F.struct(F.col(c).alias("text"), F.lit(None).cast("double").alias("amount")) for c in texts]
    values += [F.struct(F.lit(None).cast("string").alias("text"), F.col(c).cast("double").alias("amount")) for c in amounts]
    rows = label_rows(summary, ["shipment_id"], list(zip(fv.SUMMARY_LABELS, values, strict=True)))
    return rows.select("shipment_id", "pos", "label", "value.text", "value.amount")


def number_or_fail(c: Column) -> tuple[Column, Column]:
    """(value, bad): a template amount, where nothing counts as 0 and a text may be no number."""
    text = c.cast("string")
    empty = c.isNull() | (text == "")
    return F.when(empty, F.lit(0.0)).otherwise(parse_float(text)), ~empty & parse_float(text).isNull()


def calculated(rule: str) -> Column:
    """Value of a named calculation rule; an unknown rule or an unreadable operand gives 0."""
    (fob, _), (cif, _) = number_or_fail(F.col("valor_fob")), number_or_fail(F.col("valor_cif"))
    (kilos, _), (freight, _) = number_or_fail(F.col("kilos")), number_or_fail(F.col("valor_flete"))
    rules = {
        "CIF - FOB": cif - fob,
        "Flete / Kilos": F.when(kilos > 0, freight / kilos).otherwise(F.lit(0.0)),
    }
    return F.coalesce(rules.get(rule, F.lit(0.0)), F.lit(0.0))


def template_columns(template_id: str, templates: dict | None = None) -> list[tuple]:
    templates = templates or fv.TEMPLATES
    return templates.get(template_id) or templates["comercial"]


def template_data(docs: DataFrame, template_id: str, templates: dict | None = None) -> DataFrame:
    """The columns of a report template, in order; a field the documents lack is null."""
    out = []
    for field, name, _, calc in template_columns(template_id, templates):
        if calc:
            value = calculated(calc)
        else:
            value = F.col(field) if field in docs.columns else F.lit(None).cast("string")
        out.append(value.alias(name))
    keys = [k for k in ("shipment_id", "doc_id") if k in docs.columns]
    return docs.select(*keys, *out)


def template_totals(docs: DataFrame) -> DataFrame:
    """Document count, sums and freight per kilo in one row."""

    def total(field: str) -> Column:
        return sum_money(number_or_fail(F.col(field))[0])

    sums = docs.agg(
        F.count(F.lit(1)).alias("n_documents"),
        total("kilos").alias("kilos"),
        total("valor_fob").alias("fob"),
        total("valor_cif").alias("cif"),
        total("valor_flete").alias("freight"),
    )
    per_kilo = F.when(F.col("kilos") > 0, F.col("freight") / F.col("kilos")).otherwise(F.lit(0.0))
    return sums.withColumn("freight_per_kilo", per_kilo)


def template_summary(docs: DataFrame) -> DataFrame:
    columns = ["n_documents", "kilos", "fob", "cif", "freight", "freight_per_kilo"]
    pairs = [(label, F.col(c).cast("double")) for label, c in zip(fv.TEMPLATE_SUMMARY_LABELS, columns)]
    return label_rows(template_totals(docs), [], pairs)


def template_notice(docs: DataFrame) -> DataFrame:
    """A single message row when there is nothing to report, no row otherwise."""
    any_row = docs.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return any_row.where("n = 0").select(F.lit(fv.NO_TEMPLATE_DATA).alias("message"))


def quality_overview(metrics: DataFrame) -> DataFrame:
    """The five headline label and value rows."""
    columns = ["total_documents", "documents_with_errors", "success_rate", "average_completeness", "quality_score"]
    pairs = [(label, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for label, c in zip(fv.QUALITY_LABELS, columns)]
    return label_rows(metrics, [], pairs)


def quality_errors(docs: DataFrame) -> DataFrame:
    """Error list with display names."""
    named = quality.named_errors(quality.error_list(docs))
    return named.select(
        F.col("doc_id").alias("Documento"),
        "seq",
        F.col("category_name").alias("Categoría"),
        F.col("severity_name").alias("Severidad"),
        F.col("field").alias("Campo"),
        F.col("message").alias("Mensaje"),
        F.col("suggested_action").alias("Acción Sugerida"),
        F.col("impact").alias("Impacto"),
    )


def quality_sheet(metrics: DataFrame) -> DataFrame:
    """Detection rates and severity shares as section, label and value rows."""
    severity_names = {code: name for code, name, _ in fv.ERROR_SEVERITIES}
    rates = quality.detection_rates(metrics).select(
        F.lit("detection").alias("section"), "pos", F.col("name").alias("label"), F.col("rate").alias("value")
    )
    shares = quality.severity_counts(metrics).select(
        F.lit("severity").alias("section"),
        "pos",
        quality.display_name(F.col("severity"), severity_names).alias("label"),
        F.col("percentage").alias("value"),
    )
    return rates.unionByName(shares)


def recommendation_lines(metrics: DataFrame) -> DataFrame:
    """Recommendations as printed: title, priority, description and one line per action."""
    advice = quality.recommendations(metrics)
    number = (F.col("at") + 1).cast("string")
    lines = F.concat(
        F.array(
            F.concat(number, F.lit(". "), "title"),
            F.concat(F.lit("Prioridad: "), F.upper("priority")),
            F.col("description"),
            F.lit("Acciones recomendadas:"),
        ),
        F.transform("actions", lambda a: F.concat(F.lit("• "), a)),
    )
    return advice.select((F.col("at") + 1).alias("rec_no"), F.posexplode(lines).alias("line_no", "line"))


def final_report(
    items: DataFrame,
    bl: DataFrame,
    invoices: DataFrame,
    glossary: DataFrame,
    catalog: DataFrame,
    invoice_span: int = SPAN,
    item_span: int = SPAN,
    level: str = "shipment",
) -> dict[str, DataFrame]:
    """The five relations of the customs report, all under one freight rule and for the same shipments.

    ``bl`` carries exporter_details. Shipments that are not admitted are in none of the relations.
    """
    bl = admitted(bl, invoices)
    translated = reported_items(items, bl, invoices, glossary)
    allocated, _ = shares(items, bl, invoices, level)
    return {
        "aforo": aforo(items, bl, invoices, glossary, catalog, invoice_span, item_span, level),
        "listado_deva": deva(translated),
        "traduccion": translation(translated),
        "resumen_factura": invoice_summary_rows(invoice_summary(allocated, bl, invoices)).withColumn(
            "value", F.coalesce("text", F.col("amount").cast("string"))
        ),
        "catalogo": catalog_report(catalog),
    }


def template_report(docs: DataFrame, template_id: str) -> dict[str, DataFrame]:
    """Data and summary of a template, and the notice that stands in for empty data."""
    return {
        "datos": template_data(docs, template_id),
        "resumen": template_summary(docs),
        "aviso": template_notice(docs),
    }


def quality_report(docs: DataFrame) -> dict[str, DataFrame]:
    """The four relations of the quality report."""
    metrics = quality.quality_metrics(docs)
    return {
        "resumen_ejecutivo": quality_overview(metrics),
        "errores_detallados": quality_errors(docs),
        "metricas_de_calidad": quality_sheet(metrics),
        "recomendaciones": recommendation_lines(metrics),
    }


def write_report(report: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write every relation of a report below a folder, in parallel files."""
    for name, relation in report.items():
        writer = relation.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{folder.rstrip('/')}/{name}")
