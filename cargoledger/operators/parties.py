"""Merging what the BL and the invoices say about exporter and consignee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import or_zero
from cargoledger.functions.text import blank_to_null, safe_str, strip
from cargoledger.operators.allocation import admitted, complete_fob_cif, has_error
from cargoledger.operators.distribution import SLICE_ROWS, SPAN, balanced_join, nest_rows


def merge_party(bl: Column, invoice: Column) -> Column:
    """One party from two statements: invoice name and phone first, the longer address."""

    def first_known(field: str) -> Column:
        return F.coalesce(
            blank_to_null(invoice[field]), blank_to_null(bl[field]), F.lit(fv.NOT_DETECTED)
        ).alias(field)

    bl_address, inv_address = strip(safe_str(bl["address"])), strip(safe_str(invoice["address"]))
    address = F.when(F.length(inv_address) > F.length(bl_address), inv_address).otherwise(bl_address)
    return F.struct(
        first_known("name"),
        F.coalesce(blank_to_null(address), F.lit(fv.NOT_DETECTED)).alias("address"),
        first_known("phone"),
    )


def first_invoices(invoices: DataFrame) -> DataFrame:
    """The first invoice of every shipment."""
    rest = [c for c in invoices.columns if c not in ("shipment_id", "invoice_idx")]
    first = F.min_by(F.struct("invoice_idx", *rest), "invoice_idx").alias("_first")
    return invoices.groupBy("shipment_id").agg(first).select("shipment_id", "_first.*")


def invoice_parties(bl: DataFrame, invoices: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Invoices with exporter_details merged from both papers and consignee_details from the BL.

    Failed invoices carry no party details.
    """
    header = admitted(bl).select(
        "shipment_id", F.col("exporter").alias("_exporter"), F.col("consignee").alias("_consignee")
    )
    joined = balanced_join(
        invoices, header, ["shipment_id"], ["invoice_idx"], how="inner", slice_rows=slice_rows
    )
    fine = ~has_error(F.col("error"))
    return (
        joined.withColumn(
            "exporter_details", F.when(fine, merge_party(F.col("_exporter"), F.col("exporter")))
        )
        .withColumn("consignee_details", F.when(fine, F.col("_consignee")))
        .drop("_exporter", "_consignee")
    )


def bl_parties(bl: DataFrame, invoices: DataFrame) -> DataFrame:
    """Admitted BLs with exporter_details merged with the first invoice and consignee_details.

    Both stay empty where a shipment has no invoice or any of its later invoices failed.
    """
    failed = has_error(F.col("error"))
    read = invoices.groupBy("shipment_id").agg(
        F.min_by("exporter", "invoice_idx").alias("_exporter"),
        F.max(failed).alias("_failed"),
        F.min_by(failed, "invoice_idx").alias("_stops"),
    )
    usable = ~F.coalesce(F.col("_failed"), F.lit(True))
    return (
        admitted(bl)
        .join(read, "shipment_id", "left")
        .where(~F.coalesce("_stops", F.lit(False)))
        .withColumn("exporter_details", F.when(usable, merge_party(F.col("exporter"), F.col("_exporter"))))
        .withColumn("consignee_details", F.when(usable, F.col("consignee")))
        .drop("_exporter", "_failed", "_stops")
    )


def consolidated_documents(bl: DataFrame, invoices: DataFrame) -> DataFrame:
    """One flat record per shipment from the BL and its first invoice; none without invoices.

    ``bl`` carries exporter_details and consignee_details.
    """
    first = first_invoices(invoices.select("shipment_id", "invoice_idx", "incoterm", "total_value", "currency"))
    fob, cif = complete_fob_cif(F.col("incoterm"), F.col("total_value"), F.col("freight_cost"))
    return bl.join(first, "shipment_id").select(
        "shipment_id",
        F.col("bl_number").alias("numero_bl"),
        F.col("freight_cost").alias("valor_flete"),
        F.col("packages_count").alias("bultos"),
        F.col("gross_weight").alias("kilos"),
        F.col("container_no").alias("numero_contenedor"),
        F.col("exporter_details.name").alias("exportador"),
        F.col("consignee_details.name").alias("consignatario"),
        F.coalesce("bl_number", F.lit("Documento Consolidado")).alias("archivo"),
        F.lit("BL_FACTURA").alias("tipo_documento"),
        "incoterm",
        F.col("total_value").alias("valor_factura"),
        F.col("currency").alias("moneda"),
        fob.alias("valor_fob"),
        cif.alias("valor_cif"),
    )


def editable_bl(bl: DataFrame) -> DataFrame:
    """The typed form fields of a BL, with blanks and zeros for what is missing."""
    texts = {
        "bl_num": "bl_number",
        "booking_num": "booking_number",
        "pol": "port_of_loading",
        "pod": "port_of_discharge",
        "cargo_type": "cargo_type",
        "container_no": "container_no",
        "exporter_name": "exporter_details.name",
        "exporter_address": "exporter_details.address",
        "consignee_name": "consignee_details.name",
        "consignee_address": "consignee_details.address",
    }
    return bl.select(
        "shipment_id",
        *[safe_str(F.col(source)).alias(name) for name, source in texts.items()],
        or_zero(F.col("freight_cost")).alias("freight_cost"),
        or_zero(F.col("packages_count")).cast("bigint").alias("packages_count"),
        or_zero(F.col("gross_weight")).alias("gross_weight"),
    )


def editable_invoices(invoices: DataFrame) -> DataFrame:
    """The typed form fields of an invoice."""
    return invoices.select(
        "shipment_id",
        "invoice_idx",
        F.upper(safe_str(F.col("incoterm"), "NOT_FOUND")).alias("incoterm"),
        safe_str(F.col("invoice_number")).alias("inv_num"),
        safe_str(F.col("invoice_date")).alias("inv_date"),
        safe_str(F.col("currency")).alias("inv_curr"),
        or_zero(F.col("total_value")).alias("total_val"),
    )


# Fields that the form of a BL and of an invoice overwrites; parties lose their phone there.
BL_FORM = [
    "bl_number", "booking_number", "container_no", "freight_cost", "port_of_loading", "port_of_discharge", "cargo_type",
    "packages_count", "gross_weight", "exporter_details", "consignee_details",
]
INVOICE_FORM = ["incoterm", "invoice_number", "invoice_date", "currency", "total_value"]


def overlay_form(rows: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with the form fields of those that have an edit; a saved form replaces all of its fields."""
    form = edits.select(*keys, F.struct(*fields).alias("_form"))
    saved = F.col("_form").isNotNull()
    return (
        rows.join(form, keys, "left")
        .withColumns({f: F.when(saved, F.col("_form")[f]).otherwise(F.col(f)) for f in fields})
        .drop("_form")
    )


def replace_items(items: DataFrame, edited: DataFrame) -> DataFrame:
    """Items with those of edited invoices replaced as a whole; ``edited`` has the same columns."""
    key = ["shipment_id", "invoice_idx"]
    return items.join(edited.select(*key).distinct(), key, "left_anti").unionByName(edited)


def assemble_shipments(
    bl: DataFrame,
    invoices: DataFrame,
    items: DataFrame,
    invoice_span: int = SPAN,
    item_span: int = SPAN,
    gated: bool = False,
) -> DataFrame:
    """Nested shipments: ``bl_data`` and ``all_invoices_data``, each invoice with its items, in order.

    Only admitted shipments are assembled; ``gated`` says that ``bl`` holds no others. A shipment whose invoices do not fit one span continues in further parts (part_no), and an
    invoice whose items do not fit repeats with the next items_part. Without invoices part_no is null.
    """
    key = ["shipment_id", "invoice_idx"]
    bl = bl if gated else admitted(bl, invoices)
    # Rows are dealt by the key that their nested form is joined by, which spares that one a shuffle.
    items = items.repartition(*key)
    held = nest_rows(items, key, "item_idx", [c for c in items.columns if c not in key], "items", item_span)
    full = invoices.join(held.withColumnRenamed("part_no", "items_part"), key, "left").repartition("shipment_id")
    fields = [c for c in full.columns if c not in (*key, "items_part")]
    nested = nest_rows(full, ["shipment_id"], "invoice_idx", ["items_part", *fields], "all_invoices_data", invoice_span)
    bl_data = F.struct(*[c for c in bl.columns if c != "shipment_id"]).alias("bl_data")
    return bl.select("shipment_id", bl_data).join(nested, "shipment_id", "left")
