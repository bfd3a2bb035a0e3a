"""Quality analysis of flat documents: error records, metrics and recommendations.

A rule is a condition with the error it stands for. The error list collects the errors of a
document into an array and explodes it, without a shuffle; the roll-ups only count conditions, in
one aggregation that yields one row, so their shuffle moves one partial row per task.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import python_fixed, with_loose_numbers
from cargoledger.functions.text import display_name
from cargoledger.operators.rules import FIELDS, NAMES, message_names, with_messages

CATEGORIES = [c[0] for c in fv.ERROR_CATEGORIES]
SEVERITIES = [s[0] for s in fv.ERROR_SEVERITIES]


KINDS = list(fv.ERROR_TEXTS)
ERROR = "struct<kind:string,detail:string,field:string>"


@dataclass
class Rule:
    """One possible error: what kind it is, when it applies, and what it says."""

    kind: str
    applies: Column
    detail: Column | None = None
    field: str | None = None

    def record(self) -> Column:
        """Compact error; its texts are filled in from the fixed table when it is listed."""
        detail = F.lit(None).cast("string") if self.detail is None else self.detail
        where = self.field or fv.ERROR_TEXTS[self.kind][3]
        return F.struct(F.lit(self.kind).alias("kind"), detail.alias("detail"), F.lit(where).alias("field"))


def _listed(fields: list[str], names: dict[str, str] | None = None) -> Column:
    """The absent ones among some fields, by (display) name, joined by commas."""
    return F.concat_ws(", ", *[F.when(F.col(f"_a_{f}"), F.lit(names[f] if names else f)) for f in fields])


def _absent_count(fields: list[str]) -> Column:
    return reduce(operator.add, [F.col(f"_a_{f}").cast("int") for f in fields])


def with_absence(docs: DataFrame) -> DataFrame:
    """Documents with ``_a_<field>``: whether a field is null, '' or the sentinel."""
    gone = {f"_a_{f}": F.coalesce(F.col(f).isin("", fv.NOT_DETECTED), F.lit(True)) for f in FIELDS}
    return docs.withColumns(gone)


def detected_count(fields: list[str]) -> Column:
    return F.lit(len(fields)) - _absent_count(fields)


def ocr_rules() -> list[Rule]:
    """Fallback processing and several critical fields missing; complaints are kept apart."""
    return [
        Rule("fallback", F.col("metodo_procesamiento") == "fallback"),
        Rule("many_critical", _absent_count(fv.CRITICAL_FIELDS) >= 2, _listed(fv.CRITICAL_FIELDS)),
    ]


def validation_rules(field_rules: list[tuple] = fv.FIELD_RULES) -> list[Rule]:
    """One rule per possible message of the field checks."""
    out = []
    for rule in field_rules:
        kind = "field_required" if rule[3] else "field_optional"
        for name in message_names(rule):
            message = F.col(name)
            out.append(Rule(kind, message.isNotNull(), F.concat(F.lit(f"{rule[1]}: "), message), rule[0]))
    return out


def structure_rules() -> list[Rule]:
    kind = F.col("tipo_documento")
    typical = ["numero_bl", "numero_contenedor", "valor_factura", "incoterm"]
    no_fob = F.col("valor_fob").isNull() | (F.col("valor_fob") == fv.NOT_DETECTED)
    return [
        Rule("no_type", kind.isNull() | kind.isin("", "PDF_SIN_TEXTO")),
        Rule("no_typical_fields", _absent_count(typical) == len(typical)),
        Rule("fob_without_value", (F.col("incoterm") == "FOB") & no_fob),
    ]


def completeness_rules() -> list[Rule]:
    watched = fv.CRITICAL_FIELDS + fv.IMPORTANT_FIELDS + fv.OPTIONAL_FIELDS
    share = detected_count(watched) / len(watched) * 100
    half = len(fv.IMPORTANT_FIELDS) / 2
    return [
        Rule("critical_missing", _absent_count(fv.CRITICAL_FIELDS) > 0, _listed(fv.CRITICAL_FIELDS, NAMES)),
        Rule("important_missing", _absent_count(fv.IMPORTANT_FIELDS) > half, _listed(fv.IMPORTANT_FIELDS, NAMES)),
        Rule("low_completeness", share < 50, python_fixed(share, 1)),
    ]


def calculation_rules() -> list[Rule]:
    """Implausible FOB to CIF conversions, and numeric fields that are negative or not numbers."""
    tried = F.col("conversion_fob_cif")
    fob, cif = F.col("_x_valor_fob"), F.col("_x_valor_cif")
    ratio = F.when(fob > 0, cif / fob).otherwise(F.lit(0.0))
    out = [
        Rule("cif_not_above_fob", tried & (cif <= fob)),
        Rule("ratio_high", tried & cif.isNotNull() & (ratio > 1.5), python_fixed(ratio, 2)),
        Rule("conversion_not_numeric", tried & (fob.isNull() | cif.isNull())),
    ]
    for field in fv.NUMERIC_FIELDS:
        given, number, name = ~F.col(f"_a_{field}"), F.col(f"_x_{field}"), F.lit(NAMES[field])
        out.append(Rule("negative", given & (number < 0), name, field))
        out.append(Rule("not_numeric", given & number.isNull(), name, field))
    return out


ANALYZERS = {
    "ocr_quality": ocr_rules,
    "field_validation": validation_rules,
    "document_structure": structure_rules,
    "data_completeness": completeness_rules,
    "calculation_errors": calculation_rules,
}


def _rules(analyzer: str, field_rules: list[tuple]) -> list[Rule]:
    return validation_rules(field_rules) if analyzer == "field_validation" else ANALYZERS[analyzer]()


def _with_inputs(docs: DataFrame, analyzers: list[str], field_rules: list[tuple]) -> DataFrame:
    """Documents with the working columns that the rules of some analyzers read."""
    read = with_absence(docs)
    if "field_validation" in analyzers:
        read = with_messages(read, field_rules)
    if "calculation_errors" in analyzers:
        read = with_loose_numbers(read, {f"_x_{f}": f for f in fv.NUMERIC_FIELDS})
    if "ocr_quality" in analyzers:
        words = "|".join(fv.OCR_KEYWORDS)
        complaints = F.filter("errores", lambda m: F.lower(m).rlike(words))
        read = read.withColumn("_complaints", F.when(F.size("errores") > 0, complaints))
    return read


def with_errors(
    docs: DataFrame, analyzers: list[str] | None = None, field_rules: list[tuple] = fv.FIELD_RULES
) -> DataFrame:
    """Documents with the array of all their error records, in rule order; field checks follow ``field_rules``."""
    wanted = list(analyzers or ANALYZERS)
    none = F.array().cast(f"array<{ERROR}>")
    read = _with_inputs(docs, wanted, field_rules)
    rules = [rule for a in wanted for rule in _rules(a, field_rules)]
    parts = [F.when(r.applies, F.array(r.record())).otherwise(none) for r in rules]
    if "ocr_quality" in wanted:
        said = F.transform("_complaints", lambda m: Rule("ocr_text", F.lit(True), m).record())
        read = read.withColumn("_said", F.coalesce(said, none))
        at = next(i for i, r in enumerate(rules) if r.kind == "fallback") + 1
        parts.insert(at, F.col("_said"))
    return read.select(*docs.columns, F.concat(*parts).alias("errors"))


def with_error_counts(docs: DataFrame, field_rules: list[tuple] = fv.FIELD_RULES) -> DataFrame:
    """Documents with the number of their errors of every kind, without building the errors."""
    read = _with_inputs(docs, list(ANALYZERS), field_rules)
    rules = [rule for analyzer in ANALYZERS for rule in _rules(analyzer, field_rules)]
    flags = {f"_r_{i}": rule.applies for i, rule in enumerate(rules)}
    counts = {}
    for kind in KINDS:
        own = [f"int(coalesce(_r_{i}, false))" for i, rule in enumerate(rules) if rule.kind == kind]
        counts[f"kind_{kind}"] = F.expr("coalesce(size(_complaints), 0)" if kind == "ocr_text" else " + ".join(own or ["0"]))
    kept = [*docs.columns, *[f"_a_{f}" for f in FIELDS]]
    return read.withColumns(flags).select(*kept, *[c.alias(name) for name, c in counts.items()])


def error_texts(spark: SparkSession) -> DataFrame:
    """The fixed texts of every error kind."""
    rows = [(kind, *(t.replace("%%", "%") if t else t for t in texts)) for kind, texts in fv.ERROR_TEXTS.items()]
    return spark.createDataFrame(
        rows,
        "kind string, category string, severity string, pattern string, default_field string, "
        "suggested_action string, impact string",
    )


def error_list(
    docs: DataFrame, analyzers: list[str] | None = None, field_rules: list[tuple] = fv.FIELD_RULES
) -> DataFrame:
    """Long form: one row per document and error, numbered from 1 inside the document.

    The outer generator is deliberate: for an inner one Spark derives a filter on the array's size
    and evaluates every rule a second time to test it.
    """
    listed = (
        with_errors(docs, analyzers, field_rules)
        .select("doc_id", F.posexplode_outer("errors").alias("at", "e"))
        .where(F.col("at").isNotNull())
        .select("doc_id", (F.col("at") + 1).alias("seq"), "e.*")
    )
    return listed.join(F.broadcast(error_texts(docs.sparkSession)), "kind").select(
        "doc_id",
        "seq",
        "category",
        "severity",
        F.replace("pattern", F.lit("%s"), F.coalesce("detail", F.lit(""))).alias("message"),
        "field",
        "suggested_action",
        "impact",
    )


def _total(part: int, code: str) -> Column:
    """Errors of one category (part 0) or severity (part 1)."""
    return F.expr(" + ".join(f"kind_{k}" for k in KINDS if fv.ERROR_TEXTS[k][part] == code))


def quality_metrics(docs: DataFrame, field_rules: list[tuple] = fv.FIELD_RULES) -> DataFrame:
    """All document-level metrics in one row and one pass.

    Counts per category and severity keep their zeros. Rates are null when there is no document.
    """
    seen = with_error_counts(docs, field_rules)
    n_errors = F.expr(" + ".join(f"kind_{k}" for k in KINDS))
    counted = seen.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(n_errors > 0).alias("documents_with_errors"),
        F.coalesce(F.sum(n_errors), F.lit(0)).alias("total_errors"),
        *[F.expr(f"coalesce(sum(kind_{k}), 0)").alias(f"kind_{k}") for k in KINDS],
        *[F.expr(f"count_if(NOT _a_{f})").alias(f"detected_{f}") for f in FIELDS],
    )
    counted = counted.withColumns(
        {f"category_{c}": _total(0, c) for c in CATEGORIES} | {f"severity_{s}": _total(1, s) for s in SEVERITIES}
    )
    docs_n = F.nullif(F.col("total_documents"), F.lit(0))
    detected = F.expr(" + ".join(f"detected_{f}" for f in FIELDS))
    error_rate = F.col("documents_with_errors") / docs_n * 100
    success = F.lit(100.0) - error_rate
    completeness = detected * 100.0 / (docs_n * len(FIELDS))
    errors_n = F.nullif(F.col("total_errors"), F.lit(0))
    return counted.select(
        "*",
        F.round(error_rate, 2).alias("error_rate"),
        F.round(success, 2).alias("success_rate"),
        F.round(completeness, 2).alias("average_completeness"),
        F.round((success + completeness) / 2, 2).alias("quality_score"),
        *[F.expr(f"round(detected_{f} / nullif(total_documents, 0) * 100, 1)").alias(f"rate_{f}") for f in FIELDS],
        *[
            F.coalesce(F.round(F.col(f"severity_{s}") / errors_n * 100, 1), F.lit(0.0)).alias(f"share_{s}")
            for s in SEVERITIES
        ],
    )


def _unpivot(metrics: DataFrame, codes: list[str], columns: dict[str, str], code_name: str) -> DataFrame:
    """One row per code from the one-row metrics."""
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(code).alias(code_name),
                 *[F.col(prefix + code).alias(name) for prefix, name in columns.items()])
        for i, code in enumerate(codes)
    ]
    return metrics.select(F.inline(F.array(*rows)))


def category_counts(metrics: DataFrame) -> DataFrame:
    return _unpivot(metrics, CATEGORIES, {"category_": "n"}, "category")


def severity_counts(metrics: DataFrame) -> DataFrame:
    """Error count and percentage per severity."""
    return _unpivot(metrics, SEVERITIES, {"severity_": "n", "share_": "percentage"}, "severity")


def detection_rates(metrics: DataFrame) -> DataFrame:
    """Detection rate per field with its three-level label."""
    rates = _unpivot(metrics.where("total_documents > 0"), FIELDS, {"rate_": "rate"}, "field")
    (top, top_label), (mid, mid_label) = fv.DETECTION_LABELS
    label = F.when(F.col("rate") >= top, top_label).when(F.col("rate") >= mid, mid_label)
    return rates.withColumn("name", display_name(F.col("field"), NAMES)).withColumn(
        "label", label.otherwise(fv.DETECTION_LABEL_ELSE)
    )


def overview(metrics: DataFrame) -> DataFrame:
    """Headline figures; rates read 0 when there is no document."""
    return metrics.select(
        F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
        "total_errors",
        "documents_with_errors",
        F.coalesce("average_completeness", F.lit(0.0)).alias("average_completeness"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
    )


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice that the metrics call for, most urgent first, equal urgency in rule order."""
    completeness = F.coalesce("average_completeness", F.lit(0.0))
    low_fields = F.array_compact(F.array(*[F.when(F.col(f"rate_{f}") < 50, F.lit(NAMES[f])) for f in FIELDS]))
    fires = {
        "error_rate": (F.col("error_rate") > 50, []),
        "ocr": (F.col("category_ocr_quality") > 0, [F.col("category_ocr_quality").cast("string")]),
        "completeness": (completeness < 70, [python_fixed(completeness, 1)]),
        "low_fields": (F.size(low_fields) > 0, [F.array_join(low_fields, ", ")]),
    }
    advice = []
    for rule, (condition, parts) in fires.items():
        priority, category, title, description, actions = fv.RECOMMENDATIONS[rule]
        advice.append(
            F.when(
                condition,
                F.struct(
                    F.lit(priority).alias("priority"),
                    F.lit(category).alias("category"),
                    F.lit(title).alias("title"),
                    F.format_string(description, *parts).alias("description"),
                    F.array(*[F.lit(a) for a in actions]).alias("actions"),
                ),
            )
        )
    listed = metrics.select(F.posexplode(F.array_compact(F.array(*advice))).alias("at", "r")).select("at", "r.*")
    return by_priority(listed, "at")


def by_priority(rows: DataFrame, *then: str) -> DataFrame:
    """Order by urgency; unknown priorities come last."""
    rank = F.array_position(F.array(*[F.lit(p) for p in fv.PRIORITY_ORDER]), F.col("priority"))
    return rows.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(len(fv.PRIORITY_ORDER))).orderBy("rank", *then)


def processing_statistics(docs: DataFrame) -> DataFrame:
    """Document counts by method, type, INCOTERM and currency in one aggregation."""

    def entry(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"))

    def known(c: Column) -> Column:
        return F.when(c != fv.NOT_DETECTED, c)

    entries = F.array(
        entry("processing_methods", F.coalesce("metodo_procesamiento", F.lit("unknown"))),
        entry("document_types", F.coalesce("tipo_documento", F.lit("unknown"))),
        entry("incoterms", known(F.col("incoterm"))),
        entry("currencies", known(F.col("moneda"))),
    )
    counted = (
        docs.select(F.inline(entries)).where(F.col("value").isNotNull()).groupBy("metric", "value").agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    name = (
        F.when(F.col("metric") == "processing_methods", display_name(F.col("value"), fv.METHOD_NAMES))
        .when(F.col("metric") == "document_types", display_name(F.col("value"), fv.DOCUMENT_TYPE_NAMES))
        .otherwise(F.col("value"))
    )
    return counted.withColumn("name", name)


def errors_by_document(docs: DataFrame) -> DataFrame:
    """Documents that have errors, with their number; no shuffle, as a document's errors sit in its row.

    Zero counts are dropped behind an outer generator, where the condition cannot be pushed down
    into a second evaluation of all rules.
    """
    n_errors = F.expr(" + ".join(f"kind_{k}" for k in KINDS))
    counted = with_error_counts(docs).select("doc_id", n_errors.alias("n"))
    some = F.when(F.col("n") > 0, F.array("n"))
    return counted.select("doc_id", F.explode_outer(some).alias("n_errors")).where(F.col("n_errors").isNotNull())


def dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Category and severity lookup tables, five and four rows."""
    return (
        spark.createDataFrame(fv.ERROR_CATEGORIES, "category string, category_name string, description string"),
        spark.createDataFrame(fv.ERROR_SEVERITIES, "severity string, severity_name string, weight int"),
    )


def named_errors(errors: DataFrame) -> DataFrame:
    """Error rows with the display names of category and severity; both tables are fixed."""
    categories, severities = dimensions(errors.sparkSession)
    return errors.join(F.broadcast(categories.drop("description")), "category").join(
        F.broadcast(severities.drop("weight")), "severity"
    )
