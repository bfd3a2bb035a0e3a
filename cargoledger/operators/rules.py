"""Rule-based validation of flat documents, automatic fixes and edit overlays.

A document row has ``doc_id`` and the twelve string fields of ``fixed_values.FIELD_RULES``.
Rules are data; they compile to Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import with_parsed_numbers
from cargoledger.functions.text import strip, with_each

FIELDS = [rule[0] for rule in fv.FIELD_RULES]
NAMES = {rule[0]: rule[1] for rule in fv.FIELD_RULES}


def _text(field: str) -> Column:
    return F.col(f"_t_{field}")


def _number(field: str) -> Column:
    return F.col(f"_n_{field}")


def _given(field: str) -> Column:
    return F.col(f"_g_{field}")


def with_field_values(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """Working columns of a check, per field: stripped text, whether it is given, and its number."""
    docs = with_each(docs, {f"_t_{rule[0]}": rule[0] for rule in rules}, strip)
    docs = docs.withColumns(
        {f"_g_{rule[0]}": F.coalesce(~_text(rule[0]).isin(fv.MISSING_TEXTS), F.lit(False)) for rule in rules}
    )
    kinds = {"integer": "int", "decimal": "float", "currency": "float"}
    numeric = {f"_n_{r[0]}": (f"_t_{r[0]}", kinds[r[2]]) for r in rules if r[2] in kinds}
    return with_parsed_numbers(docs, numeric) if numeric else docs


def _broken_limits(rule: tuple) -> list[Column]:
    """One message or null per limit of a rule, for a value that is present."""
    field, _, _, _, limits, description = rule
    text = _text(field)
    broken: list[Column] = []
    if "min_length" in limits:
        broken.append(F.when(F.length(text) < limits["min_length"], fv.MIN_LENGTH_MESSAGE % limits["min_length"]))
    if "pattern" in limits:
        broken.append(F.when(~text.rlike(limits["pattern"]), fv.PATTERN_MESSAGE % description))
    if "min_value" in limits:
        broken.append(F.when(_number(field) < limits["min_value"], fv.MIN_VALUE_MESSAGE % limits["min_value"]))
    if "options" in limits:
        broken.append(F.when(~text.isin(limits["options"]), fv.OPTION_MESSAGE % ", ".join(limits["options"])))
    return broken or [F.lit(None).cast("string")]


def message_names(rule: tuple) -> list[str]:
    """Working columns that hold a rule's messages, one per limit and null where it is kept."""
    return [f"_m_{rule[0]}_{i}" for i in range(max(1, len(rule[4])))]


def with_messages(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """Documents with the working columns of ``with_field_values`` and ``message_names``.

    Messages stay plain columns: conditions on them compile, where a filter over an array would
    be interpreted for every document.
    """
    messages = {}
    for rule in rules:
        wanted = F.lit(fv.REQUIRED_MESSAGE % rule[1]) if rule[3] else F.lit(None).cast("string")
        first, *rest = _broken_limits(rule)
        given = _given(rule[0])
        found = [F.when(given, first).otherwise(wanted), *[F.when(given, c) for c in rest]]
        messages |= dict(zip(message_names(rule), found))
    return with_field_values(docs, rules).withColumns(messages)


def present_only(values: list[Column], kind: str) -> Column:
    """Array of the values that are not null."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(none, *[F.when(v.isNotNull(), F.array(v)).otherwise(none) for v in values])


def is_valid(rule: tuple) -> Column:
    return F.expr(" AND ".join(f"{name} IS NULL" for name in message_names(rule)))


def _value(rule: tuple) -> Column:
    field, kind = rule[0], rule[2]
    if kind in ("currency", "decimal", "integer"):
        return _number(field).cast("string")
    return _text(field) if kind == "text" else F.col(field)


def check_field(rule: tuple) -> Column:
    """struct(field, name, required, valid, detected, value, messages) from the working columns."""
    field, name, _, required, _, _ = rule
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(name).alias("name"),
        F.lit(required).alias("required"),
        is_valid(rule).alias("valid"),
        _given(field).alias("detected"),
        F.when(_given(field), _value(rule)).otherwise(fv.NOT_DETECTED).alias("value"),
        present_only([F.col(m) for m in message_names(rule)], "string").alias("messages"),
    )


def check_document(docs: DataFrame, rules: list[tuple] | None = None, name: str = "checks") -> DataFrame:
    """Documents with an array of one result struct per rule."""
    rules = rules or fv.FIELD_RULES
    return with_messages(docs, rules).select(*docs.columns, F.array(*[check_field(r) for r in rules]).alias(name))


def field_results(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Long form: one row per document and field."""
    return check_document(docs, rules).select("doc_id", F.posexplode_outer("checks").alias("rule_no", "c")).select(
        "doc_id", "rule_no", "c.*"
    )


def named_messages(rules: list[tuple]) -> list[Column]:
    """Every possible message as ``name: message``, null where it does not apply, in rule order."""
    return [F.concat(F.lit(f"{r[1]}: "), F.col(m)) for r in rules for m in message_names(r)]


def document_summary(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Per document: field counts, completion rate and messages."""
    rules = rules or fv.FIELD_RULES
    total = F.lit(len(rules))
    valid = F.col("valid_fields")
    counted = with_messages(docs, rules).select(
        "doc_id",
        sum((is_valid(r).cast("int") for r in rules), F.lit(0)).alias("valid_fields"),
        present_only(named_messages(rules), "string").alias("error_messages"),
    )
    return counted.select(
        "doc_id",
        (total == valid).alias("valid"),
        total.alias("total_fields"),
        "valid_fields",
        (total - valid).alias("invalid_fields"),
        (valid / total * 100).alias("completion_rate"),
        "error_messages",
    )


def validation_report(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """One row per field: documents seen, valid values, detected values; plus the document rate.

    All counts come from one aggregation into a single row, which is then turned into rows.
    """
    rules = rules or fv.FIELD_RULES
    all_valid = F.lit(True)
    for rule in rules:
        all_valid = all_valid & is_valid(rule)
    counts = with_messages(docs, rules).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(all_valid).alias("valid_documents"),
        *[F.count_if(is_valid(r)).alias(f"valid_{r[0]}") for r in rules],
        *[F.count_if(_given(r[0])).alias(f"detected_{r[0]}") for r in rules],
    )
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r[0]).alias("field"),
            F.col(f"valid_{r[0]}").alias("valid"),
            F.col(f"detected_{r[0]}").alias("detected"),
        )
        for i, r in enumerate(rules)
    ]
    rate = F.coalesce(F.col("valid_documents") / F.nullif(F.col("total"), F.lit(0)) * 100, F.lit(0.0))
    return counts.select("total", "valid_documents", F.inline(F.array(*rows))).withColumn("document_validity_rate", rate)


def common_errors(docs: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Frequency of every message, most frequent first, then by first appearance."""
    rules = rules or fv.FIELD_RULES
    messages = present_only(named_messages(rules), "string")
    said = with_messages(docs, rules).select("doc_id", F.posexplode_outer(messages).alias("at", "message"))
    counted = said.where(F.col("message").isNotNull()).groupBy("message").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.min_by("at", "doc_id").alias("first_at")
    )
    return counted.orderBy(F.desc("n"), "first_doc", "first_at")


def _present(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", fv.NOT_DETECTED)


def recalculate_cif(docs: DataFrame, only: Column | None = None) -> DataFrame:
    """Under FOB terms, replace valor_cif by the marked-up FOB value and flag the conversion.

    valor_cif_num holds the recalculated number. ``only`` restricts the documents touched.
    """
    read = docs.withColumn("_t_valor_fob", strip(F.col("valor_fob")))
    read = with_parsed_numbers(read, {"_n_valor_fob": ("_t_valor_fob", "float")})
    fob = _number("valor_fob")
    converts = (F.col("incoterm") == "FOB") & _present(F.col("valor_fob")) & (fob > 0)
    if only is not None:
        converts = converts & only
    flag = F.col("conversion_fob_cif") if "conversion_fob_cif" in docs.columns else F.lit(False)
    text = F.bround(F.col("valor_cif_num").cast("decimal(28,6)"), 2).cast("string")
    return (
        read.withColumn("valor_cif_num", F.when(converts, fob * fv.CIF_MARKUP))
        .withColumn("valor_cif", F.when(F.col("valor_cif_num").isNotNull(), text).otherwise(F.col("valor_cif")))
        .withColumn("conversion_fob_cif", F.col("valor_cif_num").isNotNull() | F.coalesce(flag, F.lit(False)))
        .drop("_t_valor_fob", "_n_valor_fob")
    )


def auto_fix(docs: DataFrame) -> DataFrame:
    """Standardise BL number, container, INCOTERM and money texts, then recalculate CIF."""
    bl, box, term = F.col("numero_bl"), F.col("numero_contenedor"), F.col("incoterm")
    tidy_box = F.regexp_replace(F.upper(box), "[^A-Z0-9]", "")
    tidy_term = strip(F.upper(term))
    fixed = {
        "numero_bl": F.when(_present(bl), strip(F.upper(bl))).otherwise(bl),
        "numero_contenedor": F.when(_present(box) & (F.length(tidy_box) == 11), tidy_box).otherwise(box),
        "incoterm": F.when(_present(term) & tidy_term.isin(fv.INCOTERMS), tidy_term).otherwise(term),
    }
    for field in fv.MONEY_FIELDS:
        raw, number = F.col(field), _number(field)
        fixed[field] = F.when(_present(raw) & (number > 0), number.cast("string")).otherwise(raw)
    money = [rule for rule in fv.FIELD_RULES if rule[0] in fv.MONEY_FIELDS]
    out = with_field_values(docs, money).withColumns(fixed).select(*docs.columns)
    return recalculate_cif(out)


def overlay_edits(docs: DataFrame, edits: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Edited values over originals: ``edits`` has one row per edited document.

    Every field of an edited document is taken from its edit, as a saved form replaces all of its
    fields, and its CIF is recalculated. Documents without an edit are unchanged.
    """
    fields = fields or FIELDS
    form = edits.select("doc_id", F.struct(*fields).alias("_edit"))
    edited = F.col("_edit").isNotNull()
    out = docs.join(form, "doc_id", "left").withColumns(
        {f: F.when(edited, F.col("_edit")[f]).otherwise(F.col(f)) for f in fields}
    )
    return recalculate_cif(out.withColumn("edited", edited).drop("_edit"), only=F.col("edited"))
