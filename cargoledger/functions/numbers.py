"""Number parsing and money arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.text import is_missing_text, strip, with_each

# ASCII decimal text; digit groups may be joined by single underscores.
_DIGITS = "[0-9]+(_[0-9]+)*"
FLOAT_TEXT = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
INT_TEXT = rf"^[+-]?{_DIGITS}$"

MONEY = "decimal(28,6)"


def parse_float(c: Column) -> Column:
    """Double value of a decimal text, null when it is not one."""
    return _value_of(strip(c), "float")


def parse_int(c: Column) -> Column:
    return _value_of(strip(c), "int")


def drop_text(c: Column, *parts: str) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(parse_float(c), F.lit(default))


def safe_numeric(c: Column) -> Column:
    """Number of a text whose commas are thousands marks; anything else is 0."""
    return F.coalesce(parse_float(drop_text(strip(c), ",")), F.lit(0.0))


def or_zero(c: Column) -> Column:
    """Null and NaN amounts count as nothing."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def _digits_and_marks(stripped: Column) -> Column:
    return F.regexp_replace(stripped, r"[^0-9.,\-]", "")


def _english_notation(cleaned: Column) -> Column:
    comma, dot = cleaned.contains(","), cleaned.contains(".")
    last_is_decimal = cleaned.rlike(",[^,]{0,2}$")
    return (
        F.when(comma & dot, F.translate(cleaned, ",.", "."))
        .when(comma & last_is_decimal, drop_text(F.regexp_replace(cleaned, ",([^,]*)$", ".$1"), ","))
        .when(comma, drop_text(cleaned, ","))
        .otherwise(cleaned)
    )


def _value_of(text: Column, kind: str) -> Column:
    if kind == "int":
        return F.when(text.rlike(INT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.when(text.rlike(FLOAT_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def parse_number(c: Column, kind: str = "float") -> Column:
    """Number of a text in either European or English notation; null when it has none.

    With both marks present the dot groups thousands and the comma is decimal.
    One comma before at most two digits is decimal too. Several commas are
    decimal only in the last place, again before at most two digits.
    """
    plain = _english_notation(_digits_and_marks(strip(c)))
    return F.when(~is_missing_text(c), _value_of(plain, kind))


def with_parsed_numbers(df: DataFrame, stripped: dict[str, tuple[str, str]]) -> DataFrame:
    """Add parsed numbers, 0 on failure: new column -> (column of stripped text, kind).

    Same result as ``parse_number_or_zero`` column by column, but each step is its own projection,
    so a text is cleaned once per row although the next step tests it several times.
    """
    df = with_each(df, {out: source for out, (source, _) in stripped.items()}, _digits_and_marks, _english_notation)
    for kind, value in {"int": lambda text: _value_of(text, "int"), "float": lambda text: _value_of(text, "float")}.items():
        cleaned = {out: out for out, (_, k) in stripped.items() if k == kind}
        df = with_each(df, cleaned, value) if cleaned else df
    return df.withColumns(
        {
            out: F.coalesce(
                F.when(~F.col(source).isin(fv.MISSING_TEXTS), F.col(out)),
                F.lit(0.0) if kind == "float" else F.lit(0).cast("bigint"),
            )
            for out, (source, kind) in stripped.items()
        }
    )


def with_loose_numbers(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add numbers of texts whose commas and dollar signs are decoration: new column -> text column."""
    return with_each(df, texts, lambda text: strip(drop_text(text, ",", "$")), lambda text: _value_of(text, "float"))


def parse_number_or_zero(c: Column, kind: str = "float") -> Column:
    return F.coalesce(parse_number(c, kind), F.lit(0.0) if kind == "float" else F.lit(0).cast("bigint"))


def check_numeric(c: Column, field: str) -> Column:
    """struct(valid, value, error) of a text that should be a number."""
    cleaned = strip(drop_text(c, "$", ",", "USD"))
    gone = c.isNull() | c.isin("", fv.NOT_DETECTED)
    return F.when(
        gone,
        F.struct(F.lit(False).alias("valid"), F.lit(fv.NOT_DETECTED).alias("value"),
                 F.lit(f"{field} no detectado").alias("error")),
    ).when(
        parse_float(cleaned).isNotNull(),
        F.struct(F.lit(True).alias("valid"), cleaned.alias("value"), F.lit(None).cast("string").alias("error")),
    ).otherwise(
        F.struct(F.lit(False).alias("valid"), c.alias("value"),
                 F.lit(f"{field} no es un valor numérico válido").alias("error")),
    )


def split_currency(c: Column) -> Column:
    """struct(currency, amount) of a text such as ``USD 1,250.50``."""
    upper = F.upper(c)
    code = F.coalesce(*[F.when(upper.contains(k), k) for k in fv.CURRENCIES], F.lit(fv.CURRENCIES[0]))
    amount = strip(drop_text(upper, "$", ",", *fv.CURRENCIES))
    amount = F.when(parse_float(amount).isNotNull(), amount).otherwise(fv.NOT_DETECTED)
    gone = c.isNull() | c.isin("", fv.NOT_DETECTED)
    return F.struct(
        F.when(gone, fv.NOT_DETECTED).otherwise(code).alias("currency"),
        F.when(gone, fv.NOT_DETECTED).otherwise(amount).alias("amount"),
    )


def money(c: Column) -> Column:
    """Exact form of an amount, so that sums do not depend on their order."""
    return or_zero(c).cast(MONEY)


def sum_money(c: Column) -> Column:
    """Order-independent total of an amount, to cents; no rows give 0."""
    return F.coalesce(F.round(F.sum(money(c)), 2).cast("double"), F.lit(0.0))


def python_fixed(c: Column, places: int) -> Column:
    """Fixed-point text; halves go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(c, places))
