"""Text clean-up as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv

# All Unicode white space: as a character class that Java and RE2 read alike, and as plain text.
SPACE = r"\s\x0B\x1c-\x1f\x85\p{Z}"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def with_each(df: DataFrame, columns: dict[str, str], *steps: Callable[[Column], Column]) -> DataFrame:
    """Add the outcome of the same steps on many text columns: new column -> text column.

    The steps are stated once, over an array of the texts. Stated once per column, they make generated
    methods of more than 8,000 bytes of bytecode, which the JVM interprets for every row.
    """
    each = F.array(*[F.col(source).cast("string") for source in columns.values()])
    for step in steps:
        each = F.transform(each, step)
    return df.withColumn("_each", each).withColumns({out: F.col("_each")[i] for i, out in enumerate(columns)}).drop("_each")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column, strict_accents: bool = True) -> Column:
    """Lower case, no accents, no blanks or punctuation; null gives ''.

    ``strict_accents`` keeps the historical mapping of é to a.
    """
    plain = "aaiouun" if strict_accents else "aeiouun"
    bare = F.translate(F.lower(c), "áéíóúüñ", plain)
    return F.coalesce(F.regexp_replace(bare, rf"[{SPACE}\-_.,()/#]", ""), F.lit(""))


def description_key(c: Column) -> Column:
    """Lookup key of a product description: lower case, single blanks; null gives ''."""
    return F.coalesce(collapse_spaces(F.lower(c)), F.lit(""))


def safe_str(c: Column, default: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def clean_extracted(c: Column) -> Column:
    """Collapse white space; nothing left, or a missing marker, gives the sentinel."""
    collapsed = collapse_spaces(c)
    gone = c.isNull() | c.isin(fv.MISSING_TEXTS) | (collapsed == "")
    return F.when(gone, fv.NOT_DETECTED).otherwise(collapsed)


def is_missing_stripped(c: Column) -> Column:
    """True when a stripped text carries no value at all."""
    return c.isNull() | c.isin(fv.MISSING_TEXTS)


def is_missing_text(c: Column) -> Column:
    return is_missing_stripped(strip(c))


def clean_translation(c: Column) -> Column:
    return F.regexp_replace(strip(c), r'[*"]', "")


def skips_translation(c: Column) -> Column:
    return c.isNull() | (c == "") | F.lower(c).isin(fv.UNTRANSLATED_TEXTS)


def choose_description(original: Column, translated: Column) -> Column:
    """The translation, unless it is empty or reports a failure."""
    usable = (translated != "") & ~translated.startswith(fv.TRANSLATION_ERROR_PREFIX)
    return F.when(usable, translated).otherwise(original)


def display_name(c: Column, names: dict[str, str]) -> Column:
    """Look a code up in a fixed dictionary; unknown codes pass through."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def long_date(c: Column) -> Column:
    """``03 de January de 2024``."""
    month = F.element_at(F.array(*[F.lit(m) for m in fv.MONTH_NAMES]), F.month(c))
    return F.concat(F.date_format(c, "dd"), F.lit(" de "), month, F.lit(" de "), F.date_format(c, "yyyy"))
