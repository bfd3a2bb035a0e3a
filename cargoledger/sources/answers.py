"""Model answers to typed records.

An answer is one text that should hold a JSON object, fenced or bare.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import parse_float
from cargoledger.schemas import BL, INVOICE

CORRUPT = "_corrupt_record"
SHOWN_CHARS = 500
# Where the first backtick of a text opens its fence and the object holds none, this finds what
# FENCED_JSON_PATTERN finds, but runs over the object at once instead of trying to end it at each character.
PLAIN_FENCE_PATTERN = r"\A[^`]*+```json\s*(\{[^`]*\})\s*```"
# Whole numbers of this many digits may be beyond a double.
BEYOND_DOUBLE_DIGITS = 309


def with_json_part(answers: DataFrame, text: str, name: str) -> DataFrame:
    """Answers with the JSON text inside them: a fenced object first, else from the first brace to the
    next closing one, else null. Each pattern runs once, and only where those before it failed.
    """
    plain, fenced, bare = F.col("_plain"), F.col("_fenced"), F.col("_bare")
    return (
        answers.withColumn("_plain", F.regexp_extract(text, PLAIN_FENCE_PATTERN, 1))
        .withColumn("_fenced", F.when(plain != "", plain).otherwise(F.regexp_extract(text, fv.FENCED_JSON_PATTERN, 1)))
        .withColumn("_bare", F.when(fenced == "", F.regexp_extract(text, fv.BARE_JSON_PATTERN, 1)))
        .withColumn(name, F.when(fenced != "", fenced).when(bare != "", bare))
        .drop("_plain", "_fenced", "_bare")
    )


def _with_leaves(kind: T.DataType, number: T.DataType) -> T.DataType:
    """The same shape with ``number`` for numbers and text for all other leaves."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _with_leaves(f.dataType, number)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_with_leaves(kind.elementType, number))
    return number if isinstance(kind, (T.DoubleType, T.LongType)) else T.StringType()


def _finite(c: Column) -> Column:
    """Numbers whose exponent takes them beyond a double are none, as with text leaves."""
    return F.when(F.abs(c) < math.inf, c)


def _typed(c: Column, kind: T.DataType, number: Callable[[Column], Column]) -> Column:
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_typed(c[f.name], f.dataType, number).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda element: _typed(element, kind.elementType, number))
    if isinstance(kind, T.DoubleType):
        return number(c)
    if isinstance(kind, T.LongType):
        return number(c).try_cast("bigint")
    return c


def _read(answers: DataFrame, schema: T.StructType, text: str) -> DataFrame:
    """Answers with ``_sent`` or ``_read``, and ``error``.

    ``_sent`` is the record as JSON types it. Only where that fails or could lose a long number, ``_read`` is the
    record with text leaves, so that a number sent as text does not spoil its record; read so, each number is
    written and parsed once more.
    """

    def record(number: T.DataType, **more: str) -> Column:
        guarded = T.StructType([*_with_leaves(schema, number).fields, T.StructField(CORRUPT, T.StringType())])
        return F.from_json("_json", guarded, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **more})

    said = F.coalesce(text, F.lit(""))
    no_json = F.format_string(fv.NO_JSON_ERROR, F.substring(said, 1, SHOWN_CHARS))
    long_number = (F.octet_length("_json") >= BEYOND_DOUBLE_DIGITS) & F.col("_json").rlike(f"[0-9]{{{BEYOND_DOUBLE_DIGITS}}}")
    not_sent = F.col(f"_sent.{CORRUPT}").isNotNull() | long_number
    broken = F.col(f"_read.{CORRUPT}").isNotNull()
    error = F.when(F.col("_json").isNull(), no_json).when(broken, fv.BAD_JSON_ERROR)
    return (
        with_json_part(answers, text, "_json")
        .withColumn("_sent", record(T.DoubleType(), allowNonNumericNumbers="false"))
        .withColumn("_read", F.when(not_sent, record(T.StringType())))
        .withColumn("error", error)
        .drop("_json")
    )


def _fields(schema: T.StructType) -> list[Column]:
    """The typed fields of ``_sent`` or ``_read``; all null beside an error."""
    sound, sent = F.col("error").isNull(), F.col("_read").isNull()

    def field(f: T.StructField) -> Column:
        plain = _typed(F.col(f"_sent.{f.name}"), f.dataType, _finite)
        return F.when(sound & sent, plain).when(sound, _typed(F.col(f"_read.{f.name}"), f.dataType, parse_float))

    return [field(f).alias(f.name) for f in schema.fields]


def parse_answers(answers: DataFrame, schema: T.StructType, text: str = "text") -> DataFrame:
    """Answers with ``record`` typed by ``schema`` and ``error`` where there is no sound JSON object."""
    record = F.when(F.col("error").isNull(), F.struct(*_fields(schema)))
    return _read(answers, schema, text).withColumn("record", record).drop("_sent", "_read")


def typed_bl(answers: DataFrame) -> DataFrame:
    """BL rows of ``answers(shipment_id, text)``."""
    return _read(answers, BL, "text").select("shipment_id", *_fields(BL), "error")


def typed_invoices(answers: DataFrame) -> DataFrame:
    """Invoice rows of ``answers(shipment_id, invoice_idx, text)``."""
    return _read(answers, INVOICE, "text").select("shipment_id", "invoice_idx", *_fields(INVOICE), "error")


def invoice_items(invoices: DataFrame) -> DataFrame:
    """Items of sound invoices, with their position in the invoice.

    The outer generator keeps Spark from parsing every answer once more to test the array's size;
    failed invoices have no items and drop out with the empty ones.
    """
    listed = invoices.select("shipment_id", "invoice_idx", F.posexplode_outer("items").alias("pos", "i"))
    return listed.where(F.col("pos").isNotNull()).select(
        "shipment_id", "invoice_idx", F.col("pos").cast("bigint").alias("item_idx"), "i.*"
    )
