"""Scalar functions on hand-made values; expectations are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cargoledger.functions import files, numbers, text

NUMBER_TEXTS = [
    ("12,5", 12.5, 0),
    ("1.234,56", 1234.56, 0),
    ("1,234.56", 1.23456, 0),
    ("1,234", 1234.0, 1234),
    ("1,234,567", 1234567.0, 1234567),
    ("1,2,34", 12.34, 0),
    ("1.234", 1.234, 0),
    ("1.234.567", 0.0, 0),
    ("5,", 5.0, 0),
    ("-3", -3.0, -3),
    ("$ 10", 10.0, 10),
    ("abc", 0.0, 0),
    ("12-3", 0.0, 0),
    ("5d", 5.0, 5),
    ("1_000", 1000.0, 1000),
    ("nan", 0.0, 0),
    ("0", 0.0, 0),
    ("No detectado", 0.0, 0),
    (" null ", 0.0, 0),
    ("", 0.0, 0),
    (None, 0.0, 0),
]


def values(spark, texts, *columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_parse_number(spark):
    t = F.col("t")
    got = values(
        spark,
        [x[0] for x in NUMBER_TEXTS],
        numbers.parse_number_or_zero(t),
        numbers.parse_number_or_zero(t, "int"),
    )
    assert got == [x[1:] for x in NUMBER_TEXTS]


def test_staged_parsing_equals_the_expression(spark):
    df = spark.createDataFrame([(x[0],) for x in NUMBER_TEXTS], "t string").withColumn("s", text.strip(F.col("t")))
    staged = numbers.with_parsed_numbers(df, {"f": ("s", "float"), "n": ("s", "int")})
    both = staged.select(
        "f", numbers.parse_number_or_zero(F.col("t")), "n", numbers.parse_number_or_zero(F.col("t"), "int")
    )
    for f, f2, n, n2 in both.collect():
        assert (f, n) == (f2, n2)


def test_safe_numbers(spark):
    t = F.col("t")
    texts = [" 1.5 ", "1,500", "x", None, "1e3", "inf", "5f", "-.5", "7."]
    got = values(spark, texts, numbers.safe_float(t), numbers.safe_numeric(t))
    assert got == [(1.5, 1.5), (0.0, 1500.0), (0.0, 0.0), (0.0, 0.0), (1000.0, 1000.0), (0.0, 0.0), (0.0, 0.0),
                   (-0.5, -0.5), (7.0, 7.0)]


def test_check_numeric_and_currency(spark):
    t = F.col("t")
    texts = ["USD 1,250.50", "$3", "abc", "", None, "12 EUR", "10 pen usd"]
    checked = values(spark, texts, numbers.check_numeric(t, "Flete"))
    assert [tuple(c[0]) for c in checked] == [
        (True, "1250.50", None),
        (True, "3", None),
        (False, "abc", "Flete no es un valor numérico válido"),
        (False, "No detectado", "Flete no detectado"),
        (False, "No detectado", "Flete no detectado"),
        (False, "12 EUR", "Flete no es un valor numérico válido"),
        (False, "10 pen usd", "Flete no es un valor numérico válido"),
    ]
    split = values(spark, texts, numbers.split_currency(t))
    assert [tuple(c[0]) for c in split] == [
        ("USD", "1250.50"), ("USD", "3"), ("USD", "No detectado"), ("No detectado", "No detectado"),
        ("No detectado", "No detectado"), ("EUR", "12"), ("USD", "10"),
    ]


def test_text_functions(spark):
    t = F.col("t")
    got = values(spark, ["Descripción / Ñu", "É-a_b.c(d)#", None], text.normalize_text(t), text.normalize_text(t, False))
    assert got == [("descripcionnu", "descripcionnu"), ("aabcd", "eabcd"), ("", "")]
    got = values(spark, ["  Blusa\t para  DAMA ", None, ""], text.description_key(t), text.clean_extracted(t))
    assert got == [("blusa para dama", "Blusa para DAMA"), ("", "No detectado"), ("", "No detectado")]
    got = values(spark, [' *"Rojo"* ', "S/M"], text.clean_translation(t), text.skips_translation(t))
    assert got == [("Rojo", False), ("S/M", True)]


def test_strip_takes_every_white_space(spark):
    got = values(spark, ["\t\n\x0b\x1f 　 x  \x85\xa0"], text.strip(F.col("t")))
    assert got == [("x",)]


@pytest.mark.parametrize(
    "size,label",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (32000, "31.2 KB"), (1048576, "1.0 MB"), (10485760, "10.0 MB")],
)
def test_size_label(spark, size, label):
    assert spark.range(1).select(files.size_label(F.lit(size))).first()[0] == label


def test_check_file(spark):
    df = spark.createDataFrame(
        [(0, "a.PDF", 10), (1, "b.exe", 10), (2, "c.exe", 10485761), (3, "d.tiff", 2048)], "i int, name string, size long"
    )
    got = [tuple(r[1]) for r in df.select("i", files.check_file(F.col("name"), F.col("size"))).orderBy("i").collect()]
    assert got == [
        (True, "PDF", "10 B", None),
        (False, None, None, "Tipo de archivo no permitido. Use: PDF, PNG, JPG, JPEG, TIFF, BMP"),
        (False, None, None, "Archivo demasiado grande (10.0 MB). Máximo permitido: 10MB"),
        (True, "Imagen", "2.0 KB", None),
    ]
