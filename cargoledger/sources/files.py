"""Scans of document files and of tariff catalog uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger import fixed_values as fv
from cargoledger.functions.files import check_file, file_type
from cargoledger.functions.text import strip
from cargoledger.operators.distribution import SPAN, first_rows, nest_rows


def scan_documents(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files below a path with name and size; the bytes are only read when asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    return files.select(*kept, F.element_at(F.split("path", "/"), -1).alias("name"))


def check_files(files: DataFrame) -> DataFrame:
    """Files (``name, length``) with their check result and coarse type."""
    check = check_file(F.col("name"), F.col("length"))
    return files.withColumn("check", check).withColumn("file_type", file_type(F.col("name")))


def read_catalog_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Catalog files of one layout: UTF-8 CSV with a header, empty files contribute nothing.

    With ``columns`` the texts are read as they are in one pass; without, Spark infers types,
    which costs a second pass over the files.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if columns is None:
        return reader.option("inferSchema", True).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return reader.schema(schema).csv(path)


def read_catalog_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Uploaded catalog files in the order of ``paths``, each with a header of its own.

    ``cells(file_id, row_no, pos, cells)`` holds every row as a map from header to text, and
    ``headers(file_id, col_pos, col_name)`` the headers. ``file_id`` is the order of the uploads and ``pos``
    grows along a file: Spark numbers the splits of one file in their order.
    """
    cells, headers = None, []
    for file_id, path in enumerate(paths):
        rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        headers += [(file_id, i, name) for i, name in enumerate(rows.columns)]
        pairs = [part for name in rows.columns for part in (F.lit(name), F.col(f"`{name}`").cast("string"))]
        held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        place = F.monotonically_increasing_id()
        part = rows.select(F.lit(file_id).alias("file_id"), place.alias("row_no"), place.alias("pos"), held.alias("cells"))
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        cells = spark.createDataFrame([], "file_id int, row_no long, pos long, cells map<string,string>")
    return cells, spark.createDataFrame(headers, "file_id int, col_pos int, col_name string")


def preview_catalogs(uploads: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of every uploaded file, keyed by (file_id, row_no)."""
    return first_rows(uploads, ["file_id"], [F.col("row_no")], n)


def assemble_pages(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """Text of every document from its pages (doc_id, page_no, text), joined by line breaks.

    A page without text adds an empty line. A document beyond ``span`` pages continues in further
    parts; joining the parts by line breaks gives the whole text.
    """
    nested = nest_rows(pages.withColumn("text", F.coalesce("text", F.lit(""))), ["doc_id"], "page_no", ["text"],
                       "pages", span)
    return nested.select(
        "doc_id",
        "part_no",
        F.size("pages").alias("n_pages"),
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"),
    )


def route_extraction(texts: DataFrame, text: str = "text") -> DataFrame:
    """Documents with their extraction mode: text when enough characters were found, else image."""
    chars = F.length(strip(F.coalesce(text, F.lit(""))))
    return texts.withColumn("mode", F.when(chars > fv.MIN_TEXT_CHARS, "text").otherwise("image"))


def image_pages(pages: DataFrame) -> DataFrame:
    """The pages that image mode looks at; ``page_no`` starts at 1."""
    return pages.where(F.col("page_no") <= fv.MAX_IMAGE_PAGES)
