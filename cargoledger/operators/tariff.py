"""Tariff catalog: upload filter, merge, and lookup of product descriptions.

A catalog is (pos, key, code): ``key`` is a normalised description, unique, and ``pos`` the order
in which keys were first stored, a number or the (part, load, row) of a merged catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.text import (
    choose_description,
    clean_translation,
    description_key,
    normalize_text,
    skips_translation,
)
from cargoledger.operators.distribution import SLICE_ROWS, balanced_join

# Length of the text pieces that pair descriptions with catalog keys.
PIECE = 4


def default_catalog(spark: SparkSession) -> DataFrame:
    """The two built-in entries, positioned before anything loaded later."""
    rows = [(i - len(fv.DEFAULT_CATALOG), key, code) for i, (key, code) in enumerate(fv.DEFAULT_CATALOG)]
    return spark.createDataFrame(rows, "pos long, key string, code string")


def usable_entries(
    upload: DataFrame, desc: str = "desc", code: str = "arancel", pos: str = "pos", load: str | None = None
) -> DataFrame:
    """Uploaded rows that define an entry: a description that is not blank and a settled code.

    A missing column means the upload defines nothing. ``load`` names the column with the order of
    the uploads, if there are several; positions count within an upload.
    """
    order = F.lit(0) if load is None else F.col(load)
    if desc not in upload.columns or code not in upload.columns:
        upload = upload.limit(0).withColumns({desc: F.lit(""), code: F.lit("")})
    keyed = upload.select(
        order.cast("bigint").alias("load"),
        F.col(pos).cast("bigint").alias("pos"),
        description_key(F.col(desc).cast("string")).alias("key"),
        F.col(code).cast("string").alias("code"),
    )
    return keyed.where((F.col("key") != "") & F.col("code").isNotNull() & (F.col("code") != fv.PENDING_CODE))


def merge_catalog(*parts: DataFrame) -> DataFrame:
    """The catalog after loading parts one after the other: ``pos, key, code``, one row per key.

    The code of the last load that defines a key counts, and within a load that of its last row; its
    place ``pos`` (part, load, row) is where it was first defined. Of rows that share a place the larger
    code counts.
    """
    placed = [
        part.select(
            F.struct(
                F.lit(i).alias("part"),
                (F.col("load") if "load" in part.columns else F.lit(0)).cast("bigint").alias("load"),
                F.col("pos").alias("row"),
            ).alias("pos"),
            "key",
            "code",
        )
        for i, part in enumerate(parts)
    ]
    union = placed[0]
    for part in placed[1:]:
        union = union.unionByName(part)
    first, code = F.min("pos").alias("first_pos"), F.max_by("code", F.struct("pos", "code")).alias("code")
    return union.groupBy("key").agg(first, code).select(F.col("first_pos").alias("pos"), "key", "code")


def _pieces(text: Column, sizes: Column) -> Column:
    """All distinct substrings of ``text`` that have one of the ``sizes``."""
    starts = F.sequence(F.lit(1), F.length(text))
    cut = F.flatten(
        F.transform(
            sizes,
            lambda size: F.transform(
                F.filter(starts, lambda at: at <= F.length(text) - size + 1), lambda at: F.substring(text, at, size)
            ),
        )
    )
    return F.array_distinct(cut)


def _anchored(catalog: DataFrame) -> DataFrame:
    """Catalog with one piece of every key: the piece that the fewest keys share.

    A description that contains a key contains that piece, so an equi-join on pieces finds every
    contained key; keys shorter than a piece are their own piece. Taking the rarest piece keeps
    the pairs to verify few, even where most keys share a common word.
    """
    sizes = F.array(F.least(F.lit(PIECE), F.length("key")))
    pieces = catalog.select("pos", "key", "code", F.explode(_pieces(F.col("key"), sizes)).alias("piece"))
    spread = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("_shared"))
    counted = balanced_join(
        pieces, spread, ["piece"], ["pos"], how="inner", weights=spread.withColumn("_rows", F.col("_shared"))
    )
    best = F.min_by("piece", F.struct("_shared", "piece")).alias("piece")
    return counted.groupBy("pos", "key", "code").agg(best)


def lookup_codes(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Code of every distinct description key in ``keys(desc_key)``.

    An equal key wins, otherwise the earliest stored key contained in the description,
    otherwise the pending code. Keys without any match are in the result too.
    """
    asked = keys.where(F.col("desc_key") != "")
    sizes = F.sequence(F.lit(1), F.lit(PIECE))
    cut = asked.select("desc_key", F.explode(_pieces(F.col("desc_key"), sizes)).alias("piece"))
    anchors = _anchored(catalog)
    # Both sides are plain shuffles on the piece, so at run time this becomes a broadcast join when
    # the anchors turn out small, and a popular piece is split over tasks when they do not.
    hits = cut.join(anchors, "piece").where(F.contains("desc_key", "key"))
    best = hits.groupBy("desc_key").agg(
        F.min_by("code", F.struct(F.col("desc_key") != F.col("key"), F.col("pos"))).alias("code")
    )
    return keys.join(best, "desc_key", "left").select(
        "desc_key", F.coalesce("code", F.lit(fv.PENDING_CODE)).alias("code")
    )


def tariff_codes(
    items: DataFrame,
    catalog: DataFrame,
    row_key: list[str],
    description: str = "description_es",
    name: str = "tariff_code",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Items with the tariff code of their description; distinct descriptions are looked up once."""
    keyed = items.withColumn("desc_key", description_key(F.col(description)))
    asked = keyed.groupBy("desc_key").agg(F.count(F.lit(1)).alias("_rows"))
    codes = lookup_codes(asked.select("desc_key"), catalog)
    coded = balanced_join(keyed, codes, ["desc_key"], row_key, weights=asked, slice_rows=slice_rows)
    return coded.withColumnRenamed("code", name).drop("desc_key")


def translations(descriptions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds description_es and description_used to a table of distinct descriptions.

    ``glossary(key, text_es)`` has one row per description key. A miss keeps the original text.
    """
    keyed = descriptions.withColumn("key", description_key(F.col("description")))
    joined = keyed.join(glossary.select("key", "text_es"), "key", "left")
    original = F.coalesce(F.col("description"), F.lit(""))
    found = F.when(~skips_translation(F.col("description")), clean_translation(F.col("text_es")))
    return (
        joined.withColumn("description_es", F.coalesce(found, original))
        .withColumn("description_used", choose_description(original, F.col("description_es")))
        .drop("key", "text_es")
    )


def _count_descriptions(items: DataFrame) -> DataFrame:
    return items.groupBy("description").agg(F.count(F.lit(1)).alias("_rows"))


def _attach(
    items: DataFrame, table: DataFrame, row_key: list[str], weights: DataFrame, slice_rows: int
) -> DataFrame:
    """Items with the columns of the description table; a null description reads as ''."""
    joined = balanced_join(items, table, ["description"], row_key, weights=weights, slice_rows=slice_rows)
    original = F.coalesce(F.col("description"), F.lit(""))
    return (
        joined.withColumn("description_original", original)
        .withColumn("description_es", F.coalesce("description_es", original))
        .withColumn("description", F.coalesce("description_used", original))
        .drop("description_used")
    )


def translate_items(
    items: DataFrame, glossary: DataFrame, row_key: list[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Items with description_original, description_es and the description to use.

    Every distinct description is translated once.
    """
    return attach_translations(items, items, glossary, row_key, slice_rows)


def attach_translations(
    items: DataFrame, base: DataFrame, glossary: DataFrame, row_key: list[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``translate_items`` with the descriptions counted on ``base``, the table that ``items`` came from."""
    counts = _count_descriptions(base)
    return _attach(items, translations(counts, glossary), row_key, counts, slice_rows)


def translate_live_items(
    items: DataFrame, base: DataFrame, glossary: DataFrame, row_key: list[str], live: Column, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``attach_translations`` where ``live`` holds; other items keep their description and have no translated texts."""
    texts = attach_translations(
        items.withColumns({"_raw": F.col("description"), "_live": live}), base, glossary, row_key, slice_rows
    )
    return texts.withColumns(
        {
            "description_original": F.when(F.col("_live"), F.col("description_original")),
            "description_es": F.when(F.col("_live"), F.col("description_es")),
            "description": F.when(F.col("_live"), F.col("description")).otherwise(F.col("_raw")),
        }
    ).drop("_raw", "_live")


def classify_items(
    items: DataFrame,
    base: DataFrame,
    glossary: DataFrame,
    catalog: DataFrame,
    row_key: list[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``translate_items`` and ``tariff_codes`` in one join: both depend on the description only.

    Descriptions are counted on ``base``, the table that ``items`` was derived from, so that work
    already in the plan of ``items`` is not planned again.
    """
    counts = _count_descriptions(base)
    texts = translations(counts, glossary).withColumn("desc_key", description_key(F.col("description_es")))
    codes = lookup_codes(texts.select("desc_key").distinct(), catalog)
    table = texts.join(codes, "desc_key").drop("desc_key").withColumnRenamed("code", "tariff_code")
    out = _attach(items, table, row_key, counts, slice_rows)
    return out.withColumn("tariff_code", F.coalesce("tariff_code", F.lit(fv.PENDING_CODE)))


def mapped_entries(cells: DataFrame, headers: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Entries of catalog files whose columns are found by their headers.

    ``cells(file_id, row_no, pos, cells map<string,string>)`` holds the rows as column to text. A
    file without both columns defines nothing. The result has ``load, pos, key, code``: positions count
    within a file, and ``load`` is the file's id.
    """
    desc_target, code_target = fv.CATALOG_HEADER_KEYWORDS
    found = match_headers(headers).groupBy("file_id").agg(
        F.max(F.when(F.col("target") == desc_target, F.col("col_name"))).alias("_desc_col"),
        F.max(F.when(F.col("target") == code_target, F.col("col_name"))).alias("_code_col"),
    )
    usable = found.where(F.col("_desc_col").isNotNull() & F.col("_code_col").isNotNull())
    joined = balanced_join(cells, usable, ["file_id"], ["row_no"], how="inner", slice_rows=slice_rows)
    return usable_entries(
        joined.select(
            "file_id",
            "pos",
            F.try_element_at("cells", F.col("_desc_col")).alias("desc"),
            F.try_element_at("cells", F.col("_code_col")).alias("arancel"),
        ),
        load="file_id",
    )


def match_headers(headers: DataFrame, targets: dict[str, list[str]] | None = None) -> DataFrame:
    """For every file and target, the best header: ``headers(file_id, col_pos, col_name)``.

    An equal normalised name scores 100, each contained keyword 10; the best score wins, the
    first column on a tie, and nothing below 10 counts.
    """
    targets = targets or fv.CATALOG_HEADER_KEYWORDS
    header = normalize_text(F.col("col_name"))
    scored = []
    for target, keywords in targets.items():
        hits = sum(
            (F.when((normalize_text(F.lit(k)) != "") & header.contains(normalize_text(F.lit(k))), 10).otherwise(0)
             for k in keywords),
            F.lit(0),
        )
        score = F.when(header == normalize_text(F.lit(target)), 100).otherwise(hits)
        scored.append(F.struct(F.lit(target).alias("target"), score.alias("score")))
    long = headers.select("file_id", "col_pos", "col_name", F.explode(F.array(*scored)).alias("s"))
    best = F.max_by(F.struct("col_name", "s.score"), F.struct("s.score", -F.col("col_pos"))).alias("best")
    found = F.col("best.score") >= 10
    return long.groupBy("file_id", F.col("s.target").alias("target")).agg(best).select(
        "file_id",
        "target",
        F.when(found, F.col("best.col_name")).alias("col_name"),
        F.when(found, F.col("best.score")).otherwise(0).alias("score"),
    )


def catalog_report(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("pos").select(
        "pos",
        F.col("key").alias("Descripción Producto (Español)"),
        F.col("code").alias("Posicion_Arancelaria"),
    )
