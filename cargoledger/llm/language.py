"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of the lengths in ``SPANS``, over lower-case letters with every
run of other characters as one space; the kernel of two texts is the size of the intersection of their
sets over the geometric mean of their sizes. Nyström landmarks turn the kernel into coordinates, and a
kernel ridge regression on them gives one score per language (one versus rest). The scores are linear
in a text's set, so landmarks, Nyström map and ridge weights fold into one table of a weight per
n-gram slot and language, and a batch of texts is scored as a product of its presence matrix and
that table.

The model is fitted on the driver on a bounded sample, ``per_lang * max_langs`` texts of all languages,
at most ``per_lang`` of each and at least one, and sent to the executors at ``SLOTS`` rows by the
number of languages. Tasks make the sets of the sample, so the driver collects at most ``SLOTS`` bits
a text, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import slices, split_hash, text_buffer

SPANS = (2, 3, 4)
# N-grams are told apart by a hash into so many slots.
SLOTS = 1 << 16
UNDETERMINED = "und"
# Bytes of text whose sets are held at once.
TEXT_BYTES = 1 << 20
# Languages whose scores are summed at once.
LANGUAGES_AT_ONCE = 32

# Byte classes after lower-casing: letters stay (ASCII letters and all bytes of other characters), the rest is space.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages
    sharpness: float


def _slots(letters: np.ndarray) -> np.ndarray:
    """The distinct n-gram slots of one cleaned text, ascending."""
    wide = letters.astype(np.uint32)
    found = []
    code = wide
    for span in range(2, max(SPANS) + 1):
        code = (code[:-1] << np.uint32(8)) | wide[span - 1 :] if len(code) else code
        if span in SPANS and len(code):
            spread = (code * np.uint32(2654435761) + np.uint32(span * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(16)
            found.append(spread.astype(np.uint16))
    if not found:
        return np.zeros(0, np.int64)
    present = np.zeros(SLOTS, bool)
    present[np.concatenate(found)] = True
    return np.flatnonzero(present)


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Presence sets of a column of lower-case texts: slots of all rows in sequence, and their number per row."""
    data, offsets = text_buffer(column)
    letter = _LETTER[data]
    rows, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        part, good = data[offsets[i] : offsets[i + 1]], letter[offsets[i] : offsets[i + 1]]
        kept = good.copy()
        kept[1:] |= good[:-1]  # of a run of other characters the first stays, as a space
        slots = _slots(np.where(good, part, np.uint8(32))[kept])
        rows.append(slots)
        sizes[i] = len(slots)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), sizes


def packed_set(slots: np.ndarray) -> bytes:
    """A presence set as 16-bit numbers or, if that is shorter, as ``SLOTS`` bits."""
    if 2 * len(slots) < SLOTS // 8:
        return slots.astype("<u2").tobytes()
    present = np.zeros(SLOTS, bool)
    present[slots] = True
    return np.packbits(present).tobytes()


def unpacked_set(packed: bytes) -> np.ndarray:
    if len(packed) < SLOTS // 8:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))


def presence_sets(sample: DataFrame) -> DataFrame:
    """``lang, packed`` from ``lang, text``, in the same order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = text_buffer(whole.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                batch = whole.slice(i, j - i)
                slots, sizes = presence(batch.column("text"))
                packed = [packed_set(s) for s in np.split(slots, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "packed"])

    schema = T.StructType([sample.schema["lang"]]).add("packed", "binary")
    return sample.select("lang", "text").mapInArrow(pack, schema)


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int, ridge: float, sharpness: float) -> LanguageModel:
    """Fit on presence sets; ``landmarks`` of them, taken evenly from all, or as many as languages if these are more, are the landmarks."""
    languages = sorted(set(labels))
    landmarks = max(landmarks, len(languages))
    sizes = np.array([len(s) for s in sets], np.int64)
    slots = np.concatenate(sets)
    ends = np.cumsum(sizes)
    norms = np.sqrt(np.maximum(sizes, 1)).astype(np.float64)
    chosen = np.unique(np.linspace(0, len(sets) - 1, min(landmarks, len(sets))).astype(int))
    table = np.zeros((SLOTS, len(chosen)), np.float32)
    for column, i in enumerate(chosen):
        table[slots[ends[i] - sizes[i] : ends[i]], column] = 1 / norms[i]
    kernel = np.zeros((len(sets), len(chosen)))
    for i in range(len(sets)):
        kernel[i] = table[slots[ends[i] - sizes[i] : ends[i]]].sum(axis=0) / norms[i]
    values, vectors = np.linalg.eigh(kernel[chosen])
    solid = values > 1e-8
    nystrom = vectors[:, solid] / np.sqrt(values[solid])
    coordinates = kernel @ nystrom
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    gram = coordinates.T @ coordinates + ridge * np.eye(coordinates.shape[1])
    weights = table @ (nystrom @ np.linalg.solve(gram, coordinates.T @ targets))
    return LanguageModel(languages, weights.astype(np.float32), sharpness)


def training_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str, per_lang: int, max_langs: int) -> DataFrame:
    """Labelled texts with letters of every language, at most ``per_lang`` of each.

    With more than ``max_langs`` languages each has an even share of ``per_lang * max_langs`` texts, at
    least one. Rows are drawn by a hash of id and text, and rows that repeat both are one text. A threshold
    on the hash from the number of different rows of a language that have a letter leaves a few times its
    texts before any text is shuffled, however large the table.
    """
    lang = F.col(lang_column)
    order = F.xxhash64(id_column, text_column)
    docs = docs.where(lang.isNotNull() & has_letters(F.col(text_column)))
    numbers = docs.groupBy(lang.alias("lang")).agg(F.approx_count_distinct(order).alias("n"))
    found = numbers.collect()
    per_lang = min(per_lang, max(1, per_lang * max_langs // max(1, len(found))))
    # With few texts a language, more are drawn, so that none is left without.
    shares = [F.lit(x) for row in found for x in (row["lang"], max(4 * per_lang, 64) / row["n"])]
    drawn = F.coalesce(F.create_map(*shares)[lang], F.lit(0.0)) if shares else F.lit(0.0)
    kept = docs.where(F.pmod(order, F.lit(1 << 30)) < drawn * (1 << 30))
    drawn_once = kept.groupBy(lang.alias("lang"), order.alias("order")).agg(F.min(text_column).alias("text"))
    labelled = drawn_once.withColumn("text", F.lower("text"))
    first = labelled.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("order", "text"))).where(F.col("n") <= per_lang)
    return first.orderBy("n", "lang", "order").select("lang", "text")


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    per_lang: int = 300,
    max_langs: int = 32,
    landmarks: int = 240,
    ridge: float = 1.0,
    sharpness: float = 4.0,
) -> LanguageModel | None:
    """A model from a bounded sample of labelled rows, or None if no row has a label and a letter."""
    rows = presence_sets(training_sample(docs, id_column, text_column, lang_column, per_lang, max_langs)).collect()
    if not rows:
        return None
    return fit([unpacked_set(r["packed"]) for r in rows], [r["lang"] for r in rows], landmarks, ridge, sharpness)


def _predicted(texts: pa.Array, letters: np.ndarray, fitted: tuple | None) -> tuple[list[str], np.ndarray]:
    """Best language and its share for every text; ``letters`` tells which texts have any."""
    n = len(letters)
    if fitted is None:
        return [UNDETERMINED] * n, np.zeros(n)
    languages, weights, sharpness = fitted
    slots, sizes = presence(texts)
    margins = np.zeros((n, len(languages)))
    full = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    if len(full):
        # The presence matrix has a one per listed slot; its product with the table is a sum per row.
        for c in range(0, len(languages), LANGUAGES_AT_ONCE):
            some = slice(c, c + LANGUAGES_AT_ONCE)
            margins[full, some] = np.add.reduceat(weights[:, some][slots], starts[full], axis=0, dtype=np.float64) / np.sqrt(sizes[full])[:, None]
    weight = np.exp(sharpness * (margins - margins.max(axis=1, keepdims=True)))
    best, share = margins.argmax(axis=1), weight.max(axis=1) / weight.sum(axis=1)
    names = [languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, np.where(letters, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel | None, text_column: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns with ``lang_pred`` and ``score``, from the whole text of every row.

    The score is the share of the best language in a softmax of the one-versus-rest scores. Texts
    that are null or have no letter get ``und`` and 0, as all do without a model. Rows that repeat
    are scored as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model and (model.languages, model.weights, model.sharpness))
    text = F.col(text_column).cast("string")
    inputs = docs.select(F.struct(*[F.col(c) for c in carried]).alias("carried"), F.lower(text).alias("text"), has_letters(text).alias("letters"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            _, offsets = text_buffer(whole.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                batch = whole.slice(i, j - i)
                names, share = _predicted(batch.column("text"), np.asarray(batch.column("letters"), dtype=bool), fitted)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("carried"), pa.array(names, pa.string()), pa.array(share)], names=["carried", "lang_pred", "score"]
                )

    schema = T.StructType([inputs.schema["carried"]]).add("lang_pred", "string").add("score", "double")
    return inputs.mapInArrow(score, schema).select("carried.*", "lang_pred", "score")


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5, **options) -> DataFrame:
    """Predict the language of every document from a model that never sees one fold.

    ``doc_id, held_out, lang_pred, score``. Documents with crc32(id as text) divisible by ``folds`` are
    held out, and so are those without an id; of the others the ones with a language are learned from.
    """
    remainder = split_hash(id_column, folds)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(remainder == 0, F.lit(True)).alias("held_out"),
        F.col(text_column).cast("string").alias("text"),
        F.col(lang_column).alias("lang"),
    )
    model = train(rows.where(~F.col("held_out")), "doc_id", "text", "lang", **options)
    return predict(rows, model, "text", ("doc_id", "held_out"))
