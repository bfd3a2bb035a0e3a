"""Language identification: held-out accuracy, and rows that have no language."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from cargoledger.llm import language
from cargoledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_string_kernel_language"](spark, SMALL).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_only_text_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs.where("doc_id < 600"), per_lang=60, landmarks=80)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    hidden = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS score", "1 AS lang_pred").repartition(7)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(hidden, model).collect()} == plain


def test_rows_without_a_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat and the dog"] * 5)] + [(i + 20, "el gato y la niña", "es") for i in range(5)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "123 !!", "en"), (53, "漢", None), (54, "a", None), (None, "the dog", "en"), (55, "the " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (50, 51, 52))
    assert by_id[55]["lang_pred"] == "en" and by_id[None]["held_out"] and by_id[53]["lang_pred"] in ("en", "es")
    unlabelled = language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert language.identify(docs.where("doc_id > 99")).count() == 0


def many_languages(n, texts):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        # Later languages are rarer.
        rows += [(k * 1000 + i, " ".join(rng.choices(words, k=40)), f"l{k:02}") for i in range(texts + (n - k) // 8)]
    return rows


def test_every_label_is_learned(spark):
    rows = many_languages(40, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == sorted({lang for _, _, lang in rows})
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    # The whole sample is bounded, with a text of every language.
    few = language.training_sample(docs, "doc_id", "text", "lang", 5, 16).groupBy("lang").count().collect()
    assert {r["count"] for r in few} == {2} and len(few) == 40


def test_a_label_of_copies_is_learned(spark):
    """Whatever its one text, a label whose rows repeat a single row is in the sample, once."""
    rows = [(i, f"the cat number {'abcdefghij'[i % 10]} sits there {'xyzuvw'[i % 6]}", "en") for i in range(400)]
    rows += [(5000 + i, f"{i} 99 !!", "es") for i in range(500)]
    for text in ("el gato", "la niña", "un perro", "los libros"):
        docs = spark.createDataFrame(rows + [(9000, text, "es")] * 2000, "doc_id long, text string, lang string")
        drawn = language.training_sample(docs, "doc_id", "text", "lang", 20, 4).collect()
        assert [r["text"] for r in drawn if r["lang"] == "es"] == [text]
        assert sum(r["lang"] == "en" for r in drawn) == 20


def test_rejection_follows_the_number_of_languages(spark):
    rows = many_languages(2, 30)
    # Half of one, half of the other: neither language leads.
    mixed = [(9000 + i, f"{a[1]} {b[1]}", None) for i, (a, b) in enumerate(zip(rows[:20], rows[-20:], strict=True))]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert {i for i, _, _ in rows} <= kept
    assert len(kept & {i for i, _, _ in mixed}) < 20
    assert corpus_pipeline.LEAST_LANGUAGE_LEAD / 4 == 0.3


def test_the_driver_collects_sets_of_bounded_size(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    rows = [(0, "", "en"), (1, word(300), "en"), (2, word(2_000_000), "es"), (3, word(20_000), "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    packed = language.presence_sets(docs).collect()
    assert max(len(r["packed"]) for r in packed) <= language.SLOTS // 8
    for (_, text, lang), r in zip(rows, packed, strict=True):
        assert r["lang"] == lang
        assert np.array_equal(language.unpacked_set(r["packed"]), language.presence(pa.array([text]))[0])
