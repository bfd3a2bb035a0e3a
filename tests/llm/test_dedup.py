"""Exact copies, repeated lines, and removal of repeated passages."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoledger.llm import exact_dedup, line_dedup, suffix_dedup
from cargoledger.llm.oracles import ORACLES
from cargoledger.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, kept string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "l", "k") for i, t in rows], SCHEMA).repartition(parts)


# Exact copies


def test_exact_groups(spark):
    rows = [(5, "Ab É"), (2, "aB É"), (9, "ab é"), (3, None), (4, ""), (None, "ab É"), (None, "lone"), (5, "Ab É"), (7, "x" * 200_000)]
    out = exact_dedup.exact_groups(docs(spark, rows), keep="largest", runs=16, fan_in_bits=2).collect()
    assert len(out) == len(rows)
    found = {(r["doc_id"], r["text_sha256"]): r for r in out}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    upper = found[5, sha("ab É")]
    assert (upper["keep_id"], upper["group_size"], upper["kept"]) == (5, 4, True)
    assert found[2, sha("ab É")]["keep_id"] == 5 and not found[2, sha("ab É")]["kept"]
    assert found[None, sha("ab É")]["keep_id"] == 5 and not found[None, sha("ab É")]["kept"]
    assert found[None, sha("lone")]["kept"]
    assert found[9, sha("ab é")]["group_size"] == 1
    assert found[3, sha("")]["keep_id"] == 4 and found[4, sha("")]["group_size"] == 2


def test_repeated_rows_count_as_in_sql(spark, tmp_path):
    text = "a\nb\nc\nd"
    rows = [(1, text), (1, text), (2, text), (3, "z\na\nb\nc"), (4, None), (4, None)]
    docs(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op3_exact_dedup", "op9_line_windows"):
        df = QUERIES[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(wanted) and len(wanted) == len(rows)


def test_one_row_that_is_a_third_of_all(spark):
    many = spark.range(30_000).selectExpr("if(id < 10000, 7, id) AS doc_id", "if(id < 10000, 'same', cast(id AS string)) AS text")
    found = exact_dedup.exact_groups(many)
    assert found.count() == 30_000
    assert found.where("doc_id = 7 AND group_size = 10000 AND kept").count() == 10_000


@pytest.mark.parametrize("runs,bits", [(1, 1), (2, 1), (64, 1), (64, 3), (100, 4)])
def test_tree_shape_does_not_matter(spark, runs, bits):
    rows = [(i, f"t{i % 7 if i % 3 else 0}") for i in range(300)]
    found = exact_dedup.exact_groups(docs(spark, rows), runs=runs, fan_in_bits=bits).collect()
    smallest = {}
    for i, t in rows:
        smallest.setdefault(t, i)
    assert {(r["doc_id"], r["keep_id"]) for r in found} == {(i, smallest[t]) for i, t in rows}


def test_drop_exact_copies_keeps_columns_and_one_row(spark):
    rows = [(1, "A"), (2, "a"), (1, "A"), (3, None), (None, ""), (None, "z"), (None, "z")]
    out = exact_dedup.drop_exact_copies(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "kept"]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(-1, "z"), (1, "A"), (3, None)]


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert suffix_dedup.repeated_bytes(empty).count() == 0
    assert suffix_dedup.drop_repeated_passages(empty).columns == empty.columns


# Lines


def lines_by_hand(rows, width=3):
    seen, gone = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone[i] = set()
        for p in range(len(lines) - width + 1):
            window = tuple(lines[p : p + width])
            if window in seen:
                gone[i].update(range(p, p + width))
            seen.setdefault(window, (i, p))
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]) for i, t in rows}


def test_lines_match_plain_code(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n\n\n\n"), (903, "a\r\nb\r\nc"), (904, "a\n" * 3000)]
    out = line_dedup.drop_repeated_lines(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in out} == lines_by_hand(rows)


def test_lines_of_repeated_rows_and_missing_ids(spark):
    text = "one\ntwo\nthree\nfour"
    out = line_dedup.drop_repeated_lines(docs(spark, [(1, text), (1, text), (None, text), (1, "other")])).collect()
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["n_spans"]) for r in out)
    assert got == [("1", 1, 0, 0), ("1", 4, 0, 0), ("1", 4, 0, 0), ("None", 4, 4, 1)]


# Passages


def bytes_by_hand(texts, width):
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, r in enumerate(raw):
        for p in range(len(r) - width + 1):
            places.setdefault(r[p : p + width], []).append((d, p))
    keep = [np.ones(len(r), bool) for r in raw]
    for found in places.values():
        if len(found) > 1:
            for d, p in found:
                keep[d][p : p + width] = False
    return [bytes(np.frombuffer(r, np.uint8)[k]) for r, k in zip(raw, keep, strict=True)]


def passage_texts(seed, alphabet, n=60):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randrange(30, 400)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), word(rng.randrange(0, 300))]
        texts.append("".join(parts))
    return [*texts, None, "", "a" * 700, "ab" * 300, texts[3], texts[4][50:], "x" * 199, "x" * 199, "é" * 150]


@pytest.mark.parametrize("seed,alphabet,width", [(1, "abcdefgh é\n", 60), (2, "ab", 60), (3, "abcdefghijklmnop ñ", 200), (4, "aé", 100)])
def test_bytes_match_plain_code(spark, seed, alphabet, width):
    texts = passage_texts(seed, alphabet)
    out = {r["doc_id"]: r for r in suffix_dedup.repeated_bytes(docs(spark, list(enumerate(texts)), 5), width=width).collect()}
    for i, kept in enumerate(bytes_by_hand(texts, width)):
        assert bytes(out[i]["kept"]) == kept
        assert out[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert out[i]["n_bytes"] - out[i]["n_removed"] == len(kept)


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 3, 30):
        n, depth = 500, 40
        text = np.concatenate((rng.integers(97, 97 + letters, n), np.zeros(depth + 8))).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_dedup.suffix_order(text, suffix_dedup.eight_bytes(text), n, depth)
        assert sorted(order.tolist()) == list(range(n))
        prefixes = [raw[i : i + depth] for i in order]
        assert prefixes == sorted(prefixes)


def test_repeated_rows_are_elsewhere_for_each_other(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    out = suffix_dedup.repeated_bytes(docs(spark, [(1, text), (1, text), (None, "b" + text[:150]), (2, "short")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"]) for r in out) == [("1", 300, 1), ("1", 300, 1), ("2", 0, 0), ("None", 0, 0)]


def test_dropped_passages_leave_valid_text_and_other_columns(spark):
    passage = "".join(chr(0xE0 + i * i % 28) for i in range(150))
    rows = [(1, "Á" + passage + "tail"), (2, "à" + passage + "other"), (3, None), (None, "ünique")]
    out = suffix_dedup.drop_repeated_passages(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "kept"]
    got = {r["doc_id"]: (r["text"], r["lang"], r["kept"]) for r in out.collect()}
    assert got[1] == ("Átail", "l", "k") and got[2] == ("àother", "l", "k")
    assert got[3] == (None, "l", "k") and got[None] == ("ünique", "l", "k")


def test_places_of_one_context_are_spread(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    passage = word(900)
    rows = [(i, word(100) + passage + word(100)) for i in range(1, 2001)] + [(None, passage)]
    texts = docs(spark, rows, 4).selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hits = suffix_dedup.anchor_counts(texts, 200, 8)
        found = [(r["hash"], r["task"]) for r in hits.selectExpr("hash", "spark_partition_id() AS task").collect()]
        runs = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "hash")).alias("runs"))
        marks = suffix_dedup.context_marks(texts.where("doc_id IS NOT NULL").join(runs, ["doc_id", "text_hash"]), 200, 8)
        ends = [(r["end"] - r["begin"], r["task"]) for r in marks.selectExpr("begin", "end", "spark_partition_id() AS task").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_hash = Counter(h for h, _ in found)
    assert max(per_hash.values()) == 2001
    assert max(Counter(found).values()) < 1200
    # All places of a mark come out, from several tasks.
    assert max(Counter(n for n, _ in ends).values()) >= 2000
    assert max(Counter(t for _, t in ends).values()) < len(ends) * 0.6
    out = suffix_dedup.repeated_bytes(docs(spark, rows, 4)).collect()
    by_hand = bytes_by_hand([t for _, t in rows], 200)
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in out) == sorted((str(i), k) for (i, _), k in zip(rows, by_hand, strict=True))
