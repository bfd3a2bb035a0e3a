"""Projected neighbours against brute force."""

import numpy as np
import pytest

from cargoledger.llm import neighbours
from cargoledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    """(query, rank, id, distance) by comparing all pairs."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(distance[j])) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, wanted):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in found}) for q, found in wanted.items()) / sum(map(len, wanted.values()))


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(2 * np.log(2))


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 256)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24)) * 3
    rows = [(i, (centres[i % 40] + rng.standard_normal(24)).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    queries = list(range(0, 4000, 100))
    got = result(neighbours.nearest(table, table.where("vec_id % 100 = 0")))
    wanted = brute(rows, queries, 10)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in queries}
    assert recall(got, wanted) >= 0.95
    for q, found in got.items():
        truth = dict(brute(rows, [q], 4000)[q])
        assert all(score == pytest.approx(truth[i], rel=1e-12) for i, score in found)


def test_copies_ties_and_invalid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 1500)]
    rows += [(2000, [0.0, 0.0]), (2001, None), (2002, [nan, 1.0]), (2003, [inf, 1.0]), (2004, [None, 1.0]), (2100, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    rows += [(2200, [0.0, -1.0]), (2200, [0.0, -1.0]), (-100, [0.5, 0.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = result(neighbours.nearest(table, table.where("vec_id % 100 = 0")))
    assert set(got) == {*range(0, 1500, 100), 2200, -100}
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[300] == [(i, 0.0) for i in range(0, 10)]
    assert got[-100] == [(i, 0.5) for i in range(0, 10)]
    assert [i for i, _ in got[2200]][0] == -100


def test_fewer_candidates_than_asked(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 4.0])], "vec_id long, embedding array<double>")
    assert result(neighbours.nearest(table, table.where("vec_id = 0"))) == {0: [(1, 1.0), (2, 3.0)]}
    empty = table.where("vec_id < 0")
    assert neighbours.nearest(empty, empty).count() == 0


def test_registered_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = result(QUERIES["op2_projected_neighbours"](spark, SMALL))
    wanted = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert set(got) == set(wanted)
    assert recall(got, wanted) >= 0.9
