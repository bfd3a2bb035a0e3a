"""Fill-in-the-middle: the skip list and the outputs against plain cutting, and exact restoration."""

import hashlib
import random
import re

import numpy as np
import pytest

from cargoledger.llm import infill

TEXTS = [
    "", None, "one line", "one line\n", "\n", "\n\n\n", "a\nb\nc", "é\n漢字🎉\n\n x", "has <P> inside\nx", "<S>\n", "y\n<M>", "<\nS>\nP>\n<",
    "\r\n\r\n", "long " * 2000 + "\n" + "x\n" * 3000, "a\nb\nc",
]


def plain_cut(doc_id, text, seed=7, rate=100, suffix_first_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < suffix_first_rate:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 17, 1000, 20_000])
def test_skip_list(n):
    rng = np.random.default_rng(n)
    widths = rng.integers(1, 50, n)
    units = infill.SkipList(widths)
    sums = np.concatenate(([0], np.cumsum(widths)))
    ranks = range(n + 1) if n <= 1000 else [0, 1, n, *rng.integers(0, n, 500).tolist()]
    assert all(units.code_points(int(r)) == sums[r] for r in ranks)
    assert all(lane.units.sum() == n and lane.chars.sum() == sums[-1] for lane in units.lanes)
    if n >= 1000:
        assert len(units.lanes) > 3 and len(units.lanes[-1].units) < 30
    with pytest.raises(IndexError):
        units.code_points(n + 1)


def test_line_widths():
    for text in TEXTS:
        assert infill.line_widths(text or "").tolist() == [len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text or "")]


@pytest.mark.parametrize("rates", [(100, 50), (30, 100), (0, 50)])
def test_outputs_and_restored_texts(spark, rates):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab<PSM>é\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no\nid", "x", "y"), (6, TEXTS[6], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, form string").repartition(3)
    found = infill.fill_in_middle(docs, rate=rates[0], suffix_first_rate=rates[1])
    got = found.withColumn("restored", infill.restore(found["output"], found["form"])).collect()
    want = [(*plain_cut(i, t, 7, *rates), t or "") for i, t, _, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    if rates == (100, 50):
        assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_long_text(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "é\n" * 1_000_000
    row = infill.fill_in_middle(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()[0]
    assert tuple(row) == plain_cut(3, text)
