"""The corpus pipeline: column order, effects of each stage, and independence from the library's own imports."""

import ast
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest

ROOT = Path(corpus_pipeline.__file__).parent
NAMES = ["language", "exact_dedup", "near_dedup", "passages", "packing"]


@pytest.fixture
def docs(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("the", "ing", "and", "ton", "re", "st") for b in ("ation", "er", "ous", "ly", "it", "en", "al")]
    text = lambda n: " ".join(rng.choice(words, n)) + " " + " ".join(f"z{int(x)}" for x in rng.integers(0, 10**6, n))
    base, passage = text(150), text(40)
    rows = [(1, base, "en"), (2, base.upper(), "en"), (3, base + " appended words", "en"), (4, text(60) + "\n" + passage + "\n" + text(60), "en")]
    rows += [(5, text(60) + "\n" + passage + "\n" + text(60), "en"), (6, "12345 !!!", None), (7, None, None), (8, "", "en"), (9, text(900), None)]
    rows += [(i, text(30), "en") for i in range(20, 60)]
    return spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    everything = ids(docs)
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs.write.mode("overwrite").parquet(str(tmp_path / f"before-{name}"))
        docs = stage(spark, spark.read.parquet(str(tmp_path / f"before-{name}")), "")
        left.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids(left[0]) == everything - {6, 7, 8}
    assert ids(left[1]) == everything - {6, 7, 8, 2}
    assert ids(left[2]) == everything - {6, 7, 8, 2, 3}
    kept = {r["doc_id"]: r for r in left[3].collect()}
    assert set(kept) == ids(left[2])
    before = {r["doc_id"]: r["text"] for r in left[2].collect()}
    assert len(kept[4]["text"]) < len(before[4]) - 200 and len(kept[5]["text"]) < len(before[5]) - 200
    assert all(kept[i]["text"] == before[i] for i in kept if i not in (4, 5))
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    packed = left[4].groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r["doc_id"] for r in packed} == set(kept)


def test_run_equals_its_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    filled = got.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in filled) <= corpus_pipeline.SEQUENCE_TOKENS


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("*.py"), *ROOT.glob("cargoledger/**/*.py"), *ROOT.glob("tests/*.py")]:
        inside = "llm" in path.relative_to(ROOT).parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert inside or not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path


def test_native_operators_use_no_python_in_tasks():
    for name in ("exact_dedup", "line_dedup", "preference"):
        source = (ROOT / "cargoledger" / "llm" / f"{name}.py").read_text()
        assert not any(word in source for word in ("InArrow", "InPandas", "udf", ".rdd", "numpy", "pandas", "pyarrow"))


CLASHING = ["row", "id", "kept", "rest", "left", "spans", "component_id", "digest", "dropped id", "carried", "score", "n", "piece", "key"]


def test_stages_keep_columns_with_clashing_names(spark, docs):
    wide = docs.selectExpr("*", *[f"'x{i}' AS `{c}`" for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        assert all(tuple(r[-len(CLASHING) :]) == tuple(f"x{i}" for i in range(len(CLASHING))) for r in out.collect()), name
    assert corpus_pipeline.pack_sequences(spark, wide, "").count() > 0


def test_stages_on_an_empty_table(spark, docs):
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_on_rows_of_nulls(spark, docs):
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "some words in a text", None, None, None)], docs.schema)
    nulls = nulls.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES:
        count = stage(spark, nulls, "").where("doc_id IS NULL").count()
        assert count == {"language": 0, "exact_dedup": 0, "near_dedup": 3, "passages": 3, "packing": 3}[name], name
