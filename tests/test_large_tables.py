"""What shows on large tables only: wide key ranges, needless shuffles and wide sorts."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.operators import allocation, distribution, parties, quality, rules
from cargoledger.plans import queries
from cargoledger.sources import answers


@pytest.fixture
def shuffles(spark):
    """Counts the shuffles of a plan in which no join is broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda df: len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))
    for k, v in old.items():
        spark.conf.set(k, v)


def shipment(spark):
    bl = spark.createDataFrame([(1, "B1", "c", "p", 10.0, None)],
                               "shipment_id long, bl_number string, container_no string, port_of_loading string, freight_cost double, error string")
    invoices = spark.createDataFrame([(1, i, f"N{i}", "FOB", "USD", "x", None) for i in (7, 9_999, 10_000, 59_999)],
                                     "shipment_id long, invoice_idx long, invoice_number string, incoterm string, currency string, exporter_name string, error string")
    items = spark.createDataFrame([(1, i, j, "P", "d", 1.0, 2.0) for i in (7, 9_999, 10_000, 59_999) for j in (0, 1)],
                                  "shipment_id long, invoice_idx long, item_idx long, part_number string, description string, quantity double, total_price double")
    return bl, invoices, items


def test_invoices_of_many_suppliers_stay_in_one_part(spark):
    row = queries._shown_shipments(*shipment(spark)).collect()
    assert len(row) == 1 and (row[0]["part_no"], row[0]["n_invoices"]) == (0, 4)
    assert [v.split("/")[0] for v in row[0]["invoices"].split(";")] == ["7", "9999", "10000", "59999"]


def test_nested_rows_are_joined_where_they_lie(spark, shuffles):
    bl, invoices, items = shipment(spark)
    # Items, invoices, invoices with their items, BLs.
    assert shuffles(parties.assemble_shipments(bl, invoices, items, gated=True)) == 4


def test_heavy_keys_are_found_by_their_buckets(spark):
    facts = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [(None, i) for i in range(90)], "k string, i int")
    weights = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for slice_rows in (20, 1, 1000):
        wanted = sorted(distribution.large_keys(weights, ["k"], "n", slice_rows).collect())
        assert sorted(distribution.counted_large_keys(facts, ["k"], slice_rows).collect()) == wanted


def test_keys_are_not_shuffled_to_be_counted(spark, shuffles):
    facts, lookup = spark.range(100).selectExpr("id % 7 AS k", "id"), spark.range(7).selectExpr("id AS k", "id * 2 AS v")
    plan = distribution.balanced_join(facts, lookup, ["k"], ["id"])
    keyed = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(_bucket#", keyed)
    assert plan.count() == 100


def test_edited_items_counted_on_more_rows_keep_their_shares(spark):
    bl, _, items = shipment(spark)
    more = items.unionByName(items.withColumn("item_idx", F.col("item_idx") + 10))
    plain = allocation.allocate_by_invoice(items, bl)
    sliced = allocation.allocate_by_invoice(items, bl, slice_rows=1, counted=more)
    order = ["shipment_id", "invoice_idx", "item_idx", "freight_proportional"]
    assert sorted(sliced.select(order).collect()) == sorted(plain.select(order).collect()) and plain.count() == 8


def test_first_failed_invoice_stops_a_shipment_without_a_second_pass(spark, shuffles):
    party = "struct<name:string,address:string,phone:string>"
    bl = spark.createDataFrame([(i, None, None, "mal" if i == 3 else None) for i in (1, 2, 3, 4)], f"shipment_id long, exporter {party}, consignee {party}, error string")
    invoices = spark.createDataFrame([(1, 0, None), (1, 1, "mal"), (2, 0, "mal"), (3, 0, None)], "shipment_id long, invoice_idx long, error string")
    out = parties.bl_parties(bl, invoices.selectExpr("*", "named_struct('name', 'x', 'address', 'y', 'phone', 'z') AS exporter"))
    assert {r["shipment_id"] for r in out.collect()} == {1, 4}
    assert shuffles(out) == 2


def test_first_invoices_sort_no_more_than_they_show(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1)), (1, 1, 3, 2, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1))],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, "s3", 0, 1.0), (5, "s5", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    out = queries.QUERIES["w2_first_invoice"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [(1, 3, "INV-1-3")]
    assert "exporter_address" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_field_checks_stay_in_methods_that_the_jvm_compiles(spark, shuffles):
    text = {f: v for f, v in zip(rules.FIELDS, ["BL-1", "X", "  ", "1.234,56", "12,5", "abc", "ABC123", "FOB", "USD 500", "-10", "$7", "GBP"])}
    docs = spark.createDataFrame([(1, "fallback", "BL", ["sin texto"], True, *text.values())],
                                 "doc_id long, metodo_procesamiento string, tipo_documento string, errores array<string>, conversion_fob_cif boolean, "
                                 + ", ".join(f"{f} string" for f in text))
    for out, rows in ((rules.field_results(docs), 12), (quality.error_list(docs), 12)):
        code = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        # Longer methods are interpreted for every row.
        assert sizes and max(sizes) < 8000
        assert out.count() == rows


def test_numbers_of_answers_are_read_as_numbers(spark):
    # Sent as numbers, as text, beyond a double, and as what is no number or no JSON.
    sent = {'2': 2.0, '-1.5E2': -150.0, '12345678901234567890123': 12345678901234567890123.0, 'null': None, '1e999': None, '1' * 309: float('1' * 309), '9' * 309: math.inf,
            '"12.5"': 12.5, '" 7 "': 7.0, '"1_000"': 1000.0, '""': None, '"NaN"': None, '"Infinity"': None, 'NaN': None, '-Infinity': None,
            'true': None, '[1]': None, '{"a": 1}': None}
    rows = [(1, i, '```json\n{"total_value": %s, "items": [{"part_number": 5, "quantity": %s}, null]}\n```' % (v, v)) for i, v in enumerate(sent)]
    typed = answers.typed_invoices(spark.createDataFrame([*rows, (2, 0, '{"total_value": 01}')], "shipment_id long, invoice_idx long, text string"))
    *sound, broken = typed.orderBy("shipment_id", "invoice_idx").collect()
    assert [(r["total_value"], r["error"]) for r in sound] == [(v, None) for v in sent.values()]
    assert [(r["items"][0]["part_number"], r["items"][0]["quantity"], r["items"][1]) for r in sound] == [("5", v, None) for v in sent.values()]
    assert (broken["total_value"], broken["items"], broken["error"]) == (None, None, fv.BAD_JSON_ERROR)
    # With text leaves each number is written, matched and parsed once more, which took most of the time of large tables.
    plan = answers.invoice_items(typed)._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(quantity,DoubleType,true)" in plan


def test_fenced_objects_are_found_at_once(spark):
    texts = ['```json\n{"a": 1}\n```', 'Claro:\n```json {"a": {}} ``` y ```json {"b": 2} ```', '```json {"a": "`x`"} ```', '```json {"a": "```json {"} ```',
             '```json {"a": `` } ```json {"b": 2}```', '````json {"a": 1} ```', "```json\n{}```", "```json\n{```", "```json x {} ```", "` ```json {} ```",
             'x {"a": 1} ``` y', "```json {a} x ``` } ```", "", "nada", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    fenced = [re.search(fv.FENCED_JSON_PATTERN, t or "") for t in texts]
    bare = [re.search(fv.BARE_JSON_PATTERN, t or "") for t in texts]
    out = answers.with_json_part(df, "text", "j").orderBy("i")
    assert [r["j"] for r in out.collect()] == [(f or b)[1] if f or b else None for f, b in zip(fenced, bare)]
    assert answers.PLAIN_FENCE_PATTERN in out._jdf.queryExecution().optimizedPlan().toString()
