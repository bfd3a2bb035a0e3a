"""Physical plans: what may not appear, and what must."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

JOINING = [
    "cif_by_shipment", "e6_freight_invoice", "k1_aforo", "j1_tariff_lookup", "j2_header_match", "j5_invoice_parties",
    "j6_consolidated_documents", "k8_error_list", "u2_delete_documents", "k9_service_invoice", "process_documents",
]


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in text


def test_scans_read_only_what_a_query_needs(spark):
    text = plan(spark, "e20_processing_statistics")
    schema = next(line for line in text.splitlines() if "orders" in line and "ReadSchema" in line)
    assert "o_totalprice" not in schema and "o_orderdate" not in schema


def test_row_level_rules_do_not_shuffle_documents(spark):
    """The only exchange is the one that spreads a small input file over the cores."""
    for name in ("a16_document_errors", "p1_field_validation", "e21_errors_by_document"):
        text = plan(spark, name)
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM")


def test_filters_reach_the_scan(spark):
    text = plan(spark, "e26_job_errors")
    assert "PushedFilters" in text and "event_type" in text.split("PushedFilters")[1].split("ReadSchema")[0]
