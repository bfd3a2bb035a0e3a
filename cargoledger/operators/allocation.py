"""FOB totals, freight and insurance shares, and CIF values of shipment items.

Inputs: ``items`` keyed by (shipment_id, invoice_idx, item_idx) with quantity, unit_price and
total_price; ``bl`` with one row per shipment_id and its freight_cost; ``invoices`` keyed by
(shipment_id, invoice_idx) with an ``error`` text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import or_zero, sum_money
from cargoledger.operators.distribution import SLICE_ROWS, balanced_join

ITEM_KEY = ["invoice_idx", "item_idx"]
DERIVED = ["fob_value", "freight_proportional", "insurance_calculated", "cif_value_corrected"]


def line_value() -> Column:
    return or_zero(F.col("quantity")) * or_zero(F.col("unit_price"))


def item_fob() -> Column:
    """The stated total of a line, or quantity times price where none is stated."""
    total = or_zero(F.col("total_price"))
    return F.when(total != 0, total).otherwise(line_value())


def fob_totals(items: DataFrame) -> DataFrame:
    """FOB total per shipment: stated totals, or computed ones where the stated sum is 0."""
    stated, computed = sum_money(F.col("total_price")), sum_money(line_value())
    return items.groupBy("shipment_id").agg(
        F.when(stated == 0, computed).otherwise(stated).alias("total_fob"), F.count(F.lit(1)).alias("_rows")
    )


def has_error(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def failed_shipments(invoices: DataFrame) -> DataFrame:
    """Per shipment, whether any of its invoices failed to extract."""
    return invoices.groupBy("shipment_id").agg(F.max(has_error(F.col("error"))).alias("invoice_failed"))


def admitted(bl: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """BLs of the shipments that go on to the form and the reports.

    Those whose BL failed to extract stop there, and so do those whose first invoice failed; a
    shipment without invoices goes on.
    """
    sound = bl.where(~has_error(F.col("error"))) if "error" in bl.columns else bl
    if invoices is None or "error" not in invoices.columns:
        return sound
    first = invoices.groupBy("shipment_id").agg(F.min_by(has_error(F.col("error")), "invoice_idx").alias("_stops"))
    return sound.join(first.where("_stops").select("shipment_id"), "shipment_id", "left_anti")


def admitted_rows(
    rows: DataFrame, bl: DataFrame, invoices: DataFrame, row_key: list[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The invoices or items of admitted shipments; ``row_key`` tells the rows of a shipment apart."""
    header = admitted(bl, invoices).select("shipment_id")
    return balanced_join(rows, header, ["shipment_id"], row_key, how="left_semi", slice_rows=slice_rows)


def _with_shares(joined: DataFrame, live: Column) -> DataFrame:
    total = F.col("total_fob")
    fob = F.col("fob_value")
    share = F.when(total > 0, fob / total).otherwise(F.lit(0.0))
    out = (
        joined.withColumn("fob_value", F.when(live, item_fob()))
        .withColumn("insurance_calculated", fob * fv.INSURANCE_RATE)
        .withColumn("freight_proportional", or_zero(F.col("freight_cost")) * share)
        .withColumn("freight_proportional", F.when(live, F.col("freight_proportional")))
    )
    cif = fob + F.col("freight_proportional") + F.col("insurance_calculated")
    return out.withColumn("cif_value_corrected", cif)


def allocate_by_shipment(
    items: DataFrame,
    bl: DataFrame,
    invoices: DataFrame | None = None,
    base: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Share each shipment's freight over its items by FOB value and derive insurance and CIF.

    A failed BL has no items to report. One failed invoice leaves the derived columns of its
    whole shipment empty; that check is skipped when ``invoices`` is not given. Totals are taken
    from ``base`` where ``items`` is the same table with more columns.
    """
    totals = fob_totals(items if base is None else base)
    shipments = totals.join(admitted(bl).select("shipment_id", "freight_cost"), "shipment_id")
    live = F.lit(True)
    if invoices is not None:
        shipments = shipments.join(failed_shipments(invoices), "shipment_id", "left")
        live = ~F.coalesce(F.col("invoice_failed"), F.lit(False))
    joined = balanced_join(
        items, shipments, ["shipment_id"], ITEM_KEY, how="inner", slice_rows=slice_rows, counted=items if base is None else base
    )
    return _with_shares(joined, live).drop("total_fob", "freight_cost", "invoice_failed")


def allocate_by_invoice(
    items: DataFrame,
    bl: DataFrame,
    invoices: DataFrame | None = None,
    carried: tuple[str, ...] = (),
    base: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Share the whole freight of the shipment inside every invoice.

    Only items of admitted shipments come out, with the ``carried`` columns of ``bl``. Totals are taken
    from ``base`` where ``items`` is the same table with more columns, and heavy keys are looked for in
    ``counted``, which has all rows of the items and is ``base`` by default. Overwrites fob_value and freight_proportional only;
    earlier insurance and CIF stay. With n invoices the freight is charged n times.
    """
    keys = ["shipment_id", "invoice_idx"]
    base = items if base is None else base
    counted = base if counted is None else counted
    totals = base.groupBy(*keys).agg(sum_money(F.col("total_price")).alias("_invoice_fob"))
    priced = balanced_join(
        totals,
        admitted(bl, invoices).select("shipment_id", *carried, or_zero(F.col("freight_cost")).alias("_freight")),
        ["shipment_id"],
        ["invoice_idx"],
        how="inner",
        slice_rows=slice_rows,
        counted=counted,
    )
    joined = balanced_join(items, priced, keys, ["item_idx"], how="inner", slice_rows=slice_rows, counted=counted)
    fob = or_zero(F.col("total_price"))
    share = fob / F.col("_invoice_fob") * F.col("_freight")
    return (
        joined.withColumn("fob_value", fob)
        .withColumn("freight_proportional", F.when(F.col("_invoice_fob") > 0, share).otherwise(F.lit(0.0)))
        .drop("_invoice_fob", "_freight")
    )


def shipment_totals(items: DataFrame) -> DataFrame:
    """Report totals per shipment: FOB, freight, insurance on the FOB total, and their sum."""
    sums = items.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        sum_money(F.col("fob_value")).alias("fob"),
        sum_money(F.col("freight_proportional")).alias("freight"),
    )
    return sums.withColumn("insurance", F.col("fob") * fv.INSURANCE_RATE).withColumn(
        "cif", F.col("fob") + F.col("freight") + F.col("insurance")
    )


def cif_by_shipment(items: DataFrame, bl: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """Report totals per shipment under the shipment rule, in one aggregation of the items.

    The freight of a shipment is its BL's in the share that its lines have in the FOB total; a failed
    invoice leaves its amounts at 0.
    """
    stated, computed = sum_money(F.col("total_price")), sum_money(line_value())
    sums = items.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        sum_money(item_fob()).alias("_lines"),
        F.when(stated == 0, computed).otherwise(stated).alias("_total"),
    )
    joined = sums.join(admitted(bl).select("shipment_id", "freight_cost"), "shipment_id")
    live = F.lit(True)
    if invoices is not None:
        joined = joined.join(failed_shipments(invoices), "shipment_id", "left")
        live = ~F.coalesce("invoice_failed", F.lit(False))
    share = F.col("_lines") / F.col("_total")
    freight = F.round((or_zero(F.col("freight_cost")) * share).cast("decimal(28,6)"), 2).cast("double")
    fob, insurance = F.col("fob"), F.col("fob") * fv.INSURANCE_RATE
    return (
        joined.withColumn("fob", F.when(live, F.col("_lines")).otherwise(0.0))
        .withColumn("freight", F.when(live & (F.col("_total") > 0), freight).otherwise(0.0))
        .select(
            "shipment_id", "n_items", "fob", "freight", insurance.alias("insurance"), (fob + F.col("freight") + insurance).alias("cif")
        )
    )


def complete_fob_cif(incoterm: Column, total_value: Column, freight: Column) -> tuple[Column, Column]:
    """(FOB, CIF) from an invoice total: one is stated, the other derived; other terms give nulls."""
    total = total_value.cast("double")
    freight = or_zero(freight)
    rate = fv.INSURANCE_RATE
    fob = F.when(incoterm == "FOB", total).when(incoterm == "CIF", total / (1 + rate) - freight)
    cif = F.when(incoterm == "CIF", total).when(incoterm == "FOB", total + freight + total * rate)
    return fob, cif
