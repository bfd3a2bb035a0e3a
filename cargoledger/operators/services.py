"""Service invoices: lines, totals and the client block."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import or_zero, sum_money
from cargoledger.functions.text import blank_to_null, long_date
from cargoledger.operators.distribution import SPAN, nest_rows


def price_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SERVICES, "codigo string, descripcion string, precio double")


def explode_selection(invoices: DataFrame, column: str = "selected") -> DataFrame:
    """Lines of ``map<service, struct<quantity, price>>`` in map order; quantity defaults to 1, price to 0."""
    rest = [c for c in invoices.columns if c != column]
    return invoices.select(*rest, F.posexplode(F.map_entries(column)).alias("line_no", "entry")).select(
        *rest,
        "line_no",
        F.col("entry.key").alias("descripcion"),
        F.col("entry.value.quantity").alias("quantity"),
        F.col("entry.value.price").alias("price"),
    )


def invoice_lines(selection: DataFrame) -> DataFrame:
    """Coded and priced lines. The five-row price list is fixed, so its codes join as a broadcast."""
    services = price_list(selection.sparkSession).select("descripcion", "codigo")
    quantity = F.coalesce(F.col("quantity").cast("double"), F.lit(1.0))
    price = or_zero(F.col("price"))
    return selection.join(F.broadcast(services), "descripcion", "left").select(
        *[c for c in selection.columns if c not in ("descripcion", "quantity", "price")],
        F.coalesce("codigo", F.lit(fv.GENERIC_SERVICE_CODE)).alias("codigo"),
        "descripcion",
        quantity.alias("cantidad"),
        price.alias("precio_unitario"),
        (quantity * price).alias("total"),
    )


def invoice_totals(lines: DataFrame, key: str) -> DataFrame:
    """Subtotal, tax and total per invoice."""
    return (
        lines.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_lines"), sum_money(F.col("total")).alias("subtotal"))
        .withColumn("isv", F.col("subtotal") * fv.SERVICE_TAX_RATE)
        .withColumn("total_pagar", F.col("subtotal") + F.col("isv"))
    )


def with_fallback(shown: Column, known: Column, default: str) -> Column:
    """The previewed value, else the consignee's, else a generic text."""
    return F.coalesce(blank_to_null(shown), known, F.lit(default))


def client_block(clients: DataFrame) -> DataFrame:
    """Client name, tax id and address with their defaults.

    ``clients`` has cliente_preview, rtn_preview, direccion_preview, consignee_name,
    consignee_address and bl_number.
    """
    return clients.withColumns(
        {
            "cliente": with_fallback(F.col("cliente_preview"), F.col("consignee_name"), fv.GENERIC_CLIENT),
            "rtn": F.coalesce(blank_to_null(F.col("rtn_preview")), F.lit(fv.GENERIC_TAX_ID)),
            "direccion": with_fallback(F.col("direccion_preview"), F.col("consignee_address"), fv.GENERIC_ADDRESS),
            "bl_number": F.coalesce("bl_number", F.lit("")),
        }
    ).drop("cliente_preview", "rtn_preview", "direccion_preview", "consignee_name", "consignee_address")


def issue_dates(issued: Column | dt.date) -> tuple[Column, Column]:
    """Issue date and due date one calendar month later, as printed."""
    day = issued if isinstance(issued, Column) else F.lit(issued)
    return long_date(day), long_date(F.add_months(day, 1))


def service_invoices(
    clients: DataFrame, selection: DataFrame, issued: Column | dt.date, key: str, span: int = SPAN
) -> DataFrame:
    """Invoice documents: client block, dates, nested lines and totals.

    A very long invoice continues in further parts (part_no), which repeat its header and totals.
    """
    lines = invoice_lines(selection)
    fields = ["codigo", "descripcion", "cantidad", "precio_unitario", "total"]
    nested = nest_rows(lines, [key], "line_no", fields, "items", span)
    issue, due = issue_dates(issued)
    header = client_block(clients).withColumn("fecha", issue).withColumn("fecha_vencimiento", due)
    return header.join(invoice_totals(lines, key), key).join(nested, key)
