"""Typed records of the extraction answers."""

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

# --- Fixed values: names, types and order of the answers' fields -----
PARTY = StructType().add("name", StringType()).add("address", StringType()).add("phone", StringType())

ITEM = (
    StructType()
    .add("part_number", StringType())
    .add("description", StringType())
    .add("quantity", DoubleType())
    .add("unit_price", DoubleType())
    .add("total_price", DoubleType())
)

BL = (
    StructType()
    .add("bl_number", StringType())
    .add("booking_number", StringType())
    .add("container_no", StringType())
    .add("vessel_voyage", StringType())
    .add("port_of_loading", StringType())
    .add("port_of_discharge", StringType())
    .add("place_of_delivery", StringType())
    .add("date_laden_on_board", StringType())
    .add("cargo_type", StringType())
    .add("freight_cost", DoubleType())
    .add("packages_count", LongType())
    .add("gross_weight", DoubleType())
    .add("gross_measurement", DoubleType())
    .add("exporter", PARTY)
    .add("consignee", PARTY)
)

INVOICE = (
    StructType()
    .add("invoice_number", StringType())
    .add("invoice_date", StringType())
    .add("incoterm", StringType())
    .add("currency", StringType())
    .add("total_value", DoubleType())
    .add("shipping_cost_invoice", DoubleType())
    .add("exporter", PARTY)
    .add("items", ArrayType(ITEM))
)
