"""From model answers to priced items: the steps a shipment goes through, for all shipments at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.operators.allocation import ITEM_KEY, allocate_by_shipment
from cargoledger.operators.parties import bl_parties, invoice_parties
from cargoledger.operators.tariff import translate_live_items
from cargoledger.sources.answers import invoice_items, typed_bl, typed_invoices


@dataclass
class Shipments:
    """BLs and invoices with merged parties, and items with translations and values."""

    bl: DataFrame
    invoices: DataFrame
    items: DataFrame


def price_items(items: DataFrame, bl: DataFrame, invoices: DataFrame, glossary: DataFrame) -> DataFrame:
    """Translated and allocated items; a failed invoice leaves all of its shipment's items as they were."""
    priced = allocate_by_shipment(items, bl, invoices)
    live = F.col("fob_value").isNotNull()
    return translate_live_items(priced, items, glossary, ["shipment_id", *ITEM_KEY], live)


def process_documents(bl_answers: DataFrame, invoice_answers: DataFrame, glossary: DataFrame) -> Shipments:
    """``bl_answers(shipment_id, text)`` and ``invoice_answers(shipment_id, invoice_idx, text)`` to shipments.

    A BL that could not be read keeps its error row and contributes no invoices or items.
    """
    bl, invoices = typed_bl(bl_answers), typed_invoices(invoice_answers)
    items = invoice_items(invoices)
    return Shipments(
        bl=bl_parties(bl, invoices),
        invoices=invoice_parties(bl, invoices),
        items=price_items(items, bl, invoices, glossary),
    )
