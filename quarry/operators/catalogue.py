"""Catalogue rows: (tenant, item_code, item_name, disabled, barcode, description, brand, stock_uom, uom_conversions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of rows that are no items.
NO_ITEMS = ("DELIVERY FEE", "OPENING BALANCE")
OPTIONAL = ("barcode", "description", "brand", "stock_uom", "uom_conversions")


def eligible() -> Column:
    """Whether a row may be matched: not disabled, not superseded, and an item at all."""
    return (F.col("disabled") == "0") & ~F.col("item_code").endswith("-OLD") & ~F.upper(F.trim(F.col("item_name"))).isin(*NO_ITEMS)


def completed(catalogue: DataFrame) -> DataFrame:
    """With every optional column; missing ones and nulls are blank."""
    for c in OPTIONAL:
        catalogue = catalogue.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in catalogue.columns else F.lit(""))
    return catalogue
