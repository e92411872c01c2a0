"""Range lookups and backward as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers up to this many become one expression; more are looked up by a window.
MOST_TIERS = 1000


def tier_lookup(df: DataFrame, value: Column, tiers: list[tuple[float, float]], into: str) -> DataFrame:
    """The payload of the highest tier whose least value is at most ``value``; null below all tiers."""
    if len(tiers) > MOST_TIERS:
        raise ValueError("use previous_value for tables of tiers")
    found = F.lit(None).cast("double")
    for least, payload in sorted(tiers):
        found = F.when(value >= F.lit(float(least)), F.lit(float(payload))).otherwise(found)
    return df.withColumn(into, found)


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """The last non-null value strictly before each row, within its keys: a backward as-of lookup in one window."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(before))
