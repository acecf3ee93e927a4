"""Running values of each key in which no task holds a key's rows.

Rows are parted by key and by range of time, so that a key with a third of a table is spread
over all ranges.  Windows run inside a part; a table with one row a part, at most 1024 a key, tells what the
parts before it leave behind.  Rows of one key and one moment stay together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .batching import range_of

#: The column of the part: a struct, so that rows with a null key form parts too and a join by it needs no shuffle of its own.
PART = "__part"


def parted(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds ``PART``: the key (k) and the range of ``ts`` (b), ascending."""
    timed = rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.withColumn(PART, F.struct(F.col(key).alias("k"), range_of(timed.select("__us"), "__us").alias("b"))).drop("__us")


def inside(*order: str) -> WindowSpec:
    """The rows of a part in order."""
    return Window.partitionBy(PART).orderBy(*order)


def upto(*order: str) -> WindowSpec:
    return inside(*order).rowsBetween(Window.unboundedPreceding, 0)


def with_carry(local: DataFrame, ends: list[Column], carried: Callable[[WindowSpec], list[Column]], first: Callable[[WindowSpec], list[Column]] | None = None) -> DataFrame:
    """``local`` beside values of its part: ``ends`` aggregate a part, ``carried`` is given the key's parts before it as a window.

    ``first`` makes columns of the parts from their neighbours (a window without frame) that ``carried`` may use.
    """
    parts = local.groupBy(PART).agg(*ends)
    key, at = F.col(f"{PART}.k"), F.col(f"{PART}.b")
    order = Window.partitionBy(key).orderBy(at)
    if first is not None:
        parts = parts.select("*", *first(order))
    table = parts.select(PART, *carried(order.rowsBetween(Window.unboundedPreceding, -1)))
    return local.join(table, PART)
