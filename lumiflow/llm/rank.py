"""Gapless ranks and running sums without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group are dealt by hash over so many buckets.
BUCKETS = 1024


def gapless_rank(df: DataFrame, group: str, order: list[str], rank: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each ``group``, each number once.

    A group is split by a hash of ``order`` into buckets that are numbered alone; the sums
    of the smaller buckets' counts come from a pre-aggregated table of at most
    groups x buckets rows.  ``df`` must give the same rows when it is run twice.
    """
    b, n, before = "__bucket", "__n", "__before"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, b).agg(F.count("*").alias(n))
    sums = counts.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    own = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(group, b).orderBy(*order)) - 1)
    return own.join(sums.withColumnsRenamed({group: "__g", b: "__b"}), F.col(group).eqNullSafe(F.col("__g")) & (F.col(b) == F.col("__b"))).withColumn(rank, (F.col(rank) + F.col(before)).cast("long")).drop(b, "__g", "__b", before)
