"""Connected components of a link table by union-find in partitions and star contraction between them.

Each round first runs union-find inside every partition of links, which leaves a forest,
then links every vertex's neighbours to the smallest one it knows (large star, small star).
Only minima per vertex are aggregated, with partial aggregation; no group is gathered and
nothing but two counters reaches the driver.  Each round's links are written to the shared
folder, so a lost executor costs at most a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


#: Links of a partition, whose forest a task holds (400,000 vertices at most).
PARTITION_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Links of a partition, replaced by (vertex, root) of union-find; emptied when it holds ``limit`` vertices."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(v, find(v)) for v in list(parent) if find(v) != v]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > limit:
            yield out()
    yield out()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) of every linked vertex; the component is its smallest vertex. ``links``: long columns a, b, of a stored table.

    Partitions have ``PARTITION_LINKS`` links; the forest of a single one is the answer.
    """
    links = links.select("a", "b").where("a <> b")
    parts = -(-links.count() // PARTITION_LINKS) or 1
    e = stored(links.coalesce(parts).mapInArrow(_forest, "a long, b long").distinct(), "links")
    for _ in range(rounds):
        if _are_stars(e):
            return _labels(e)
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours of v go to the smallest that v knows
        large = both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: v and its smaller neighbours go to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        small = down.join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("v", "m")).distinct()
        e = stored(small.mapInArrow(_forest, "a long, b long").distinct(), "links")
    raise RuntimeError("components did not settle")


def _labels(stars: DataFrame) -> DataFrame:
    leaf = stars.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return leaf.union(stars.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """No vertex is both root and leaf, and each leaf has one root."""
    leaves = e.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n"))
    roots = e.select(F.col("b").alias("v")).distinct().withColumn("root", F.lit(True))
    return leaves.join(roots, "v", "left").where("n > 1 or root").isEmpty()
