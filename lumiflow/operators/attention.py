"""Attention over any number of keys, block by block.

A softmax over many keys is a state that merges: the largest score, the sum of exp(score - largest), and the values' sum with these weights.  Parts of a
group's queries meet parts of its keys; a task walks its part's keys in blocks and merges their states as it goes, so a query has one state a part of keys
whatever the block's size, and those few are brought to their common maximum and summed.  No task holds the keys of a group, no row an array of them.

Defined cases: a query without keys in its group has no row; scores of any size don't overflow; equal scores weigh the same; a null group
matches nothing; vectors of a group have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose scores are in memory at once, and rows of a group that a task holds.
BLOCK, PART = 2048, 16384


def _dealt(rows: DataFrame, key: str, part: int) -> DataFrame:
    """Adds ``part`` and ``parts``: parts of about ``part`` rows of a group, by hash."""
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    return rows.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int"))


def attention_states(queries: DataFrame, keys: DataFrame, scale: float, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, top, total, sums): a mergeable state for each query and part of keys. ``queries``: grp, qid, q; ``keys``: grp, kid, k, v."""
    q, k = _dealt(queries, "qid", part), _dealt(keys, "kid", part)
    counts = lambda rows, name: rows.select("grp", F.col("parts").alias(name)).distinct()
    q = q.drop("parts").join(counts(k, "others"), "grp").select("grp", "qid", "q", "part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    k = k.drop("parts").join(counts(q0 := _dealt(queries, "qid", part), "others"), "grp").select("grp", "k", "v", F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("part"))
    k = k.select(*(F.col(c).alias(c) for c in k.columns))  # columns of its own
    kind = q0.schema["qid"].dataType.simpleString()

    def states(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a["qid"].slice(0, 0), "top": pa.array([], pa.float64()), "total": pa.array([], pa.float64()), "sums": pa.array([], pa.list_(pa.float64()))})
        rows = lambda t, c: np.asarray(t[c].combine_chunks().flatten()).reshape(t.num_rows, -1)
        q_, k_, v_ = rows(a, "q"), rows(b, "k"), rows(b, "v")
        top, total, sums = np.full(len(q_), -np.inf), np.zeros(len(q_)), np.zeros((len(q_), v_.shape[1]))
        for i in range(0, len(q_), BLOCK):
            own = slice(i, i + BLOCK)
            for j in range(0, len(k_), block):
                scores = q_[own] @ k_[j : j + block].T * scale
                highest = np.maximum(top[own], scores.max(axis=1))
                weights, before = np.exp(scores - highest[:, None]), np.exp(top[own] - highest)
                total[own] = total[own] * before + weights.sum(axis=1)
                sums[own] = sums[own] * before[:, None] + weights @ v_[j : j + block]
                top[own] = highest
        return pa.table({"qid": a["qid"], "top": pa.array(top), "total": pa.array(total), "sums": pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))})

    by = ["grp", "part", "other"]
    return q.groupBy(*by).cogroup(k.groupBy(*by)).applyInArrow(states, f"qid {kind}, top double, total double, sums array<double>")


def merged_states(states: DataFrame) -> DataFrame:
    """(qid, out): states of a query, one a part of keys, brought to one maximum, summed and divided."""
    rows = states.groupBy("qid").agg(F.collect_list(F.struct("top", "total", "sums")).alias("s"), F.max("top").alias("highest"))
    scaled = F.transform("s", lambda s: F.struct(F.exp(s["top"] - F.col("highest")).alias("f"), F.concat(F.array(s["total"]), s["sums"]).alias("x")))
    summed = F.aggregate(scaled, F.array().cast("array<double>"), lambda a, s: F.when(F.size(a) == 0, F.transform(s["x"], lambda v: v * s["f"])).otherwise(F.zip_with(a, s["x"], lambda p, v: p + v * s["f"])))
    return rows.select("qid", summed.alias("x")).select("qid", F.transform(F.slice("x", F.lit(2), F.size("x") - 1), lambda v: v / F.get("x", F.lit(0))).alias("out"))


def block_attention(queries: DataFrame, keys: DataFrame, scale: float, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, out): softmax(scale x q k) v over the keys of each query's group."""
    return merged_states(attention_states(queries, keys, scale, block, part))
