"""Sharding by weighted rendezvous hashing.

A record goes to the shard with the smallest ``-ln(u(key, shard)) / weight``, where u is a
hash of key and shard in (0, 1).  Each pair's number never changes, so one more shard takes
rows only into itself, and in proportion to its weight.  The law is ``key``: the id and the
shards alone decide, so copies of a text may lie apart and sizes are near equal only as
the law of large numbers makes them; a row is never split or moved by what others hold.

Defined cases: a null text has no bytes (size 1, crc32 0); a null id is hashed as its own
key (the empty string); repeated rows share the shard and take slots of their own; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import gapless_rank


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key`` among ``len(weights)`` shards, as an expression that Spark compiles.

    52 bits of md5 make u; ties, practically impossible, go to the smaller shard.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be above 0")
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")
        u = (bits + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.log(u) / float(weight)).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"].cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its shard, a gapless slot there, and its shard if one of weight ``grown`` were added."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = F.col("doc_id")
    rows = own.select(
        key,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(key, weights).alias("shard"),
        (rendezvous_shard(key, [*weights, grown]) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    ranked = gapless_rank(rows, "shard", ["doc_id", "text_crc32", "size"], rank="slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8, id_col: str = "doc_id", **options: str) -> None:
    """Write whole documents below ``path/shard=N``; rows of one shard are spread over tasks, so a heavy shard is many files."""
    if "shard" in docs.columns:
        raise ValueError("the documents already have a column named shard")
    docs.withColumn("shard", rendezvous_shard(F.col(id_col), weights)).write.partitionBy("shard").options(**options).parquet(path)
