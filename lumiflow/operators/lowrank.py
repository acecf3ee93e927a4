"""Weights too large for a row: low-rank updates by a block matrix product, and 8-bit storage.

A matrix is a table of its rows: name, row, values.  A product joins blocks: the left one's rows are cut into chunks of the inner index, and each
chunk meets the block of right rows of the same index.  Left rows of a name are dealt by ``ROWS``, and the right block
goes to each of these parts, so a name that holds all rows is spread as evenly as many small ones; partial products of a row are summed by its key.
A task holds ``ROWS`` chunks and one block, never a matrix.

Defined cases: inner rows that one side lacks count as zeros; rows without an update stay; an update of another width
gives a problem in place of values; a null or non-finite value makes what depends on it null or NaN as sums do; in 8 bits a block of zeros keeps scale 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inner indices of a block, left rows of a part, values that share a scale.
INNER, ROWS, QUANT = 256, 4096, 64


def inner_chunks(rows: DataFrame, inner: int = INNER) -> DataFrame:
    """(name, row, k, values): chunks of ``inner`` values of each row."""
    last = F.floor((F.size("values") - 1) / inner).cast("int")
    ks = F.when(F.size("values") > 0, F.sequence(F.lit(0), last))
    return rows.select("name", "row", "values", F.explode(ks).alias("k")).select("name", "row", "k", F.slice("values", F.col("k") * inner + 1, F.lit(inner)).alias("values"))


def block_product(left: DataFrame, right: DataFrame, inner: int = INNER, rows: int = ROWS) -> DataFrame:
    """(name, row, values) of left x right, both (name, row, values); a right row is an inner index."""
    chunks = inner_chunks(left, inner).withColumn("part", F.floor(F.col("row") / rows).cast("long"))
    blocks = right.select("name", F.floor(F.col("row") / inner).cast("int").alias("k"), (F.col("row") % inner).cast("int").alias("at"), "values")
    asked = chunks.select("name", "k", "part").distinct()
    dealt = asked.join(blocks, ["name", "k"]).select(*(F.col(c).alias(c) for c in ("name", "k", "part", "at", "values")))  # columns of its own

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        n = a.num_rows
        if not n or not b.num_rows:
            return pa.table({"name": pa.array([], pa.string()), "row": pa.array([], pa.int64()), "values": pa.array([], pa.list_(pa.float64()))})
        b = b.sort_by("at")
        at = np.asarray(b["at"].combine_chunks())
        block = np.asarray(b["values"].combine_chunks().flatten()).reshape(len(at), -1)
        sizes = np.asarray(a["values"].combine_chunks().value_lengths())
        x = np.zeros((n, inner))
        x[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes])] = np.asarray(a["values"].combine_chunks().flatten())
        y = x[:, at] @ block
        return pa.table({"name": a["name"], "row": a["row"], "values": pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))})

    keys = ["name", "k", "part"]
    parts = chunks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(multiply, "name string, row long, values array<double>")
    # as many partial rows as the inner index has blocks
    sums = parts.groupBy("name", "row").agg(F.collect_list("values").alias("p"))
    zero = F.transform(F.get("p", F.lit(0)), lambda v: F.lit(0.0))
    return sums.select("name", "row", F.aggregate("p", zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)).alias("values"))


def lora_merged(base: DataFrame, b: DataFrame, a: DataFrame, scale: float, inner: int = INNER, rows: int = ROWS) -> DataFrame:
    """(name, row, values, problem): base + scale x B A by name; names without an update stay as they are."""
    delta = block_product(b, a, inner, rows).select("name", "row", F.col("values").alias("delta"))
    both = base.join(delta, ["name", "row"], "left")
    fits = F.size("delta") == F.size("values")
    merged = F.when(F.col("delta").isNull(), F.col("values")).when(fits, F.zip_with("values", "delta", lambda v, x: v + scale * x))
    return both.select("name", "row", merged.alias("values"), F.when(F.col("delta").isNotNull() & ~fits, F.lit("dimension mismatch")).alias("problem"))


def quantised(values: Column, block: int = QUANT) -> Column:
    """struct(scales array<double>, codes array<tinyint>): blocks scaled by their largest absolute value to -127 to 127, halves to even."""
    count = F.ceil(F.size(values) / block).cast("int")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    scales = F.transform(starts, lambda i: F.array_max(F.transform(F.slice(values, i * block + 1, F.lit(block)), F.abs)))
    parts = F.transform(starts, lambda i: F.struct(F.slice(values, i * block + 1, F.lit(block)).alias("v"), F.array_max(F.transform(F.slice(values, i * block + 1, F.lit(block)), F.abs)).alias("m")))
    codes = F.flatten(F.transform(parts, lambda p: F.transform(p["v"], lambda x: F.when(p["m"] > 0, F.rint(x / p["m"] * 127)).otherwise(x * 0).cast("tinyint"))))
    return F.struct(scales.alias("scales"), codes.alias("codes"))


def dequantised(scales: Column, codes: Column, block: int = QUANT) -> Column:
    """What the codes stand for; off by scale / 254 at most."""
    return F.transform(codes, lambda c, i: c * F.get(scales, F.floor(i / block).cast("int")) / 127)


def write_8bit(rows: DataFrame, folder: str, block: int = QUANT) -> None:
    """Store (name, row, values) as scales and codes."""
    rows.withColumn("q", quantised(F.col("values"), block)).select("name", "row", "q.scales", "q.codes").write.option("compression", "zstd").parquet(folder)


def read_8bit(spark, folder: str, block: int = QUANT) -> DataFrame:
    """(name, row, values, codes) of ``write_8bit``."""
    rows = spark.read.parquet(folder)
    return rows.select("name", "row", dequantised(F.col("scales"), F.col("codes"), block).alias("values"), "codes")
