"""Lengths and length-balanced batches.

Row numbers over a whole table come from a range partition and per-partition counts, not
from a window of one task; a megabatch is a small group that one fold deals out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..functions.tokens import IMAGE_WORDS


#: Keys of which the cuts of text ranges are taken.
SAMPLE = 8192


def _cuts(df: DataFrame, column: str) -> list:
    """Up to 1023 cuts between ranges of about as many rows: quantiles of numbers, for texts those of the ``SAMPLE`` rows of least hash."""
    if df.schema[column].dataType.simpleString() != "string":
        return df.select(F.percentile_approx(column, [i / 1024 for i in range(1, 1024)], 10_000)).first()[0] or []
    spread = F.xxhash64(*df.columns) if all(not f.dataType.simpleString().startswith("map") for f in df.schema) else F.xxhash64(column)
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__k"), spread.alias("__h")).orderBy("__h").limit(SAMPLE).select("__k").collect()
    keys = sorted(r["__k"].encode() for r in rows)  # the order of UTF-8 bytes, as Spark's
    step = max(1, -(-len(keys) // 1024))
    return [k.decode() for k in keys[step::step]][:1023]


def range_of(df: DataFrame, column: str) -> Column:
    """The number of a row's range of ``column``, ascending, of up to 1024 ranges. A range is found in two steps of 32 comparisons."""
    value = F.col(column)
    cuts = _cuts(df, column)
    if not cuts:
        return F.lit(0)
    below = lambda cs: F.size(F.filter(cs, lambda c: c < value))
    literal = lambda cs: F.array(*(F.lit(c) for c in cs))
    cuts = cuts + [cuts[-1]] * (1023 - len(cuts))
    coarse = below(literal(cuts[31::32]))
    fine = F.array(*(literal(cuts[i : i + 31]) for i in range(0, 1024, 32)))
    return F.coalesce(coarse * 32 + below(F.get(fine, coarse)), F.lit(-1))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, ranges: Column | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in ascending ``order``.

    Ranges of the first sort column are summed alone and start where the sums of those before
    them end, so the only window over all is over a row for each range.  ``ranges`` gives them where they are known,
    ascending with the first sort column.
    """
    rows = df.withColumn("__b", range_of(df, order[0]) if ranges is None else ranges).withColumn("__v", value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("__b").alias("__c")).agg(F.sum("__v").alias("__n")).select("__c", F.coalesce(F.sum("__n").over(before(Window.orderBy("__c"))), F.lit(0)).alias("__before"))
    own = rows.withColumn("__at", F.coalesce(F.sum("__v").over(before(Window.partitionBy("__b").orderBy(*order))), F.lit(0)))
    return own.join(sums, F.col("__b").eqNullSafe(F.col("__c"))).withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__b", "__c", "__v", "__at", "__before")


def global_position(df: DataFrame, order: list[str], name: str = "pos", ranges: Column | None = None) -> DataFrame:
    """Adds 0, 1, ... in ascending ``order`` over all rows."""
    return running_sum(df, order, F.lit(1), name, ranges)


def shuffled(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Positions of a permutation that any engine can repeat: by md5 of the key, whose first digits are ranges of like size."""
    return global_position(df.withColumn("__h", F.md5(F.col(key).cast("string").cast("binary"))), ["__h", key], name, F.substring("__h", 1, 3)).drop("__h")


def conversation_lengths(turns: DataFrame, has_image: Column, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """(conv, words, length: with image words, modality_length: negative without an image)."""
    rows = turns.groupBy(conv).agg(F.sum(word_count(F.col(text))).alias("words"))
    return rows.select(conv, "words", (F.col("words") + F.when(has_image, IMAGE_WORDS).otherwise(0)).alias("length"), F.when(has_image, F.col("words")).otherwise(-F.col("words")).alias("modality_length"))


def megabatches(df: DataFrame, size: int, key: str, length: str = "length") -> DataFrame:
    """Adds ``megabatch`` and ``rank``: shuffled rows in groups of ``size``, longest first in each."""
    rows = shuffled(df, key).withColumn("megabatch", F.floor(F.col("pos") / size).cast("long"))
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy("megabatch").orderBy(F.desc(length), "pos")) - 1).cast("long"))


def even_chunks(batches: DataFrame, chunks: int, key: str, length: str = "length") -> DataFrame:
    """Adds ``chunk`` and ``place`` in it: each row, longest first, to the lightest chunk that isn't full; strides where a megabatch doesn't divide.

    One fold over a megabatch, whose size is the caller's.
    """
    groups = batches.groupBy("megabatch").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(key).alias("key"), F.col(length).cast("double").alias("len")))).alias("rows"))
    n = F.size("rows")
    full = F.floor(n / chunks)
    zero = F.struct(F.array_repeat(F.lit(0.0), chunks).alias("load"), F.array_repeat(F.lit(0), chunks).alias("held"), F.array().cast("array<struct<key:bigint,chunk:bigint,place:bigint>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        c = (F.array_position(a["load"], F.array_min(a["load"])) - 1).cast("int")
        held = F.get(a["held"], c) + 1
        load = F.transform(a["load"], lambda x, i: F.when(i == c, F.when(held == full, F.lit(float("inf"))).otherwise(x + r["len"])).otherwise(x))
        return F.struct(load.alias("load"), F.transform(a["held"], lambda x, i: F.when(i == c, held).otherwise(x)).alias("held"), F.concat(a["out"], F.array(F.struct(r["key"].cast("long").alias("key"), c.cast("long").alias("chunk"), (held - 1).cast("long").alias("place")))).alias("out"))

    greedy = F.aggregate("rows", zero, step)["out"]
    stride = F.transform("rows", lambda r, i: F.struct(r["key"].cast("long").alias("key"), (i % chunks).cast("long").alias("chunk"), F.floor(i / chunks).cast("long").alias("place")))
    out = groups.select("megabatch", F.explode(F.when(n % chunks == 0, greedy).otherwise(stride)).alias("r"))
    return out.select("megabatch", F.col("r.key").alias(key), F.col("r.chunk").alias("chunk"), F.col("r.place").alias("place"))


def modality_order(df: DataFrame, size: int, chunks: int, key: str, length: str = "modality_length") -> DataFrame:
    """(key, section, megabatch, chunk, place): megabatches of one modality each; both last ones, full or not, are merged at the end in order of keys.

    With one modality alone, its megabatches are all there is.
    """
    kinds = []
    for kind, cond in (("image", F.col(length) > 0), ("text", F.col(length) < 0)):
        rows = df.where(cond).withColumn("length", F.abs(length))
        batched = even_chunks(megabatches(rows, size, key), chunks, key)
        kinds.append(batched.withColumn("kind", F.lit(kind)))
    both = kinds[0].unionByName(kinds[1])
    last = both.groupBy("kind").agg(F.max("megabatch").alias("last"))
    many = last.agg((F.count("*") > 1).alias("mixed"))
    rows = both.join(F.broadcast(last), "kind").crossJoin(F.broadcast(many))  # two rows and one row
    tail = F.col("mixed") & (F.col("megabatch") == F.col("last"))
    return rows.select(key, F.when(tail, "tail").otherwise(F.col("kind")).alias("section"), F.when(~tail, F.col("megabatch")).alias("megabatch"), F.when(~tail, F.col("chunk")).alias("chunk"), F.when(~tail, F.col("place")).alias("place"))
