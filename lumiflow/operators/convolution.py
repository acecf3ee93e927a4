"""Kernels and pictures as tables: folded branches, and attention of a picture to its own pixels.

Kernels are long tables (layer, branch, out, in, ky, kx, w), so a weight of any size is spread by its keys.  Folding is algebra on them: a batch norm scales a
branch's kernel and gives a bias, smaller kernels are moved to the middle of a larger one, an identity is a one there, and branches are summed by place.

A window over pictures is a stencil: pixels go to the tile they lie in and to those whose border of ``reach`` holds them, so a tile of ``TILE`` pixels a side
has all it needs, whatever the picture's size.

Defined cases: pixels outside a picture count as zeros; branches that lack a layer add nothing; a picture of one pixel is a tile; missing batch norms leave
a branch as it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 32


def folded(kernels: DataFrame, norms: DataFrame, eps: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(kernels, biases): each branch with its batch norm in it. ``norms``: layer, branch, out, gamma, beta, mean, var."""
    keys = ["layer", "branch", "out"]
    scaled = norms.select(*keys, (F.col("gamma") / F.sqrt(F.col("var") + eps)).alias("s"), "beta", "mean")
    k = kernels.join(scaled, keys, "left").select(*keys, "in", "ky", "kx", (F.col("w") * F.coalesce("s", F.lit(1.0))).alias("w"))
    return k, scaled.select(*keys, (F.col("beta") - F.col("mean") * F.col("s")).alias("b"))


def identity_kernels(outs: DataFrame, channel: Column) -> DataFrame:
    """A 1 x 1 kernel that hands through ``channel`` of each (layer, out)."""
    return outs.select("layer", F.lit("identity").alias("branch"), "out", channel.alias("in"), F.lit(0).alias("ky"), F.lit(0).alias("kx"), F.lit(1.0).alias("w"))


def one_kernel(kernels: DataFrame, biases: DataFrame, sizes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """((layer, out, in, ky, kx, w), (layer, out, b)): branches of odd ``sizes`` moved to the middle of the largest and summed."""
    most = max(sizes.values())
    shift = F.coalesce(*(F.when(F.col("branch") == name, (most - n) // 2) for name, n in sizes.items()))
    moved = kernels.withColumns({"ky": F.col("ky") + shift, "kx": F.col("kx") + shift})
    return moved.groupBy("layer", "out", "in", "ky", "kx").agg(F.sum("w").alias("w")), biases.groupBy("layer", "out").agg(F.sum("b").alias("b"))


def applied(kernels: DataFrame, biases: DataFrame, inputs: DataFrame) -> DataFrame:
    """(layer, out, y): a kernel's sum over the window (layer, out, in, ky, kx, x) that each output sees, plus its bias."""
    sums = inputs.join(kernels, ["layer", "out", "in", "ky", "kx"]).groupBy("layer", "out").agg(F.sum(F.col("x") * F.col("w")).alias("y"))
    return sums.join(biases, ["layer", "out"], "left").select("layer", "out", (F.col("y") + F.coalesce("b", F.lit(0.0))).alias("y"))


def channel_gates(pixels: DataFrame, first: Sequence[Sequence[float]], second: Sequence[Sequence[float]]) -> DataFrame:
    """(image, gates): sigmoid of a small network of each channel's mean plus that of its maximum. ``pixels``: image, y, x, v (array of channels)."""
    channels = len(second)
    means = [F.avg(F.col("v")[c]).alias(f"m{c}") for c in range(channels)]
    tops = [F.max(F.col("v")[c]).alias(f"t{c}") for c in range(channels)]
    pools = pixels.groupBy("image").agg(*means, *tops)

    def network(prefix: str) -> list[Column]:
        hidden = [F.greatest(sum((F.col(f"{prefix}{c}") * float(w) for c, w in enumerate(row)), F.lit(0.0)), F.lit(0.0)) for row in first]
        return [sum((h * float(w) for h, w in zip(hidden, row, strict=True)), F.lit(0.0)) for row in second]

    return pools.select("image", F.array(*(1 / (1 + F.exp(-(a + b))) for a, b in zip(network("m"), network("t"), strict=True))).alias("gates"))


def stencil(maps: DataFrame, kernel: np.ndarray, tile: int = TILE, keep: Sequence[str] = ()) -> DataFrame:
    """(image, y, x, s, columns of ``keep``): windows of ``kernel`` (planes, k, k) over (image, y, x, planes array), zeros outside.

    Rows come in order of their tiles, so a task takes many tiles at a time and holds no more than a batch and one tile.
    """
    planes, size, _ = kernel.shape
    reach = size // 2
    side = tile + 2 * reach
    most = max(1, (1 << 20) // (side * side * planes))
    kinds = {c: maps.schema[c].dataType.simpleString() for c in ("image", *keep)}
    tiles = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + o) / tile) for o in ((-reach, 0, reach) if tile >= reach else range(-reach, reach + 1)))))
    rows = maps.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))
    own = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    rows = rows.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "planes", "ty", "tx", *(F.when(own, F.col(c)).alias(c) for c in keep))
    dealt = rows.repartition("image", "ty", "tx").sortWithinPartitions("image", "ty", "tx")

    def starts(t: pa.Table) -> np.ndarray:
        """Places at which a tile begins, and the number of rows."""
        image = t["image"].combine_chunks().dictionary_encode(null_encoding="encode").indices
        keys = [np.asarray(image), np.asarray(t["ty"].combine_chunks()), np.asarray(t["tx"].combine_chunks())]
        return np.r_[0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, t.num_rows]

    def windows(t: pa.Table, at: np.ndarray) -> pa.Table:
        y, x, ty, tx = (np.asarray(t[c].combine_chunks()) for c in ("y", "x", "ty", "tx"))
        group, gy, gx = np.repeat(np.arange(len(at) - 1), np.diff(at)), y - ty * tile + reach, x - tx * tile + reach
        grid = np.zeros((planes, len(at) - 1, side, side))
        grid[:, group, gy, gx] = np.asarray(t["planes"].combine_chunks().flatten()).reshape(-1, planes).T
        out = np.zeros((len(at) - 1, tile, tile))
        for plane in range(planes):
            for dy in range(size):
                for dx in range(size):
                    out += kernel[plane, dy, dx] * grid[plane, :, dy : dy + tile, dx : dx + tile]
        mine = np.flatnonzero((y // tile == ty) & (x // tile == tx))
        sums = pa.array(out[group[mine], gy[mine] - reach, gx[mine] - reach])
        return t.select(["image", "y", "x", *keep]).take(pa.array(mine)).add_column(3, "s", sums)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            at = starts(t)
            for i in range(0, len(at) - 2, most):  # the last tile may go on
                part = at[i : min(i + most, len(at) - 2) + 1]
                yield from windows(t.slice(part[0], part[-1] - part[0]), part - part[0]).to_batches()
            rest = t.slice(at[-2])
        if rest is not None and rest.num_rows:
            yield from windows(rest, np.array([0, rest.num_rows])).to_batches()

    return dealt.mapInArrow(walk, f"image {kinds['image']}, y long, x long, s double" + "".join(f", {c} {kinds[c]}" for c in keep))


def spatial_attention(pixels: DataFrame, kernel: np.ndarray, tile: int = TILE) -> DataFrame:
    """(image, y, x, v): pixels times the sigmoid of a window over their channels' mean and maximum."""
    n = F.size("v")
    maps = pixels.select("image", "y", "x", F.array(F.aggregate("v", F.lit(0.0), lambda s, v: s + v) / n, F.array_max("v")).alias("planes"), "v")
    return stencil(maps, kernel, tile, ["v"]).select("image", "y", "x", F.transform("v", lambda v: v / (1 + F.exp(-F.col("s")))).alias("v"))


def block_attention_module(pixels: DataFrame, first: Sequence[Sequence[float]], second: Sequence[Sequence[float]], kernel: np.ndarray, tile: int = TILE) -> DataFrame:
    """Channels weighed by picture, then pixels by their surroundings."""
    gates = channel_gates(pixels, first, second)
    weighed = pixels.join(gates, "image").select("image", "y", "x", F.zip_with("v", "gates", lambda v, g: v * g).alias("v"))
    return spatial_attention(weighed, kernel, tile)
