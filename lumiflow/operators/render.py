"""Per-pixel colour transforms with weights as data.

A pixel is a row, so a picture is rendered by as many tasks as it has partitions and chunked
rendering is the same as whole.  The conditioning vector of a picture is projected once per
picture.  Small networks are higher-order functions inside one stage; ``wide_pixels`` is numpy
over Arrow batches for wide ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, weight: Matrix, bias: Sequence[float]) -> Column:
    """weight x + bias; weight has a row for each output."""
    return F.array(*(dot(x, vector(row)) + F.lit(float(b)) for row, b in zip(weight, bias, strict=True)))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def hard_sigmoid(v: Column) -> Column:
    return F.least(F.greatest(v / 6.0 + 0.5, F.lit(0.0)), F.lit(1.0))


def hard_tanh(v: Column) -> Column:
    """Clipped to [-1, 1], stretched by 1.1 and moved to [-0.05, 1.05]."""
    return (F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * 1.1 + 1.0) * 0.5


ACTIVATIONS = {"none": lambda v: v, "sigmoid": sigmoid, "hard_sigmoid": hard_sigmoid, "hard_tanh": hard_tanh}


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` made once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """By mean and biased variance, which are made once for a vector: the mean first, then the squares of what lies off it, so a large mean costs no digits."""
    n = F.size(x).cast("double")
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n

    def around(m: Column) -> Column:
        spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / n + eps)
        return bound(spread, lambda d: F.transform(x, lambda v: (v - m) / d))

    return bound(mean, around)


def condition(x: Column, k: Column, method: str, weights: Attention | None = None) -> Column:
    """Join a pixel's features with a picture's projected vector, or by ``cross_attn`` with its vectors ``k``."""
    if method == "add":
        return F.zip_with(x, k, lambda a, b: a + b)
    if method == "cat":
        return F.concat(x, k)
    if method == "adain":
        n = F.size(x)
        return F.zip_with(F.zip_with(x, F.slice(k, F.lit(1), n), lambda a, s: a * (1.0 + s)), F.slice(k, n + 1, n), lambda a, s: a + s)
    if method == "cross_attn":
        return F.zip_with(x, cross_attention(x, k, weights), lambda a, b: a + b)
    raise ValueError(f"no such condition: {method}")


def attention(query: Column, keys: Column, values: Column) -> Column:
    """Softmax of scaled products with ``keys`` (array<array<double>>), applied to ``values``."""
    scores = F.transform(keys, lambda k: dot(query, k) / F.sqrt(F.size(query).cast("double")))
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    zero = F.transform(values[0], lambda v: F.lit(0.0))
    return F.aggregate(F.zip_with(weights, values, lambda w, v: F.transform(v, lambda x: w * x / total)), zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q))


@dataclass(frozen=True)
class Attention:
    """(weight, bias) of query, key, value and output, and the number of heads."""

    query: tuple[Matrix, Sequence[float]]
    key: tuple[Matrix, Sequence[float]]
    value: tuple[Matrix, Sequence[float]]
    out: tuple[Matrix, Sequence[float]]
    heads: int


def cross_attention(x: Column, vectors: Column, w: Attention) -> Column:
    """Attention of a pixel's features to a picture's normed vectors (array<array<double>>), head by head, projected back."""
    normed = F.transform(vectors, lambda t: layer_norm(t))
    made = F.struct(linear(x, *w.query).alias("q"), F.transform(normed, lambda t: linear(t, *w.key)).alias("k"), F.transform(normed, lambda t: linear(t, *w.value)).alias("v"))
    width = len(w.query[1]) // w.heads

    def head(m: Column, h: int) -> Column:
        part = lambda c: F.slice(c, h * width + 1, width)
        return attention(part(m["q"]), F.transform(m["k"], part), F.transform(m["v"], part))

    joined = lambda m: F.concat(*(head(m, h) for h in range(w.heads)))
    return bound(bound(made, joined), lambda o: linear(o, *w.out))


def delta_features(before: Column, after: Column, eps: float = 1e-6) -> tuple[Column, Column]:
    """(difference, ratio) of two pixel vectors."""
    return F.zip_with(before, after, lambda a, b: b - a), F.zip_with(before, after, lambda a, b: b / (a + eps))


def masked_latent(latent: Column, mask: Column, width: int) -> Column:
    """Each of the mask's flags scales its ``width`` values of the latent."""
    return F.transform(latent, lambda x, i: x * F.get(mask, F.floor(i / width).cast("int")))


#: Widths up to which a layer's values are columns of their own, which Spark compiles; wider ones are arrays.
SCALARS = 16


def _scalar_mlp(pixels: DataFrame, layers, out, act: str, rgb: str, conditions) -> DataFrame:
    """``pixel_mlp`` with a column for each value; each projection is made once."""
    total = lambda cols: sum(cols[1:], cols[0])
    rows, x, made = pixels, [F.get(rgb, F.lit(j)) for j in range(len(layers[0][0][0]))], []

    def named(prefix: str, values: list[Column]) -> list[Column]:
        nonlocal rows
        names = [f"__{prefix}{i}" for i in range(len(values))]
        rows = rows.withColumns(dict(zip(names, values, strict=True)))
        made.extend(names)
        return [F.col(n) for n in names]

    for k, (weight, bias) in enumerate(layers):
        n = len(bias)
        h = named(f"h{k}_", [F.greatest(total([v * float(w) for v, w in zip(x, row, strict=True)]) + float(b), F.lit(0.0)) for row, b in zip(weight, bias, strict=True)])
        (mean,) = named(f"m{k}_", [total(h) / n])
        (spread,) = named(f"s{k}_", [F.sqrt(total([(v - mean) * (v - mean) for v in h]) / n + 1e-5)])
        x = [(v - mean) / spread for v in h]
        if k < len(conditions):
            method, column = conditions[k]
            at = lambda i, c=column: F.get(c, F.lit(i))
            if method == "add":
                x = [v + at(i) for i, v in enumerate(x)]
            elif method == "adain":
                x = [v * (1.0 + at(i)) + at(n + i) for i, v in enumerate(x)]
            else:  # cat: as many values as the next layer takes
                following = layers[k + 1][0] if k + 1 < len(layers) else out[0]
                x = [*x, *(at(i) for i in range(len(following[0]) - n))]
        x = named(f"x{k}_", x)
    y = [total([v * float(w) for v, w in zip(x, row, strict=True)]) + float(b) for row, b in zip(*out, strict=True)]
    y = named("y", y)
    return rows.withColumn("out", F.array(*(ACTIVATIONS[act](v) for v in y))).drop(*made)


def pixel_mlp(pixels: DataFrame, layers: Sequence[tuple[Matrix, Sequence[float]]], out: tuple[Matrix, Sequence[float]], act: str = "sigmoid", rgb: str = "rgb", conditions: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds ``out`` to pixel rows; ``conditions`` gives for each layer the method and the column with the projected vector.

    Layers are projections one after the other, so each one's values are made once.
    """
    if max(len(bias) for _, bias in (*layers, out)) <= SCALARS and all(m in ("add", "cat", "adain") for m, _ in conditions):
        return _scalar_mlp(pixels, layers, out, act, rgb, conditions)
    rows = pixels.withColumn("__x", F.col(rgb))
    for i, (weight, bias) in enumerate(layers):
        rows = rows.withColumn("__h", relu(linear(F.col("__x"), weight, bias))).withColumn("__x", layer_norm(F.col("__h")))
        if i < len(conditions):
            method, column = conditions[i]
            rows = rows.withColumn("__x", condition(F.col("__x"), F.col(column), method))
    final = ACTIVATIONS[act]
    return rows.withColumn("out", F.transform(linear(F.col("__x"), *out), final)).drop("__x", "__h")


WIDE_ACTIVATIONS = {"none": lambda v: v, "sigmoid": lambda v: 1 / (1 + np.exp(-v)), "hard_sigmoid": lambda v: np.clip(v / 6 + 0.5, 0, 1), "hard_tanh": lambda v: (np.clip(v, -1, 1) * 1.1 + 1) * 0.5}


def _normed(x: np.ndarray) -> np.ndarray:
    """Rectified rows with mean 0 and variance 1."""
    x = np.maximum(x, 0)
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)


def wide_pixels(pixels: DataFrame, layers, out, act: str = "sigmoid") -> DataFrame:
    """(image_id, px, out) as ``pixel_mlp`` gives it without conditions, by matrix products over Arrow batches."""
    mats = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]
    last = tuple(np.asarray(x, dtype=float) for x in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for w, b in mats:
                x = _normed(x @ w.T + b)
            y = WIDE_ACTIVATIONS[act](x @ last[0].T + last[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))], names=["image_id", "px", "out"])

    return pixels.select("image_id", "px", "rgb").mapInArrow(run, "image_id long, px long, out array<double>")


#: Pixels in a row of a tile, and pixels whose features are in memory at once.
TILE, AT_ONCE = 256, 32_768


def wide_renderer(pixels: DataFrame, latents: DataFrame, layers, conditions, out, act: str = "sigmoid", image: str = "image_id", latent: str = "z") -> DataFrame:
    """(image_id, px, out) as ``pixel_mlp`` gives it with ``conditions`` at widths of networks in use, by matrix products over Arrow batches.

    ``conditions`` has for each layer the method (``add`` or ``adain``) and the weight and bias that project the rectified ``latent``;
    ``latents`` has a row an image, and pixels without one are left out.  Up to ``TILE`` neighbouring pixels share a row and its latent, so vectors aren't repeated a pixel
    and a large picture is spread over tasks; what a tile needs doesn't grow with the picture.
    """
    pair = lambda p: tuple(np.asarray(x, dtype=float) for x in p)
    mats = [(*pair(layer), method, *pair(projection)) for layer, (method, projection) in zip(layers, conditions, strict=True)]
    if {m for _, _, m, _, _ in mats} - {"add", "adain"}:
        raise ValueError("conditions are add or adain")
    last, final = pair(out), WIDE_ACTIVATIONS[act]

    def rendered(x: np.ndarray, z: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        z = np.maximum(z, 0)
        for w, b, method, wz, bz in mats:
            x = _normed(x @ w.T + b)
            k = np.repeat(z @ wz.T + bz, lengths, axis=0)
            n = x.shape[1]
            x = x + k if method == "add" else x * (1 + k[:, :n]) + k[:, n:]
        return final(x @ last[0].T + last[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, AT_ONCE // TILE)
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                ids, px, rgb, z = (batch.column(i) for i in range(4))
                lengths = np.diff(px.offsets.to_numpy())
                x = rgb.flatten().flatten().to_numpy(zero_copy_only=False).reshape(lengths.sum(), -1)
                y = rendered(x, z.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), lengths)
                result = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(batch.num_rows), lengths))), px.flatten(), result], names=["image_id", "px", "out"])

    tiles = pixels.groupBy(F.col(image).alias("image_id"), F.floor(F.col("px") / TILE).alias("tile")).agg(F.collect_list(F.struct("px", "rgb")).alias("p"))
    vectors = latents.select(F.col(image).alias("__image"), F.col(latent).alias("z"))
    rows = tiles.join(vectors, F.col("image_id") == F.col("__image")).select("image_id", "p.px", "p.rgb", "z")
    return rows.mapInArrow(run, "image_id long, px long, out array<double>")


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function at x, by the series of the error function whose terms are all positive."""
    y = np.minimum(np.abs(x) / np.sqrt(2.0), 6.0)
    term, total, n = y.copy(), y.copy(), 1
    while term.size and term.max() > 1e-18:
        term = term * (2 * y * y / (2 * n + 1))
        total += term
        n += 1
    return 0.5 * x * (1 + np.sign(x) * (2 / np.sqrt(np.pi)) * np.exp(-y * y) * total)


def latent_head(rows: DataFrame, layers: Sequence[tuple[Matrix, Sequence[float]]], out: tuple[Matrix, Sequence[float]], id_col: str, latent: str) -> DataFrame:
    """(id, out): every layer linear, normed, then GELU; ``out`` linear. Matrix products over Arrow batches, for latents of any width."""
    mats = [tuple(np.asarray(x, dtype=float) for x in layer) for layer in (*layers, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, mats[0][0].shape[1])
            for w, b in mats[:-1]:
                x = x @ w.T + b
                x = gelu((x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5))
            y = x @ mats[-1][0].T + mats[-1][1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))], names=[id_col, "out"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(latent).cast("array<double>")).mapInArrow(run, f"{id_col} {kind}, out array<double>")


def special_latent(ids: Column, states: Column, tokens: Sequence[int]) -> Column:
    """The states at the first place of each of ``tokens`` in generated ``ids``, joined; null where one is missing."""
    return F.concat(*(F.get(states, (F.nullif(F.array_position(ids, t), F.lit(0)) - 1).cast("int")) for t in tokens))


def slider_prediction(latent: Column, weight: Matrix, bias: Sequence[float]) -> Column:
    """Sigmoids of a linear map of a latent."""
    return F.transform(linear(latent, weight, bias), sigmoid)


def projector_depth(kind: Column) -> Column:
    """Linear layers of a projector's name: linear 1, mlpNx_gelu N, identity 0, others null."""
    n = F.regexp_extract(kind, r"^mlp(\d+)x_gelu$", 1)
    return F.when(kind == "linear", 1).when(n != "", n.cast("int")).when(kind == "identity", 0)
