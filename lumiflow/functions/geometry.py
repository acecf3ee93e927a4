"""Sizes, paddings and tiles of images, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Candidate resolutions (width, height) of tiled images, and the model's tile.
RESOLUTIONS = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))
TILE = 336


def _int(c: Column) -> Column:
    return c.cast("int")


def short_edge(w: Column, h: Column, edge: int = 512) -> tuple[Column, Column]:
    """Size with the shorter edge at ``edge``; the other is cut to an integer. Equal edges go by the width."""
    return F.when(w <= h, F.lit(edge)).otherwise(_int(w * (F.lit(float(edge)) / h))), F.when(w <= h, _int(h * (F.lit(float(edge)) / w))).otherwise(F.lit(edge))


def fit(w: Column, h: Column, to_w: Column, to_h: Column) -> dict[str, Column]:
    """Resize into a box by the tighter scale (rounded up, capped) and centre."""
    sw, sh = to_w / w, to_h / h
    new_w = F.when(sw < sh, to_w).otherwise(F.least(_int(F.ceil(w * sh)), to_w))
    new_h = F.when(sw < sh, F.least(_int(F.ceil(h * sw)), to_h)).otherwise(to_h)
    return {"new_w": _int(new_w), "new_h": _int(new_h), "paste_x": _int(F.floor((to_w - new_w) / 2)), "paste_y": _int(F.floor((to_h - new_h) / 2))}


def resolution_fit(w: Column, h: Column, to_w: Column, to_h: Column) -> tuple[Column, Column]:
    """(effective pixels, wasted pixels) of an image in a candidate resolution."""
    scale = F.least(to_w / w, to_h / h)
    effective = F.least(_int(w * scale) * _int(h * scale), w * h)
    return effective.cast("long"), (to_w * to_h - effective).cast("long")


def best_resolution(w: Column, h: Column, candidates=RESOLUTIONS) -> Column:
    """struct<w, h> of the candidate with most effective pixels, then least waste, then the first in the list; null if none holds a pixel."""
    ranked = []
    for i, (cw, ch) in enumerate(candidates):
        effective, waste = resolution_fit(w, h, F.lit(cw), F.lit(ch))
        ranked.append(F.struct((-effective).alias("e"), waste.alias("waste"), F.lit(i).alias("i"), F.struct(F.lit(cw).alias("w"), F.lit(ch).alias("h")).alias("size")))
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    return F.when(best["e"] < 0, best["size"])


def tiles(w: Column, h: Column, size: int) -> Column:
    """array<struct<x0, y0, x1, y1>>, row by row; tiles at the far edges run over."""
    steps = lambda n: F.sequence(F.lit(0), n - 1, F.lit(size))
    return F.flatten(F.transform(steps(h), lambda y: F.transform(steps(w), lambda x: F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1")))))


def grid_shape(w: Column, h: Column, patch: int = TILE, candidates=RESOLUTIONS) -> tuple[Column, Column]:
    best = best_resolution(w, h, candidates)
    return _int(F.floor(best["w"] / patch)), _int(F.floor(best["h"] / patch))


def square(w: Column, h: Column) -> tuple[Column, Column, Column]:
    """(side, x, y) of an image centred on a square."""
    side = F.greatest(w, h)
    return side, _int(F.floor((side - w) / 2)), _int(F.floor((side - h) / 2))


def serving_size(w: Column, h: Column, longest: int = 1344, shortest: int = 672) -> tuple[Column, Column]:
    """Size sent to a server: larger images shrink until the long edge fits and the short edge is below its limit."""
    hi, lo = F.greatest(w, h), F.least(w, h)
    ratio = hi / lo
    low = _int(F.least(F.lit(float(longest)) / ratio, F.lit(float(shortest)), lo.cast("double")))
    high = _int(low * ratio)
    big = hi > longest
    return F.when(big, F.when(h > w, low).otherwise(high)).otherwise(w), F.when(big, F.when(h > w, high).otherwise(low)).otherwise(h)


def unpad_window(now_w: Column, now_h: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) of the original image inside a padded one."""
    wide = (w / h) > (now_w / now_h)
    pad_y = _int(F.floor((now_h - _int(h * (now_w / w))) / 2))
    pad_x = _int(F.floor((now_w - _int(w * (now_h / h))) / 2))
    zero = F.lit(0)
    return F.when(wide, zero).otherwise(pad_x), F.when(wide, pad_y).otherwise(zero), F.when(wide, now_w).otherwise(now_w - pad_x), F.when(wide, now_h - pad_y).otherwise(now_h)


def merged_features(features: Column, side: int, grid_w: Column, grid_h: Column, w: Column, h: Column, newline: Column) -> Column:
    """Patch features of a picture in reading order: the thumbnail's ``side`` x ``side``, then the tiles' as one grid, cropped to the picture's shape, each line ended by ``newline``.

    ``features`` has the thumbnail first, then tiles row by row, each row by row.
    """
    x0, y0, x1, y1 = unpad_window(grid_w * side, grid_h * side, w, h)
    half = lambda v: F.floor(v / side).cast("int")
    at = lambda y, x: side * side * (1 + half(y) * grid_w + half(x)) + (y % side) * side + x % side
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    line = lambda y: F.concat(F.transform(upto(x0, x1), lambda x: F.get(features, at(y, x).cast("int"))), F.array(newline))
    return F.concat(F.slice(features, 1, side * side), F.flatten(F.transform(upto(y0, y1), line)))


def normalised(pixel: Column) -> Column:
    """A byte in [-1, 1]."""
    return (pixel / 255.0 - 0.5) * 2


def to_byte(value: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clipped, scaled and rounded half to even."""
    scaled = (F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo)
    return F.rint(scaled * 255.0).cast("int")
