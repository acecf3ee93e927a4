"""Colour profiles (ICC, matrix and curves) and pixels brought to sRGB.

A profile is parsed once, into three tables of 256 linear values and a matrix to XYZ; pixels meet these in a join by the profile's checksum, and the chain of table, matrix and
sRGB's curve is column expressions.  Profiles are few beside pixels, however many pictures there are, and the planner decides how they are joined.

Defined cases: a picture without a profile, or with one that is broken or no matrix profile, takes ``fallback``; colours outside sRGB are clipped; values round half up;
a null picture stays null.  The intent is relative colorimetric without black point compensation: white stays white.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .png import chunks

# Primaries at D50 (columns of XYZ for red, green, blue) and curves of sRGB and of Adobe RGB (1998).
SRGB = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
ADOBE = ((0.60974, 0.20528, 0.14919), (0.31111, 0.62567, 0.06322), (0.01947, 0.06087, 0.74457))
ADOBE_GAMMA = 563 / 256
SRGB_CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


def _fixed(data: bytes, at: int) -> float:
    return struct.unpack(">i", data[at : at + 4])[0] / 65536


def curve(data: bytes) -> np.ndarray:
    """256 linear values of a curve tag: a gamma, a table, or one of the parametric forms."""
    x = np.arange(256) / 255
    kind = data[:4]
    if kind == b"curv":
        n = struct.unpack(">I", data[8:12])[0]
        if n == 0:
            return x
        values = np.frombuffer(data[12 : 12 + 2 * n], dtype=">u2").astype(float)
        return x ** (values[0] / 256) if n == 1 else np.interp(x, np.arange(n) / (n - 1), values / 65535)
    if kind != b"para":
        raise ValueError(f"no such curve: {kind!r}")
    form = struct.unpack(">H", data[8:10])[0]
    count = (1, 3, 4, 5, 7)[form]
    g, a, b, c, d, e, f = ([_fixed(data, 12 + 4 * i) for i in range(count)] + [0.0] * 7)[:7]
    if form == 0:
        return x**g
    power = np.maximum(a * x + b, 0) ** g
    if form in (1, 2):  # c is added in form 2, to both parts
        return np.where(x >= -b / a, power, 0) + (c if form == 2 else 0)
    return np.where(x >= d, power + (e if form == 4 else 0), c * x + (f if form == 4 else 0))


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((3, 256) linear values, 3 x 3 matrix to XYZ) of an RGB matrix profile."""
    if len(data) < 132 or data[36:40] != b"acsp" or data[16:20] != b"RGB " or data[20:24] != b"XYZ ":
        raise ValueError("no RGB matrix profile")
    tags = {}
    for i in range(struct.unpack(">I", data[128:132])[0]):
        name, at, size = struct.unpack(">4sII", data[132 + 12 * i : 144 + 12 * i])
        tags[name] = data[at : at + size]
    columns = []
    for c in (b"r", b"g", b"b"):
        xyz = tags[c + b"XYZ"]
        if xyz[:4] != b"XYZ " or len(xyz) < 20:
            raise ValueError("a primary is broken")
        columns.append([_fixed(xyz, 8 + 4 * i) for i in range(3)])
    return np.array([curve(tags[c + b"TRC"]) for c in (b"r", b"g", b"b")]), np.array(columns).T


def build(primaries: Sequence[Sequence[float]], curves: Sequence[bytes]) -> bytes:
    """A profile of primaries (as ``SRGB``) and three curve tags."""
    fixed = lambda v: struct.pack(">i", round(v * 65536))
    tags = [(c + b"XYZ", b"XYZ \0\0\0\0" + b"".join(fixed(row[i]) for row in primaries)) for i, c in enumerate((b"r", b"g", b"b"))]
    tags += [(c + b"TRC", t) for c, t in zip((b"r", b"g", b"b"), curves, strict=True)]
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, data in tags:
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    head = struct.pack(">I", at + len(body)) + b"\0" * 8 + b"mntrRGB XYZ " + b"\0" * 12 + b"acsp"
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + table + body


def gamma_tag(gamma: float) -> bytes:
    return b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256))


def profile_of_png(data: bytes) -> bytes | None:
    """The profile that a PNG carries."""
    for kind, body in chunks(data):
        if kind == b"iCCP":
            return zlib.decompress(body[body.index(b"\0") + 2 :])
    return None


def with_profile(data: bytes, profile: bytes) -> bytes:
    """A PNG with a profile behind its header."""
    body = b"icc\0\0" + zlib.compress(profile)
    return data[:33] + struct.pack(">I", len(body)) + b"iCCP" + body + struct.pack(">I", zlib.crc32(b"iCCP" + body)) + data[33:]


def _tables(profiles: DataFrame, fallback: bytes) -> DataFrame:
    """(profile, curves array of three arrays, m array of nine: to linear sRGB) of distinct (profile md5, icc)."""
    inverse = np.linalg.inv(np.array(SRGB))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves, mats = [], []
            for data in batch.column(1).to_pylist():
                try:
                    c, m = parse(data or b"")
                except (ValueError, KeyError, IndexError, struct.error):
                    c, m = parse(fallback)
                curves.append(c.tolist())
                mats.append((inverse @ m).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curves, pa.list_(pa.list_(pa.float64()))), pa.array(mats, pa.list_(pa.float64()))], names=["profile", "curves", "m"])

    return profiles.mapInArrow(read, "profile string, curves array<array<double>>, m array<double>")


def srgb_byte(linear: Column) -> Column:
    """A linear value, clipped, on sRGB's curve as 0 to 255."""
    v = F.least(F.greatest(linear, F.lit(0.0)), F.lit(1.0))
    return F.floor(F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055) * 255 + 0.5).cast("long")


def to_srgb(pixels: DataFrame, profiles: DataFrame, fallback: bytes, rgb: str = "rgb") -> DataFrame:
    """``pixels`` (profile, rgb array of 0 to 255, ...) with ``rgb`` in sRGB. ``profiles``: profile (its md5, or '' for none), icc."""
    known = _tables(profiles.select("profile", "icc").dropDuplicates(["profile"]), fallback).withColumnRenamed("profile", "__profile")
    rows = pixels.join(known, F.coalesce("profile", F.lit("")) == F.col("__profile"), "left")
    linear = [F.get(F.get("curves", F.lit(i)), F.get(rgb, F.lit(i)).cast("int")) for i in range(3)]
    rows = rows.withColumn("__l", F.array(*linear))
    out = [srgb_byte(sum((F.get("__l", F.lit(i)) * F.get("m", F.lit(3 * k + i)) for i in range(3)), F.lit(0.0))) for k in range(3)]
    return rows.withColumn(rgb, F.when(F.col(rgb).isNotNull(), F.array(*out))).drop("__profile", "curves", "m", "__l")


def profiles_of(pictures: DataFrame, name: str = "name", content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """(name, profile, icc, columns of ``keep``) of PNGs: the profile's md5, '' where there is none."""
    kind = pictures.schema[name].dataType.simpleString()
    kept = [f"__{c}" for c in keep]
    more = "".join(f", __{c} {pictures.schema[c].dataType.simpleString()}" for c in keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(None if data is None else profile_of_png(data))
                except (ValueError, zlib.error, struct.error):
                    found.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], names=[name, "icc", *kept])

    own = pictures.select(name, content, *(F.col(c).alias(f"__{c}") for c in keep)).mapInArrow(read, f"{name} {kind}, icc binary{more}")
    return own.select(name, F.coalesce(F.md5("icc"), F.lit("")).alias("profile"), "icc", *(F.col(f"__{c}").alias(c) for c in keep))
