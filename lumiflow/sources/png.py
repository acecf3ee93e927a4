"""PNG pictures to pixels and back, over Arrow batches.

Scanline filters are undone by numpy: a run of differences to the left is a running sum, one to the row above an addition; averages and Paeth go byte by byte.

Defined cases: 8 bits a channel; grey becomes three equal channels, an alpha channel is dropped, palettes are looked up; a null picture gives nulls; anything
else (a checksum that is wrong, interlacing, other depths) fails, or gives nulls where ``strict`` is False.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARK = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes of pictures that go on together.
BATCH = 1 << 22


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of a file's chunks, checksums held against them."""
    if data[:8] != _MARK:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError("a chunk's checksum is wrong")
        yield kind, body
        at += 12 + size


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above-left the one nearest to left + above - above-left."""
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels (width, channels) of a filtered row and the row above."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError(f"no such filter: {kind}")
    n = row.shape[1]
    out, up = bytearray(n), bytes(n) + above.tobytes()  # byte by byte: a numpy call a pixel takes many times as long
    for i, x in enumerate(row.tobytes()):
        a, b = out[i], up[i + n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out.append((x + guess) & 255)
    return np.frombuffer(bytes(out[n:]), dtype=np.uint8).reshape(row.shape)


def _filter(kind: int, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The inverse of ``_unfilter``, for rows (rows, width, channels) at a time."""
    left, corner = np.zeros_like(rows), np.zeros_like(above)
    left[:, 1:], corner[:, 1:] = rows[:, :-1], above[:, :-1]
    if kind == 4:
        guess = _paeth(*(x.astype(np.int64) for x in (left, above, corner))).astype(np.uint8)
    else:
        guess = (np.zeros_like(rows), left, above, ((left.astype(np.int64) + above) // 2).astype(np.uint8))[kind]
    return rows - guess


def encode(pixels: np.ndarray, filters: Sequence[int] = (0,), palette: bytes | None = None) -> bytes:
    """A PNG of (height, width, channels) bytes; rows take the filters in turn."""
    height, width, channels = pixels.shape
    above, lines = np.zeros_like(pixels), np.empty((height, 1 + width * channels), dtype=np.uint8)
    above[1:] = pixels[:-1]
    for k, kind in enumerate(filters):
        own = slice(k, None, len(filters))
        lines[own, 0], lines[own, 1:] = kind, _filter(kind, pixels[own], above[own]).reshape(-1, width * channels)
    colour = 3 if palette is not None else {n: c for c, n in CHANNELS.items() if c != 3}[channels]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    table = part(b"PLTE", palette) if palette is not None else b""
    return _MARK + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + table + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of a PNG."""
    found: dict[bytes, bytes] = {}
    for kind, body in chunks(data):
        found[kind] = found.get(kind, b"") + body
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if depth != 8 or laced or colour not in CHANNELS:
        raise ValueError("only 8-bit pictures without interlacing")
    n = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(found[b"IDAT"]), dtype=np.uint8).reshape(height, 1 + width * n)
    out = np.empty((height, width, n), dtype=np.uint8)
    above = np.zeros((width, n), dtype=np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:].reshape(width, n), above)
    if colour == 3:
        return np.frombuffer(found[b"PLTE"], dtype=np.uint8).reshape(-1, 3)[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if n < 3 else out[:, :, :3]


def decoded(pictures: DataFrame, name: str = "name", content: str = "content", strict: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(name, width, height, rgb binary, columns of ``keep``) of PNGs, given as bytes or in base64."""
    more = "".join(f", {c} {pictures.schema[c].dataType.simpleString()}" for c in keep)
    kind, text = pictures.schema[name].dataType.simpleString(), pictures.schema[content].dataType.simpleString() == "string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes, out = 0, [], []
            for i, data in enumerate(batch.column(1).to_pylist(), 1):
                try:
                    p = None if data is None else decode(base64.b64decode(data) if text else data)
                except (ValueError, KeyError, struct.error, zlib.error):
                    if strict:
                        raise
                    p = None
                sizes.append((None, None) if p is None else (p.shape[1], p.shape[0]))
                out.append(None if p is None else p.tobytes())
                if i == batch.num_rows or sum(len(o or b"") for o in out) > BATCH or len(out) == 64:  # pictures differ widely in size
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *(pa.array([s[k] for s in sizes], pa.int32()) for k in range(2)), pa.array(out, pa.binary()), *(batch.column(2 + k).slice(first, len(out)) for k in range(len(keep)))], names=[name, "width", "height", "rgb", *keep])
                    first, sizes, out = i, [], []

    return pictures.select(name, content, *keep).mapInArrow(read, f"{name} {kind}, width int, height int, rgb binary{more}")


def pixel_rows(pictures: DataFrame, name: str = "name", keep: Sequence[str] = ()) -> DataFrame:
    """(name, columns of ``keep``, px long, rgb array<long>) of (name, width, height, rgb binary): a row a pixel, none of null pictures."""
    held = [name, *keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(held)).to_pylist()):
                values = np.frombuffer(data or b"", dtype=np.uint8).astype(np.int64)
                for at in range(0, len(values) // 3, BATCH // 64):
                    own = values[at * 3 : at * 3 + BATCH // 64 * 3]
                    n = len(own) // 3
                    same = pa.array(np.full(n, i))
                    rgb = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.array(own))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(len(held))), pa.array(np.arange(at, at + n)), rgb], names=[*held, "px", "rgb"])

    kinds = "".join(f"{c} {pictures.schema[c].dataType.simpleString()}, " for c in held)
    return pictures.select(*held, "rgb").mapInArrow(rows, f"{kinds}px long, rgb array<long>")


def encoded(pictures: DataFrame, name: str = "name", filters: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """(name, content) PNGs of (name, width, height, rgb binary)."""
    kind = pictures.schema[name].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(np.frombuffer(rgb, dtype=np.uint8).reshape(h, w, 3), filters) for w, h, rgb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[name, "content"])

    return pictures.select(name, "width", "height", "rgb").mapInArrow(write, f"{name} {kind}, content binary")
