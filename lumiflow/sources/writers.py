"""Sinks: files by name, day-partitioned logs, content-addressed stores, weight tables.

All write through Spark's committers or, for files with names of their own, under the name of an
attempt that is then renamed, so retried tasks leave whole files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png_bytes(rgb: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGB picture in PNG's format, without filters."""
    if len(rgb) != 3 * width * height:
        raise ValueError("the pixels don't fill the picture")
    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, content binary) as files; returns (name, bytes). The folder must be one that executors share."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                mine = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(mine) as f:
                    f.write(content)
                system.move(mine, f"{base}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "content").mapInArrow(put, "name string, bytes long")


def write_png(images: DataFrame, folder: str) -> DataFrame:
    """Write (name, width, height, rgb binary) as ``name.png``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"name": [r["name"] + ".png" for r in rows], "content": [png_bytes(r["rgb"], r["width"], r["height"]) for r in rows]})

    return write_files(images.select("name", "width", "height", "rgb").mapInArrow(encode, "name string, content binary"), folder)


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, text) as ``name.txt`` in UTF-8."""
    return write_files(rows.select(F.concat("name", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content")), folder)


def append_log(events: DataFrame, folder: str, ts: str = "tstamp") -> None:
    """Append events as JSON lines, a folder for each day."""
    events.withColumn("day", F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(folder)


def log_name(ts):
    """Name of a day's log."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("-conv.json"))


def new_content(items: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """(md5, content): each distinct content that the store (md5) doesn't hold yet."""
    keyed = items.select(F.md5(content).alias("md5"), content).dropDuplicates(["md5"])
    return keyed.join(stored.select("md5").distinct(), "md5", "left_anti")


def write_weights(weights: DataFrame, folder: str) -> None:
    weights.write.mode("overwrite").parquet(folder)
