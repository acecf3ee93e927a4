"""Scan of large JSON arrays in which every file block is a task.

A JSON array of records can't be cut at lines, as a record may hold line breaks or the array none.  It can be cut behind ``}``: the text source
splits files at any separator, and no escape sequence contains that byte.  What a block can't know is whether it begins inside a string, and how deep.  So the scan runs twice:

1. every block counts its unescaped quotes, and its change of depth for both cases (it begins inside a string or outside);
2. running sums over a file's blocks (a row each) give the state in which each block begins;
3. every block emits the records that lie in it, and the pieces of those that cross a border, which are joined by the record they belong to.

The first scan gives a row a block, so nothing grows on the driver or in a task but the longest record.

Defined cases: an array of objects, objects one after the other (with or without line breaks), or one object; numbers, texts and nulls among the elements are passed over, an array fails; braces, quotes and escapes in strings don't matter, nor does a byte order mark;
an empty file or array has no records; a file that ends inside a record fails; compressed files are one task each, as their format can't be split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = ("file", "block")


def _blocks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, piece, size): texts between closing braces, in order within a block, and the bytes of the file."""
    pieces = spark.read.option("lineSep", "}").text(list(paths))
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"), F.col("_metadata.file_size").alias("size"))


def _bytes(pieces: list[str]) -> np.ndarray:
    """The pieces with their braces. The last piece of a file gets one that it may not have had, which ``block_states`` takes into account."""
    return np.frombuffer(("}".join(pieces) + "}").encode(), dtype=np.uint8)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes without an odd run of backslashes before them."""
    quote = data == 0x22
    slash = data == 0x5C
    if not slash.any():
        return quote
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(slash, -1, at))  # last byte that is no backslash
    run = np.zeros(len(data), dtype=np.int64)
    run[1:] = at[:-1] - other[:-1]
    return quote & (run % 2 == 0)


def _marks(data: np.ndarray) -> np.ndarray:
    """+1 for what opens, -1 for what closes, 0 for the rest."""
    step = np.zeros(256, dtype=np.int64)
    step[[0x7B, 0x5B]], step[[0x7D, 0x5D]] = 1, -1
    return step[data]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], int]]:
    """Pieces of each batch by the block they are in."""
    for batch in batches:
        files, blocks, pieces, sizes = (batch.column(i).to_pylist() for i in range(4))
        at = 0
        while at < len(pieces):
            to = at + 1
            while to < len(pieces) and blocks[to] == blocks[at] and files[to] == files[at]:
                to += 1
            yield files[at], blocks[at], pieces[at:to], sizes[at]
            at = to


def _counted(blocks: DataFrame) -> DataFrame:
    """(file, block, quotes, outside, inside, first, bytes, size): quotes of a block, its change of depth if it begins outside or inside a string, its first letter that isn't blank, its bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for file, block, pieces, size in _runs(batches):
            data = _bytes(pieces)
            quotes = np.cumsum(_quotes(data))
            odd, marks = quotes % 2, _marks(data)
            both = int(marks[odd == 0].sum()), int(marks[odd == 1].sum())
            own = held.setdefault((file, block), [0, 0, 0, "", 0, size])
            own[4] += len(data)
            flip = own[0] % 2
            own[1] += both[flip]
            own[2] += both[1 - flip]
            own[0] += int(quotes[-1])
            own[3] = own[3] or "".join(pieces).lstrip("﻿ \t\r\n")[:1]
        columns = [[k[0] for k in held], [k[1] for k in held], *([v[i] for v in held.values()] for i in range(6))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64()), strict=True)], names=[*_PLACE, "quotes", "outside", "inside", "first", "bytes", "size"])

    return blocks.mapInArrow(count, "file string, block long, quotes long, outside long, inside long, first string, bytes long, size long")


def block_states(counted: DataFrame) -> DataFrame:
    """(file, block, string, depth, base): the state before each block; records open at depth ``base``, which is 1 in an array. Fails where a file ends inside a string, array or record."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = counted.withColumn("string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("change", F.when(F.col("string"), F.col("inside")).otherwise(F.col("outside")))
    first = F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(whole)
    # 1 if the last piece got a brace; Hadoop's reader drops the three bytes of a byte order mark
    added = F.pmod(F.sum("bytes").over(whole) - F.col("size"), F.lit(3))
    ended = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum("change").over(whole) + added == 0)
    base = F.when(~ended, F.raise_error(F.concat(F.lit("a record or array without an end in "), "file")).cast("long")).when(first == "[", 1).otherwise(0).cast("long")
    return rows.select(*_PLACE, "string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), base.alias("base"))


def _cut(blocks: DataFrame) -> DataFrame:
    """(file, block, place, part, body): whole records (part 'all'), and the 'head', 'body' and 'tail' of those that cross a block's border.

    ``blocks`` has the states beside the pieces, in order within a block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict = {"at": None}

        def leave() -> None:
            """What a block leaves open goes on in the next one."""
            if state["at"] is not None and state["open"] is not None:
                text = b"".join(state["open"]).decode()
                out.append((*state["at"], state["place"], "head" if state["own"] else "body", text))

        for batch in batches:
            files, begun = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces, strings, depths, bases = (batch.column(i).to_pylist() for i in range(2, 6))
            at = 0
            while at < len(pieces):
                to = at + 1
                while to < len(pieces) and begun[to] == begun[at] and files[to] == files[at]:
                    to += 1
                if state["at"] != (files[at], begun[at]):
                    leave()
                    state = {"at": (files[at], begun[at]), "string": strings[at], "depth": depths[at], "base": bases[at], "place": 0, "own": False, "open": [] if depths[at] > bases[at] else None}
                data, base = _bytes(pieces[at:to]), state["base"]
                quoted = (np.cumsum(_quotes(data)) + state["string"]) % 2 == 1
                marks = np.where(quoted, 0, _marks(data))
                depth = state["depth"] + np.cumsum(marks)
                begins = np.flatnonzero((marks == 1) & (depth == base + 1) & (data == 0x7B))
                ends = np.flatnonzero((marks == -1) & (depth == base) & (data == 0x7D)) + 1
                raw = data.tobytes()
                if base and ((marks == 1) & (depth == base + 1) & (data == 0x5B)).any():
                    raise ValueError(f"an element of {files[at]} is an array")
                if state["open"] is not None:
                    state["open"].append(raw[: ends[0]] if len(ends) else raw)
                    if len(ends):
                        out.append((*state["at"], state["place"], "all" if state["own"] else "tail", b"".join(state["open"]).decode()))
                        state["place"] += 1
                        state["open"], ends = None, ends[1:]
                for b, e in zip(begins, ends, strict=False):
                    out.append((*state["at"], state["place"], "all", raw[b:e].decode()))
                    state["place"] += 1
                if len(begins) > len(ends):
                    state["open"], state["own"] = [raw[begins[-1] :]], True
                state["string"], state["depth"] = bool(quoted[-1]), int(depth[-1])
                at = to
            if out:
                yield _rows(out)
                out = []
        leave()
        if out:
            yield _rows(out)

    return blocks.mapInArrow(cut, "file string, block long, place long, part string, body string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[*_PLACE, "place", "part", "body"])


def _joined(parts: DataFrame) -> DataFrame:
    """Records of their head, bodies and tail in the blocks behind it."""
    order = Window.partitionBy("file").orderBy("block", F.col("part") != "tail")
    owner = F.last(F.when(F.col("part") == "head", F.col("block")), ignorenulls=True).over(order)
    last = F.last(F.when(F.col("part") == "head", F.col("place")), ignorenulls=True).over(order)
    rows = parts.withColumns({"owner": owner, "at": last})
    found = rows.groupBy("file", "owner").agg(F.first("at").alias("place"), F.bool_or(F.col("part") == "tail").alias("ended"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda p: p["body"]), "").alias("body"))
    whole = F.when(F.col("ended") & F.col("owner").isNotNull(), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("a record without an end in "), "file")))
    return found.select("file", F.col("owner").alias("block"), "place", whole.alias("body"))


def read_json_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, place, body): the text of each record; ascending (block, place) is the order in a file."""
    blocks = _blocks(spark, paths)
    states = block_states(_counted(blocks)).withColumnsRenamed({"file": "__file", "block": "__block"})
    # a row for each block of the scan, so a small fraction of any file; probing a broadcast keeps the order of the pieces
    placed = blocks.join(F.broadcast(states), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).select(*_PLACE, "piece", "string", "depth", "base")
    cut = _cut(placed)
    return cut.where("part = 'all'").drop("part").unionByName(_joined(cut.where("part <> 'all'")))


def read_json_array(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Records of ``schema`` with (file, block, place); a malformed one fails."""
    parsed = F.from_json("body", schema, {"mode": "FAILFAST"}).alias("r")
    return read_json_records(spark, paths).select(*_PLACE, "place", parsed).select(*_PLACE, "place", "r.*")


def write_json_array(records: DataFrame, folder: str, tasks: int | None = None) -> None:
    """Write a column of JSON texts as arrays, a file for each of ``tasks`` partitions, through Spark's committer."""
    rows = records.select(F.col(records.columns[0]).cast("string").alias("value"))
    rows = rows.repartition(tasks) if tasks else rows

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                out.append(f"{mark}{x}")
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], names=["value"])

    rows.mapInArrow(lines, "value string").write.text(folder)
