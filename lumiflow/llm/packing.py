"""Packing documents into sequences of equal length by shortest-pack-first over a length histogram.

Documents are cut into pieces of ``capacity`` tokens and a rest, so a piece's checksum needs
no knowledge of the packing and token ids are made once and never shuffled.  The histogram
of piece lengths has at most ``capacity`` rows whatever the table's size; the driver packs
it, not the documents: lengths are placed longest first, each onto the shortest packs that
have room, and packs with the same content are one pattern with a count.  A pattern takes a
run of ranks of each of its lengths, and pieces find their pattern by length and rank.

The pattern table has one row per pattern and distinct length in it.  Each step of the
planner ends a length or uses up a pattern, so there are at most 2 x capacity patterns with
below sqrt(2 x capacity) distinct lengths each: 262,000 rows for 2048, a bound that doesn't grow with
the data.  It is broadcast for that reason.

Defined cases: null and empty texts are one piece, the end id alone; a null id is kept;
repeated rows are packed each; very long texts become many pieces; an empty table gives no
sequence; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import gapless_rank
from .shared import stored
from .tokens import default_tokenizer, encoder
from .words import slices

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents: at most ``capacity`` ids, in order, each id in one piece."""
    from .words import texts_column

    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts_column(part, "text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        piece = ids[4 * at : 4 * (at + capacity)]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        kept.append(piece if with_ids else None)
                yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(kept, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(pieces, PIECES.format(id=kind))
    return out if with_ids else out.drop("ids")


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, packs)]: a pattern is ((length, copies), ...) in the order of its places.

    Longest lengths first; each goes onto the shortest open packs with room, all packs of a
    pattern at once, and opens packs filled with itself when none has room.
    """
    by_fill: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    fills: list[int] = []

    def put(pattern, packs, fill) -> None:
        if fill not in by_fill:
            by_fill[fill] = []
            heapq.heappush(fills, fill)
        by_fill[fill].append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left and fills and fills[0] + length <= capacity:
            fill = fills[0]
            pattern, packs = by_fill[fill].pop()
            if not by_fill[fill]:
                del by_fill[fill]
                heapq.heappop(fills)
            used = min(packs, left)
            if used < packs:
                put(pattern, packs - used, fill)
            more = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(more, used, fill + length)
            left -= used
        if left:
            each = capacity // length
            if left >= each:
                put(((length, each),), left // each, each * length)
            if left % each:
                put(((length, left % each),), 1, left % each * length)
    return [x for fill in sorted(by_fill) for x in by_fill[fill]]


def pattern_rows(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, copies, offset, first sequence) of each length in each pattern."""
    rows, rank, first = [], {}, 0
    for pattern, packs in patterns:
        at = 0
        for length, copies in pattern:
            lo = rank.get(length, 0)
            rank[length] = lo + copies * packs
            rows.append((length, lo, rank[length], copies, at, first))
            at += copies * length
        first += packs
    return rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: where its ids lie in its document and in which sequence at which offset."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(cut_pieces(own, tokenizer or default_tokenizer(), end_id, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = docs.sparkSession.createDataFrame(pattern_rows(plan_packs(histogram, capacity)), "p_length long, lo long, hi long, copies long, at long, first long")
    ranked = gapless_rank(pieces, "length", ["doc_id", "start", "ids_crc32"])
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def packed_sequences(docs: DataFrame, pad_id: int = 0, capacity: int = 2048, **options) -> DataFrame:
    """The sequences themselves: (sequence_id, input_ids binary of u32, n_tokens, doc_starts).  A group holds one sequence, capacity ids at most."""
    pieces = pack_documents(docs, capacity=capacity, with_ids=True, **options)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    pad = pad_id.to_bytes(4, "little")

    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))
    gaps = F.lit(capacity) - F.expr("aggregate(p, 0L, (a, x) -> a + x.length)")
    return rows.select(
        "sequence_id",
        F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("body"),
        gaps.alias("n_pad"),
        F.expr(f"transform(p, x -> struct(x.offset as offset, cast(x.doc_id as {kind}) as doc_id))").alias("doc_starts"),
    ).select("sequence_id", F.concat("body", F.unhex(F.repeat(F.lit(pad.hex()), F.col("n_pad").cast("int")))).alias("input_ids"), (F.lit(capacity) - F.col("n_pad")).alias("n_tokens"), "doc_starts")
