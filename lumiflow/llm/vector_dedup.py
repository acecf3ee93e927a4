"""Near-duplicate vectors by a pivot-permutation index, exact confirmation and union-find.

Index.  Pivots are vectors of a bounded sample (``SAMPLE`` distinct vectors of least hash, of which up to
``PIVOTS`` that lie apart are taken, so a crowd of copies gives one pivot).  A vector is described by the ``NEAREST`` pivots nearest to it, in order.  Inverted
lists are kept for pairs of pivots: a vector is in the lists of all pairs of its first ``LISTED`` pivots, so two vectors that share two of these meet.  Those that
share ``SHARED`` of all their ``NEAREST`` pivots are compared by cosine in double precision.  Every vector is indexed.  At a cosine of exactly 0.98 a pair in 64
dimensions is missed with probability 0.001 (measured on check_h); nothing below the limit is linked.

Groups of any size.  Equal vectors of one label are one class, so copies are never compared.  A list of more than ``BLOCK`` classes is dealt into blocks, and a task
compares two blocks: it gives a number of links for each class and a forest of them, never the pairs.  A pair that meets in several lists counts in the first of them.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing; so do rows with a null id, which have no component and are kept; vectors of different lengths aren't compared; where a length
has fewer than ``LEAST`` pivots, all its vectors of a label share one list, so the comparison is exact; rows that share an id are one vertex (the links of each row are counted for
itself, its component holds those of all); ids are integers (others raise ``TypeError``); an empty table gives no rows; extra columns don't matter.
Classes are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stored

SAMPLE, PIVOTS, APART, LEAST = 2048, 128, 0.7, 16
NEAREST, LISTED, SHARED = 8, 5, 4
#: Classes of a block; a task compares two.
BLOCK = 2000
_WORDS = PIVOTS // 64


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of each length among ``vectors``."""
    sizes = np.asarray(vectors.value_lengths())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, unit(np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), d))


def choose_pivots(vectors: list[list[float]]) -> dict[int, np.ndarray]:
    """Length -> unit pivots that lie apart, in the order of the sample."""
    out = {}
    for d in {len(v) for v in vectors}:
        chosen = np.zeros((0, d))
        for v in unit(np.array([x for x in vectors if len(x) == d])):
            if len(chosen) == PIVOTS:
                break
            if not len(chosen) or (chosen @ v).max() < APART:
                chosen = np.vstack([chosen, v])
        if len(chosen) >= LEAST:
            out[d] = chosen
    return out


def nearest(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, NEAREST) pivots of unit vectors, the nearest first."""
    return np.argsort(-(u @ pivots.T), axis=1, kind="stable")[:, :NEAREST]


def bits(lists: np.ndarray) -> np.ndarray:
    """(n, words) sets of pivots as 64-bit words."""
    out = np.zeros((len(lists), _WORDS), dtype=np.uint64)
    rows = np.arange(len(lists))
    for column in lists.T:
        out[rows, column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def _usable(v: str, label: str, key: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], single: bool) -> DataFrame:
    """f1, f2, u (the vector's bytes, in ``single`` precision where that is all it has), near and first (sets of pivots; null without pivots) of each class."""
    number = np.float32 if single else np.float64

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, u in _by_length(batch.column("v")):
                p = pivots.get(u.shape[1])
                lists = None if p is None else nearest(u, p)
                sets = [[None] * len(at)] * 2 if lists is None else [[x.tobytes() for x in bits(lists[:, :n])] for n in (NEAREST, LISTED)]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("label", "f1", "f2", "id", "copies")), pa.array([np.array(x, number).tobytes() for x in batch.column("v").take(rows).to_pylist()], pa.binary()), *(pa.array(x, pa.binary()) for x in sets)], names=["label", "f1", "f2", "id", "copies", "u", "near", "first"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(describe, f"label {kind}, f1 long, f2 long, id long, copies long, u binary, near binary, first binary")


def _listed(described: DataFrame) -> DataFrame:
    """(label, d, p, q, f1, f2): a row for each inverted list of a class, without its vector."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, p, q = [], [], []
            for i, x in enumerate(batch.column("first").to_pylist()):
                own = [] if x is None else np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).tolist()
                lists = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :]] or [(-1, -1)]
                rows += [i] * len(lists)
                p += [a for a, _ in lists]
                q += [b for _, b in lists]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("label", "d", "f1", "f2")), pa.array(p, pa.int32()), pa.array(q, pa.int32())], names=["label", "d", "f1", "f2", "p", "q"])

    kind = described.schema["label"].dataType.simpleString()
    return described.select("label", F.length("u").alias("d"), "f1", "f2", "first").mapInArrow(pairs, f"label {kind}, d int, f1 long, f2 long, p int, q int")


def _members(hits: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric matrix of links reaches."""
    low = np.arange(len(hits))
    while True:
        new = np.minimum(low, np.where(hits, low, len(hits)).min(axis=1, initial=len(hits)))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def compared(u: np.ndarray, near: np.ndarray | None, first: np.ndarray | None, p: int, q: int, across: np.ndarray | None, cosine: float) -> np.ndarray:
    """Matrix of the links that count in list (p, q): enough pivots shared, no list before this one, cosine reached. ``across``: block of each row, of which only pairs of two count."""
    n = len(u)
    ok = ~np.eye(n, dtype=bool) if across is None else across[:, None] != across[None, :]
    if near is not None:
        shared = np.zeros((n, n), dtype=np.uint8)
        for w in range(_WORDS):
            shared += np.bitwise_count(near[:, None, w] & near[None, :, w])
            both = first[:, None, w] & first[None, :, w]
            # of the first shared pivots only p lies before q
            below = (1 << min(64, max(0, q - 64 * w))) - 1
            ok &= (both & np.uint64(below)) == np.uint64((1 << (p - 64 * w)) if w == p // 64 else 0)
        ok &= shared >= SHARED
    return ok & (u @ u.T >= cosine) if ok.any() else ok


def _linked(groups: DataFrame, cosine: float, single: bool) -> DataFrame:
    """(f1, f2, links, id, root) of the classes with links in (label, d, p, q, i, j), sorted by these; root: smallest id reached inside the group."""
    keys = ["label", "d", "p", "q", "i", "j"]
    number = np.float32 if single else np.float64

    def one(rows: dict) -> pa.RecordBatch | None:
        n = len(rows["f1"])
        if n < 2:
            return None
        u = unit(np.frombuffer(b"".join(rows["u"]), number).reshape(n, -1).astype(np.float64))
        near, first = (None if rows[c][0] is None else np.frombuffer(b"".join(rows[c]), np.uint64).reshape(n, -1) for c in ("near", "first"))
        across = None if rows["i"][0] == rows["j"][0] else np.array(rows["own"])
        hits = compared(u, near, first, rows["p"][0], rows["q"][0], across, cosine)
        at = np.flatnonzero(hits.any(axis=1))
        if not len(at):
            return None
        ids = np.array(rows["id"])
        at = at[np.argsort(ids[at], kind="stable")]
        hits = hits[np.ix_(at, at)]
        links = hits @ np.array(rows["copies"])[at]
        return pa.RecordBatch.from_arrays([pa.array(np.array(rows["f1"])[at]), pa.array(np.array(rows["f2"])[at]), pa.array(links, pa.int64()), pa.array(ids[at]), pa.array(ids[at][_members(hits)])], names=["f1", "f2", "links", "id", "root"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        last = None
        for batch in batches:
            rows = batch.to_pydict()
            marks = list(zip(*(rows[k] for k in keys), strict=True))
            at = 0
            while at < len(marks):
                to = at + 1
                while to < len(marks) and marks[to] == marks[at]:
                    to += 1
                if marks[at] != last:
                    if held and (out := one(held)) is not None:
                        yield out
                    held, last = {k: [] for k in rows}, marks[at]
                for k, values in rows.items():
                    held[k] += values[at:to]
                at = to
        if held and (out := one(held)) is not None:
            yield out

    return groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(find, "f1 long, f2 long, links long, id long, root long")


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id of its group), kept."""
    if not isinstance(rows.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: near_vectors takes integer ids")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), F.col(label_col).alias("label"))
    own = own.withColumn("ok", _usable("v", "label", "vec_id"))
    own = own.withColumns({"f1": F.xxhash64("label", "v"), "f2": F.xxhash64(F.lit("second"), "v", "label")})
    grouped = own.where("ok").groupBy("f1", "f2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(grouped, "classes")
    sample = classes.select("v").orderBy("f1", "f2").limit(SAMPLE).collect()  # a bounded sample for the index
    single = rows.schema[vector_col].dataType.elementType == T.FloatType()
    described = stored(_described(classes, choose_pivots([r["v"] for r in sample]), single), "described")
    listed = stored(_listed(described), "lists")
    by = ["label", "d", "p", "q"]
    sizes = listed.groupBy(*by).agg(F.count("*").alias("g")).where("g > 1")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    dealt = listed.hint("merge").join(sizes, by).withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("f1", "f2"), "n").cast("int"))
    dealt = dealt.select(*by, "f1", "f2", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("with"))
    dealt = dealt.select(*by, "f1", "f2", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    met = dealt.hint("merge").join(described.drop("label"), ["f1", "f2"])
    links = stored(_linked(met, cosine, single), "links")
    edges = links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    again = own.where("ok").groupBy("vec_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("vec_id")
    same = own.where("ok").join(again, "vec_id", "left_semi").hint("merge").join(classes.select("f1", "f2", "id"), ["f1", "f2"]).where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")).distinct()
    of = components(stored(edges.union(same), "edges"))
    total = links.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    counted = classes.select("f1", "f2", "id", "copies").hint("merge").join(total, ["f1", "f2"], "left").hint("merge").join(of.withColumnRenamed("vertex", "id"), "id", "left")
    counted = counted.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = own.select("vec_id", F.when(F.col("ok"), F.col("f1")).alias("f1"), F.when(F.col("ok"), F.col("f2")).alias("f2")).hint("merge").join(counted, ["f1", "f2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def without_near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows of ``rows``, all columns as they are, whose id stands for its group."""
    gone = near_vectors(rows, cosine, id_col, vector_col, label_col).where("not kept").select(F.col("vec_id").alias("__gone")).distinct()
    return rows.hint("merge").join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
