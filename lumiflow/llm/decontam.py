"""Benchmark decontamination: an exact containment join filtered by rare prefix shingles.

A window is ``width`` consecutive words of an item (all of a shorter one).  A document can
hold a window only if it holds every word pair of it, so one pair is a sufficient prefix:
the one that is rarest in all documents (counted first, over the whole table).  Documents
look up their pairs in the prefix index; an entry also says where in the window the pair
stands, so the window must fit between the text's ends (position and length bounds) before
all its words are compared (by their 64-bit hashes).  Nothing but the marks of hit words is kept of a document.

The benchmark is a stated query set.  It is cut by hash into blocks of at most about
``BLOCK_BYTES`` of text, each written once to the shared folder; tasks hold one block at a
time, so memory doesn't grow with the benchmark, and no block is ever broadcast.

Defined cases: null or wordless texts have no words and are clean; null or wordless items
have no windows; a null item id with words is reported as the string ``null``; equal
items, or repeated rows of one, each count by their distinct ids; ties in rarity go to the
earliest pair; empty tables give no hit or no rows; extra columns are kept by the filter and
not read by the report.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, held, shared_dir, stored
from .words import ALNUM, Words, mix, slices, texts_column, words_of

#: Of text: in a block of the benchmark, and of documents whose hashed words are held while all blocks pass.
BLOCK_BYTES, HELD_BYTES = 8 << 20, 8 << 20


def _pairs(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each word with the next; at a text's last word, of that word alone."""
    follow = np.empty_like(h)
    follow[:-1] = h[1:]
    if len(h):
        follow[-1] = 0
    follow[last] = 0
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + follow)


def _last(w: Words) -> np.ndarray:
    return w.first[1:][w.counts() > 0] - 1


class Block:
    """Windows of some benchmark items, and after ``index`` the prefix pairs that lead to them."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int) -> None:
        w = words_of(pa.array(texts, pa.string()), ALNUM)
        h = w.hashes()
        windows: dict[bytes, set[int]] = defaultdict(set)
        self.ids = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.ids)}
        for k, item in enumerate(ids):
            lo, hi = int(w.first[k]), int(w.first[k + 1])
            size = min(width, hi - lo)
            for at in range(lo, hi - size + 1) if size else ():
                windows[h[at : at + size].tobytes()].add(number[item])
        self.windows = [np.frombuffer(x, dtype=np.uint64) for x in windows]
        self.items = [np.array(sorted(x), dtype=np.int64) for x in windows.values()]
        self.pairs = [_pairs(x, np.array([], dtype=np.int64))[:-1] if len(x) > 1 else x for x in self.windows]
        self.keys = np.unique(np.concatenate(self.pairs)) if self.pairs else np.zeros(0, np.uint64)

    def index(self, counts: np.ndarray) -> None:
        """counts: of ``keys`` in all documents."""
        key, window, place = [], [], []
        for i, p in enumerate(self.pairs):
            at = int(np.argmin(counts[np.searchsorted(self.keys, p)]))
            key.append(p[at])
            window.append(i)
            place.append(at)
        order = np.argsort(np.array(key, dtype=np.uint64), kind="stable")
        self.prefix = np.array(key, dtype=np.uint64)[order]
        self.window, self.place = np.array(window, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]
        self.size = np.array([len(x) for x in self.windows], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.flat = np.concatenate(self.windows) if self.windows else np.zeros(0, np.uint64)
        self.pairs = []

    def find(self, h: np.ndarray, pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every place where a window stands; lo and hi: the text's bounds at each word."""
        if not len(self.prefix) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for keys, one in ((pair, False), (h, True)):
            a = np.searchsorted(self.prefix, keys, "left")
            at = np.flatnonzero(self.prefix[np.minimum(a, len(self.prefix) - 1)] == keys)
            n = np.searchsorted(self.prefix, keys[at], "right") - a[at]
            word = np.repeat(at, n)
            entry = np.repeat(a[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep = (self.size[self.window[entry]] == 1) == one
            found.append((word[keep], entry[keep]))
        word, entry = (np.concatenate(x) for x in zip(*found, strict=True))
        window = self.window[entry]
        start = word - self.place[entry]
        keep = (start >= lo[word]) & (start + self.size[window] <= hi[word])
        start, window = start[keep], window[keep]
        for j in range(int(self.size.max())):
            more = self.size[window] > j
            same = np.ones(len(start), dtype=bool)
            same[more] = h[start[more] + j] == self.flat[self.begin[window[more]] + j]
            start, window = start[same], window[same]
        return start, window


def _load(path: str) -> Block:
    """The block at ``path``; a worker keeps the last one."""

    def read() -> Block:
        fs, p = file_system(path)
        with fs.open_input_file(p) as f:
            return pickle.loads(f.read())

    return held(f"block {path}", read)


def _save(block: Block, path: str) -> str:
    fs, p = file_system(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(pickle.dumps(block))
    return path


def _bounds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    n = w.counts()
    return np.repeat(w.first[:-1], n), np.repeat(w.first[1:], n)


def build_blocks(docs: DataFrame, items: DataFrame, width: int) -> list[str]:
    """Indexes of all items in the shared folder, by rarity in ``docs`` (item_id, text; doc text)."""
    folder = shared_dir(docs.sparkSession)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    raw = []
    for b in range(n):  # a block at a time passes the driver
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        raw.append(_save(Block(["null" if r["item_id"] is None else str(r["item_id"]) for r in rows], [r["text"] for r in rows], width), f"{folder}/raw-{b}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * n
        for part in (part for batch in batches for part in slices(batch, "text", HELD_BYTES)):
            hashed = [(w.hashes(), _last(w)) for w in (words_of(texts_column(x, "text"), ALNUM) for x in slices(part, "text"))]
            for b, path in enumerate(raw):
                block = _load(path)
                if total[b] is None:
                    total[b] = np.zeros(len(block.keys), dtype=np.int64)
                for h, last in hashed:
                    for keys in (_pairs(h, last), h):
                        if len(block.keys) and len(keys):
                            at = np.minimum(np.searchsorted(block.keys, keys), len(block.keys) - 1)
                            total[b] += np.bincount(at[block.keys[at] == keys], minlength=len(block.keys))
        for b, x in enumerate(total):
            if x is not None:
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at), pa.array(x[at])], names=["block", "key", "n"])

    counts = docs.select("text").mapInArrow(count, "block int, key long, n long").groupBy("block", "key").agg(F.sum("n").alias("n"))
    if n > 1:
        counts = stored(counts, "counts")
    out = []
    for b, path in enumerate(raw):
        block = _load(path)
        x = np.zeros(len(block.keys), dtype=np.int64)
        for r in counts.where(F.col("block") == b).toLocalIterator():  # one block's keys
            x[r["key"]] = r["n"]
        block.index(x)
        out.append(_save(block, f"{folder}/index-{b}"))
    return out


class _Texts:
    """Hashed words of some texts, and what blocks have found in them."""

    def __init__(self, texts: pa.Array) -> None:
        w = words_of(texts, ALNUM)
        self.hashes, self.text, self.counts = w.hashes(), w.text_of_word(), w.counts()
        self.pair, self.bounds = _pairs(self.hashes, _last(w)), _bounds(w)
        self.marks = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        self.found: list[set[str]] = [set() for _ in range(len(texts))]

    def look(self, block: Block) -> None:
        start, window = block.find(self.hashes, self.pair, *self.bounds)
        if len(start):
            np.add.at(self.marks, start, 1)
            np.add.at(self.marks, start + block.size[window], -1)
            n = np.array([len(block.items[i]) for i in window])
            both = np.unique(np.stack([np.repeat(self.text[start], n), np.concatenate([block.items[i] for i in window])]), axis=1)
            for t, i in both.T.tolist():
                self.found[t].add(block.ids[i])

    def hits(self) -> np.ndarray:
        return np.bincount(self.text[np.cumsum(self.marks[:-1]) > 0], minlength=len(self.found))


def _searched(batches: Iterator[pa.RecordBatch], text_col: str, blocks: list[str]) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
    """Rows with what all blocks found in them; a block is read once for ``HELD_BYTES`` of text."""
    for part in (part for batch in batches for part in slices(batch, text_col, HELD_BYTES)):
        rows = list(slices(part, text_col))
        texts = [_Texts(texts_column(x, text_col)) for x in rows]
        for path in blocks:
            block = _load(path)
            for t in texts:
                t.look(block)
        yield from zip(rows, texts, strict=True)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: its words, the words inside benchmark windows, and the items they come from."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    blocks = build_blocks(own, items, width)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _searched(batches, "text", blocks):
            hit = texts.hits()
            found = [sorted(x) for x in texts.found]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id"), pa.array(texts.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(sha), pa.array(hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return own.mapInArrow(report, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark window stands."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    blocks = build_blocks(docs.select(F.col(text_col).alias("text")), items, width)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _searched(batches, text_col, blocks):
            yield part.filter(pa.array(texts.hits() == 0))

    return docs.mapInArrow(clean, docs.schema)
