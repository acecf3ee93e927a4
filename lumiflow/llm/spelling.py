"""Spelling variants: words one edit apart, by asymmetric q-chunks, and the form that each stands for.

Words.  Runs of ASCII letters and U+00C0 to U+00FF are found with numpy over whole texts, counted per task
and summed by Spark before anything else is made of them.

Join.  Of two words that differ by one edit the shorter one (of equal length: either) gives its two halves as disjoint chunks, the other one its positional
grams: an edit spares a chunk, which stands in the other word at the same place, or one place further if the edit lies before it.  A half shared is
too weak a key in a large vocabulary, so the half that the edit may have touched is cut into two chunks again, of which one is spared again, until at most
``GAP`` letters are left open (``DEPTH`` cuts at most).  The key of a join is then the chunks spared at all cuts, that is all letters but a gap; a list of one key is bounded by the
words that fill a gap of four letters, however large the vocabulary.  Keys are 64-bit hashes; each candidate is verified by its edit distance.

Forms.  A word's near words are counted and their best is a minimum, both partial before the shuffle.  Counts grow
ten-fold along a chain of forms, so a chain has at most 18 steps, and five rounds of pointer doubling reach every root.

Defined cases: null, empty and letterless texts have no words; a null id hashes as the empty string; repeated rows count each; ties of the
best near word go to the smallest in code-point order; a run of any length is one word; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import _LOWER, buffers, slices, texts_column

#: Least code points and occurrences of a word; one run of DAMAGE loses a letter; a form is FACTOR times as frequent.
LEAST_LENGTH, LEAST_COUNT, DAMAGE, FACTOR = 7, 2, 31, 10
#: Letters left open at most by the chunks of a key, and cuts at most.
GAP, DEPTH = 3, 5
#: Words that a task holds before it gives their counts away.
HELD = 200_000
#: Longer runs are hashed one by one.
_SHORT = 64

_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end, code points and text of each run of letters."""
    offsets, raw = buffers(texts)
    lead = raw == _LEAD
    inside = _ALPHA[raw] | lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    if len(raw):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return _LOWER[raw], start, end, (end - start) - (leads[end] - leads[start]), np.searchsorted(offsets, start, side="right") - 1


def hashes(prefixes: np.ndarray, text: np.ndarray, size: np.ndarray, words: list[bytes], word: np.ndarray) -> np.ndarray:
    """crc32 of each run's prefix and word: the prefix' checksum moved on by the word's bytes, plus the word's own (checksums are linear)."""
    own = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    out = np.empty(len(word), dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], np.arange(_SHORT + 2))
    moved = prefixes.copy()
    for n in range(_SHORT + 1):
        at = order[cuts[n] : cuts[n + 1]]
        out[at] = moved[text[at]] ^ own[word[at]]
        moved = (moved >> np.uint32(8)) ^ _CRC[moved & np.uint32(255)]
    for i in order[cuts[_SHORT + 1] :]:
        out[i] = zlib.crc32(words[word[i]], int(prefixes[text[i]]))
    return out


def _counted(part: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a slice, words damaged where the hash says so."""
    data, start, end, length, text = runs(texts_column(part, "text"))
    long = length >= LEAST_LENGTH
    start, end, length, text = start[long], end[long], length[long], text[long]
    if not len(start):
        return
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    letters = data[np.repeat(start - first[:-1], size) + np.arange(first[-1])]
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(first.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())).dictionary_encode()
    words, word = found.dictionary.to_pylist(), np.asarray(found.indices)
    prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in texts_column(part, "doc_id").to_pylist()], dtype=np.uint32)
    h = hashes(prefixes, text, size, [w.encode() for w in words], word)
    damaged = h % DAMAGE == 0
    yield from zip(words, np.bincount(word[~damaged], minlength=len(words)).tolist(), strict=True)
    place = h[damaged] % length[damaged]
    for i, k in zip(word[damaged].tolist(), place.tolist(), strict=True):
        w = words[i]
        if len(w) > LEAST_LENGTH:
            yield w[:k] + w[k + 1 :], 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, damaged runs under what is left of them; words of ``LEAST_LENGTH`` and ``LEAST_COUNT`` at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for w, n in _counted(part):
                    if n:
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD:
                    yield out()
        yield out()

    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keys(length: Column, shift: int) -> Column:
    """Keys of a word for chunks of a word of ``length``: an array of hashes, one for each gap. The letters behind the gap stand ``shift`` places further."""
    cuts = F.least(F.lit(DEPTH), F.greatest(F.lit(1), F.ceil(F.log2(length / GAP)))).cast("int")
    parts = F.pow(F.lit(2), cuts).cast("int")

    def key(i: Column) -> Column:
        a, b = F.floor(length * i / parts).cast("int"), F.floor(length * (i + 1) / parts).cast("int")
        return F.xxhash64(length, i, F.substr("word", F.lit(1), a), F.substr("word", b + 1 + shift))

    return F.transform(F.sequence(F.lit(0), parts - 1), key)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of words of (word, n) that are one edit apart, once; no pair is listed by a cross product."""
    length = F.length("word")
    chunks = words.select(F.explode(_keys(length, 0)).alias("key"), F.col("word").alias("a"), F.col("n").alias("an"))
    same = words.select(F.explode(_keys(length, 0)).alias("key"), F.col("word").alias("b"), F.col("n").alias("bn"))
    longer = words.where(length > LEAST_LENGTH).select(F.explode(_keys(length - 1, 1)).alias("key"), F.col("word").alias("b"), F.col("n").alias("bn"))
    ordered = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    found = chunks.hint("merge").join(same.union(longer), "key").where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "an", "b", "bn").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by pointer doubling."""
    at = forms.withColumnRenamed("form", "root")
    for _ in range(5):  # 2 ** 5 steps, more than a chain can have
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.hint("merge").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n, root."""
    words = stored(word_counts(docs, id_col, text_col), "words")
    pairs = stored(near_pairs(words), "pairs")
    both = pairs.union(pairs.select("b", "bn", "a", "an"))
    # the most frequent near word, and of several the smallest
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"), F.first("an").alias("n"))
    near = near.withColumn("has", -F.col("best.less") >= FACTOR * F.col("n"))
    near = stored(near.select("word", "n_near", F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null").select("word", "form"))
    out = words.hint("merge").join(near, "word", "left").hint("merge").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
