"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM.

Kernel.  A word's features are its subsequences of four symbols inside six positions, each
weighing ``DECAY`` to the power of the span, so characters inserted in an insult cost weight
but not the match; word ends are symbols too.  Letters are folded (case, digits that stand
for letters; letters beyond a-z into 13 symbols), other characters are dropped from words, and
single letters in a row are one word.

Fit.  Labels are of documents, insults are words, so the machine learns as in multiple-instance learning: a
text is its highest-rated word in any sentence, and which word that is, is learned.  In a bounded
sample of labelled rows (``TOXIC_ROWS`` and ``CLEAN_ROWS``, by a hash of the id; copies count once) each toxic
row first stands for its word of most evidence (log likelihood against chance, from counts by label over
the sample), weighing by that evidence, without a cut.  Clean rows give common words and others by hash
(``NEGATIVES``).  In each of ``ROUNDS`` the machine is trained, rates every word of every sampled row, and takes each
toxic row's highest word, weighing less where it doesn't rise above ``QUIET`` of the clean rows, and each clean
row's highest as another negative.  Landmarks are a subset of
both; Nyström features are K(word, landmarks) K(landmarks)^-1/2, and the SVM is linear in them.  As
each landmark's kernel is linear in subsequences, the machine folds into one table of 41^4
weights (11 MB at any size), so scoring a word is a sum of lookups.

A text's score is the share of toxic rows among sampled ones of its highest margin (isotonic regression);
all words of whole texts are rated.

Defined cases: null, empty and wordless texts get the score of the bias alone; ties among words
change nothing; repeated rows are scored each; rows without a label or with a null label teach
nothing; without toxic or clean labels, or without a word in either, every score is 0; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import stored
from .words import SPACED, shingle_hashes, slices, texts_column, words_of

TOXIC_ROWS, CLEAN_ROWS = 3000, 12_000
NEGATIVES, LANDMARKS, ROUNDS = 6000, 384, 2
#: A word weighs fully from this log likelihood against chance on: one in 200,000. Share of clean rows that a toxic row's word should rise above, and its weight if not.
EVIDENCE, QUIET, FAINT = math.log(200_000), 0.95, 0.05
DECAY, SPAN, THRESHOLD = 0.7, 6, 0.7
EDGE, OTHERS = 27, 13
BASE = EDGE + 1 + OTHERS
#: Folded letters beyond a-z are written as characters of the private use area.
PRIVATE = 0xE000
_STEPS = [s for s in itertools.combinations(range(1, SPAN), 3)]

#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane: 1-26 letters, 27 blank, then other letters, 0 dropped."""
    table = np.zeros(1 << 16, dtype=np.int32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isspace() or c == 0:
            table[c] = EDGE
        elif ch in LOOKALIKES:
            table[c] = ord(LOOKALIKES[ch]) - 96
        elif ch.isalpha():
            low = ch.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else EDGE + 1 + ord(low) % OTHERS
    table[PRIVATE + EDGE + 1 : PRIVATE + BASE] = np.arange(EDGE + 1, BASE)
    return table


def _letters(symbols) -> str:
    """Folded letters as text that folds to them again; blanks stay blanks."""
    return "".join(chr(96 + c) if c < EDGE else " " if c == EDGE else chr(PRIVATE + c) for c in symbols.tolist())


_table: list[np.ndarray] = []


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with blanks between words, text of each symbol)."""
    if not _table:
        _table.append(_symbols())
    raw = np.frombuffer(("\x00".join((t or "").replace("\x00", " ") for t in texts) + "\x00").encode("utf-32-le"), dtype="<u4")
    sym = _table[0][np.minimum(raw, 0xFFFF)]
    end = raw == 0
    text = np.cumsum(end) - end
    keep = sym > 0
    sym, text, end = sym[keep], text[keep], end[keep]
    blank = np.flatnonzero(sym == EDGE)
    size = np.diff(np.concatenate([[-1], blank])) - 1  # of the word before each blank
    inner = np.zeros(len(sym), dtype=bool)
    inner[blank[:-1]] = (size[:-1] == 1) & (size[1:] == 1) & ~end[blank[:-1]]
    keep = ~inner & ~((sym == EDGE) & (np.concatenate([[EDGE], sym[:-1]]) == EDGE) & ~end)
    # a blank opens the stream, so that the first word has both ends
    return np.concatenate([[EDGE], sym[keep]]).astype(np.int32), np.concatenate([[0], text[keep]])


def _norms(n: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector, its subsequences taken as different; n: letters."""
    out = np.zeros(len(n), dtype=np.float64)
    for s in _STEPS:
        out += np.maximum(n + 2 - s[2], 0) * DECAY ** (2 * (s[2] + 1))
    return np.sqrt(np.maximum(out, 1e-9))


def word_features(sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first positions, feature codes, weight) of each shape of subsequence; none crosses a blank."""
    before = np.concatenate([[0], np.cumsum(sym == EDGE)]).astype(np.int32)
    n = len(sym)
    for a, b, c in _STEPS:
        if n <= c:
            continue
        m = n - c
        code = ((sym[:m] * BASE + sym[a : a + m]) * BASE + sym[b : b + m]) * BASE + sym[c : c + m]
        yield np.flatnonzero(before[c : c + m] == before[1 : 1 + m]), code, DECAY ** (c + 1)


def word_margins(sym: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first letter, kernel sum over norm) of every word."""
    total = np.zeros(len(sym) + 1, dtype=np.float32)
    for at, code, weight in word_features(sym):
        total[at + 1] += table[code[at]] * np.float32(weight)
    letters = sym != EDGE
    first = np.flatnonzero(letters & np.concatenate([[True], ~letters[:-1]]))
    if not len(first):
        return first, np.zeros(0)
    last = np.flatnonzero(letters & np.concatenate([~letters[1:], [True]]))
    return first, np.add.reduceat(total, first)[: len(first)].astype(np.float64) / _norms(last - first + 1)


def _table_of(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the words' normed features, each by its weight."""
    table = np.zeros(BASE**4, dtype=np.float64)
    sym, text = stream(words)
    scale = weights / _norms(np.bincount(text[sym != EDGE], minlength=len(words)))
    for at, code, weight in word_features(sym):
        np.add.at(table, code[at], weight * scale[text[np.minimum(at + 1, len(text) - 1)]])
    return table.astype(np.float32)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    sym, text = stream(words)
    out = np.zeros((len(words), len(landmarks)))
    for j, mark in enumerate(landmarks):
        first, k = word_margins(sym, _table_of([mark], np.ones(1)))
        np.maximum.at(out[:, j], text[first], k)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared hinge by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(reg + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def train_words(positive: dict[str, float], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """(weights of all subsequences, bias) of words with their weights, and of others."""
    kmm = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    # directions in which landmarks hardly differ are left out: their weights would be large and cancel
    known = values > 3e-3 * values.max()
    root = vectors @ np.diag(np.where(known, np.maximum(values, 1e-9) ** -0.5, 0.0)) @ vectors.T
    x = kernel([*positive, *negative], landmarks) @ root
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = np.array([*positive.values()])
    weight = np.concatenate([0.5 * share / share.sum(), np.full(len(negative), 0.5 / len(negative))]) * len(y) / 10
    w, bias = _svm(x, y, weight)
    return _table_of(landmarks, root @ w), bias


class Scorer:
    """Fitted weights; ``knots`` map a text's highest margin to a score."""

    def __init__(self, table: np.ndarray | None, bias: float = 0.0, knots: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.table, self.bias, self.knots = table, bias, knots

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Highest margin of each text's words, and that word's folded letters."""
        out, words = np.full(len(texts), self.bias), [""] * len(texts)
        sym, text = stream(texts)
        first, k = word_margins(sym, self.table)
        if len(first):
            k = k + self.bias
            order = np.lexsort((k, text[first]))
            last = np.flatnonzero(np.diff(text[first][order], append=-1))
            for i in order[last]:
                t = text[first[i]]
                out[t] = k[i]
                end = first[i]
                while end < len(sym) and sym[end] != EDGE:
                    end += 1
                words[t] = _letters(sym[first[i] : end])
        return out, words

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """By the knots; beyond them and between equal shares the margin still tells texts apart, by a hair."""
        return 0.999 * np.interp(margins, *self.knots) + 0.001 / (1 + np.exp(-np.clip(margins, -50, 50)))


def _isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, share of toxic rows there): the closest shares that never fall as the margin rises, a row of each
    label added at the far ends, joined by lines."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, of labels, rows
    for x, label in [(m[order[0]], 0.0), *zip(m[order].tolist(), y[order].tolist(), strict=True), (m[order[-1]], 1.0)]:
        blocks.append([x, label, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at, share = (np.array(x) for x in zip(*((a / k, b / k) for a, b, k in blocks), strict=True))
    return at, share


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(toxic, text) of at most about TOXIC_ROWS and CLEAN_ROWS labelled rows."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.when(F.col("toxic") == 1, int(min(1.0, TOXIC_ROWS / counts[1]) * (1 << 30))).otherwise(int(min(1.0, CLEAN_ROWS / counts[0]) * (1 << 30)))
    rows = known.where(key < most)
    known = docs.join(F.broadcast(rows), "doc_id").select("toxic", "text")  # bounded: two caps of a few thousand ids

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, text = shingle_hashes(words_of(texts_column(part, "text"), SPACED), 3)
                least = np.full(part.num_rows, np.uint64(0xFFFFFFFFFFFFFFFF))
                np.minimum.at(least, text, h)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least.view(np.int64))], names=["toxic", "text", "h"])

    # copies say one thing many times: rows of one label and least shingle hash count once
    return stored(known.mapInArrow(marked, "toxic int, text string, h long").groupBy("toxic", "h").agg(F.min("text").alias("text")), "sample")


def _row_words(sample: DataFrame) -> DataFrame:
    """(toxic, h, word), each word of a row once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, h = (texts_column(batch, c).to_numpy() for c in ("toxic", "h"))
            for i, text in enumerate(texts_column(batch, "text").to_pylist()):
                found = sorted({w for w in _letters(stream([text])[0]).split(" ") if len(w) > 1})
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), toxic[i], np.int32)), pa.array(np.full(len(found), h[i])), pa.array(found, pa.string())], names=["toxic", "h", "word"])

    return sample.mapInArrow(words, "toxic int, h long, word string")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled rows of (doc_id, text) and (doc_id, toxic)."""
    sample = _sample(docs, labels)
    if sample is None:
        return Scorer(None)
    words = stored(_row_words(sample), "words")
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = min(max(rows.get(1, 0) / max(1, sum(rows.values())), 0.01), 0.9)
    t, c = F.col("t"), F.col("c")
    counted = stored(words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")), "counted")
    # log likelihood ratio of a word's rows against the share of toxic rows
    evidence = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    told = counted.where(t > share * (t + c)).select("word", evidence.alias("evidence"))
    first = words.where("toxic = 1").join(told, "word").groupBy("h").agg(F.max(F.struct("evidence", "word")).alias("best")).select("best.*").collect()  # a word for each toxic row of the sample
    positive: dict[str, float] = {}
    for r in first:
        positive[r["word"]] = positive.get(r["word"], 0.0) + _weight(r["evidence"])
    clean = counted.where("c > 0 and c * 2 >= t").withColumn("by", F.xxhash64("word"))
    negative = [r["word"] for r in clean.orderBy(F.desc("c"), "word").limit(NEGATIVES // 3).collect()]
    negative += [r["word"] for r in clean.orderBy("by", "word").limit(NEGATIVES).collect()]
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        negative = sorted(set(negative) - set(positive))
        if not positive or not negative:
            return Scorer(None)
        some = lambda x, n: [x[i] for i in np.sort(rng.permutation(len(x))[:n])]
        strong = sorted(positive, key=lambda w: (-positive[w], w))
        marks = list(dict.fromkeys(strong[: LANDMARKS // 2] + some(strong, LANDMARKS // 4) + some(negative, LANDMARKS // 4)))
        # words that many rows stand for count more, but not in proportion: one insult must not outweigh all others
        scorer = Scorer(*train_words({w: math.log1p(v) for w, v in positive.items()}, negative, marks))
        rated = _best_words(sample, scorer)
        margin, toxic = np.array([r["margin"] for r in rated]), np.array([r["toxic"] for r in rated], dtype=float)
        loud = np.quantile(margin[toxic == 0], QUIET)
        positive = {}
        for r in rated:
            if r["toxic"] == 1 and r["word"]:
                positive[r["word"]] = positive.get(r["word"], 0.0) + (1.0 if r["margin"] > loud else FAINT)
        known = _evidence(told, list(positive))
        positive = {w: v * _weight(known.get(w, 0.0)) for w, v in positive.items()}
        negative = sorted({*negative, *(r["word"] for r in rated if r["toxic"] == 0 and r["word"])})
    scorer.knots = _isotonic(margin, toxic)
    return scorer


def _weight(evidence: float) -> float:
    """Of a word among positives."""
    return min(1.0, max(evidence / EVIDENCE, FAINT))


def _evidence(told: DataFrame, words: list[str]) -> dict[str, float]:
    """Evidence of ``words``: one for each toxic row of the sample at most."""
    asked = told.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["evidence"] for r in told.join(F.broadcast(asked), "word").collect()}


def _best_words(sample: DataFrame, scorer: Scorer) -> list:
    """The highest-rated word of each row of the sample."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m, w = scorer.margins(texts_column(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([texts_column(part, "toxic"), pa.array(m), pa.array(w, pa.string())], names=["toxic", "margin", "word"])

    return sample.mapInArrow(best, "toxic int, margin double, word string").collect()


def toxicity_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = scorer.scores(scorer.margins(texts_column(part, "text").to_pylist())[0]) if scorer.table is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside fold 1 of 3 and score all documents."""
    scorer = fit(docs.select("doc_id", "text"), labels.where(~held_out(3, 1)))
    return toxicity_scores(docs, scorer).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
