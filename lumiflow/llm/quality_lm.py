"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Units are whole bytes in n-grams of ``DEPTH``, so what is counted grows with trusted text and no
script or case is folded.  One task's documents of one chunk (``CHUNK`` rows of a file) give each
distinct n-gram once, with how often trusted text of theirs has it.  Counts are summed by
n-gram over the reducers; all orders are rows (k, code) of one table, so totals and continuation counts of
contexts, discounts from counts of counts, and the interpolated probabilities of all n-grams that
documents ask for take one aggregate or join each, by shard.  Only the lowest two orders (256 + 65536 rows at
any size), whose keys are hot, are broadcast.  The answers go back by chunk as files in
the shared folder; a scoring task holds those of one chunk.

A document's perplexity is that of its bytes.  One trusted document of ``HELD`` isn't counted: counted
text is likelier than other good text.  A document is accepted up to its language's threshold, the
``QUANTILE`` of that language's trusted documents: of those held out or of all, whichever is higher
(in small tables the few held out say little).

Defined cases: null and empty texts have no perplexity (null) and are rejected; a null
language, or one without trusted documents, takes the threshold of all trusted documents;
where no trusted text is left to count, the one held out is counted too;
without trusted text nothing is judged and every text that isn't empty is accepted; rows with
a null id or label aren't trusted; repeated rows are judged each; an empty table gives no
rows; extra columns are kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import file_system, held, shared_dir, stored
from .words import buffers, slices, texts_column

QUANTILE = 0.99
#: Of the classifier's model: length of n-grams, rows of a chunk, one trusted document of so many is held out.
DEPTH, CHUNK, HELD = 5, 8192, 5
#: Bytes of text that are counted or scored together: each takes some sixty bytes while it is.
TOGETHER = 500_000
#: Orders of which all n-grams fit a broadcast: 256 + 65536 rows.
LOW = 2
#: Fixed: no byte of UTF-8; and so many n-grams are held before repeats among them are summed.
BEGIN, PENDING = 0xFF, 1_500_000


def byte_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the ``DEPTH`` - 1 before it, offsets of the texts); texts begin after BEGIN bytes."""
    offsets, raw = buffers(texts)
    before = DEPTH - 1
    parts, lead = [], np.full(before, BEGIN, dtype=np.uint8)
    inside = np.ones(len(raw) + before * (len(offsets) - 1), dtype=bool)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts += [lead, raw[lo:hi]]
        inside[lo + before * i : lo + before * (i + 1)] = False
    padded = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    whole = padded.copy()
    for j in range(1, DEPTH):
        whole[j:] |= padded[:-j] << (8 * j)
    return whole[inside], offsets


def _suffixes(code: str = "code", orders: range = range(1, DEPTH + 1)) -> Column:
    """Rows (k, code) of the last k bytes of an n-gram, for each order."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.pmod(F.col(code), F.lit(256**k)).alias("code")) for k in orders)))


def _discounts(orders: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, of each order of (k, n)."""
    found = {(r["k"], r["n"]): r["m"] for r in orders.where("n <= 4").groupBy("k", "n").agg(F.count("*").alias("m")).collect()}  # four rows an order
    out = {}
    for k in range(1, DEPTH + 1):
        n1, n2, n3, n4 = (max(1, found.get((k, i), 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        out[k] = tuple(float(min(max(d, 0.05), i - 0.05)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
    return out


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of counts (code, n) of the highest order: (k, code, p: the discounted part), (k, context, back: the weight of the order below)."""
    # an n-gram below the highest order counts the bytes that stand before it
    longer = counts.select(_suffixes(orders=range(2, DEPTH + 1)).alias("s")).select("s.k", "s.code").distinct()
    below = longer.groupBy((F.col("k") - 1).alias("k"), F.expr("pmod(code, shiftleft(1L, 8 * (k - 1)))").alias("code")).agg(F.count("*").alias("n"))
    orders = stored(below.union(counts.select(F.lit(DEPTH).alias("k"), "code", "n")), "orders")
    by = _discounts(orders)
    d1, d2, d3 = (F.create_map(*(F.lit(x) for k in by for x in (k, by[k][i])))[F.col("k")] for i in range(3))
    rows = orders.withColumn("context", F.shiftright("code", 8))
    sums = rows.groupBy("k", "context").agg(F.sum("n").alias("total"), *(F.count_if(c).alias(f"m{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") >= 3))))
    back = stored(sums.select("k", "context", "total", ((d1 * F.col("m1") + d2 * F.col("m2") + d3 * F.col("m3")) / F.col("total")).alias("back")), "back")
    discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    p = rows.join(back, ["k", "context"]).select("k", "code", ((F.col("n") - discount) / F.col("total")).alias("p"))
    return stored(p, "model"), back.select("k", "context", "back")


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__chunk``: the same for rows that stand together in a file, at each reading."""
    chunk = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK)).alias("__chunk")
    try:
        return docs.select("*", chunk)
    except AnalysisException:  # not read from Parquet files
        return stored(docs, "docs").select("*", chunk)


def _by_chunk(rows: DataFrame, name: str) -> str:
    """Write ``rows`` to a folder for each ``chunk``; the path above them."""
    path = f"{shared_dir(rows.sparkSession)}/{name}"
    rows.repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    return path


def _read_chunk(path: str, chunk: int) -> pa.Table | None:
    from pyarrow import fs as pafs
    from pyarrow import parquet

    fs, p = file_system(f"{path}/chunk={chunk}")
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables([parquet.ParquetFile(f, filesystem=fs).read() for f in sorted(found)]) if found else None


def _parts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows of it) in the order of reading."""
    for batch in batches:
        for part in slices(batch, text_col, TOGETHER):
            chunk = texts_column(part, "__chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(chunk[i]), part.slice(i, j - i)


def _marks(path: str, chunk: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trusted, held out) of each id."""
    known = held(f"marks {path} {chunk}", lambda: _read_chunk(path, chunk))
    if known is None:
        return np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
    out = known.column("held")
    is_in = lambda t: pc.is_in(ids, value_set=t.column("doc_id").combine_chunks().cast(ids.type)).to_numpy(zero_copy_only=False)
    return is_in(known), is_in(known.filter(out))


def _grams(docs: DataFrame, marks: str, text_col: str, id_col: str) -> DataFrame:
    """(chunk, code, n: occurrences in counted text, m: in trusted text) of the n-grams of ``docs``, by task."""

    def summed(found: list) -> list:
        code = np.concatenate([f[0] for f in found])
        codes, at = np.unique(code, return_inverse=True)
        return [(codes, *(np.bincount(at, np.concatenate([f[i] for f in found]), len(codes)).astype(np.int64) for i in (1, 2)))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for codes, n, m in summed(found):
                for i in range(0, len(codes), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[i : i + 100_000]), last)), *(pa.array(x[i : i + 100_000]) for x in (codes, n, m))], names=["chunk", "code", "n", "m"])

        found, last, held_now = [], None, 0
        for chunk, part in _parts(batches, text_col):
            if found and chunk != last:
                yield from out()
                found, held_now = [], 0
            last = chunk
            codes, offsets = byte_codes(texts_column(part, text_col))
            if not len(codes):
                continue
            trusted, out_of = _marks(marks, chunk, texts_column(part, id_col))
            # a n-gram's code has 40 bits; the next two say whose it is
            code, n = np.unique(codes << 2 | np.repeat(trusted.astype(np.int64) + out_of, np.diff(offsets)), return_counts=True)
            whose, code = code & 3, code >> 2
            found.append((code, np.where(whose == 1, n, 0), np.where(whose > 0, n, 0)))
            held_now += len(code)
            if held_now > PENDING:
                found = summed(found)
                held_now = len(found[0][0])
                if held_now > PENDING // 2:
                    yield from out()
                    found, held_now = [], 0
        if found:
            yield from out()

    return docs.select("__chunk", F.col(id_col), F.col(text_col)).mapInArrow(find, "chunk long, code long, n long, m long")


def probabilities(wanted: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(code, p) of each of the n-grams ``wanted`` (code, distinct), seen in trusted text or not."""
    own, back = model
    own, back = own.withColumnRenamed("p", "own"), back.withColumnRenamed("back", "weight")
    asked = wanted.select(F.col("code").alias("whole"), _suffixes().alias("s")).select("whole", "s.k", "s.code", F.shiftright("s.code", 8).alias("context"))
    low, high = f"k <= {LOW}", f"k > {LOW}"
    hot = asked.where(low).join(F.broadcast(own.where(low)), ["k", "code"], "left").join(F.broadcast(back.where(low)), ["k", "context"], "left")
    # what is asked of the higher orders is asked once for each n-gram of theirs
    once = asked.where(high).select("k", "code", "context").distinct().hint("merge").join(own.where(high), ["k", "code"], "left").hint("merge").join(back.where(high), ["k", "context"], "left")
    rest = asked.where(high).select("whole", "k", "code").hint("merge").join(once.select("k", "code", "own", "weight"), ["k", "code"])
    parts = hot.select("whole", "k", "own", "weight").union(rest.select("whole", "k", "own", "weight"))
    pick = lambda c, k, other: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(other))
    sums = parts.groupBy("whole").agg(*(pick("own", k, 0.0).alias(f"own{k}") for k in range(1, DEPTH + 1)), *(pick("weight", k, 1.0).alias(f"weight{k}") for k in range(1, DEPTH + 1)))
    p = F.lit(1 / 256)
    for k in range(1, DEPTH + 1):
        p = F.col(f"own{k}") + F.col(f"weight{k}") * p
    return sums.select(F.col("whole").alias("code"), p.alias("p"))


class Answers:
    """Logarithms of the probabilities of n-grams, by their code."""

    def __init__(self, code: np.ndarray, log_p: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        self.code, self.log_p = code[order], log_p[order].astype(np.float64)
        self.shift = np.uint64(64 - max(10, int(4 * len(code)).bit_length()))
        at = self._slot(self.code)
        # a slot of one code answers at once; where codes share one, they are searched
        self.value = np.full(1 << (64 - int(self.shift)), np.nan)
        self.value[at] = self.log_p
        self.holder = np.full(len(self.value), -1, dtype=np.int64)
        self.holder[at] = self.code

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        at = self._slot(code)
        out = self.value[at]
        missed = np.flatnonzero(self.holder[at] != code)
        if len(missed):
            i = np.minimum(np.searchsorted(self.code, code[missed]), max(0, len(self.code) - 1))
            if not len(self.code) or (self.code[i] != code[missed]).any():
                raise ValueError("texts changed between two readings: n-grams without a probability")
            out[missed] = self.log_p[i]
        return out


def _perplexities(part: pa.RecordBatch, text_col: str, table: Answers) -> pa.Array:
    codes, offsets = byte_codes(texts_column(part, text_col))
    total = np.concatenate([[0.0], np.cumsum(table.of(codes))])
    n = np.diff(offsets)
    return pa.array(np.exp(-(total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)), pa.float64(), mask=n == 0)


def _chunk_answers(path: str, chunk: int) -> Answers:
    t = _read_chunk(path, chunk)
    return Answers(np.zeros(0, dtype=np.int64), np.zeros(0)) if t is None else Answers(t.column("code").to_numpy(), t.column("log_p").to_numpy())


def with_perplexity(docs: DataFrame, paths: tuple[str, str], text_col: str, id_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of chunked ``docs`` with __perplexity, and __trusted: 0, 1, or 2 of those held out."""
    answers, marks = paths
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__perplexity", T.DoubleType()), T.StructField("__trusted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, None
        for chunk, part in _parts(batches, text_col):
            if chunk != last:
                last, table = chunk, None  # the old table goes before the new one is read
                table = _chunk_answers(answers, chunk)
            trusted, out_of = _marks(marks, chunk, texts_column(part, id_col))
            whose = pa.array(trusted.astype(np.int32) + out_of)
            yield pa.RecordBatch.from_arrays([*(texts_column(part, c) for c in keep), _perplexities(part, text_col, table), whose], names=[*keep, "__perplexity", "__trusted"])

    needed = dict.fromkeys([*keep, id_col, text_col, "__chunk"])
    return docs.select(*needed).mapInArrow(score, schema)


def train(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[str, str] | None:
    """Fit on the rows of chunked ``docs`` whose id is in ``trusted`` (doc_id); the paths of the answers and of the trusted ids."""
    ids = docs.where(F.col(text_col) != "").select(F.col("__chunk").alias("chunk"), F.col(id_col).alias("doc_id"))
    # both sides grow with the corpus: a merge join at every size, of ids alone
    known = ids.join(trusted.hint("merge"), "doc_id", "left_semi").distinct()
    marks = _by_chunk(known.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0), "trusted")
    grams = stored(_grams(docs, marks, text_col, id_col), "ngrams")
    some = grams.agg(F.max("n"), F.max("m")).first()
    if not some[1]:
        return None
    n = "n" if some[0] else "m"
    counts = stored(grams.where(F.col(n) > 0).groupBy("code").agg(F.sum(n).alias("n")), "counts")
    wanted = stored(grams.select("code").distinct(), "wanted")
    p = probabilities(wanted, kneser_ney(counts)).select("code", F.log("p").cast("float").alias("log_p"))
    return _by_chunk(grams.select("chunk", "code").distinct().hint("merge").join(stored(p, "p"), "code"), "answers"), marks


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose quality label is 1 (every label of a repeated id must be)."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count_if(F.col("quality").isNull()).alias("u")).where("q = 1 and u = 0").select("doc_id")


def thresholds(known: DataFrame) -> tuple[dict[str, float], float]:
    """(threshold by language, threshold of all) of rows of (lang, __perplexity, __trusted)."""
    quantile = lambda x: F.percentile_approx(x, QUANTILE, 10_000)
    held = F.when(F.col("__trusted") == 2, F.col("__perplexity"))
    found = known.where("__trusted > 0 and __perplexity is not null").rollup("lang").agg(F.grouping("lang").alias("all"), F.greatest(quantile(held), quantile(F.col("__perplexity"))).alias("t")).collect()
    return {r["lang"]: r["t"] for r in found if not r["all"] and r["lang"] is not None}, next((r["t"] for r in found if r["all"] and r["t"] is not None), float("inf"))


def _limit(by: dict[str, float], rest: float, lang_col: str):
    if not by:
        return F.lit(rest)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in by.items() for x in kv))[F.coalesce(F.col(lang_col), F.lit(""))], F.lit(rest))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, perplexity, threshold, accepted."""
    own = chunked(docs.select("doc_id", "text", "lang"))
    paths = train(own, trusted_ids(labels))
    if paths is None:
        return own.select("doc_id", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.coalesce(F.col("text") != "", F.lit(False)).alias("accepted"))
    scored = stored(with_perplexity(own, paths, "text", "doc_id", ["doc_id", "lang"]), "scored")
    limit = _limit(*thresholds(scored), "lang")
    return scored.select("doc_id", F.col("__perplexity").alias("perplexity"), limit.alias("threshold"), F.coalesce(F.col("__perplexity") <= limit, F.lit(False)).alias("accepted"))


def without_unlikely(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model accepts."""
    own = chunked(docs)
    paths = train(own, trusted_ids(labels), text_col, id_col)
    if paths is None:
        return docs.where(F.col(text_col) != "")
    scored = stored(with_perplexity(own, paths, text_col, id_col, docs.columns), "scored")
    limit = _limit(*thresholds(scored.select(F.col(lang_col).alias("lang"), "__perplexity", "__trusted")), lang_col)
    return scored.where(F.col("__perplexity") <= limit).select(*docs.columns)
