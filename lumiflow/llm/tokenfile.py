"""Token ids in Arrow IPC files of fixed-size-list batches.

Texts are encoded where they are read; only their ids are shuffled, by ranges of the key.  Each task then writes two files of its own key range:

* ``part-N.tokens.arrow``: record batches of ``BATCH_ROWS`` sequences, columns ``ids``
  (fixed_size_list<uint16 or uint32>[length]) and ``mask`` (fixed_size_list<bool>[length],
  false where the last sequence is padded).  All batches but the last have one size, so
  token i is in batch i // (length x rows) and a memory map gives it without a copy.
* ``part-N.docs.arrow``: doc_id, start (first token in this file), n_tokens.

A manifest (written to the shared folder) has one row per file, in key order.  A task
writes under a name of its own attempt and then renames, so retries and twins leave the
same bytes; nothing is kept on an executor.

Defined cases: null and empty texts are the end id alone; null ids come first; repeated
rows are each written, in the order of their ids' bytes; an empty table gives no file and
an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import file_system, shared_dir, stored
from .tokens import default_tokenizer, encoder
from .words import slices, texts_column

BATCH_ROWS = 64
#: Sampled keys for each range of keys.
SAMPLED = 100


class TokenWriter:
    """Appends ids to a file of equal-length sequences."""

    def __init__(self, sink, length: int, dtype: str) -> None:
        self.length, self.dtype = length, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * BATCH_ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        step = self.length * BATCH_ROWS
        at = 0
        while len(ids) - at >= step or (last and at < len(ids)):
            part = ids[at : at + step].astype(self.dtype)
            real = len(part)
            rows = -(-real // self.length)
            mask = np.ones(rows * self.length, dtype=bool)
            mask[real:] = False
            part = np.concatenate([part, np.zeros(rows * self.length - real, self.dtype)])
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            at += real
        self.waiting, self.held = [ids[at:]], len(ids) - at

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class TokenFile:
    """Random access to a tokens file; slices inside a batch are views of the mapped file."""

    def __init__(self, path: str) -> None:
        fs, p = file_system(path)
        source = pa.memory_map(p) if fs.type_name == "local" else fs.open_input_file(p)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.step = self.length * BATCH_ROWS
        self._at, self._ids = -1, None

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._ids = self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)
            self._at = i
        return self._ids

    def read(self, start: int, n: int) -> np.ndarray:
        out = []
        while n > 0:
            i, at = divmod(start, self.step)
            part = self._batch(i)[at : at + n]
            if not len(part):
                raise EOFError(f"{n} ids are missing from {start}")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        b = self.reader.get_batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS * self.length
        return b.column(0).flatten().to_numpy()[at : at + self.length], b.column(1).flatten().to_numpy(zero_copy_only=False)[at : at + self.length]


def _moved(fs, source: str, target: str) -> None:
    if fs.type_name != "local" and fs.get_file_info(target).type.name != "NotFound":
        fs.delete_file(target)
    fs.move(source, target)


def key_cuts(keys: DataFrame, parts: int) -> list:
    """At most ``parts - 1`` keys that cut the rows into ranges of near equal counts, from a sample of about ``SAMPLED`` keys a range.

    The sample only balances the ranges; every row belongs to one of them.
    """
    total = keys.count()
    sample = keys.where(keys[0].isNotNull()).sample(min(1.0, SAMPLED * parts / max(1, total)), seed=7)
    sampled = sorted(r[0] for r in sample.collect())
    return sorted({sampled[len(sampled) * i // parts] for i in range(1, parts)}) if sampled else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order below ``path``; returns the manifest (part, file, docs, n_docs, n_tokens)."""
    tokenizer = tokenizer or default_tokenizer()
    dtype = "<u2" if max(encoder(tokenizer).vocabulary - 1, end_id) < 1 << 16 else "<u4"
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = key_cuts(own.select("doc_id"), parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text"):
                keys = texts_column(part, "doc_id")
                place = [0 if k is None else bisect_left(cuts, k) for k in keys.to_pylist()]
                ids = [np.frombuffer(t + end, dtype="<u4").astype(dtype).tobytes() for t in tokens.encode(texts_column(part, "text").to_pylist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "place", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():08d}"
        writer = index = None
        n_docs = 0
        for batch in batches:
            if writer is None and batch.num_rows:
                fs, base = file_system(name)
                fs.create_dir(base.rpartition("/")[0], recursive=True)
                mine = f"{base}.attempt-{context.taskAttemptId()}"
                token_sink, doc_sink = fs.open_output_stream(f"{mine}.tokens"), fs.open_output_stream(f"{mine}.docs")
                writer = TokenWriter(token_sink, length, dtype)
                schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(doc_sink, schema)
            if batch.num_rows:
                first, sizes = [], []
                for raw in texts_column(batch, "ids"):
                    ids = np.frombuffer(raw.as_buffer(), dtype=dtype)
                    first.append(writer.total)
                    sizes.append(len(ids))
                    writer.append(ids)
                index.write_batch(pa.record_batch([texts_column(batch, "doc_id"), pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
                n_docs += len(sizes)
        if writer is not None:
            writer.close()
            index.close()
            token_sink.close()
            doc_sink.close()
            _moved(fs, f"{mine}.tokens", f"{base}.tokens.arrow")
            _moved(fs, f"{mine}.docs", f"{base}.docs.arrow")
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "tokens": [f"{name}.tokens.arrow"], "docs": [f"{name}.docs.arrow"], "n_docs": [n_docs], "n_tokens": [writer.total]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # ranges that are known before make one pass: a range partition would run the encoder twice, once for its ranges
    rows = own.mapInArrow(encode, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, place int, ids binary")
    ordered = rows.repartitionById(parts, "place").drop("place").sortWithinPartitions("doc_id", "ids")
    return stored(ordered.mapInArrow(write, "part int, tokens string, docs string, n_docs long, n_tokens long"), "manifest")


def read_documents(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per document, from the files: doc_id, start (over all files), n_tokens, ids_crc32.  The window has one row per file."""
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens"])
                fs, p = file_system(row["docs"])
                index = pa.ipc.open_file(fs.open_input_file(p))
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    crc = [zlib.crc32(tokens.read(s, n).astype("<u4")) for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                    start = pa.array(np.asarray(part.column(1)) + row["base"], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file: adaptive execution would put these few short rows into one
    return files.select("tokens", "docs", "base").repartition(max(1, manifest.count()), "tokens").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read every document back from the files."""
    manifest = write_tokens(docs, path or f"{shared_dir(spark)}/tokens", **options)
    return read_documents(manifest, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
