"""Language identification by compressed size under per-language dictionaries.

Texts are lower-cased.  Each language has a raw-content zstandard dictionary, filled from a bounded sample of
labelled rows.  A whole text is cut into chunks of ``CHUNK`` bytes, each compressed alone
under each dictionary (so a long text can't become its own dictionary), and the
language with the smallest sum is chosen.  ``rejected`` marks narrow margins: the runner-up is
within ``MARGIN`` of the best; the best guess is still given.

The sample: about ``SAMPLE_ROWS`` rows of each language, chosen by a hash of the id, and of each a
window of ``SAMPLE_CHARS`` characters at a hashed place; a dictionary has ``DICTIONARY_BYTES``.
So fitting reads the table once and gathers a few hundred KB per language at any size.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing was learned; ties go to the first language by name; rows with a null language
teach nothing; repeated rows are judged each; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, texts_column

SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 1000, 112_000
CHUNK, LEVEL, MARGIN, TEMPERATURE = 400, 9, 0.01, 12.0


def fit_dictionaries(rows: DataFrame, lang: str = "lang") -> dict[str, bytes]:
    """Dictionary contents by language of labelled rows (doc_id, text, lang)."""
    rows = rows.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    key = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, SAMPLE_ROWS / n) * (1 << 30)))))
    start = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1).cast("int")
    sample = rows.where(key < share[F.col(lang)]).select(F.col(lang).alias("lang"), key.alias("key"), F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("window")).collect()
    out = {}
    for name in sorted(counts):
        parts, held = [], 0
        for r in sorted((r for r in sample if r["lang"] == name), key=lambda r: (r["key"], r["window"])):
            raw = r["window"].lower().encode()
            if held + len(raw) > DICTIONARY_BYTES:
                break
            parts.append(raw)
            held += len(raw) + 1
        if parts:
            out[name] = b"\n".join(parts)
    return out


def _chunks(text: bytes) -> Iterator[bytes]:
    """Runs of about CHUNK bytes: equal parts, so the last isn't a stump."""
    n = max(1, round(len(text) / CHUNK))
    for i in range(n):
        yield text[len(text) * i // n : len(text) * (i + 1) // n]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        self.names = sorted(dictionaries)
        self.tools = []
        for name in self.names:
            content = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.tools.append(z.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        chunks = list(_chunks(text.lower().encode()))
        sizes = [sum(len(t.compress(c)) for c in chunks) for t in self.tools]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1.0 / sum(math.exp(max(-700.0, (sizes[best] - s) / TEMPERATURE)) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=math.inf)
        return self.names[best], score, rest - sizes[best] < MARGIN * sizes[best]


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [classifier.predict(t) for t in texts_column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(predict, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(parts: int, rest: int, id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(True))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from rows that aren't held out (fold 0 of 5) and predict all."""
    fitted = fit_dictionaries(docs.where(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return identify_languages(docs, fitted).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")
