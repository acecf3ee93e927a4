"""Near-duplicate groups: SuperMinHash, banding, exact confirmation, union-find.

Signature.  Each shingle gives every slot a rank of its own permutation (an affine one of a
prime number of slots) plus a fraction, and a slot keeps its least value.  Ranks are drawn
level by level: level j fills slots that no shingle took at a lower level, and a document
stops when all its slots are full, after one or two levels for long texts.  A slot agrees
between two documents with probability equal to their Jaccard similarity.

Links.  Documents with one shingle set are one class (grouped by a 128-bit set hash) and
its smallest id stands for it.  Representatives that agree on a band of 5 of 250 slots
share a bucket; at 0.8 a pair shares none of 50 buckets with probability 2e-9.  A bucket is
never expanded into all its pairs.  First its hub (the member that shares its buckets with most rows,
so nearest to the others) is compared with all others, and links join members into
components.  Members of buckets that still hold two components (without the hub, which is
done) then go through an exact prefix-filtered join, the same for groups of any size: a set's shingles are
ordered by how few of these sets hold them; of a pair at ``percent`` the smaller set's first
n - ceil(2p / (1 + p) n) + 1 and the larger one's first n - ceil(p n) + 1 must share one, at places that
leave room for the overlap, and only pairs of two components count.  Of a shingle's postings those outside its largest component
are joined with all, so the work grows with a component's members times those that aren't in it; no candidate is dropped, and a frequent shingle's postings can be
split as any skewed join.  Every candidate is confirmed on the full shingle sets, made again from the texts.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing;
a text of fewer words than a shingle is one shingle; rows that share an id count as linked, whatever
their texts; rows with a null id belong to no group and are kept; ids are integers (others raise
``TypeError``); an empty table gives no rows; extra columns don't matter.
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
from .words import SPACED, mix, shingle_hashes, slices, texts_column, words_of

#: Slots (a prime), of which BANDS x ROWS are used.
SLOTS, BANDS, ROWS = 251, 50, 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted by text and hash."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def superminhash(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, SLOTS) least values; a text without elements keeps the empty mark."""
    sig = np.full(n * SLOTS, _EMPTY, dtype=np.uint64)
    base = text * SLOTS
    slot = (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(SLOTS)).astype(np.int64)
    step = 1 + (mix(h ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % np.uint64(SLOTS - 1)).astype(np.int64)
    full = np.zeros(n, dtype=np.int64)
    for level in range(SLOTS):
        if not len(h):
            break
        key = base + slot
        free = sig[key] == _EMPTY
        key = key[free]
        value = (np.uint64(level) << np.uint64(56)) | (mix(h[free] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(8))
        np.minimum.at(sig, key, value)
        full += np.bincount(np.unique(key) // SLOTS, minlength=n)
        go = full[base // SLOTS] < SLOTS
        slot += step
        slot[slot >= SLOTS] -= SLOTS
        if not go.all():
            h, base, slot, step = h[go], base[go], slot[go], step[go]
    return sig.reshape(n, SLOTS)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of buckets."""
    rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return out.view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n_shingles, set hash (f1, f2), buckets of each row of (doc_id, th, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                h, text = distinct(*shingle_hashes(words_of(texts_column(part, "text"), SPACED), k))
                size = np.bincount(text, minlength=n)
                first = np.concatenate([[0], np.cumsum(size)])
                prints = []
                for salt in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B):
                    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                    prints.append(mix(run[first[1:]] - run[first[:-1]] + size.astype(np.uint64)).view(np.int64))
                buckets = band_hashes(superminhash(h, text, n))
                yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id"), texts_column(part, "th"), pa.array(size, pa.int64()), *(pa.array(x) for x in prints), pa.FixedSizeListArray.from_arrays(pa.array(buckets.ravel()), BANDS).cast(pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "f1", "f2", "buckets"])

    return docs.mapInArrow(sketch, "doc_id long, th long, n_shingles long, f1 long, f2 long, buckets array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, z): texts compressed, for the joins of confirmation."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([texts_column(batch, "doc_id"), texts_column(batch, "th"), pa.array([c.compress((t or "").encode()) for t in texts_column(batch, "text").to_pylist()], pa.binary())], names=["doc_id", "th", "z"])

    return docs.mapInArrow(pack, "doc_id long, th long, z binary")


def similar(texts: pa.Array, k: int, percent: int) -> np.ndarray:
    """Of texts 0 and 1, 2 and 3, ...: whether 100 x intersection >= percent x union of their shingle sets."""
    h, text = distinct(*shingle_hashes(words_of(texts, SPACED), k))
    n = np.bincount(text, minlength=len(texts)).reshape(-1, 2).sum(axis=1)
    pair = text // 2
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    both = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
    return (100 * both >= percent * (n - both)) & (both > 0)


def confirmed(pairs: DataFrame, packed: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = (texts_column(batch, x).to_pylist() for x in ("za", "zb"))
            keep, at, held, texts = [], 0, 0, []
            for i, both in enumerate(zip(a, b, strict=True)):
                texts += [d.decompress(x).decode() for x in both]
                held += len(texts[-1]) + len(texts[-2])
                if held > 2_000_000 or i == batch.num_rows - 1:
                    keep.append(similar(pa.array(texts, pa.large_string()), k, percent))
                    held, texts = 0, []
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    texts = packed.select("doc_id", "z")
    one = pairs.hint("merge").join(texts.withColumnsRenamed({"doc_id": "b", "z": "zb"}), "b").hint("merge").join(texts.withColumnsRenamed({"doc_id": "a", "z": "za"}), "a")
    return one.select("a", "b", "za", "zb").mapInArrow(confirm, "a long, b long")


def _shingles(members: DataFrame, k: int) -> DataFrame:
    """(rep, th, label, n, token), a row for each shingle of the sets of (rep, th, label, z)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()

        def out(rows: list[int], texts: list[str]) -> pa.RecordBatch:
            h, text = distinct(*shingle_hashes(words_of(pa.array(texts, pa.large_string()), SPACED), k))
            n = np.bincount(text, minlength=len(texts))
            own = [np.asarray(texts_column(batch, c))[rows][text] for c in ("rep", "th", "label")]
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), pa.array(n[text]), pa.array(h.view(np.int64))], names=["rep", "th", "label", "n", "token"])

        for batch in batches:
            rows, texts, held = [], [], 0
            for i, z in enumerate(texts_column(batch, "z").to_pylist()):
                rows.append(i)
                texts.append(d.decompress(z).decode())
                held += len(texts[-1])
                if held > 1_000_000 or i == batch.num_rows - 1:
                    yield out(rows, texts)
                    rows, texts, held = [], [], 0

    return members.select("rep", "th", "label", "z").mapInArrow(find, "rep long, th long, label long, n long, token long")


def _fits(small: Column, large: Column, percent: int) -> Column:
    """Sizes of which a pair can reach ``percent``."""
    return 100 * small >= percent * large


def prefix_pairs(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidates (a, b) of two labels among the sets of (rep, th, label, z), by an exact prefix-filtered join."""
    tokens = stored(_shingles(members, k), "shingles")
    held = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("df > 1")
    held = stored(held.select("token", "df", (F.col("lo") < F.col("hi")).alias("mixed")), "frequent")
    # shingles of one set alone come first and lead nowhere: only their number matters
    ranked = tokens.hint("merge").join(held, "token").groupBy("rep", "th", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token", "mixed"))).alias("t"))
    n, shared = F.col("n"), F.size("t")
    most = n - F.ceil(percent * n / 100) + 1  # prefix of a pair's larger set
    least = n - F.ceil(2 * percent * n / (100 + percent)) + 1  # and of its smaller one
    first = F.slice("t", F.lit(1), F.greatest(F.lit(0), most - (n - shared)).cast("int"))
    places = ranked.select("rep", "label", "n", least.alias("least"), (n - shared).alias("alone"), F.posexplode(first).alias("i", "x")).where("x.mixed")
    places = stored(places.select("rep", "label", "n", "least", (F.col("alone") + F.col("i")).alias("place"), F.col("x.token").alias("token")), "postings")
    few, all_ = sides(places)
    # of a pair the smaller set shows its shorter prefix
    first_is_small = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("rep1") < F.col("rep2")))
    shown = F.when(first_is_small, F.col("place1") < F.col("least1")).otherwise(F.col("place2") < F.col("least2"))
    room = (100 + percent) * F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= percent * (F.col("n1") + F.col("n2"))
    found = few.hint("merge").join(all_, "token").where((F.col("label1") != F.col("label2")) & shown & _fits(F.least("n1", "n2"), F.greatest("n1", "n2"), percent) & room)
    return found.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def sides(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of postings (token, rep, label, n, least, place): those outside their token's largest label, and all.

    Of a pair of two labels one is outside, so members of one large component are never joined with each other.
    """
    counts = places.groupBy("token", "label").agg(F.count("*").alias("g"))
    # stored, so that a frequent token's postings can be split in the join with it
    largest = stored(counts.groupBy("token").agg(F.max(F.struct("g", "label"))["label"].alias("largest")), "largest")
    columns = ("rep", "label", "n", "least", "place")
    few = places.hint("merge").join(largest, "token").where("label <> largest").select("token", *(F.col(c).alias(f"{c}1") for c in columns))
    return few, places.select("token", *(F.col(c).alias(f"{c}2") for c in columns))


def _links(own: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links that join the components of representatives (rep, th, n, buckets); None if no bucket holds two."""
    rows = reps.select("rep", "n", F.explode("buckets").alias("bucket"))
    shared = stored(rows.groupBy("bucket").agg(F.count("*").alias("g")).where("g > 1"), "shared")
    rows = stored(rows.hint("merge").join(shared, "bucket"), "members")
    if rows.isEmpty():
        return None
    near = rows.groupBy("rep").agg(F.sum("g").alias("near"))
    hubs = stored(rows.hint("merge").join(near, "rep").groupBy("bucket").agg(F.max(F.struct("near", "rep", "n")).alias("hub")), "hubs")
    ids = reps.hint("merge").join(near.select("rep"), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "th")
    packed = stored(_packed(own.hint("merge").join(ids, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])), "texts")
    rows = rows.drop("g").hint("merge").join(hubs, "bucket").where((F.col("rep") != F.col("hub.rep")) | (F.col("n") != F.col("hub.n")))
    fits = _fits(F.least("n", "hub.n"), F.greatest("n", "hub.n"), percent)
    first = stored(rows.where(fits).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct(), "pairs")
    links = stored(confirmed(first, packed, k, percent), "confirmed")
    labels = components(links).withColumnsRenamed({"vertex": "rep"})
    # what is left of each bucket without its hub
    rest = stored(rows.select("bucket", "rep").hint("merge").join(labels, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("label")), "labelled")
    mixed = stored(rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    if mixed.isEmpty():
        return links
    left = rest.hint("merge").join(mixed, "bucket", "left_semi").select("rep", "label").distinct()
    members = packed.withColumnsRenamed({"doc_id": "rep"}).hint("merge").join(left, "rep")
    more = prefix_pairs(members, k, percent).hint("merge").join(first, ["a", "b"], "left_anti")
    return links.union(stored(confirmed(stored(more, "pairs"), packed, k, percent), "confirmed"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: near_duplicates takes integer ids")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    rows = stored(sketches(own, k), "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    # all rows of a class have one set, and so one size and one list of buckets
    classes = real.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = stored(classes.select("f1", "f2", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "n", "buckets"), "classes")
    links = _links(own, classes.select("rep", "th", "n", "buckets"), k, percent)
    known = real.select("doc_id", "f1", "f2").hint("merge").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    # an id whose rows have different texts joins their classes
    again = stored(known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a"), "repeated")
    if not again.isEmpty():
        same = stored(known.hint("merge").join(again, "doc_id").where(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")).distinct(), "same")
        links = same if links is None else links.union(same)
    of = classes.select("f1", "f2", "rep")
    of = of.hint("merge").join(components(links).withColumnsRenamed({"vertex": "rep"}), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id")) if links is not None else of.withColumnRenamed("rep", "component_id")
    out = rows.select("doc_id", "n_shingles", "f1", "f2").hint("merge").join(of, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one document of each group stays (the smallest id), and of rows that share an id the one with the smallest text."""
    gone = near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct().hint("merge")
    kept = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    again = stored(again, "repeated")
    if again.isEmpty():
        return kept
    one = F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("__row")
    rows = kept.join(again, F.col(id_col) == F.col("__again"), "left_semi").groupBy(F.col(id_col).alias("__again")).agg(one)
    return kept.join(again, F.col(id_col) == F.col("__again"), "left_anti").unionByName(rows.select("__row.*"))
