"""Queries of large scans and sinks, low-rank and 8-bit weights, blockwise attention and decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import attention as at
from ..operators import convolution as cv
from ..operators import decoding as dc
from ..operators import lowrank as lr
from ..operators import registry as rg
from ..operators import weights as wt
from ..sources import file_sink as fs
from ..sources import icc, png
from ..sources.json_arrays import write_json_array
from ..sources.readers import corpus_turns, read_corpora
from ..sources.scratch import scratch_folder
from .catalog import query
from .system_queries import NAMED, _round, _weights

# ---- scans and sinks: written, then read back


@query("s01_corpus_records", "SELECT conv_id, CAST(turn - min(turn) OVER (PARTITION BY conv_id) AS BIGINT) AS turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, text, CAST(conv_id % 2 AS INTEGER) AS img_path_idx FROM conversations")
def s01(d):
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    records = d.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("from"), F.col("text").alias("value")))).alias("m"))
    said = F.transform("m", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))).alias("conversations")
    texts = records.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), said)).alias("value"))
    folder = scratch_folder(d.spark)
    for i in range(2):  # two corpora
        write_json_array(texts.where(F.col("conv_id") % 2 == i).select("value"), f"{folder}/{i}")
    corpus = read_corpora(d.spark, [f"{folder}/{i}" for i in range(2)])
    return corpus_turns(corpus, "id").select(F.col("id").cast("long").alias("conv_id"), "turn", "role", "text", "img_path_idx")


@query("k07_weight_files", f"""WITH w AS (SELECT {NAMED} AS name, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS data FROM embeddings), s AS (SELECT DISTINCT string_split(name, 'lora_')[1] || 'bias' AS b FROM w WHERE contains(name, 'lora_'))
SELECT 'mm_projector.jsonl' AS file, name, data FROM w WHERE contains(name, 'mm_projector') UNION ALL SELECT 'adapter_model.jsonl', name, data FROM w WHERE contains(name, 'lora_') OR name IN (SELECT b FROM s) UNION ALL SELECT 'non_lora_trainables.jsonl', name, data FROM w WHERE NOT contains(name, 'lora_') AND vec_id % 13 <> 0""")
def k07_files(d):
    """Each part of a training's weights in a file of its own, which appears when the write is done."""
    data = F.transform("embedding", lambda x: x.cast("double"))
    kept = wt.sinks(_weights(d).select("name", "requires_grad", data.alias("data")))
    line = F.concat(F.to_json(F.struct("name", "data")), F.lit("\n"))
    folder = scratch_folder(d.spark)
    fs.save_files(kept.select(F.concat("sink", F.lit(".jsonl")).alias("name"), F.encode(line, "UTF-8").alias("content"), F.col("name").alias("weight")), folder, ["weight"])
    rows = d.spark.read.text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", "name string, data array<double>").alias("w"))
    return rows.select("file", "w.name", "w.data")


@query("k02_text_files", "SELECT 'img-' || doc_id || '.txt' AS name, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''")
def k02_files(d):
    """A text file for each document, written and read back (without empty ones)."""
    folder = scratch_folder(d.spark)
    named = d.documents.where("doc_id is not null").select(F.concat(F.lit("img-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    names = fs.save_files(named, folder)
    return fs.read_files(d.spark, folder, names).select("name", F.decode("content", "UTF-8").alias("text"))


_PICTURES = "p AS (SELECT l_suppkey AS picture, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey % 256) - 1 AS px, [l_orderkey % 256, l_partkey % 256, l_suppkey % 256] AS rgb FROM lineitem)"


def _pictures(d):
    """Pictures of 8 pixels in a row from the lines of a supplier, the last row filled with zeros."""
    byte = lambda c: F.substring(F.hex(F.col(c) % 256 + 256), -2, 2)
    px = F.concat(*(byte(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")))
    rows = d.lineitem.groupBy(F.col("l_suppkey").alias("picture")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", px.alias("px")))).alias("p"))
    height = F.ceil(F.size("p") / 8).cast("int")
    return rows.select("picture", F.lit(8).alias("width"), height.alias("height"), F.unhex(F.rpad(F.array_join(F.transform("p", lambda x: x["px"]), ""), height * 48, F.lit("0"))).alias("rgb"))


_FILLED = f"WITH {_PICTURES}, n AS (SELECT picture, (count(*) + 7) // 8 * 8 AS n FROM p GROUP BY picture) SELECT n.picture, CAST(i AS BIGINT) AS px, coalesce(p.rgb, [CAST(0 AS BIGINT), 0, 0]) AS rgb FROM n, unnest(range(n.n)) u(i) LEFT JOIN p ON p.picture = n.picture AND p.px = i"


@query("k03_pictures", _FILLED)
def k03(d):
    """Pictures written as PNG files under their names, read back and decoded; all five filters occur."""
    folder = scratch_folder(d.spark)
    files = png.encoded(_pictures(d), "picture")
    names = fs.save_files(files.select(F.concat(F.col("picture").cast("string"), F.lit(".png")).alias("name"), "content"), folder)
    read = fs.read_files(d.spark, folder, names).select(F.regexp_extract("name", r"^\d+", 0).cast("long").alias("picture"), "content")
    return png.pixel_rows(png.decoded(read, "picture"), "picture")


@query("s05_base64_pictures", _FILLED)
def s05_pictures(d):
    """Pictures in base64, decoded to pixels."""
    return png.pixel_rows(png.decoded(png.encoded(_pictures(d), "picture", (4, 3, 0)).select("picture", F.base64("content").alias("content")), "picture"), "picture")


_TO_SRGB = np.linalg.inv(np.array(icc.SRGB)) @ np.round(np.array(icc.ADOBE) * 65536) / 65536
_CLIPPED = "list_transform([" + ", ".join("least(greatest(" + " + ".join(f"({float(_TO_SRGB[k][i])!r}::DOUBLE) * l[{i + 1}]" for i in range(3)) + ", 0), 1)" for k in range(3)) + "], lambda v: CAST(floor(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4::DOUBLE) - 0.055 END * 255 + 0.5) AS BIGINT))"


@query("s06_pictures_in_srgb", f"WITH f AS ({_FILLED}), l AS (SELECT picture, px, list_transform(rgb, lambda c: pow(c / 255.0::DOUBLE, CASE WHEN picture % 2 = 0 THEN 461 / 256.0::DOUBLE ELSE 563 / 256.0::DOUBLE END)) AS l FROM f) SELECT picture, px, {_CLIPPED} AS rgb FROM l")
def s06(d):
    """PNGs to sRGB: every second one carries a profile with gamma 1.8, the rest take the fallback."""
    from pyspark.sql import DataFrame

    fallback = icc.build(icc.ADOBE, [icc.gamma_tag(icc.ADOBE_GAMMA)] * 3)
    own = icc.build(icc.ADOBE, [icc.gamma_tag(1.8)] * 3)

    def marked(files: DataFrame) -> DataFrame:
        def mark(batches):
            import pyarrow as pa

            for batch in batches:
                out = [icc.with_profile(c, own) if n % 2 == 0 else c for n, c in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["picture", "content"])

        return files.mapInArrow(mark, "picture long, content binary")

    files = marked(png.encoded(_pictures(d), "picture").select(F.col("picture").cast("long").alias("picture"), "content"))
    folder = scratch_folder(d.spark)  # pictures are made once
    files.write.parquet(folder)
    files = d.spark.read.parquet(folder)
    found = icc.profiles_of(files, "picture", keep=["content"])
    pixels = png.pixel_rows(png.decoded(found, "picture", keep=["profile"]), "picture", ["profile"])
    return icc.to_srgb(pixels, found, fallback).select("picture", "px", "rgb")


# ---- low-rank updates and 8-bit weights: a matrix for each label, a row for each vector

_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _matrix(d):
    return d.embeddings.select(F.concat(F.lit("layer"), F.col("label").cast("string")).alias("name"), F.col("vec_id").cast("long").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def _factors(d):
    """B: sums of eight values each of every row; A: means of the rows with the same remainder, so an inner index of eight."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(F.slice("values", k * 8 + 1, F.lit(8)), F.lit(0.0), lambda s, v: s + v))
    b = _matrix(d).select("name", "row", sums.alias("values"))
    each = _matrix(d).select("name", (F.col("row") % 8).alias("row"), F.posexplode("values").alias("dim", "v"))
    means = each.groupBy("name", "row", "dim").agg(F.avg("v").alias("v")).groupBy("name", "row")
    a = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("values"))
    return b, a


@query("s09_lora_merge", f"""WITH w AS (SELECT 'layer' || label AS name, vec_id AS row, {_DOUBLES} AS v FROM embeddings),
a AS (SELECT name, row % 8 AS k, i, avg(v[i]) AS x FROM w, unnest(range(1, 65)) u(i) GROUP BY ALL),
al AS (SELECT name, k, list(x ORDER BY i) AS a FROM a GROUP BY ALL),
p AS (SELECT w.name, row, k, list_transform(a, lambda x: x * list_sum(v[8 * k + 1:8 * k + 8])) AS p FROM w JOIN al ON al.name = w.name),
s AS (SELECT name, row, i, sum(p[i]) AS s FROM p, unnest(range(1, 65)) u(i) GROUP BY ALL), sl AS (SELECT name, row, list(s ORDER BY i) AS s FROM s GROUP BY ALL)
SELECT w.name, w.row, list_transform(range(1, 65), lambda i: round(v[i] + 2 * s[i], 6) + 0.0::DOUBLE) AS values FROM w JOIN sl ON sl.name = w.name AND sl.row = w.row""")
def s09_merge(d):
    b, a = _factors(d)
    return lr.lora_merged(_matrix(d), b, a, 2.0, inner=3, rows=256).select("name", "row", F.transform("values", lambda v: F.round(v, 6) + 0.0).alias("values"))


@query("s09_8bit_weights", f"""WITH w AS (SELECT 'layer' || label AS name, vec_id AS row, {_DOUBLES} AS v FROM embeddings),
m AS (SELECT name, row, v, [list_max(list_transform(v[1:48], lambda x: abs(x))), list_max(list_transform(v[49:64], lambda x: abs(x)))] AS m FROM w)
SELECT name, row, list_transform(v, lambda x, i: CAST(round_even(x / m[(i - 1) // 48 + 1] * 127, 0) AS INTEGER)) AS codes, list_transform(v, lambda x, i: round(round_even(x / m[(i - 1) // 48 + 1] * 127, 0) * m[(i - 1) // 48 + 1] / 127, 6) + 0.0::DOUBLE) AS values FROM m""")
def s09_8bit(d):
    """Weights stored in 8 bits, read back and made doubles again."""
    folder = scratch_folder(d.spark)
    lr.write_8bit(_matrix(d), folder, 48)
    rows = lr.read_8bit(d.spark, folder, 48)
    return rows.select("name", "row", F.transform("codes", lambda c: c.cast("int")).alias("codes"), F.transform("values", lambda v: F.round(v, 6) + 0.0).alias("values"))


# ---- attention by blocks

_ATTEND = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT a.vec_id, b.v, list_dot_product(a.v, b.v) * {0} AS s FROM e a JOIN e b ON a.label = b.label), m AS (SELECT *, s - max(s) OVER (PARTITION BY vec_id) AS t FROM s),
w AS (SELECT vec_id, i, sum(exp(t) * v[i]) / sum(exp(t)) AS x FROM m, unnest(range(1, 65)) u(i) GROUP BY vec_id, i)
SELECT vec_id, list(round(x, 6) + 0.0::DOUBLE ORDER BY i) AS out FROM w GROUP BY vec_id"""


def _attended(d, scale, block):
    rows = d.embeddings.select(F.col("label").alias("grp"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = at.block_attention(rows.select("grp", F.col("vec_id").alias("qid"), F.col("v").alias("q")), rows.select("grp", F.col("vec_id").alias("kid"), F.col("v").alias("k"), "v"), scale, block)
    return out.select(F.col("qid").alias("vec_id"), F.transform("out", lambda x: F.round(x, 6) + 0.0).alias("out"))


@query("n26_block_attention", _ATTEND.format("0.125::DOUBLE"))
def n26(d):
    """Every vector attends to all of its label."""
    return _attended(d, 0.125, at.BLOCK)


@query("n26_sharp_attention", _ATTEND.format("700.0::DOUBLE"))
def n26_sharp(d):
    """Scores up to 700, and blocks of a few keys."""
    return _attended(d, 700.0, 16)


# ---- decoding, with scores from how often characters follow each other

_PAIRS = "g AS (SELECT text[i:i] AS context, text[i + 1:i + 1] AS token, ln(count(*)) AS logit FROM conversations, unnest(range(1, length(text))) u(i) GROUP BY ALL)"


def _kept_sql(temperature: float, top_p: float) -> str:
    return f"""{_PAIRS}, w AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY context)) / {temperature}::DOUBLE) AS w FROM g), p AS (SELECT context, token, w / sum(w) OVER (PARTITION BY context) AS p FROM w),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY context ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
k AS (SELECT context, token, p / sum(p) OVER (PARTITION BY context) AS p FROM b WHERE before < {top_p}), u AS (SELECT *, sum(p) OVER (PARTITION BY context ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) AS upto FROM k)"""


@query("t12_nucleus", f"WITH {_kept_sql(0.7, 0.9)} SELECT context, token, round(p, 9) AS p, round(upto, 9) AS upto FROM u")
def t12_nucleus(d):
    kept = dc.nucleus(dc.bigram_logits(d.conversations, "text"), 0.7, 0.9)
    return kept.select("context", "token", F.round("p", 9).alias("p"), F.round("upto", 9).alias("upto"))


_ASKED = "a AS (SELECT conv_id || '-' || turn AS key, right(text, 1) AS context FROM conversations)"


def _asked(d):
    return d.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.expr("right(text, 1)").alias("context"))


@query("t12_draws", f"WITH {_kept_sql(0.7, 0.9)}, {_ASKED}, n AS (SELECT *, CAST(('0x' || left(md5('7:' || key), 7)) AS BIGINT) / 268435456.0::DOUBLE AS x FROM a) SELECT n.key, coalesce(arg_min(token, upto) FILTER (upto > x), arg_max(token, upto)) AS token FROM n JOIN u ON u.context = n.context GROUP BY n.key")
def t12_draws(d):
    """A token drawn behind each turn."""
    return dc.drawn(_asked(d), dc.nucleus(dc.bigram_logits(d.conversations, "text"), 0.7, 0.9), 7)


@query("t12_greedy", f"WITH {_PAIRS}, {_ASKED}, b AS (SELECT context, first(token ORDER BY logit DESC, token) AS token FROM g GROUP BY context) SELECT key, token FROM a JOIN b USING (context)")
def t12_greedy(d):
    """Temperature 0."""
    return dc.drawn(_asked(d), dc.nucleus(dc.bigram_logits(d.conversations, "text"), 0, 0.9), 7)


@query("t12_beams", f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT context, token, CAST(round((logit - ln(sum(exp(logit)) OVER (PARTITION BY context))) * 1e6) AS BIGINT) AS step FROM g),
b AS (SELECT DISTINCT context AS start, context AS sequence, context AS tail, CAST(0 AS BIGINT) AS score, 0 AS n FROM g
UNION ALL SELECT start, sequence, tail, score, n FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, sequence) AS r FROM (
SELECT start, sequence || coalesce(token, '') AS sequence, coalesce(token, tail) AS tail, score + coalesce(step, 0) AS score, n + 1 AS n FROM b LEFT JOIN l ON l.context = b.tail AND b.tail <> '.' WHERE n < 5 AND (token IS NOT NULL OR tail = '.'))) WHERE r <= 3)
SELECT start, sequence, score, CAST(row_number() OVER (PARTITION BY start ORDER BY score DESC, sequence) AS BIGINT) AS rank FROM b WHERE n = 5""")
def t12_beams(d):
    """The three best continuations of five characters from every context, ended by a full stop."""
    folder = scratch_folder(d.spark)  # the texts are counted once, not for each step
    dc.bigram_logits(d.conversations, "text").write.parquet(folder)
    steps = dc.log_steps(d.spark.read.parquet(folder))
    starts = steps.select(F.col("context").alias("start"), "context").distinct()
    return dc.beams(starts, steps, 3, 5, ".")


# ---- checkpoints in shards

_BYTES = "length(name) + 8 * 64"


@query("z19_sharded_checkpoint", f"""WITH w AS (SELECT replace({NAMED}, 'layers.', 'model.layers.') AS name, {_DOUBLES} AS data FROM embeddings), b AS (SELECT *, (sum({_BYTES}) OVER (ORDER BY name) - ({_BYTES})) // 20000 AS s FROM w), n AS (SELECT *, dense_rank() OVER (ORDER BY s) AS no FROM b)
SELECT name, 'model-' || lpad(CAST(no AS VARCHAR), 5, '0') || '-of-' || lpad(CAST(max(no) OVER () AS VARCHAR), 5, '0') || '.jsonl' AS file, data FROM n""")
def z19(d):
    """Renamed tensors written to shards and read back by their index."""
    data = F.transform("embedding", lambda x: x.cast("double"))
    rows = wt.sharded(_weights(d).select(F.replace("name", F.lit("layers."), F.lit("model.layers.")).alias("name"), data.alias("data")), 20_000, F.length("name") + 8 * F.size("data"))
    folder = scratch_folder(d.spark)
    line = F.concat(F.to_json(F.struct("name", "data")), F.lit("\n"))
    rows.select("name", F.concat("file", F.lit(".jsonl")).alias("file")).write.parquet(f"{folder}/index")
    fs.save_files(rows.select(F.concat("file", F.lit(".jsonl")).alias("name"), F.encode(line, "UTF-8").alias("content"), F.col("name").alias("tensor")), f"{folder}/shards", ["tensor"])
    read = d.spark.read.text(f"{folder}/shards").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", "name string, data array<double>").alias("w"))
    return d.spark.read.parquet(f"{folder}/index").join(read.select("file", "w.name", "w.data"), ["name", "file"])


# ---- folded branches: an output for each vector, whose values are the kernels, norms and the window that it sees

_AT = "CAST(embedding[{0}] AS DOUBLE)"
_SIZES = {"wide": 3, "narrow": 1, "identity": 1}


def _v(i):
    return F.get("embedding", F.lit(i - 1)).cast("double")


def _norms(d):
    each = [d.embeddings.select(F.col("label").alias("layer"), F.lit(name).alias("branch"), F.col("vec_id").alias("out"), _v(i).alias("gamma"), _v(i + 1).alias("beta"), _v(i + 2).alias("mean"), (_v(i + 3) * _v(i + 3) + 0.5).alias("var")) for name, i in (("wide", 41), ("narrow", 45), ("identity", 49))]
    return each[0].union(each[1]).union(each[2])


def _kernel(d):
    own = d.embeddings.select(F.col("label").alias("layer"), F.col("vec_id").alias("out"), "embedding")
    wide = own.select("layer", "out", F.posexplode(F.slice("embedding", 1, 36)).alias("i", "w")).select("layer", F.lit("wide").alias("branch"), "out", F.floor(F.col("i") / 9).cast("long").alias("in"), F.floor(F.col("i") % 9 / 3).cast("int").alias("ky"), (F.col("i") % 3).alias("kx"), F.col("w").cast("double").alias("w"))
    narrow = own.select("layer", "out", F.posexplode(F.slice("embedding", 37, 4)).alias("i", "w")).select("layer", F.lit("narrow").alias("branch"), "out", F.col("i").cast("long").alias("in"), F.lit(0).alias("ky"), F.lit(0).alias("kx"), F.col("w").cast("double").alias("w"))
    return wide.union(narrow).union(cv.identity_kernels(own, F.col("out") % 4))


_NORMED = " + ".join(f"({_AT.format(i)} * ({x} - {_AT.format(i + 2)}) / sqrt(pow({_AT.format(i + 3)}, 2) + 0.5 + 1e-5::DOUBLE) + {_AT.format(i + 1)})" for x, i in (("wide", 41), ("narrow", 45), ("own", 49)))


@query("n21_folded_branches", f"""WITH s AS (SELECT *, list_transform(list_reverse(embedding)[1:36], lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL),
b AS (SELECT *, list_dot_product(list_transform(embedding[1:36], lambda v: CAST(v AS DOUBLE)), x) AS wide, list_dot_product(list_transform(embedding[37:40], lambda v: CAST(v AS DOUBLE)), [x[5], x[14], x[23], x[32]]) AS narrow, x[vec_id % 4 * 9 + 5] AS own FROM s)
SELECT label AS layer, vec_id AS out, round({_NORMED}, 6) + 0.0::DOUBLE AS y FROM b""")
def n21(d):
    """One kernel in place of a 3 x 3, a 1 x 1 and an identity branch, each with its norm; SQL runs the branches apart."""
    kernel, bias = cv.one_kernel(*cv.folded(_kernel(d), _norms(d)), _SIZES)
    seen = d.embeddings.select(F.col("label").alias("layer"), F.col("vec_id").alias("out"), F.posexplode(F.slice(F.reverse("embedding"), 1, 36)).alias("i", "x"))
    window = seen.select("layer", "out", F.floor(F.col("i") / 9).cast("long").alias("in"), F.floor(F.col("i") % 9 / 3).cast("int").alias("ky"), (F.col("i") % 3).alias("kx"), F.col("x").cast("double").alias("x"))
    return cv.applied(kernel, bias, window).select("layer", "out", (F.round("y", 6) + 0.0).alias("y"))


# ---- attention of pictures to their own pixels

_FIRST, _SECOND = [[0.5, -0.25, 1.0], [-1.0, 0.75, 0.5]], [[0.5, -0.5], [1.0, 0.25], [-0.75, 1.0]]
_WINDOW = np.array([[[((p * 5 + y * 3 + x * 2) % 11 - 5) / 20.0 for x in range(7)] for y in range(7)] for p in range(2)])


def _grid(d):
    """Pictures of eight pixels in a row, without fill."""
    rows = d.lineitem.groupBy(F.col("l_suppkey").alias("image")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("p"))
    each = rows.select("image", F.posexplode("p").alias("px", "p"))
    return each.select("image", F.floor(F.col("px") / 8).cast("long").alias("y"), (F.col("px") % 8).cast("long").alias("x"), F.array(*(F.col(f"p.{c}") % 256 / 255.0 for c in ("l_orderkey", "l_partkey", "l_suppkey"))).alias("v"))


_GRID = "g AS (SELECT l_suppkey AS image, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 8 AS y, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) % 8 AS x, [l_orderkey % 256 / 255.0::DOUBLE, l_partkey % 256 / 255.0::DOUBLE, l_suppkey % 256 / 255.0::DOUBLE] AS v FROM lineitem)"
_SPATIAL = """m AS (SELECT image, y, x, list_avg(v) AS a, list_max(v) AS t FROM {0}), o AS (SELECT dy, dx, ((dy * 3 + dx * 2) % 11 - 5) / 20.0::DOUBLE AS wa, ((5 + dy * 3 + dx * 2) % 11 - 5) / 20.0::DOUBLE AS wt FROM range(7) a(dy), range(7) b(dx)),
s AS (SELECT p.image, p.y, p.x, sum(q.a * wa + q.t * wt) AS s FROM m p, o, m q WHERE q.image = p.image AND q.y = p.y + dy - 3 AND q.x = p.x + dx - 3 GROUP BY ALL)
SELECT image, y, x, list_transform(v, lambda c: round(c / (1 + exp(-s)), 6)) AS v FROM {0} JOIN s USING (image, y, x)"""


@query("n15_spatial_attention", f"WITH {_GRID}, {_SPATIAL.format('g')}")
def n15(d):
    """Pixels times a window of seven over their surroundings, by tiles of sixteen pixels."""
    return cv.spatial_attention(_grid(d), _WINDOW, 16).select("image", "y", "x", _round("v").alias("v"))


def _gate_sql(pool: str) -> list[str]:
    hidden = ["greatest(" + " + ".join(f"({w}::DOUBLE) * {pool}{c}" for c, w in enumerate(row)) + ", 0.0::DOUBLE)" for row in _FIRST]
    return [" + ".join(f"({w}::DOUBLE) * {h}" for h, w in zip(hidden, row, strict=True)) for row in _SECOND]


_GATES = ", ".join(f"1 / (1 + exp(-({a} + {b})))" for a, b in zip(_gate_sql("a"), _gate_sql("t"), strict=True))
_POOLS = ", ".join(f"avg(v[{c + 1}]) AS a{c}, max(v[{c + 1}]) AS t{c}" for c in range(3))


@query("n15_block_attention_module", f"WITH {_GRID}, pools AS (SELECT image, {_POOLS} FROM g GROUP BY image), gates AS (SELECT image, [{_GATES}] AS k FROM pools), c AS (SELECT image, y, x, list_transform(v, lambda e, i: e * k[i]) AS v FROM g JOIN gates USING (image)), {_SPATIAL.format('c')}")
def n15_module(d):
    """Channels weighed by picture, then pixels by their surroundings."""
    return cv.block_attention_module(_grid(d), _FIRST, _SECOND, _WINDOW, 16).select("image", "y", "x", _round("v").alias("v"))


# ---- the pool of workers, read from the state of its stream

_DAYS = 5
_POOL = f"""e AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS worker, event_type, CAST(floor(value) AS INTEGER) % 20 AS queue_length, CAST(event_id % 5 + 1 AS INTEGER) AS speed, user_id % 4 <> 0 AS checked FROM events),
f AS (SELECT worker, min(ts) AS registered FROM e WHERE event_type = 'signup' GROUP BY worker), r AS (SELECT worker, arg_max(speed, ts) AS speed, arg_max(checked, ts) AS checked FROM e WHERE event_type = 'signup' GROUP BY worker),
l AS (SELECT worker, max(ts) AS beat, arg_max(queue_length, e.ts) AS queue_length FROM e GROUP BY worker), p AS (SELECT * FROM f JOIN r USING (worker) JOIN l USING (worker)),
pool AS (SELECT *, [('m' || CAST(worker AS BIGINT) % 3), 'all'] AS model_names FROM p WHERE NOT checked OR epoch_us(beat) // 1000 + {_DAYS} * 86400000 + 1 > (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM e))"""


def _state(d):
    """Runs the stream over all events, stops it and reads what it knows of each worker."""
    from ..streaming.workers import PROVIDER, pool_state, worker_stream

    spark, key = d.spark, "spark.sql.streaming.stateStore.providerClass"
    table = spark.read.parquet(f"{d.folder}/events.parquet")
    folder, before = scratch_folder(spark), spark.conf.get(key)
    reader = spark.readStream.schema(table.schema)
    # a stream reads folders: where the table is one file, the one that holds it
    alone = all(f.endswith("/events.parquet") for f in table.inputFiles())
    events = reader.option("pathGlobFilter", "events.parquet").parquet(d.folder) if alone else reader.parquet(f"{d.folder}/events.parquet")
    user = F.col("user_id")
    rows = events.select(user.cast("string").alias("worker"), F.when(F.col("event_type") == "signup", "register").otherwise("heartbeat").alias("event"), (F.floor("value").cast("int") % 20).alias("queue_length"), (user % 4 != 0).alias("check_heart_beat"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5 + 1).cast("int").alias("speed"), F.array(F.concat(F.lit("m"), (user % 3).cast("string")), F.lit("all")).alias("model_names"))
    spark.conf.set(key, PROVIDER)
    try:
        run = worker_stream(rows, _DAYS * 86400).writeStream.format("noop").outputMode("append").option("checkpointLocation", folder).start()
        run.processAllAvailable()
        run.stop()
        run.awaitTermination(60)
    finally:
        spark.conf.set(key, before)
    return pool_state(spark, folder)


@query("s10_running_pool", f"WITH {_POOL} SELECT worker, queue_length, speed, checked AS check_heart_beat, CAST(epoch_us(beat) // 1000 AS BIGINT) AS last_beat_ms, CAST(epoch_us(registered) // 1000 AS BIGINT) AS registered_ms, model_names FROM pool")
def s10_pool(d):
    """List: every worker that the stopped stream still holds."""
    return _state(d)


@query("s10_address", f"WITH {_POOL}, c AS (SELECT *, unnest(model_names) AS model FROM pool) SELECT model, arg_min(worker, lpad(CAST(CAST(round(queue_length * 1e9 / speed) AS BIGINT) AS VARCHAR), 20, '0') || lpad(CAST(epoch_us(registered) // 1000 AS VARCHAR), 20, '0')) AS worker, CAST(arg_min(queue_length, lpad(CAST(CAST(round(queue_length * 1e9 / speed) AS BIGINT) AS VARCHAR), 20, '0') || lpad(CAST(epoch_us(registered) // 1000 AS VARCHAR), 20, '0')) + 1 AS INTEGER) AS queue_length FROM c GROUP BY model")
def s10_address(d):
    """The worker of each model with the shortest queue, the first registered on ties."""
    return rg.shortest_queue(rg.candidates(_state(d)), order="registered_ms")


@query("s10_status", f"WITH {_POOL} SELECT (SELECT list_sort(list(DISTINCT m)) FROM (SELECT unnest(model_names) AS m FROM pool)) AS model_names, CAST(sum(speed) AS BIGINT) AS speed, CAST(sum(queue_length) AS BIGINT) AS queue_length FROM pool")
def s10_status(d):
    return rg.status(_state(d))
