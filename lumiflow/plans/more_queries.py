"""Queries of remaining inventory rows: records as JSON, collation, running offsets, attention and the renderer as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import templates as tp
from ..functions import tokens as tk
from ..operators import chat
from ..operators import decoding as dc
from ..operators import registry as rg
from ..operators import render as rn
from ..operators import weights as wt
from .catalog import query, quoted
from .chat_queries import CHATML, TURNS, _prompt_sql
from .data_queries import _PADDED, IDS, SIZES, _batch, _ids, _sizes, size_columns
from .system_queries import _H, B1, B2, EVENTS, NAMED, W1, W2, WZ, _events, _lin, _out_sql, _pixels, _round, _weights


@query("s05_base64", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, to_base64(encode(text)) AS b64 FROM documents")
def s05(d):
    b64 = F.base64(F.encode("text", "UTF-8"))
    # Spark breaks lines after 76 characters where the session asks for it
    return d.documents.select("doc_id", F.octet_length(F.unbase64(b64)).cast("long").alias("bytes"), F.replace(b64, F.lit("\r\n"), F.lit("")).alias("b64"))


@query("w02_running_offsets", f"WITH {TURNS} SELECT conv_id, CAST(pos // 2 AS BIGINT) AS round, CAST(coalesce(sum(sum(length(text))) OVER (PARTITION BY conv_id ORDER BY pos // 2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t GROUP BY conv_id, pos // 2")
def w02(d):
    rounds = chat.usable_turns(d.conversations).groupBy("conv_id", F.floor(F.col("pos") / 2).cast("long").alias("round")).agg(F.sum(F.length("text")).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.select("conv_id", "round", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("start"))


@query("z02_always_pad", f"WITH {SIZES} SELECT p_partkey, greatest(w, h) AS side FROM s")
def z02(d):
    return _sizes(d).select("p_partkey", g.square(*size_columns())[0].alias("side"))


@query("z06_collate", f"{_PADDED}, f AS (SELECT conv_id, bool_and(turn % 2 = 0) AS images FROM conversations WHERE turn = 0 GROUP BY conv_id) SELECT conv_id, turn, list_concat(ids, list_transform(range(m - len(ids)), lambda i: CAST(0 AS BIGINT))) AS input_ids, list_transform(range(m), lambda i: i < len(ids)) AS attention_mask, images FROM b JOIN f USING (conv_id)")
def z06(d):
    ids = tk.pad_right(F.col("ids"), F.col("m"), 0)
    first = F.first(F.col("turn") % 2 == 0).over(Window.partitionBy("conv_id").orderBy("turn"))  # optional columns go by the first row
    return _batch(d).select("conv_id", "turn", ids.alias("input_ids"), tk.attention_mask(ids, 0).alias("attention_mask"), first.alias("images"))


@query("k02_text_names", "SELECT doc_id, 'img-' || doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def k02(d):
    return d.documents.select("doc_id", F.concat(F.lit("img-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("bytes"))


def _values(n, m):
    return F.transform(F.slice("embedding", n, m), lambda x: x.cast("double"))


_E = "CAST(embedding[{0}] AS DOUBLE)"


@query("n05_dual_condition", "SELECT vec_id, [" + ", ".join(f"round(({_E.format(i)} * (1 + {_E.format(i + 2)}) + {_E.format(i + 4)}) * (1 + {_E.format(i + 6)}) + {_E.format(i + 8)}, 6)" for i in (1, 2)) + "] AS x FROM embeddings")
def n05(d):
    one = rn.condition(_values(1, 2), _values(3, 4), "adain")
    return d.embeddings.select("vec_id", _round(rn.condition(one, _values(7, 4), "adain")).alias("x"))


def _square(a: int, b: int, m: int):
    return [[((i * a + j * b) % m - m // 2) / 4.0 for j in range(4)] for i in range(4)], [(i - 1) / 8.0 for i in range(4)]


def _square_sql(a: int, b: int, m: int, x: str) -> str:
    return f"list_transform(range(4), lambda i: list_sum(list_transform(range(4), lambda j: ((i * {a} + j * {b}) % {m} - {m // 2}) / 4.0::DOUBLE * {x}[j + 1])) + (i - 1) / 8.0::DOUBLE)"


ATTEND = rn.Attention(_square(3, 2, 5), _square(2, 3, 7), _square(1, 2, 5), _square(5, 3, 7), 2)
_HEAD = "list_transform(list_transform(k, lambda t: (q[{0}] * t[{0}] + q[{1}] * t[{1}]) / sqrt(2.0::DOUBLE)), lambda y: exp(y))"
# two heads of two values, over three vectors normed each
_ATTENDED = f"""e AS (SELECT vec_id, [{", ".join(_E.format(j) for j in range(1, 5))}] AS x, [{", ".join("[" + ", ".join(_E.format(4 * k + j) for j in range(1, 5)) + "]" for k in (1, 2, 3))}] AS c FROM embeddings),
n AS (SELECT vec_id, x, list_transform(c, lambda t: list_transform(t, lambda v: (v - list_avg(t)) / sqrt(list_var_pop(t) + 1e-5::DOUBLE))) AS c FROM e),
q AS (SELECT vec_id, x, {_square_sql(3, 2, 5, "x")} AS q, list_transform(c, lambda t: {_square_sql(2, 3, 7, "t")}) AS k, list_transform(c, lambda t: {_square_sql(1, 2, 5, "t")}) AS v FROM n),
w AS (SELECT *, {_HEAD.format(1, 2)} AS a, {_HEAD.format(3, 4)} AS b FROM q),
o AS (SELECT vec_id, x, [{", ".join(f"list_sum(list_transform(range(3), lambda j: {h}[j + 1] * v[j + 1][{i}])) / list_sum({h})" for i, h in ((1, "a"), (2, "a"), (3, "b"), (4, "b")))}] AS o FROM w),
y AS (SELECT vec_id, x, {_square_sql(5, 3, 7, "o")} AS y FROM o)"""


def _vectors():
    return F.array(*(_values(4 * k + 1, 4) for k in (1, 2, 3)))


@query("n06_cross_attention", f"WITH {_ATTENDED} SELECT vec_id, list_transform(y, lambda v: round(v, 6) + 0.0::DOUBLE) AS x FROM y")
def n06(d):
    return d.embeddings.select("vec_id", F.transform(rn.cross_attention(_values(1, 4), _vectors(), ATTEND), lambda v: F.round(v, 6) + 0.0).alias("x"))


@query("n03_condition_cross_attention", f"WITH {_ATTENDED} SELECT vec_id, list_transform(range(1, 5), lambda i: round(x[i] + y[i], 6) + 0.0::DOUBLE) AS x FROM y")
def n03_cross(d):
    return d.embeddings.select("vec_id", F.transform(rn.condition(_values(1, 4), _vectors(), "cross_attn", ATTEND), lambda v: F.round(v, 6) + 0.0).alias("x"))


_Z = "z AS (SELECT vec_id, " + ", ".join(f"{e} AS k{i}" for i, e in enumerate(_lin(WZ, [0.0] * 4, [f"greatest({_E.format(j + 1)} * {'(vec_id % 2)' if 2 <= j < 4 else '1'}, 0.0::DOUBLE)" for j in range(6)]))) + " FROM embeddings)"


def _dense(name, x, rows, cols, a, b, m, c, unit=10):
    """SQL of a linear map whose weights follow from their places; ``c`` bounds the bias."""
    w = f"((i * {a} + j * {b}) % {m} - {m // 2}) / {unit}.0::DOUBLE"
    return f"list_transform(range({rows}), lambda i: list_sum(list_transform(range({cols}), lambda j: {w} * {x}[j + 1])) + (i % {c} - {c // 2}) / {unit}.0::DOUBLE) AS {name}"


def _made(rows, cols, a, b, m, c, unit=10):
    return [[((i * a + j * b) % m - m // 2) / unit for j in range(cols)] for i in range(rows)], [(i % c - c // 2) / unit for i in range(rows)]


_UNIT = "list_transform({0}, lambda v: (v - list_avg({0})) / sqrt(list_var_pop({0}) + 1e-5::DOUBLE)) AS n"
_RECTIFIED = "list_transform({0}, lambda v: greatest(v, 0.0::DOUBLE)) AS h"


@query("n01_wide_conditions", f"""WITH z AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(CAST(v AS DOUBLE), 0.0::DOUBLE)) AS z FROM embeddings),
k AS (SELECT vec_id, {_dense("k1", "z", 128, 64, 3, 5, 11, 3)}, {_dense("k2", "z", 64, 64, 2, 7, 13, 5)} FROM z),
p AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS px, [(l_orderkey % 256) / 255.0::DOUBLE, (l_partkey % 256) / 255.0::DOUBLE, (l_suppkey % 256) / 255.0::DOUBLE] AS x FROM lineitem),
a1 AS (SELECT image_id, px, {_dense("a", "x", 64, 3, 7, 3, 11, 5)} FROM p), h1 AS (SELECT image_id, px, {_RECTIFIED.format("a")} FROM a1), n1 AS (SELECT image_id, px, {_UNIT.format("h")} FROM h1),
x1 AS (SELECT image_id, px, k2, list_transform(range(64), lambda i: n[i + 1] * (1 + k1[i + 1]) + k1[i + 65]) AS x FROM n1 JOIN k ON image_id % 500 = vec_id),
a2 AS (SELECT image_id, px, k2, {_dense("a", "x", 64, 64, 5, 2, 13, 3)} FROM x1), h2 AS (SELECT image_id, px, k2, {_RECTIFIED.format("a")} FROM a2), n2 AS (SELECT image_id, px, k2, {_UNIT.format("h")} FROM h2),
x2 AS (SELECT image_id, px, list_transform(range(64), lambda i: n[i + 1] + k2[i + 1]) AS x FROM n2), o AS (SELECT image_id, px, {_dense("o", "x", 3, 64, 3, 1, 7, 3, 50)} FROM x2)
SELECT image_id, px, list_transform(o, lambda v: round(1 / (1 + exp(-v)), 6)) AS out FROM o""")
def n01_wide(d):
    """The renderer at width 64 with a scale and shift in the first layer and a sum in the second; a latent for each image."""
    images = d.lineitem.select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("vec_id", F.col("image_id") % 500)
    latents = images.join(d.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("z")), "vec_id")
    layers = [_made(64, 3, 7, 3, 11, 5), _made(64, 64, 5, 2, 13, 3)]
    conditions = [("adain", _made(128, 64, 3, 5, 11, 3)), ("add", _made(64, 64, 2, 7, 13, 5))]
    return rn.wide_renderer(_pixels(d), latents, layers, conditions, _made(3, 64, 3, 1, 7, 3, 50)).select("image_id", "px", _round("out").alias("out"))


@query("n09_retouch_renderer", f"WITH {_H}, {_Z} SELECT image_id, px, {_out_sql(' + k{0}')} FROM n JOIN z ON n.image_id % 500 = z.vec_id")
def n09(d):
    mask = F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double"), F.lit(1.0))
    z = d.embeddings.select("vec_id", rn.linear(rn.relu(rn.masked_latent(_values(1, 6), mask, 2)), WZ, [0.0] * 4).alias("k"))
    rows = _pixels(d).withColumn("vec_id", F.col("image_id") % 500).join(z, "vec_id")
    return rn.pixel_mlp(rows, [(W1, B1)], (W2, B2), conditions=[("add", "k")]).select("image_id", "px", _round("out").alias("out"))


# ---- turns, prompts and records as they are


@query("p11_turn_index", """WITH k AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 3 THEN NULL WHEN role = 'user' THEN 0 WHEN role = 'assistant' THEN 1 END AS role_no FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, first_value(role_no) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM k)
SELECT conv_id, turn, CAST(i - head AS BIGINT) AS pos, role_no = (i - head) % 2 AS alternates FROM n WHERE role_no IS NOT NULL AND head IS NOT NULL AND i >= head""")
def p11_index(d):
    role = F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, "narrator").otherwise(F.col("role"))
    return chat.training_turns(d.conversations.withColumn("role", role)).select("conv_id", "turn", "pos", "alternates")


@query("f03_chatml_images", f"WITH {TURNS.replace('t AS (', 'u AS (')}, t AS (SELECT conv_id, turn, CASE WHEN pos = 0 THEN repeat('<image>', conv_id % 3) || text ELSE text END AS text, role_no, pos FROM u) {_prompt_sql(CHATML)}")
def f03_images(d):
    rows = chat.messages(chat.usable_turns(d.conversations), CHATML.roles)
    images = F.col("conv_id") % 3
    said = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, tp.with_image_marks(m["text"], images)).otherwise(m["text"]).alias("text")))
    return rows.select("conv_id", tp.render(CHATML, said).alias("prompt"))


@query("f13_interleaved", "WITH p AS (SELECT conv_id, turn, [text, text, 'end'] AS p FROM conversations) SELECT conv_id, turn, list_filter(flatten(list_transform(range(3), lambda i: [p[i + 1], CASE WHEN i < conv_id % 4 THEN 'image ' || i END])), lambda x: x IS NOT NULL) AS pieces FROM p")
def f13_interleaved(d):
    images = F.slice(F.array(*(F.lit(f"image {i}") for i in range(3))), F.lit(1), (F.col("conv_id") % 4).cast("int"))
    prompt = F.concat("text", F.lit(" <image>\n"), "text", F.lit("<image>end"))
    return d.conversations.select("conv_id", "turn", tp.interleaved(prompt, images).alias("pieces"))


@query("f18_conversation_record", f"WITH {TURNS} SELECT conv_id, {quoted(tp.QWEN)} AS system, list([CAST(role_no AS VARCHAR), text] ORDER BY pos) AS messages FROM t GROUP BY conv_id")
def f18_record(d):
    rows = chat.messages(chat.usable_turns(d.conversations), ("0", "1"))
    js = F.to_json(F.struct(F.lit(tp.QWEN).alias("system"), F.transform("messages", lambda m: F.array(m["role"], m["text"])).alias("messages"), F.lit(0).alias("offset")))
    return rows.select("conv_id", F.from_json(js, "system string, messages array<array<string>>").alias("r")).select("conv_id", "r.system", "r.messages")


@query("z05_token_lengths", f"SELECT conv_id, turn, list_slice({IDS}, 1, 64) AS ids, CAST(len(list_filter(list_slice({IDS}, 1, 64), lambda x: x <> 101)) AS BIGINT) AS n FROM conversations")
def z05_lengths(d):
    rows = _ids(d).withColumn("ids", F.slice("ids", 1, 64))
    return rows.select("conv_id", "turn", "ids", (F.size("ids") - tk.count_id(F.col("ids"), 101)).cast("long").alias("n"))


# ---- pictures


@query("r11_merged_features", """WITH s AS (SELECT vec_id, embedding, 64 + vec_id * 37 % 4000 AS w, 64 + vec_id * 91 % 3000 AS h FROM embeddings),
u AS (SELECT *, CASE WHEN w / CAST(h AS DOUBLE) > 1.5 THEN 0 ELSE (6 - CAST(trunc(w * (4.0::DOUBLE / h)) AS BIGINT)) // 2 END AS px, CASE WHEN w / CAST(h AS DOUBLE) > 1.5 THEN (4 - CAST(trunc(h * (6.0::DOUBLE / w)) AS BIGINT)) // 2 ELSE 0 END AS py FROM s)
SELECT vec_id, list_concat(embedding[1:4], flatten(list_transform(range(py, 4 - py), lambda y: list_concat(list_transform(range(px, 6 - px), lambda x: embedding[5 + (y // 2 * 3 + x // 2) * 4 + y % 2 * 2 + x % 2]), [CAST(-1 AS FLOAT)])))) AS merged FROM u""")
def r11_merged(d):
    v = F.col("vec_id")
    w, h = (F.lit(64) + v * 37 % 4000).cast("int"), (F.lit(64) + v * 91 % 3000).cast("int")
    return d.embeddings.select(v, g.merged_features(F.col("embedding"), 2, F.lit(3), F.lit(2), w, h, F.lit(-1.0).cast("float")).alias("merged"))


@query("g16_patch_floor", "SELECT p_partkey, CAST((p_partkey % 700 // 14) * (p_partkey % 700 // 14) AS BIGINT) AS patches FROM part")
def g16_floor(d):
    side = F.floor(F.col("p_partkey") % 700 / 14)
    return d.part.select("p_partkey", (side * side).cast("long").alias("patches"))


# ---- a generation as one plan: ids to states, states to a latent, the latent masked, pictures rendered by it

_STATE = ", ".join(f"CAST(embedding[vec_id % 4 * 2 + {j}] AS DOUBLE)" for j in (1, 2, 5, 6, 7, 8))
_GENERATED = f"""e AS (SELECT vec_id, [{_STATE}] AS x FROM embeddings),
h1 AS (SELECT vec_id, list_transform(range(6), lambda i: list_sum(list_transform(range(6), lambda j: ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE * x[j + 1])) + (i % 5 - 2) / 10.0::DOUBLE) AS h FROM e),
n1 AS (SELECT vec_id, list_transform(h, lambda v: (v - m) / sqrt(s + 1e-5::DOUBLE)) AS n FROM (SELECT *, list_avg(h) AS m, list_var_pop(h) AS s FROM h1)),
g1 AS (SELECT vec_id, list_transform(n, lambda v: 0.5::DOUBLE * v * (1 + exp(-v * v / 2) * list_sum(list_transform(range(120), lambda k: pow(v / sqrt(2.0::DOUBLE), 2 * k + 1) / gamma(k + 1.5::DOUBLE))))) AS x FROM n1),
o1 AS (SELECT vec_id, list_transform(range(6), lambda i: (list_sum(list_transform(range(6), lambda j: ((i * 3 + j) % 7 - 3) / 10.0::DOUBLE * x[j + 1])) + i / 10.0::DOUBLE) * CASE WHEN i // 2 = 1 THEN vec_id % 2 ELSE 1 END) AS o FROM g1),
z AS (SELECT vec_id, {", ".join(f"{e} AS k{i}" for i, e in enumerate(_lin(WZ, [0.0] * 4, [f"greatest(o[{j + 1}], 0.0::DOUBLE)" for j in range(6)])))} FROM o1)"""


@query("n25_generated_retouch", f"WITH {_H}, {_GENERATED} SELECT image_id, px, {_out_sql(' + k{0}')} FROM n JOIN z ON n.image_id % 500 = z.vec_id")
def n25(d):
    # states of nine steps; the three marks come after up to three other ids, the first of them twice
    ids = F.concat(F.array_repeat(F.lit(7), (F.col("vec_id") % 4).cast("int")), F.array(*(F.lit(i) for i in (900, 5, 901, 902, 900))))
    states = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda s: F.transform(F.slice("embedding", s * 2 + 1, F.lit(2)), lambda x: x.cast("double")))
    latents = d.embeddings.select("vec_id", rn.special_latent(ids, states, (900, 901, 902)).alias("latent"))
    made = lambda a, b, m: [[((i * a + j * b) % m - m // 2) / 10.0 for j in range(6)] for i in range(6)]
    head = rn.latent_head(latents, [(made(7, 3, 11), [(i % 5 - 2) / 10.0 for i in range(6)])], (made(3, 1, 7), [i / 10.0 for i in range(6)]), "vec_id", "latent")
    mask = F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double"), F.lit(1.0))
    z = head.select("vec_id", rn.linear(rn.relu(rn.masked_latent(F.col("out"), mask, 2)), WZ, [0.0] * 4).alias("k"))
    rows = _pixels(d).withColumn("vec_id", F.col("image_id") % 500).join(z, "vec_id")
    return rn.pixel_mlp(rows, [(W1, B1)], (W2, B2), conditions=[("add", "k")]).select("image_id", "px", _round("out").alias("out"))


@query("n25_replies", "SELECT conv_id, turn, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') AS reply FROM conversations")
def n25_replies(d):
    """The text beside a generated picture: words of a turn as ids, with the marks of the three latents among them, and back."""
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))
    rows = d.conversations.select("conv_id", "turn", words.alias("w"))
    vocabulary = rows.select(F.explode("w").alias("piece")).distinct().select(F.xxhash64("piece").alias("id"), "piece")
    ids = F.transform("w", lambda w: F.xxhash64(w))
    marks = lambda *m: F.array(*(F.lit(i).cast("long") for i in m))
    marked = F.concat(marks(900), F.slice(ids, 1, 2), marks(901, 902), F.slice(ids, F.lit(3), F.greatest(F.size(ids), F.lit(0))), marks(900))
    return dc.decoded_text(rows.select("conv_id", "turn", marked.alias("ids")), vocabulary, [900, 901, 902], ["conv_id", "turn"]).withColumnRenamed("text", "reply")


# ---- the worker's side of the pool, and what a trainer saves


@query("x07_admission", f"""WITH {EVENTS}, s AS (SELECT event_id, worker, ts, sum(CASE WHEN model IN ('click', 'view') THEN 1 ELSE -1 END) OVER w AS s FROM e WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id)),
q AS (SELECT event_id, worker, s - least(0, min(s) OVER (PARTITION BY worker ORDER BY ts, event_id)) AS q FROM s) SELECT event_id, worker, CAST(least(q, 5) AS BIGINT) AS running, CAST(greatest(q - 5, 0) AS BIGINT) AS waiting FROM q""")
def x07(d):
    step = F.when(F.col("model").isin("click", "view"), 1).otherwise(-1)
    return rg.admission(_events(d), step, ["event_id"]).select("event_id", "worker", F.col("running").cast("long").alias("running"), F.col("waiting").cast("long").alias("waiting"))


@query("x04_worker_beats", f"""WITH {EVENTS}, s AS (SELECT event_id, worker, ts, sum(CASE WHEN model = 'click' THEN 1 ELSE -1 END) OVER w AS s, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', first_value(ts) OVER w)) AS BIGINT) // 15 AS t FROM e WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id))
SELECT event_id, worker, CAST(s - least(0, min(s) OVER w) AS BIGINT) AS queue_length, CAST(t - coalesce(lag(t) OVER w, 0) AS BIGINT) AS timed_beats FROM s WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id)""")
def x04(d):
    step = F.when(F.col("model") == "click", 1).otherwise(-1)
    return rg.admission(_events(d), step, ["event_id"]).select("event_id", "worker", F.col("queue_length").cast("long").alias("queue_length"), F.col("timed_beats").cast("long").alias("timed_beats"))


@query("a14_skipped_parameters", """WITH t AS (SELECT label AS module, md5(CAST(round(CAST(embedding[1] AS DOUBLE) * 8) AS INTEGER)::VARCHAR) AS storage, max(len(embedding)) AS n FROM embeddings GROUP BY ALL),
m AS (SELECT module, CAST(sum(n) AS BIGINT) AS parameters FROM t GROUP BY module) SELECT module, parameters, CAST(sum(parameters) OVER (ORDER BY module) AS BIGINT) AS skipped FROM m""")
def a14(d):
    """Labels are modules; vectors whose first value is about the same share a storage."""
    storage = F.md5(F.rint(F.element_at("embedding", 1).cast("double") * 8).cast("int").cast("string").cast("binary"))
    return wt.skipped_parameters(d.embeddings.select(F.col("label").alias("module"), storage.alias("storage"), F.size("embedding").alias("values")))


@query("k07_weight_sinks", f"""WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings), s AS (SELECT DISTINCT string_split(name, 'lora_')[1] || 'bias' AS b FROM w WHERE contains(name, 'lora_'))
SELECT vec_id, 'mm_projector' AS sink FROM w WHERE contains(name, 'mm_projector') UNION ALL SELECT vec_id, 'adapter_model' FROM w WHERE contains(name, 'lora_') OR name IN (SELECT b FROM s) UNION ALL SELECT vec_id, 'non_lora_trainables' FROM w WHERE NOT contains(name, 'lora_') AND vec_id % 13 <> 0""")
def k07(d):
    return wt.sinks(_weights(d).select("vec_id", "name", "requires_grad")).select("vec_id", "sink")
