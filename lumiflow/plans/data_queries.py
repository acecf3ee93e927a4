"""Queries of lengths, batches, token sequences, geometry and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import templates as tp
from ..functions.numbers import rounded_binary
from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import batching as bt
from ..operators import chat, masks
from ..operators import params as pm
from .catalog import query, quoted
from .chat_queries import TURNS, _prompt_sql



def has_image():
    return F.col("conv_id") % 3 == 0

WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"
LENGTHS = f"l AS (SELECT conv_id, CAST(sum({WORDS}) AS BIGINT) AS words FROM conversations GROUP BY conv_id)"

# ---- lengths and batches


@query("a01_lengths", f"WITH {LENGTHS} SELECT conv_id, words + CASE WHEN conv_id % 3 = 0 THEN 128 ELSE 0 END AS length FROM l")
def a01(d):
    return bt.conversation_lengths(d.conversations, has_image()).select("conv_id", "length")


@query("a02_modality_lengths", f"WITH {LENGTHS} SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN words ELSE -words END AS modality_length FROM l")
def a02(d):
    return bt.conversation_lengths(d.conversations, has_image()).select("conv_id", "modality_length")


MEGA = f"WITH {LENGTHS}, s AS (SELECT conv_id, words, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) - 1 AS pos FROM l), m AS (SELECT *, pos // 16 AS megabatch FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY megabatch ORDER BY words DESC, pos) - 1 AS rank FROM m)"


def _lengths(d):
    return bt.conversation_lengths(d.conversations, has_image())


@query("t06_permutation", f"{MEGA} SELECT conv_id, CAST(pos AS BIGINT) AS pos FROM r")
def t06(d):
    return bt.shuffled(_lengths(d), "conv_id").select("conv_id", "pos")


@query("w06_megabatches", f"{MEGA} SELECT conv_id, CAST(megabatch AS BIGINT) AS megabatch FROM r")
def w06(d):
    return bt.megabatches(_lengths(d), 16, "conv_id", "words").select("conv_id", "megabatch")


@query("t02_length_rank", f"{MEGA} SELECT conv_id, CAST(megabatch AS BIGINT) AS megabatch, CAST(rank AS BIGINT) AS rank FROM r")
def t02(d):
    return bt.megabatches(_lengths(d), 16, "conv_id", "words").select("conv_id", "megabatch", "rank")


@query("w07_stride", f"{MEGA} SELECT conv_id, CAST(rank % 3 AS BIGINT) AS chunk, CAST(rank // 3 AS BIGINT) AS place FROM r")
def w07(d):
    return bt.megabatches(_lengths(d), 16, "conv_id", "words").select("conv_id", (F.col("rank") % 3).cast("long").alias("chunk"), F.floor(F.col("rank") / 3).cast("long").alias("place"))


@query("t03_even_chunks", f"""WITH RECURSIVE {MEGA[5:]}, c AS (SELECT megabatch, count(*) AS n FROM r GROUP BY megabatch), q AS (SELECT r.*, n FROM r JOIN c USING (megabatch)),
x AS (SELECT megabatch, n, CAST(-1 AS BIGINT) AS rank, CAST(-1 AS BIGINT) AS conv_id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, CAST(0 AS BIGINT) AS na, CAST(0 AS BIGINT) AS nb, CAST(-1 AS BIGINT) AS chunk, CAST(-1 AS BIGINT) AS place FROM c WHERE n % 2 = 0
UNION ALL SELECT x.megabatch, x.n, q.rank, q.conv_id, CASE WHEN x.a <= x.b THEN CASE WHEN x.na + 1 = x.n // 2 THEN 'inf'::DOUBLE ELSE x.a + q.words END ELSE x.a END, CASE WHEN x.a <= x.b THEN x.b ELSE CASE WHEN x.nb + 1 = x.n // 2 THEN 'inf'::DOUBLE ELSE x.b + q.words END END,
CASE WHEN x.a <= x.b THEN x.na + 1 ELSE x.na END, CASE WHEN x.a <= x.b THEN x.nb ELSE x.nb + 1 END, CASE WHEN x.a <= x.b THEN 0 ELSE 1 END, CASE WHEN x.a <= x.b THEN x.na ELSE x.nb END FROM x JOIN q ON q.megabatch = x.megabatch AND q.rank = x.rank + 1)
SELECT CAST(megabatch AS BIGINT) AS megabatch, conv_id, chunk, place FROM x WHERE rank >= 0 UNION ALL SELECT CAST(megabatch AS BIGINT), conv_id, CAST(rank % 2 AS BIGINT), CAST(rank // 2 AS BIGINT) FROM q WHERE n % 2 = 1""")
def t03(d):
    return bt.even_chunks(bt.megabatches(_lengths(d), 16, "conv_id", "words"), 2, "conv_id", "words")


@query("t04_length_grouped", f"{MEGA} SELECT conv_id, CAST(megabatch * 16 + rank AS BIGINT) AS place FROM r")
def t04(d):
    return bt.megabatches(_lengths(d), 16, "conv_id", "words").select("conv_id", (F.col("megabatch") * 16 + F.col("rank")).alias("place"))


@query("t05_modality_sections", f"""WITH {LENGTHS}, k AS (SELECT conv_id, words, CASE WHEN conv_id % 3 = 0 THEN 'image' ELSE 'text' END AS kind FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) - 1 AS pos FROM k), m AS (SELECT *, pos // 8 AS megabatch, max(pos // 8) OVER (PARTITION BY kind) AS last FROM s)
SELECT conv_id, CASE WHEN megabatch = last THEN 'tail' ELSE kind END AS section, CASE WHEN megabatch <> last THEN CAST(megabatch AS BIGINT) END AS megabatch FROM m""")
def t05(d):
    return bt.modality_order(_lengths(d), 8, 2, "conv_id").select("conv_id", "section", "megabatch")


@query("a10_length_checks", f"WITH {LENGTHS} SELECT bool_and(words <> 0) AS none_zero, bool_and(conv_id % 3 = 0) OR bool_and(conv_id % 3 <> 0) AS one_modality FROM l")
def a10(d):
    x = F.col("modality_length")
    return _lengths(d).agg(F.bool_and(x != 0).alias("none_zero"), (F.bool_and(x > 0) | F.bool_and(x < 0)).alias("one_modality"))


# ---- token sequences, at the texts of turns

IDS = "list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))"
WITH_IMAGE = f"list_concat(list_transform(string_split('ab' , ''), lambda c: CAST(unicode(c) AS BIGINT)), [CAST(-200 AS BIGINT)], {IDS})"


def _ids(d):
    return d.conversations.withColumn("ids", tk.char_ids(F.col("text")))


def _marked(d):
    return d.conversations.withColumn("ids", tk.ids_with_images(F.concat(F.lit("ab<image>"), "text")))


@query("f11_ids_with_images", f"SELECT conv_id, turn, list_concat([CAST(1 AS BIGINT)], {WITH_IMAGE}) AS ids FROM conversations")
def f11(d):
    return d.conversations.select("conv_id", "turn", tk.ids_with_images(F.concat(F.lit("ab<image>"), "text"), bos=True).alias("ids"))


@query("a05_token_counts", f"SELECT conv_id, turn, CAST(len(list_filter({IDS}, lambda x: x <> 101)) AS BIGINT) AS n FROM conversations")
def a05(d):
    return _ids(d).select("conv_id", "turn", (F.size("ids") - tk.count_id(F.col("ids"), 101)).cast("long").alias("n"))


@query("a06_image_counts", "SELECT conv_id, turn, CAST(1 AS BIGINT) AS n FROM conversations")
def a06(d):
    return _marked(d).select("conv_id", "turn", tk.count_id(F.col("ids"), tk.IMAGE_ID).alias("n"))


@query("a07_batch_max", "SELECT conv_id, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY conv_id")
def a07(d):
    return _ids(d).groupBy("conv_id").agg(F.max(F.size("ids")).cast("long").alias("longest"))


_PADDED = f"WITH b AS (SELECT conv_id, turn, {IDS} AS ids, max(length(text)) OVER (PARTITION BY conv_id) AS m FROM conversations)"


def _batch(d):
    from pyspark.sql import Window

    return _ids(d).withColumn("m", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))


@query("r01_pad_right", f"{_PADDED} SELECT conv_id, turn, list_concat(ids, list_transform(range(m - len(ids)), lambda i: CAST(0 AS BIGINT))) AS input_ids, list_concat(ids, list_transform(range(m - len(ids)), lambda i: CAST(-100 AS BIGINT))) AS labels FROM b")
def r01(d):
    return _batch(d).select("conv_id", "turn", tk.pad_right(F.col("ids"), F.col("m"), 0).alias("input_ids"), tk.pad_right(F.col("ids"), F.col("m"), tk.IGNORE).alias("labels"))


@query("r02_pad_left", f"{_PADDED} SELECT conv_id, turn, list_concat(list_transform(range(m - len(ids)), lambda i: CAST(0 AS BIGINT)), ids) AS input_ids FROM b")
def r02(d):
    return _batch(d).select("conv_id", "turn", tk.pad_left(F.col("ids"), F.col("m"), 0).alias("input_ids"))


@query("r03_attention_mask", f"{_PADDED} SELECT conv_id, turn, list_transform(range(m), lambda i: i < len(ids)) AS mask FROM b")
def r03(d):
    return _batch(d).select("conv_id", "turn", tk.attention_mask(tk.pad_right(F.col("ids"), F.col("m"), 0), 0).alias("mask"))


@query("r04_unpad", f"{_PADDED} SELECT conv_id, turn, ids FROM b")
def r04(d):
    rows = _batch(d).withColumn("p", tk.pad_right(F.col("ids"), F.col("m"), 0))
    return rows.select("conv_id", "turn", tk.unpadded(F.col("p"), tk.attention_mask(F.col("p"), 0)).alias("ids"))


@query("w05_positions", f"{_PADDED} SELECT conv_id, turn, list_transform(range(m), lambda i: CASE WHEN i < len(ids) THEN CAST(i AS BIGINT) ELSE 0 END) AS position_ids FROM b")
def w05(d):
    return _batch(d).select("conv_id", "turn", tk.positions(F.size("ids"), F.col("m")).alias("position_ids"))


@query("r05_splice", f"SELECT conv_id, turn, list_concat([CAST(97 AS BIGINT), 98], list_transform(range(4), lambda i: CAST(-100 AS BIGINT)), {IDS}) AS labels FROM conversations")
def r05(d):
    return _marked(d).select("conv_id", "turn", tk.spliced(F.col("ids"), 4, tk.IGNORE).alias("labels"))


@query("t10_truncate", f"SELECT conv_id, turn, list_slice({IDS}, 1, 64) AS ids FROM conversations")
def t10(d):
    return _ids(d).select("conv_id", "turn", F.slice("ids", 1, 64).alias("ids"))


@query("w10_first_token", "SELECT conv_id, turn, CAST(strpos(text, 'e') AS BIGINT) AS step, CASE WHEN strpos(text, 'e') > 1 THEN CAST(unicode(substr(text, strpos(text, 'e') - 1, 1)) AS BIGINT) END AS before FROM conversations")
def w10(d):
    step = F.array_position("ids", 101).cast("long")
    return _ids(d).select("conv_id", "turn", step.alias("step"), F.when(step > 1, F.get("ids", step.cast("int") - 2)).alias("before"))


@query("a15_stop_keyword", "SELECT conv_id, bool_and(contains(text, '.')) AS stop FROM conversations GROUP BY conv_id")
def a15(d):
    return _ids(d).groupBy("conv_id").agg(F.bool_and(F.array_contains("ids", 46)).alias("stop"))


SLOTS = "CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END"


@query("j05_feature_slots", f"WITH c AS (SELECT DISTINCT conv_id, {SLOTS} AS n FROM conversations) SELECT conv_id, CAST(coalesce(sum(greatest(n, 1)) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_feature FROM c")
def j05(d):
    # batches are told by nothing here, so the table is one batch
    rows = d.conversations.select("conv_id").distinct().withColumn("n", F.when(has_image(), 2).otherwise(0))
    return bt.running_sum(rows, ["conv_id"], F.greatest("n", F.lit(1)), "first_feature").select("conv_id", "first_feature")


@query("w08_feature_index", f"{MEGA}, n AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM r) SELECT conv_id, CAST(megabatch AS BIGINT) AS megabatch, CAST(sum(n) OVER (PARTITION BY megabatch ORDER BY rank) - n AS BIGINT) AS first_feature FROM n")
def w08(d):
    """Where each sample's features begin in those of its batch; a sample without an image takes an empty one."""
    from pyspark.sql import Window

    rows = bt.megabatches(_lengths(d), 16, "conv_id", "words").withColumn("n", F.when(has_image(), 2).otherwise(1))
    w = Window.partitionBy("megabatch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a batch is a few rows
    return rows.select("conv_id", "megabatch", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("first_feature"))


@query("w09_split_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def w09(d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return d.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("long").alias("start"))


# ---- label masks, by characters as tokens. Separators and end texts of these templates have the widths that the rules
# take from real tokenizers, so that lengths add up; the SQL states each rule's numbers itself.

T = tp.TEMPLATES
MASKED = {
    "qwen": tp.Template("masked_qwen", "QWEN_2", "S", ("u:", "a:"), "|\n", version="qwen_v2"),
    "v1": tp.Template("masked_v1", "TWO", "S", ("USER", "ASSISTANT"), " ", "$", "v1"),
    "llama_2": tp.Template("masked_llama_2", "LLAMA_2", "S", ("USER", "ASSISTANT"), "^", "$", "llama_v2"),
    "mpt": tp.Template("masked_mpt", "MPT", "S", ("u:", "a:"), "|", version="mpt"),
}


def _mask_sql(kind: str, rounds: str, split: str, start: int, n: str, asked: str, first: str, checked: bool) -> str:
    """labels from spans: ``n`` and ``asked`` are lengths of a round (r, number i) and of what is asked in it (q)."""
    off = "coalesce(s.ends, {0}) <> len(ids)".format(start) if checked else "false"
    return f"""WITH {TURNS}, p AS ({_prompt_sql(MASKED[kind])}),
a AS (SELECT conv_id, {rounds} AS rounds FROM p),
x AS (SELECT conv_id, unnest(rounds) AS r, generate_subscripts(rounds, 1) - 1 AS i FROM a),
y AS (SELECT *, string_split(r, {quoted(split)})[1] || {quoted(split)} AS q, r <> '' AND len(string_split(r, {quoted(split)})) = 2 AS ok FROM x),
z AS (SELECT conv_id, i, {n} AS n, {asked} AS asked, bool_and(ok) OVER (PARTITION BY conv_id ORDER BY i) AS go FROM y),
o AS (SELECT conv_id, n, asked, {start} + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM z WHERE go),
s AS (SELECT conv_id, max(lo + n) AS ends, list(lo) AS los, list(lo + asked) AS his FROM o GROUP BY conv_id),
i AS (SELECT conv_id, list_concat({first}, list_transform(string_split(prompt, ''), lambda c: CAST(unicode(c) AS BIGINT))) AS ids FROM p)
SELECT i.conv_id, list_transform(ids, lambda v, k: CASE WHEN {off} OR k - 1 < {start} OR k - 1 >= coalesce(s.ends, {start}) OR len(list_filter(range(len(coalesce(los, []))), lambda j: k - 1 >= los[j + 1] AND k - 1 < his[j + 1])) > 0 THEN -100 ELSE v END) AS labels, {off} AS mismatch FROM i LEFT JOIN s ON i.conv_id = s.conv_id"""


_NONE, _BEGIN = "CAST([] AS BIGINT[])", "[CAST(1 AS BIGINT)]"
_BY_PAIRS = "list_transform(range(1, len(list_concat([f[1] || '|' || chr(10) || f[2]], f[3:])) + 1, 2), lambda k: array_to_string((list_concat([f[1] || '|' || chr(10) || f[2]], f[3:]))[k:k + 1], '|' || chr(10)))".replace("f[", "string_split(prompt, '|' || chr(10))[")
_BY_THREE = "list_concat([array_to_string(string_split(prompt, '|')[1:3], '|')], list_transform(range(4, len(string_split(prompt, '|')) + 1, 2), lambda k: array_to_string(string_split(prompt, '|')[k:k + 1], '|')))"


def _masks(d, kind, **options):
    rows = masks.label_masks(chat.prompts(d.conversations, MASKED[kind]), MASKED[kind], **options)
    return rows.select("conv_id", "labels", "mismatch")


query("m01_qwen_masks", _mask_sql("qwen", _BY_PAIRS, "|\na:", 0, "length(r) + 2", "length(q)", _NONE, True))(lambda d: _masks(d, "qwen"))
query("m02_v1_masks", _mask_sql("v1", "string_split(prompt, '$')", " ASSISTANT: ", 1, "length(r) + 1", "length(q) + 1 - 2", _BEGIN, True))(lambda d: _masks(d, "v1"))
query("m03_llama2_masks", _mask_sql("llama_2", "string_split(prompt, '$')", "[/INST] ", 1, "length(r) + 1", "length(q) + 1 - 2", _BEGIN, True))(lambda d: _masks(d, "llama_2"))
# one more id from the second round on; the longest sequence is short, where the rule doesn't hold lengths against each other
query("m04_mpt_masks", _mask_sql("mpt", _BY_THREE, "|a:", 0, "length(r) + CASE WHEN i > 0 THEN 1 ELSE 0 END", "length(q) - 1 + CASE WHEN i > 0 THEN 1 ELSE 0 END", _NONE, False))(lambda d: _masks(d, "mpt", later=1, model_max=0))


@query("m05_plain_masks", f"SELECT conv_id, turn, list_concat([CAST(-100 AS BIGINT)], {IDS}, [CAST(10 AS BIGINT)]) AS labels FROM conversations")
def m05(d):
    return d.conversations.select("conv_id", "turn", masks.plain_labels(F.col("text"))[1].alias("labels"))


@query("m06_legacy_masks", f"WITH {TURNS} SELECT conv_id, list_concat(list_transform(range(9), lambda i: CAST(-100 AS BIGINT)), flatten(list(CASE WHEN role_no = 0 THEN list_transform({IDS}, lambda x, i: CASE WHEN i <= 2 THEN x ELSE -100 END) ELSE {IDS} END ORDER BY pos))) AS labels FROM t GROUP BY conv_id")
def m06(d):
    rows = chat.messages(chat.usable_turns(d.conversations), ("h", "g"))
    lines = F.transform("messages", lambda m: F.struct((m["role"] == "h").alias("human"), m["text"].alias("text")))
    return rows.select("conv_id", masks.legacy_labels(F.lit("A header."), lines)[1].alias("labels"))


@query("m07_mask_router", """WITH m AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM (VALUES ('default', 'qwen'), ('v0', 'legacy'), ('v1', 'v1'), ('vicuna_v1', 'v1'), ('qwen_2', 'qwen'), ('llama_2', 'llama_2'), ('mistral_instruct', 'llama_2'), ('chatml_direct', 'mpt'), ('mistral_direct', 'mpt'),
('plain', 'plain'), ('v0_plain', 'plain'), ('llava_v0', 'legacy'), ('v0_mmtag', 'legacy'), ('llava_v1', 'v1'), ('v1_mmtag', 'v1'), ('llava_llama_2', 'llama_2'), ('mpt', 'mpt')) t(name, mask))
SELECT conv_id, name, mask FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN m ON c.conv_id % 17 = m.i""")
def m07(d):
    """The mask of each conversation's template, whose version and style decide."""
    from pyspark.sql import Window

    v = F.col("version")
    mask = F.when(F.col("style") == "PLAIN", "plain").when(F.col("style") == "LLAMA_2", "llama_2").when(v.startswith("v1"), "v1").when(v == "mpt", "mpt").when(v.startswith("qwen_v2"), "qwen").otherwise("legacy")
    known = tp.template_table(d.spark).select("name", mask.alias("mask"), (F.row_number().over(Window.orderBy("name")) - 1).alias("i"))  # a row a template
    return d.conversations.select("conv_id").distinct().withColumn("i", F.col("conv_id") % 17).join(known, "i").select("conv_id", "name", "mask")


@query("w03_round_pairs", f"WITH {TURNS}, p AS ({_prompt_sql(MASKED['qwen'])}) SELECT conv_id, {_BY_PAIRS} AS rounds FROM p")
def w03(d):
    return chat.prompts(d.conversations, MASKED["qwen"]).select("conv_id", masks.rounds_of(MASKED["qwen"], F.col("prompt")).alias("rounds"))


@query("w04_mpt_rounds", f"WITH {TURNS}, p AS ({_prompt_sql(MASKED['mpt'])}) SELECT conv_id, {_BY_THREE} AS rounds FROM p")
def w04(d):
    return chat.prompts(d.conversations, MASKED["mpt"]).select("conv_id", masks.rounds_of(MASKED["mpt"], F.col("prompt")).alias("rounds"))


# ---- geometry, at synthetic sizes

SIZES = "s AS (SELECT p_partkey, CAST(64 + p_partkey * 37 % 4000 AS INTEGER) AS w, CAST(64 + p_partkey * 91 % 3000 AS INTEGER) AS h FROM part)"


def size_columns():
    return F.col("w"), F.col("h")


def _sizes(d):
    k = F.col("p_partkey")
    return d.part.select(k, (F.lit(64) + k * 37 % 4000).cast("int").alias("w"), (F.lit(64) + k * 91 % 3000).cast("int").alias("h"))


@query("g01_short_edge", f"WITH {SIZES} SELECT p_partkey, CASE WHEN w <= h THEN 512 ELSE CAST(trunc(w * (512.0::DOUBLE / h)) AS INTEGER) END AS new_w, CASE WHEN w <= h THEN CAST(trunc(h * (512.0::DOUBLE / w)) AS INTEGER) ELSE 512 END AS new_h FROM s")
def g01(d):
    a, b = g.short_edge(*size_columns())
    return _sizes(d).select("p_partkey", a.alias("new_w"), b.alias("new_h"))


_CANDS = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(g.RESOLUTIONS)) + ") v(i, cw, ch))"
BEST = f"""{SIZES}, {_CANDS}, e AS (SELECT p_partkey, w, h, i, cw, ch, least(CAST(cw AS DOUBLE) / w, CAST(ch AS DOUBLE) / h) AS scale FROM s CROSS JOIN c),
f AS (SELECT *, least(CAST(trunc(w * scale) AS BIGINT) * CAST(trunc(h * scale) AS BIGINT), CAST(w AS BIGINT) * h) AS eff FROM e), best AS (SELECT * FROM (SELECT *, cw * ch - eff AS waste, row_number() OVER (PARTITION BY p_partkey ORDER BY eff DESC, cw * ch - eff, i) AS n FROM f) WHERE n = 1)"""


@query("g02_best_resolution", f"WITH {BEST} SELECT p_partkey, cw AS best_w, ch AS best_h FROM best")
def g02(d):
    return _sizes(d).withColumn("b", g.best_resolution(*size_columns())).select("p_partkey", F.col("b.w").alias("best_w"), F.col("b.h").alias("best_h"))


@query("t09_resolution_ranking", f"WITH {BEST} SELECT p_partkey, i, CAST(eff AS BIGINT) AS effective, CAST(cw * ch - eff AS BIGINT) AS waste FROM f")
def t09(d):
    rows = d.spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(g.RESOLUTIONS)], "i int, cw int, ch int")
    e, waste = g.resolution_fit(*size_columns(), F.col("cw"), F.col("ch"))
    return _sizes(d).crossJoin(F.broadcast(rows)).select("p_partkey", "i", e.alias("effective"), waste.alias("waste"))  # a fixed list of candidates


#: Parts whose candidates one task ranks.
PARTS_A_TASK = 200_000


@query("j03_best_by_join", f"WITH {BEST} SELECT p_partkey, cw AS best_w, ch AS best_h FROM best")
def j03(d):
    rows = d.spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(g.RESOLUTIONS)], "i int, cw int, ch int")
    e, waste = g.resolution_fit(*size_columns(), F.col("cw"), F.col("ch"))
    # a rank in one number, as 30, 30 and 3 bits hold effective pixels, waste and place: a minimum of numbers needs no sort, and parts are dealt first, so a task holds a bounded count of them
    rank = F.coalesce(((1 << 30) - 1 - e) * (1 << 33) + waste * 8 + F.col("i"), F.col("i"))
    parts = d.part.count() // PARTS_A_TASK + 1
    fits = _sizes(d).repartition(parts, "p_partkey").crossJoin(F.broadcast(rows))
    best = fits.groupBy("p_partkey").agg(F.min(rank).alias("k"))
    return best.join(F.broadcast(rows), F.col("k") % 8 == F.col("i")).select("p_partkey", F.col("cw").alias("best_w"), F.col("ch").alias("best_h"))


FIT = """x AS (SELECT *, CAST(cw AS DOUBLE) / w AS sw, CAST(ch AS DOUBLE) / h AS sh FROM best), y AS (SELECT *, CASE WHEN sw < sh THEN cw ELSE least(CAST(ceil(w * sh) AS INTEGER), cw) END AS new_w, CASE WHEN sw < sh THEN least(CAST(ceil(h * sw) AS INTEGER), ch) ELSE ch END AS new_h FROM x)"""


@query("g03_resize_and_pad", f"WITH {BEST}, {FIT} SELECT p_partkey, new_w, new_h, (cw - new_w) // 2 AS paste_x, (ch - new_h) // 2 AS paste_y FROM y")
def g03(d):
    rows = _sizes(d).withColumn("b", g.best_resolution(*size_columns()))
    return rows.select("p_partkey", *(c.alias(n) for n, c in g.fit(*size_columns(), F.col("b.w"), F.col("b.h")).items()))


@query("g04_tiles", f"WITH {SIZES} SELECT p_partkey, CAST(xs AS INTEGER) AS x0, CAST(ys AS INTEGER) AS y0, CAST(xs + 336 AS INTEGER) AS x1, CAST(ys + 336 AS INTEGER) AS y1 FROM s, unnest(range(0, w, 336)) a(xs), unnest(range(0, h, 336)) b(ys)")
def g04(d):
    return _sizes(d).select("p_partkey", F.inline(g.tiles(*size_columns(), 336)))


@query("g05_grid_shape", f"WITH {BEST} SELECT p_partkey, cw // 336 AS grid_w, ch // 336 AS grid_h FROM best")
def g05(d):
    a, b = g.grid_shape(*size_columns())
    return _sizes(d).select("p_partkey", a.alias("grid_w"), b.alias("grid_h"))


@query("g06_anyres_patches", f"WITH {BEST} SELECT p_partkey, CAST(1 + (cw // 336) * (ch // 336) AS BIGINT) AS patches FROM best")
def g06(d):
    rows = _sizes(d).withColumn("b", g.best_resolution(*size_columns()))
    return rows.select("p_partkey", (1 + F.size(g.tiles(F.col("b.w"), F.col("b.h"), g.TILE))).cast("long").alias("patches"))


@query("g07_square", f"WITH {SIZES} SELECT p_partkey, greatest(w, h) AS side, (greatest(w, h) - w) // 2 AS x, (greatest(w, h) - h) // 2 AS y, 122 AS background FROM s")
def g07(d):
    side, x, y = g.square(*size_columns())
    return _sizes(d).select("p_partkey", side.alias("side"), x.alias("x"), y.alias("y"), F.lit(int(0.48145466 * 255)).alias("background"))


@query("g08_serving_size", f"WITH {SIZES}, q AS (SELECT *, greatest(w, h) AS hi, least(w, h) AS lo FROM s), r AS (SELECT *, CAST(hi AS DOUBLE) / lo AS ratio FROM q), u AS (SELECT *, CAST(trunc(least(1344.0::DOUBLE / ratio, 672.0::DOUBLE, CAST(lo AS DOUBLE))) AS INTEGER) AS low FROM r), v AS (SELECT *, CAST(trunc(low * ratio) AS INTEGER) AS high FROM u) SELECT p_partkey, CASE WHEN hi <= 1344 THEN w WHEN h > w THEN low ELSE high END AS new_w, CASE WHEN hi <= 1344 THEN h WHEN h > w THEN high ELSE low END AS new_h FROM v")
def g08(d):
    a, b = g.serving_size(*size_columns())
    return _sizes(d).select("p_partkey", a.alias("new_w"), b.alias("new_h"))


@query("g09_unpad_window", f"WITH {SIZES} SELECT p_partkey, CASE WHEN CAST(w AS DOUBLE) / h > 1.0 THEN 0 ELSE (336 - CAST(trunc(w * (336.0::DOUBLE / h)) AS INTEGER)) // 2 END AS x0, CASE WHEN CAST(w AS DOUBLE) / h > 1.0 THEN (336 - CAST(trunc(h * (336.0::DOUBLE / w)) AS INTEGER)) // 2 ELSE 0 END AS y0 FROM s")
def g09(d):
    x0, y0, _, _ = g.unpad_window(F.lit(336), F.lit(336), *size_columns())
    return _sizes(d).select("p_partkey", x0.alias("x0"), y0.alias("y0"))


@query("g10_normalise", "SELECT l_orderkey, l_linenumber, round((CAST(l_partkey % 256 AS DOUBLE) / 255.0::DOUBLE - 0.5) * 2, 6) AS v FROM lineitem")
def g10(d):
    return d.lineitem.select("l_orderkey", "l_linenumber", rounded_binary(g.normalised(F.col("l_partkey") % 256), 6).alias("v"))


@query("g11_to_byte", "SELECT l_orderkey, l_linenumber, CAST(round_even(least(greatest(l_discount * 20 - 0.5, 0), 1) * 255, 0) AS INTEGER) AS v FROM lineitem")
def g11(d):
    return d.lineitem.select("l_orderkey", "l_linenumber", g.to_byte(F.col("l_discount") * 20 - 0.5).alias("v"))


@query("g12_channel_swap", "SELECT l_orderkey, l_linenumber, [l_suppkey % 256, l_partkey % 256, l_orderkey % 256] AS rgb FROM lineitem")
def g12(d):
    bgr = F.array(F.col("l_orderkey") % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 256)
    return d.lineitem.select("l_orderkey", "l_linenumber", F.reverse(bgr).alias("rgb"))


@query("g16_patches", "SELECT p_partkey, CAST((p_size * 14 // 14) * (p_size * 14 // 14) AS BIGINT) AS patches FROM part")
def g16(d):
    side = F.floor(F.col("p_size") * 14 / 14)
    return d.part.select("p_partkey", (side * side).cast("long").alias("patches"))


@query("z01_image_modes", f"WITH {BEST} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN greatest(w, h) WHEN 1 THEN cw ELSE w END AS out_w, CASE p_partkey % 3 WHEN 0 THEN greatest(w, h) WHEN 1 THEN ch ELSE h END AS out_h FROM best")
def z01(d):
    rows = _sizes(d).withColumn("b", g.best_resolution(*size_columns()))
    mode, side = F.col("p_partkey") % 3, g.square(*size_columns())[0]
    return rows.select("p_partkey", F.when(mode == 0, side).when(mode == 1, F.col("b.w")).otherwise(F.col("w")).alias("out_w"), F.when(mode == 0, side).when(mode == 1, F.col("b.h")).otherwise(F.col("h")).alias("out_h"))


@query("a09_same_shapes", f"WITH {SIZES} SELECT p_partkey % 40 AS batch, count(DISTINCT w * 10000 + h) = 1 AS stack FROM s GROUP BY p_partkey % 40")
def a09(d):
    return _sizes(d).groupBy((F.col("p_partkey") % 40).alias("batch")).agg((F.countDistinct("w", "h") == 1).alias("stack"))


@query("r08_resolution_literal", "SELECT p_partkey, [[CAST(p_size AS INTEGER), 336], [672, CAST(p_size AS INTEGER)]] AS candidates FROM part")
def r08(d):
    text = F.concat(F.lit("[("), F.col("p_size").cast("string"), F.lit(", 336), (672, "), F.col("p_size").cast("string"), F.lit(")]"))
    return d.part.select("p_partkey", F.from_json(F.translate(text, "()", "[]"), "array<array<int>>").alias("candidates"))


@query("t11_scales", "SELECT p_partkey, list_sort([CAST(p_size * 3 AS INTEGER), CAST(p_size AS INTEGER), 336]) AS scales FROM part")
def t11(d):
    text = F.concat_ws(",", (F.col("p_size") * 3).cast("string"), F.col("p_size").cast("string"), F.lit("336"))
    return d.part.select("p_partkey", F.array_sort(F.transform(F.split(text, ","), lambda x: x.cast("int"))).alias("scales"))


# ---- parameters, from synthetic slider documents


def _docs(d):
    """Five sliders, one of them unknown; values in -100..100."""
    k = F.col("p_partkey")
    v = lambda m: ((k * m) % 201 - 100).cast("double")
    pairs = [("Exposure2012", v(7)), ("Saturation", F.when(k % 2 == 0, v(13)).otherwise(F.lit(0.0))), ("HueAdjustmentRed", F.when(k % 3 == 0, v(3)).otherwise(F.lit(0.0))), ("Contrast2012", F.lit(0.0)), ("Unknown2012", v(5))]
    js = F.to_json(F.map_from_arrays(F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(F.struct(x.alias("value")) for _, x in pairs))))
    return d.part.select(k, F.from_json(js, pm.DOCUMENT, {"mode": "FAILFAST"}).alias("params"))


_V = "CAST((p_partkey * {m}) % 201 - 100 AS DOUBLE)"
_SL = {"Exposure2012": _V.format(m=7), "Saturation": f"CASE WHEN p_partkey % 2 = 0 THEN {_V.format(m=13)} ELSE 0 END", "HueAdjustmentRed": f"CASE WHEN p_partkey % 3 = 0 THEN {_V.format(m=3)} ELSE 0 END"}
_ALL = ", ".join(f"('{grp}', '{n}')" for grp, ns in pm.GROUPS.items() for n in ns)


@query("s02_slider_documents", "SELECT p_partkey, CAST(5 AS BIGINT) AS sliders, CAST((p_partkey * 7) % 201 - 100 AS DOUBLE) AS exposure FROM part")
def s02(d):
    return _docs(d).select("p_partkey", F.size("params").cast("long").alias("sliders"), F.element_at("params", "Exposure2012")["value"].alias("exposure"))


@query("p04_slider_whitelist", f"SELECT p_partkey, group_name, slider, round(CASE slider {' '.join(f'WHEN {quoted(n)} THEN {e}' for n, e in _SL.items())} ELSE 0 END / 100.0::DOUBLE, 3) + 0.0 AS value FROM part CROSS JOIN (VALUES {_ALL}) v(group_name, slider)")
def p04(d):
    return pm.slider_rows(_docs(d), "p_partkey")


@query("p05_scale_round", "SELECT p_partkey, round(CAST((p_partkey * 7) % 201 - 100 AS DOUBLE) / 100.0::DOUBLE, 3) AS value FROM part")
def p05(d):
    return d.part.select("p_partkey", pm.scaled(((F.col("p_partkey") * 7) % 201 - 100).cast("double")).alias("value"))


@query("p05_fractional_sliders", "SELECT l_orderkey, l_linenumber, CAST(format('{:.3f}', ((l_partkey * 7) % 20001 - 10000) / 100.0::DOUBLE / 100.0::DOUBLE) AS DOUBLE) AS value FROM lineitem")
def p05_fractions(d):
    """Sliders with two decimals, so that half of a thousandth comes up in every tenth of them; the binary value decides."""
    return d.lineitem.select("l_orderkey", "l_linenumber", pm.scaled(((F.col("l_partkey") * 7) % 20001 - 10000).cast("double") / 100.0).alias("value"))


_MASK = f"SELECT p_partkey, {_SL['Exposure2012']} = 0 AS a, ({_SL['Saturation']}) = 0 AS b, ({_SL['HueAdjustmentRed']}) = 0 AS c FROM part"


@query("p06_all_zero", f"SELECT p_partkey, a AS light, b AS color, c AS mixer FROM ({_MASK})")
def p06(d):
    n = pm.normalised(F.col("params"))
    return _docs(d).select("p_partkey", *(pm.all_zero(n[grp]).alias(a) for grp, a in zip(pm.GROUPS, ("light", "color", "mixer"), strict=True)))


@query("p07_control_mask", f"SELECT p_partkey, [CASE WHEN a THEN 0.0::DOUBLE ELSE 1.0 END, CASE WHEN b THEN 0.0 ELSE 1.0 END, CASE WHEN c THEN 0.0 ELSE 1.0 END] AS mask FROM ({_MASK})")
def p07(d):
    return _docs(d).select("p_partkey", pm.control_mask(F.col("params")).alias("mask"))


def _text_sql(grp, names):
    cells = " || ', ' || ".join(f"'''{n}'': ' || " + (f"CAST(round(({_SL[n]}) / 100.0::DOUBLE, 3) + 0.0 AS VARCHAR)" if n in _SL else "'0.0'") for n in names)
    return f"'''{grp}'': {{' || {cells} || '}}'"


@query("p03_param_prompt", f"SELECT p_partkey, {quoted(pm.PARAM_PROMPT)} || '{{' || " + " || ', ' || ".join(_text_sql(grp, ns) for grp, ns in pm.GROUPS.items()) + " || '}' AS prompt FROM part")
def p03(d):
    return _docs(d).select("p_partkey", pm.param_prompt(F.col("params")).alias("prompt"))


# ---- scans and sets


@query("s12_zero_image", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ELSE list_transform(range(64), lambda i: 0.0::DOUBLE) END AS image FROM embeddings")
def s12(d):
    from ..sources.readers import image_or_zero

    rows = d.embeddings.withColumn("pixels", F.transform("embedding", lambda x: x.cast("double"))).withColumn("has", F.col("vec_id") % 3 == 0)
    return rows.select("vec_id", image_or_zero("pixels", "has", 64).alias("image"))


@query("s13_error_fallback", "SELECT doc_id AS asked, CASE WHEN doc_id % 10 = 3 THEN (SELECT text FROM documents ORDER BY doc_id LIMIT 1) ELSE text END AS text FROM documents")
def s13(d):
    from ..sources.readers import with_fallback

    return with_fallback(d.documents.withColumn("bad", F.col("doc_id") % 10 == 3), "bad", "doc_id").select("asked", "text")


@query("j02_image_paths", "SELECT DISTINCT conv_id, 'folder' || (conv_id % 4) || '/' || conv_id || '.png' AS path FROM conversations")
def j02(d):
    from ..sources.readers import with_image_path

    folders = d.spark.createDataFrame([(i, f"folder{i}") for i in range(4)], "img_path_idx long, folder string")
    rows = d.conversations.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 4).alias("img_path_idx"), F.concat(F.col("conv_id").cast("string"), F.lit(".png")).alias("image"))
    return with_image_path(rows, folders).select("conv_id", "path")


@query("j04_positional_zip", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, text AS prompt, conv_id || '-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS image FROM conversations")
def j04(d):
    rows = d.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    images = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")))
    return rows.select("conv_id", F.posexplode(F.arrays_zip("p", images.alias("image"))).alias("pos", "z")).select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("z.p.text").alias("prompt"), F.col("z.image").alias("image"))


@query("u01_corpora_concat", "SELECT doc_id AS id, text, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def u01(d):
    return d.documents.select(F.col("doc_id").alias("id"), "text").unionByName(d.pages.select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("u03_set_removal", "SELECT DISTINCT p_type AS name FROM part WHERE p_brand <> 'Brand#11' EXCEPT SELECT p_type FROM part WHERE p_brand = 'Brand#11'")
def u03(d):
    return d.part.where("p_brand <> 'Brand#11'").select(F.col("p_type").alias("name")).subtract(d.part.where("p_brand = 'Brand#11'").select("p_type"))


@query("u04_tail_concat", f"{MEGA}, z AS (SELECT max(megabatch) AS last FROM r) SELECT conv_id, megabatch = last AS tail FROM r, z")
def u04(d):
    rows = bt.megabatches(_lengths(d), 16, "conv_id", "words")
    last = rows.agg(F.max("megabatch").alias("last"))
    both = rows.crossJoin(F.broadcast(last))  # one row
    return both.where("megabatch < last").select("conv_id", F.lit(False).alias("tail")).union(both.where("megabatch = last").select("conv_id", F.lit(True).alias("tail")))


@query("u05_feature_concat", "SELECT vec_id, list_concat(embedding, list_reverse(embedding)) AS both FROM embeddings")
def u05(d):
    return d.embeddings.select("vec_id", F.concat("embedding", F.reverse("embedding")).alias("both"))


@query("k01_file_names", "SELECT event_id, string_split('img-' || event_id || '.v2.jpg', '.')[1] || '.png' AS name FROM events")
def k01(d):
    return d.events.select("event_id", F.concat(tx.file_stem(F.concat(F.lit("/a.b/img-"), F.col("event_id").cast("string"), F.lit(".v2.jpg"))), F.lit(".png")).alias("name"))


@query("k05_content_store", "SELECT DISTINCT md5(text) AS md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 7 = 0)")
def k05(d):
    from ..sources.writers import new_content

    return new_content(d.documents.select(F.col("text").alias("content")), d.documents.where("doc_id % 7 = 0").select(F.md5("text").alias("md5"))).select("md5")


@query("s08_config_names", "SELECT p_partkey, string_split(lower(p_brand) || '_base_x', '_')[1] || '_' || string_split(lower(p_brand) || '_base_x', '_')[2] AS config FROM part")
def s08(d):
    parts = F.split(F.concat(F.lower("p_brand"), F.lit("_base_x")), "_")
    return d.part.select("p_partkey", F.array_join(F.slice(parts, 1, 2), "_").alias("config"))


@query("r09_record_merge", "SELECT c_custkey, c_nationkey, CAST(c_custkey % 3 AS INTEGER) AS img_path_idx FROM customer")
def r09(d):
    merged = F.map_concat(F.create_map(F.lit("nation"), F.col("c_nationkey")), F.create_map(F.lit("img_path_idx"), (F.col("c_custkey") % 3).cast("int")))
    return d.customer.withColumn("m", merged).select("c_custkey", F.col("m")["nation"].alias("c_nationkey"), F.col("m")["img_path_idx"].alias("img_path_idx"))


@query("p18_mode_check", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'style' ELSE 'param' END AS mode FROM conversations")
def p18(d):
    mode = F.when(F.col("turn") % 3 == 0, "auto").when(F.col("turn") % 3 == 1, "style").otherwise("param")
    return d.conversations.select("conv_id", "turn", pm.checked_mode(mode).alias("mode"))
