"""Queries of conversations, prompts, routing and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates as tp
from ..functions import text as tx
from ..operators import chat
from ..operators import params as pm
from .catalog import query, quoted

#: Turns of known roles in order, as every conversation query needs them.
TURNS = """t0 AS (SELECT conv_id, turn, text, CASE WHEN role IN ('human', 'user') THEN 0 WHEN role IN ('gpt', 'assistant') THEN 1 END AS role_no FROM conversations),
t1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t0 WHERE role_no IS NOT NULL),
t AS (SELECT conv_id, turn, text, role_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM t1 WHERE NOT (n = 1 AND role_no = 1))"""


def _role(t: tp.Template) -> str:
    return f"CASE WHEN role_no = 0 THEN {quoted(t.roles[0])} ELSE {quoted(t.roles[1])} END"


def _prompt_sql(t: tp.Template) -> str:
    role, shots = _role(t), t.shots
    pos = f"(pos + {len(shots)})"
    sep, sep2 = quoted(t.sep), quoted(t.sep2)
    alternate = f"CASE WHEN {pos} % 2 = 0 THEN {sep} ELSE {sep2} END"
    head = quoted(t.system + t.sep)
    ended = lambda e: f"string_agg({e}, '' ORDER BY pos)"
    said = "length(text) > 0"
    if t.style == "SINGLE":
        first = "".join(t.roles[i % 2] + ": " + s + t.sep for i, s in enumerate(shots))
        body = f"{quoted(t.system + t.sep + first)} || " + ended(f"CASE WHEN {said} THEN {role} || ': ' || text || {sep} ELSE {role} || ':' END")
    elif t.style in ("QWEN_2", "MPT"):
        body = f"{head} || " + ended(f"CASE WHEN {said} THEN {role} || text || {sep} ELSE {role} END")
    elif t.style == "TWO":
        body = f"{head} || " + ended(f"CASE WHEN {said} THEN {role} || ': ' || text || {alternate} ELSE {role} || ':' END")
    elif t.style == "PLAIN":
        body = f"CASE WHEN bool_or({said} AND {pos} % 2 = 1) AND {sep2} IS NULL THEN NULL ELSE {quoted(t.system)} || " + ended(f"CASE WHEN {said} THEN text || {alternate} ELSE '' END") + " END"
    elif t.style == "CHATML":
        body = f"{quoted(t.system and t.system + t.sep + chr(10))} || " + ended(f"CASE WHEN {said} THEN {role} || chr(10) || text || {sep} || chr(10) ELSE {role} || chr(10) END")
    else:
        system = quoted(f"<<SYS>>\n{t.system}\n<</SYS>>\n\n") if t.system else "''"
        turn = f"CASE WHEN NOT {said} THEN '' WHEN pos % 2 = 0 THEN {sep} || '[INST] ' || CASE WHEN pos = 0 THEN {system} ELSE '' END || text || ' [/INST]' ELSE ' ' || text || ' ' || {sep2} END"
        body = ended(turn)
        if t.sep:
            body = f"ltrim({body}, {sep})"
        body = f"CASE WHEN bool_or(pos = 0 AND {said} AND role_no = 0) THEN {body} END"
    return f"SELECT conv_id, {body} AS prompt FROM t GROUP BY conv_id"


CHATML = tp.Template("chatml", "CHATML", "You are a helpful assistant.", ("<|im_start|>user", "<|im_start|>assistant"), "<|im_end|>")
STYLES = {"f01_single_prompt": tp.TEMPLATES["v0"], "f02_qwen_prompt": tp.TEMPLATES["qwen_2"], "f03_chatml_prompt": CHATML, "f04_two_prompt": tp.TEMPLATES["v1"], "f05_mpt_prompt": tp.TEMPLATES["mpt"], "f06_llama2_prompt": tp.TEMPLATES["llama_2"], "f07_plain_prompt": tp.TEMPLATES["plain"]}
for _name, _t in STYLES.items():
    query(_name, f"WITH {TURNS} {_prompt_sql(_t)}")(lambda d, t=_t: chat.prompts(d.conversations, t))

query("f_all_templates", f"WITH {TURNS} " + " UNION ALL ".join(f"SELECT '{t.name}' AS template, conv_id, md5(prompt) AS prompt_md5 FROM ({_prompt_sql(t)})" for t in tp.TEMPLATES.values()))(
    lambda d: chat.all_prompts(d.conversations, tp.TEMPLATES.values()).select("template", "conv_id", F.md5("prompt").alias("prompt_md5"))
)


_F08 = "CASE WHEN role_no = 0 THEN 'USER' ELSE 'ASSISTANT' END || ': ' || CASE WHEN pos = 0 THEN {0} ELSE text END"


@query("f08_image_messages", f"WITH {TURNS} SELECT conv_id, 'plain' AS kind, list({_F08.format("'<image>' || chr(10) || trim(replace(text, '<image>', ''))")} ORDER BY pos) AS said FROM t GROUP BY conv_id UNION ALL SELECT conv_id, 'tagged', list_concat(['USER: <Image><image></Image>', 'ASSISTANT: Received.'], list({_F08.format("trim(replace(text, '<image>', ''))")} ORDER BY pos)) FROM t GROUP BY conv_id")
def f08_messages(d):
    """All messages after the image is put first, both ways."""
    rows = chat.messages(chat.usable_turns(d.conversations), ("USER", "ASSISTANT")).where(F.size("messages") > 0)
    said = lambda t: F.transform(tp.with_image_first(t, F.col("messages")), lambda m: F.concat_ws(": ", m["role"], m["text"]))
    return rows.select("conv_id", F.lit("plain").alias("kind"), said(tp.TEMPLATES["qwen_2"]).alias("said")).union(rows.select("conv_id", F.lit("tagged"), said(tp.TEMPLATES["v1_mmtag"])))


@query("f08_image_first", f"WITH {TURNS}, x AS (SELECT * FROM t WHERE pos = 0) SELECT conv_id, 'plain' AS kind, '<image>' || chr(10) || trim(replace(text, '<image>', '')) AS first_text, CAST(1 AS BIGINT) AS added FROM x UNION ALL SELECT conv_id, 'tagged', '<Image><image></Image>', 3 FROM x")
def f08(d):
    rows = chat.messages(chat.usable_turns(d.conversations), ("USER", "ASSISTANT")).where(F.size("messages") > 0)
    out = []
    for kind, t in (("plain", tp.TEMPLATES["qwen_2"]), ("tagged", tp.TEMPLATES["v1_mmtag"])):
        new = tp.with_image_first(t, F.col("messages"))
        out.append(rows.select("conv_id", F.lit(kind).alias("kind"), new[0]["text"].alias("first_text"), (F.size(new) - F.size("messages") + 1).cast("long").alias("added")))
    return out[0].unionByName(out[1])


MARKED = "conversations.text || CASE WHEN turn % 2 = 0 THEN ' <image> ' ELSE '' END"


@query("f09_image_to_front", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<image>' || chr(10) || trim(replace({MARKED}, '<image>', ''), ' ' || chr(10)) ELSE text END AS moved, CASE WHEN turn % 2 = 0 THEN '<Image><im_start><image><im_end></Image>' || chr(10) || trim(replace({MARKED}, '<image>', ''), ' ' || chr(10)) ELSE text END AS tagged FROM conversations")
def f09(d):
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, " <image> ").otherwise(""))
    return d.conversations.select("conv_id", "turn", tp.image_to_front(text).alias("moved"), tp.image_to_front(text, True, True).alias("tagged"))


@query("f10_legacy_lines", "SELECT conv_id, turn, '### ' || CASE WHEN role = 'user' THEN 'Human' WHEN role = 'assistant' THEN 'Assistant' ELSE 'unknown' END || ': ' || text || chr(10) AS line FROM conversations")
def f10(d):
    return d.conversations.select("conv_id", "turn", chat.legacy_lines(F.col("role"), F.col("text"), tp.TITLE).alias("line"))


PATHS = "CASE o_orderkey % 3 WHEN 0 THEN '/models/run-' || o_orderkey || '/checkpoint-' || o_custkey || '/' WHEN 1 THEN 'org/llava-v1.5-' || o_custkey || 'b' ELSE '/m' || o_orderkey || '/' END"


def _paths(d):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    n = F.col("o_orderkey") % 3
    return d.orders.withColumn("path", F.when(n == 0, F.concat(F.lit("/models/run-"), key, F.lit("/checkpoint-"), cust, F.lit("/"))).when(n == 1, F.concat(F.lit("org/llava-v1.5-"), cust, F.lit("b"))).otherwise(F.concat(F.lit("/m"), key, F.lit("/"))))


@query("f12_model_name", f"WITH p AS (SELECT o_orderkey, string_split(trim({PATHS}, '/'), '/') AS parts FROM orders) SELECT o_orderkey, CASE WHEN starts_with(parts[-1], 'checkpoint-') THEN parts[-2] || '_' || parts[-1] ELSE parts[-1] END AS model FROM p")
def f12(d):
    return _paths(d).select("o_orderkey", tx.model_name_of_path(F.col("path")).alias("model"))


@query("f13_split_at_images", "SELECT conv_id, turn, CAST(len(string_split(text || '<image>' || text, '<image>')) AS BIGINT) AS parts, string_split(text || '<image>' || text, '<image>')[2] AS second FROM conversations")
def f13(d):
    parts = F.split(F.concat("text", F.lit("<image>"), "text"), "<image>")
    return d.conversations.select("conv_id", "turn", F.size(parts).cast("long").alias("parts"), parts[1].alias("second"))


@query("f14_stop_trim", "SELECT conv_id, turn, CASE WHEN ends_with(text, '.') THEN left(text, length(text) - 1) ELSE text END AS trimmed FROM conversations")
def f14(d):
    from ..operators.registry import without_stop

    return d.conversations.select("conv_id", "turn", without_stop(F.col("text"), ".").alias("trimmed"))


@query("f15_after_prompt", "SELECT conv_id, turn, trim(substr(text, 6), ' ' || chr(10)) AS answer FROM conversations")
def f15(d):
    return d.conversations.select("conv_id", "turn", tx.strip(F.substring("text", 6, 1 << 30)).alias("answer"))


@query("f16_daily_log_name", "SELECT event_id, strftime(ts, '%Y-%m-%d') || '-conv.json' AS name FROM events")
def f16(d):
    from ..sources.writers import log_name

    return d.events.select("event_id", log_name(F.col("ts")).alias("name"))


@query("f17_chat_pairs", f"WITH {TURNS} SELECT conv_id, CAST(pos // 2 AS BIGINT) AS pair, max(CASE WHEN pos % 2 = 0 THEN text END) AS asked, max(CASE WHEN pos % 2 = 1 THEN text END) AS answered FROM t GROUP BY conv_id, pos // 2")
def f17(d):
    return chat.chat_pairs(chat.usable_turns(d.conversations))


@query("f18_conversation_json", f"WITH {TURNS} SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg('[' || role_no || ',' || length(text) || ']', ',' ORDER BY pos) AS shape FROM t GROUP BY conv_id")
def f18(d):
    rows = chat.messages(chat.usable_turns(d.conversations), ("0", "1"))
    js = F.to_json(F.struct(F.lit(tp.QWEN).alias("system"), F.array(F.lit("0"), F.lit("1")).alias("roles"), F.transform("messages", lambda m: F.array(m["role"], m["text"])).alias("messages"), F.lit(0).alias("offset")))
    back = F.from_json(js, "struct<messages: array<array<string>>>")["messages"]
    return rows.select("conv_id", F.size(back).cast("long").alias("n"), F.array_join(F.transform(back, lambda m: F.concat(F.lit("["), m[0], F.lit(","), F.length(m[1]).cast("string"), F.lit("]"))), ",").alias("shape"))


# fixed values: the questions, in order
_Q = """(VALUES
    (0, 'content', 'Please describe the framing and content of this image.'),
    (1, 'content', 'Can you provide a description of how this image is composed and what it depicts?'),
    (2, 'content', 'Could you outline both the structure and the subject matter of the photograph?'),
    (3, 'content', 'Please give an account of the image’s framing as well as its depicted elements.'),
    (4, 'content', 'Tell me about the composition and the narrative content captured in this image.'),
    (5, 'retouch', 'Could you help me to retouch this image?'),
    (6, 'retouch', 'Can you assist with retouching this image for me?'),
    (7, 'retouch', 'Would you be able to help retouch this picture?'),
    (8, 'retouch', 'Could you do me a favor and retouch this image?'),
    (9, 'retouch', 'Is it possible for you to help with retouching this picture?'),
    (10, 'retouch', 'Can you lend a hand in retouching this image?'),
    (11, 'retouch', 'Would you help me out by retouching this picture?'),
    (12, 'retouch', 'Could you assist me in retouching this image?'),
    (13, 'retouch', 'Is there a way you could help retouch this picture for me?'),
    (14, 'retouch', 'Can you help me get this image retouched?'),
    (15, 'retouch', 'Would you be willing to help with retouching this picture?')
) v(no, kind, question)"""


@query("f19_questions", f"SELECT c.conv_id, v.kind, '<image>' || chr(10) || v.question AS question FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN {_Q} ON c.conv_id % 16 = v.no")
def f19(d):
    rows = d.spark.createDataFrame([(i, k, "<image>\n" + q) for i, (k, q) in enumerate(pm.QUESTIONS)], "no long, kind string, question string")
    return d.conversations.select("conv_id").distinct().withColumn("no", F.col("conv_id") % 16).join(rows, "no").select("conv_id", "kind", "question")


@query("p01_auto_prompt", f"SELECT doc_id, {quoted(tp.QWEN)} || '<|im_end|>' || chr(10) || {quoted(tp.IM[0])} || '<image>' || chr(10) || {quoted(pm.AUTO_PROMPT)} || '<|im_end|>' || chr(10) || {quoted(tp.IM[1])} AS prompt FROM documents")
def p01(d):
    t = tp.TEMPLATES["qwen_2"]
    said = F.array(F.struct(F.lit(t.roles[0]).alias("role"), F.lit("<image>\n" + pm.AUTO_PROMPT).alias("text")), F.struct(F.lit(t.roles[1]).alias("role"), F.lit(None).cast("string").alias("text")))
    return d.documents.select("doc_id", tp.render(t, said).alias("prompt"))


@query("p02_style_prompt", f"SELECT doc_id, '<image>' || chr(10) || {quoted(pm.STYLE_PROMPT)} || text AS prompt FROM documents")
def p02(d):
    return d.documents.select("doc_id", pm.style_prompt(F.col("text")).alias("prompt"))


@query("p08_modality", "SELECT DISTINCT conv_id, conv_id % 3 = 0 AS multimodal FROM conversations")
def p08(d):
    image = F.when(F.col("conv_id") % 3 == 0, F.concat(F.col("conv_id").cast("string"), F.lit(".png")))
    return d.conversations.select("conv_id", image.isNotNull().alias("multimodal")).distinct()


@query("p09_role_map", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'USER' WHEN role = 'assistant' THEN 'ASSISTANT' END AS name FROM conversations")
def p09(d):
    n = chat.role_index(F.col("role"))
    return d.conversations.select("conv_id", "turn", F.when(n == 0, "USER").when(n == 1, "ASSISTANT").alias("name"))


@query("p10_drop_first", f"WITH {TURNS} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos FROM t")
def p10(d):
    return chat.usable_turns(d.conversations.where("not (conv_id % 5 = 0 and turn = 0 and role = 'nobody')")).select("conv_id", "turn", "pos")


@query("p11_unknown_roles", "SELECT conv_id, CAST(count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS BIGINT) AS skipped, bool_or(turn = 0 AND role NOT IN ('user', 'assistant')) AS first_unknown FROM conversations GROUP BY conv_id")
def p11(d):
    unknown = chat.role_index(F.col("role")).isNull()
    return d.conversations.groupBy("conv_id").agg(F.count_if(unknown).alias("skipped"), F.bool_or((F.col("turn") == 0) & unknown).alias("first_unknown"))


@query("p12_alternation", f"WITH {TURNS} SELECT conv_id, bool_and(role_no = pos % 2) AS alternates FROM t GROUP BY conv_id")
def p12(d):
    return chat.usable_turns(d.conversations).groupBy("conv_id").agg(F.bool_and("alternates").alias("alternates"))


NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'LLaVA-Llama-2-13b' WHEN 1 THEN 'llava-mistral-orca' WHEN 2 THEN 'llava-mixtral-hermes' WHEN 3 THEN 'llava-v1.6-34b' WHEN 4 THEN 'llava-v1-mmtag' WHEN 5 THEN 'llava-mpt-7b' WHEN 6 THEN 'mpt-7b' WHEN 7 THEN 'llava-plain-lora' ELSE 'vicuna-13b' END"
_NAMES = ("LLaVA-Llama-2-13b", "llava-mistral-orca", "llava-mixtral-hermes", "llava-v1.6-34b", "llava-v1-mmtag", "llava-mpt-7b", "mpt-7b", "llava-plain-lora", "vicuna-13b")


def _named(d):
    return d.part.withColumn("model", F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("p_partkey") % 9 + 1).cast("int")))


@query("p13_loader_route", f"WITH p AS (SELECT p_partkey, lower({NAMES}) AS m FROM part) SELECT p_partkey, CASE WHEN contains(m, 'llava') THEN CASE WHEN contains(m, 'lora') THEN 'lora' WHEN contains(m, 'mpt') THEN 'mpt' WHEN contains(m, 'mistral') THEN 'mistral' WHEN contains(m, 'qwen') THEN 'qwen' ELSE 'llama' END WHEN contains(m, 'mpt') THEN 'mpt_text' ELSE 'language' END AS loader FROM p")
def p13(d):
    from ..operators.weights import loader_of_model

    return _named(d).select("p_partkey", loader_of_model(F.col("model")).alias("loader"))


@query("p14_template_route", f"WITH p AS (SELECT p_partkey, {NAMES} AS name, lower({NAMES}) AS m FROM part) SELECT p_partkey, CASE WHEN contains(m, 'llama-2') THEN 'llava_llama_2' WHEN contains(m, 'mistral') THEN 'mistral_instruct' WHEN contains(m, 'v1.6-34b') THEN 'chatml_direct' WHEN contains(m, 'v1') THEN 'llava_v1' WHEN contains(m, 'mpt') THEN 'mpt' ELSE 'llava_v0' END AS terminal, CASE p_partkey % 9 WHEN 0 THEN 'llava_llama_2' WHEN 2 THEN 'chatml_direct' WHEN 3 THEN 'chatml_direct' WHEN 4 THEN 'v1_mmtag' WHEN 5 THEN 'mpt' WHEN 7 THEN 'v0_mmtag' WHEN 8 THEN 'vicuna_v1' END AS web FROM p")
def p14(d):
    return _named(d).select("p_partkey", tp.template_of_model(F.col("model")).alias("terminal"), tp.template_of_model(F.col("model"), True).alias("web"))


@query("p19_user_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 1536) ELSE left(text, 1200) || chr(10) || '<image>' END AS said FROM documents WHERE length(text) > 0")
def p19(d):
    from ..operators.registry import user_text

    return d.documents.where("length(text) > 0").select("doc_id", user_text(F.col("text"), F.col("doc_id") % 2 == 1).alias("said"))


@query("p20_placeholders", "SELECT conv_id, turn, turn % 3 = CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS fits FROM conversations")
def p20(d):
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, "<image>").otherwise(""))
    return d.conversations.select("conv_id", "turn", (F.col("turn") % 3 == tx.count_of(text, "<image>")).alias("fits"))


@query("p23_booleans", "SELECT o_orderkey, o_orderkey % 4 < 2 AS flag FROM orders")
def p23(d):
    word = F.element_at(F.array(*(F.lit(w) for w in ("Yes", "1", "off", "N"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return d.orders.select("o_orderkey", tx.truth_of(word).alias("flag"))


@query("w01_turn_ordinal", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal FROM conversations")
def w01(d):
    from pyspark.sql import Window

    return d.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("ordinal"))


@query("z08_special_tokens", """WITH k AS (SELECT * FROM (VALUES (0, 'retouch', '<retouch_light>'), (1, 'retouch', '<retouch_color&temp>'), (2, 'retouch', '<retouch_colormixer>'),
(3, 'problem', '<problem_light_start>'), (4, 'problem', '<problem_globalcolor_start>'), (5, 'problem', '<problem_specificcolor_start>'), (6, 'problem', '<problem_light_end>'), (7, 'problem', '<problem_globalcolor_end>'), (8, 'problem', '<problem_specificcolor_end>'),
(9, 'plan', '<plan_light_start>'), (10, 'plan', '<plan_globalcolor_start>'), (11, 'plan', '<plan_specificcolor_start>'), (12, 'plan', '<plan_light_end>'), (13, 'plan', '<plan_globalcolor_end>'), (14, 'plan', '<plan_specificcolor_end>'),
(15, 'task', '<Auto_Retouch_Task>'), (16, 'task', '<Style_Retouch_Task>'), (17, 'task', '<Professional_Retouch_Task>')) t(i, kind, token))
SELECT conv_id, turn, kind, token, CAST(length(token || text) AS BIGINT) AS length FROM conversations JOIN k ON (conv_id + turn) % 18 = k.i""")
def z08(d):
    """A mark before each turn, all of them in the order in which they are declared."""
    marks = [(k, t) for k, ts in pm.SPECIAL_TOKENS.items() for t in ts]
    mark = F.get(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("token")) for k, t in marks)), ((F.col("conv_id") + F.col("turn")) % len(marks)).cast("int"))
    rows = d.conversations.withColumn("mark", mark)
    return rows.select("conv_id", "turn", "mark.kind", "mark.token", F.length(F.concat("mark.token", "text")).cast("long").alias("length"))


@query("z09_plain_reply", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS reply FROM conversations")
def z09(d):
    tokens = [t for ts in pm.SPECIAL_TOKENS.values() for t in ts] + ["<|im_end|>", "<|im_start|>"]
    text = F.concat(F.lit(" <retouch_light><plan_light_start>"), "text", F.lit("<|im_end|>\n"))
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(""))
    return d.conversations.select("conv_id", "turn", tx.strip(text).alias("reply"))


@query("z10_regenerate", f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN pos = max(pos) OVER (PARTITION BY conv_id) AND role_no = 1 THEN NULL ELSE text END AS kept FROM t")
def z10(d):
    from pyspark.sql import Window

    rows = chat.usable_turns(d.conversations)
    last = F.max("pos").over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn", F.when(~((F.col("pos") == last) & (F.col("role_no") == 1)), F.col("text")).alias("kept"))


@query("z10_cleared_history", f"WITH {TURNS}, c AS (SELECT *, max(CASE WHEN (conv_id + turn) % 5 = 3 THEN pos END) OVER (PARTITION BY conv_id) AS cleared FROM t) SELECT conv_id, turn, CAST(pos - coalesce(cleared + 1, 0) AS BIGINT) AS place, text FROM c WHERE cleared IS NULL OR pos > cleared")
def z10_cleared(d):
    """Turns behind the last one at which the history was cleared, counted anew."""
    from pyspark.sql import Window

    clear = (F.col("conv_id") + F.col("turn")) % 5 == 3
    rows = chat.usable_turns(d.conversations).withColumn("cleared", F.max(F.when(clear, F.col("pos"))).over(Window.partitionBy("conv_id")))
    kept = rows.where(F.col("cleared").isNull() | (F.col("pos") > F.col("cleared")))
    return kept.select("conv_id", "turn", (F.col("pos") - F.coalesce(F.col("cleared") + 1, F.lit(0))).cast("long").alias("place"), "text")


@query("z11_first_turn_image", f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN pos = 0 THEN '<image>' || chr(10) || text ELSE text END AS said FROM t WHERE role_no = 0")
def z11(d):
    return chat.usable_turns(d.conversations).where("role_no = 0").select("conv_id", "turn", F.when(F.col("pos") == 0, F.concat(F.lit("<image>\n"), "text")).otherwise(F.col("text")).alias("said"))


@query("z16_rerange", "SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12') AS rerange FROM part")
def z16(d):
    return d.part.select("p_partkey", F.col("p_brand").isin("Brand#11", "Brand#12").alias("rerange"))
