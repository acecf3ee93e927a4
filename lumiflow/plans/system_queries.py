"""Queries of the worker pool, weights and pixel kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded_binary
from ..operators import registry as rg
from ..operators import render as rn
from ..operators import weights as wt
from .catalog import query

# ---- the worker pool: users are workers, event types their models, values queues

EVENTS = "e AS (SELECT event_id, ts, user_id AS worker, event_type AS model, CAST(floor(value) AS INTEGER) % 20 AS queue_length, CAST(event_id % 5 + 1 AS INTEGER) AS speed, user_id % 4 <> 0 AS check_heart_beat FROM events)"
LATEST = f"{EVENTS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1), pool AS (SELECT l.worker, l.ts, l.queue_length, l.speed, l.check_heart_beat, list_sort(list(DISTINCT e.model)) AS model_names, min(e.event_id) AS registered FROM latest l JOIN e USING (worker) GROUP BY ALL)"


def _events(d):
    return d.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("worker"), F.col("event_type").alias("model"), (F.floor("value").cast("int") % 20).alias("queue_length"), (F.col("event_id") % 5 + 1).cast("int").alias("speed"), (F.col("user_id") % 4 != 0).alias("check_heart_beat"))


def _pool(d):
    e = _events(d)
    names = e.groupBy("worker").agg(F.array_sort(F.collect_set("model")).alias("model_names"), F.min("event_id").alias("registered"))
    return rg.latest(e.drop("model"), "worker", ["ts", "event_id"]).join(names, "worker")


@query("x01_register_upsert", f"WITH {LATEST} SELECT worker, queue_length, speed, check_heart_beat, model_names FROM pool")
def x01(d):
    return _pool(d).select("worker", "queue_length", "speed", "check_heart_beat", "model_names")


@query("j09_registry_upsert", f"WITH {LATEST} SELECT worker, event_id, queue_length FROM latest")
def j09(d):
    return rg.latest(_events(d), "worker", ["ts", "event_id"]).select("worker", "event_id", "queue_length")


@query("x02_heartbeat_known", f"WITH {EVENTS} SELECT event_id, worker, worker IN (SELECT worker FROM e WHERE model = 'signup') AS exist FROM e")
def x02(d):
    e = _events(d)
    return rg.known_beats(e, e.where("model = 'signup'")).select("event_id", "worker", "exist")


@query("j08_unknown_beats", f"WITH {EVENTS} SELECT event_id FROM e WHERE worker NOT IN (SELECT worker FROM e WHERE model = 'error' AND event_id % 3 = 0)")
def j08(d):
    e = _events(d)
    return e.join(e.where("model = 'error' and event_id % 3 = 0").select("worker").distinct(), "worker", "left_anti").select("event_id")


@query("x03_expiry_spans", f"""WITH {EVENTS}, b AS (SELECT *, lag(ts) OVER (PARTITION BY worker ORDER BY ts, event_id) AS before FROM e), s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', before)) > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts, event_id) AS span FROM b)
SELECT worker, CAST(span AS BIGINT) AS span, CAST(count(*) AS BIGINT) AS beats, CAST((floor((max(epoch(date_trunc('second', ts))) + 43200) / 30) + 1) * 30 AS BIGINT) AS removed_after FROM s GROUP BY worker, span""")
def x03(d):
    return rg.live_spans(_events(d), gap=43200).select("worker", "span", "beats", "removed_after")


@query("x03_alive_at", f"WITH {LATEST} SELECT worker FROM pool WHERE NOT check_heart_beat OR epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '2024-01-30 00:00:00') - 86400")
def x03b(d):
    rows = _pool(d).withColumnRenamed("ts", "last_heart_beat")
    return rg.alive_at(rows, F.lit("2024-01-30 00:00:00").cast("timestamp"), gap=86400).select("worker")


@query("x05_refresh_all", f"WITH {LATEST} SELECT worker, queue_length FROM pool WHERE worker % 10 <> 0")
def x05(d):
    pool = _pool(d)
    answers = pool.where("worker % 10 <> 0").select("worker", F.lit(True).alias("answers"))
    return pool.join(answers, "worker", "left_semi").select("worker", "queue_length")


@query("j01_model_candidates", f"WITH {LATEST} SELECT worker, unnest(model_names) AS model FROM pool")
def j01(d):
    return rg.candidates(_pool(d)).select("worker", "model")


@query("a03_model_list", f"WITH {EVENTS} SELECT DISTINCT model FROM e")
def a03(d):
    return rg.model_list(_pool(d))


@query("u02_model_union", f"WITH {EVENTS} SELECT DISTINCT model FROM e")
def u02(d):
    e = _events(d)
    return e.where("worker % 2 = 0").select("model").union(e.where("worker % 2 = 1").select("model")).distinct()


@query("a04_cluster_status", f"WITH {LATEST} SELECT (SELECT list_sort(list(DISTINCT model)) FROM e) AS model_names, CAST(sum(speed) AS BIGINT) AS speed, CAST(sum(queue_length) AS BIGINT) AS queue_length FROM pool")
def a04(d):
    return rg.status(_pool(d))


@query("z14_status_rollup", f"WITH {LATEST} SELECT CAST(sum(speed) AS BIGINT) AS speed, CAST(sum(queue_length) AS BIGINT) AS queue_length FROM pool")
def z14(d):
    below = _pool(d).groupBy((F.col("worker") % 3).alias("site")).agg(F.sum("speed").alias("speed"), F.sum("queue_length").alias("queue_length"), F.array_distinct(F.flatten(F.collect_set("model_names"))).alias("model_names"))
    return rg.status(below).select("speed", "queue_length")


@query("a08_lottery_weights", f"WITH {LATEST}, c AS (SELECT worker, speed, unnest(model_names) AS model FROM pool) SELECT worker, model, round(CAST(speed AS DOUBLE) / sum(speed) OVER (PARTITION BY model), 9) AS weight FROM c")
def a08(d):
    return rg.lottery_weights(rg.candidates(_pool(d))).select("worker", "model", F.round("weight", 9).alias("weight"))


@query("t07_shortest_queue", f"WITH {LATEST}, c AS (SELECT worker, speed, queue_length, registered, unnest(model_names) AS model FROM pool), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CAST(queue_length AS DOUBLE) / speed, registered) AS n FROM c) SELECT model, worker, queue_length + 1 AS queue_length FROM o WHERE n = 1")
def t07(d):
    return rg.shortest_queue(rg.candidates(_pool(d)))


@query("t08_lottery", f"WITH {LATEST}, c AS (SELECT worker, speed, unnest(model_names) AS model FROM pool), draws AS (SELECT model, worker, -ln((CAST('0x' || substr(md5('7|' || model || '|' || worker), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / speed AS e FROM c WHERE speed > 0), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY e, worker) AS n FROM draws) SELECT model, worker FROM o WHERE n = 1")
def t08(d):
    return rg.lottery(rg.candidates(_pool(d)), 7)


@query("x06_dispatch_until_beat", f"WITH {EVENTS}, d AS (SELECT event_id, worker, queue_length, model, sum(CASE WHEN model <> 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts, event_id) AS beat FROM e) SELECT event_id, worker, CAST(coalesce(max(CASE WHEN model <> 'click' THEN queue_length END) OVER w, 0) + count(CASE WHEN model = 'click' THEN 1 END) OVER w AS BIGINT) AS queue_now FROM d WINDOW w AS (PARTITION BY worker, beat ORDER BY event_id)")
def x06(d):
    return rg.queue_until_beat(_events(d), F.col("model") == "click", ["event_id"]).select("event_id", "worker", "queue_now")


@query("x08_cumulative_text", "SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations")
def x08(d):
    return rg.cumulative_text(d.conversations, "conv_id", "turn").select("conv_id", "turn", "so_far")


@query("x09_error_codes", "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS code, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'worker exception' WHEN 2 THEN 'no worker' ELSE 'timeout' END AS meaning FROM events")
def x09(d):
    code = (F.col("event_id") % 4).cast("int")
    return d.events.select("event_id", code.alias("code"), F.create_map(*(F.lit(x) for kv in rg.ERRORS.items() for x in kv))[code].alias("meaning"))


@query("x10_vote_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def x10(d):
    return d.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@query("added_beat_windows", f"WITH {EVENTS} SELECT worker, date_trunc('hour', ts) AS window_start, CAST(count(*) AS BIGINT) AS beats FROM e GROUP BY ALL")
def beat_windows(d):
    from ..streaming.workers import beat_windows as windows

    return windows(_events(d)).select("worker", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "beats")


@query("k06_reply_frames", "SELECT event_id, '{\"text\":\"' || event_type || '\",\"error_code\":' || (event_id % 4) || '}' || chr(0) AS frame FROM events")
def k06(d):
    return d.events.select("event_id", rg.framed(F.col("event_type"), (F.col("event_id") % 4).cast("int")).alias("frame"))


@query("r10_json_round_trip", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def r10(d):
    return d.events.select("event_id", F.from_json(F.to_json(F.from_json("props", "k int")), "k int")["k"].alias("k"))


@query("k04_daily_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def k04(d):
    log = d.events.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("tstamp"), "event_id")
    return log.groupBy(F.date_format(F.timestamp_seconds("tstamp"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("p21_token_budget", "SELECT o_orderkey, CAST(least(least(o_custkey % 2000, 1024), 2048 - o_orderkey % 1500 - (o_orderkey % 3) * 256) AS BIGINT) AS budget, least(least(o_custkey % 2000, 1024), 2048 - o_orderkey % 1500 - (o_orderkey % 3) * 256) < 1 AS exceeded FROM orders")
def p21(d):
    k = F.col("o_orderkey")
    b = rg.token_budget(F.col("o_custkey") % 2000, F.lit(2048), k % 1500, k % 3, 256).cast("long")
    return d.orders.select("o_orderkey", b.alias("budget"), (b < 1).alias("exceeded"))


@query("g15_queue_length", "SELECT event_id, CAST(5 - event_id % 6 + user_id % 3 AS BIGINT) AS queue FROM events")
def g15(d):
    return d.events.select("event_id", rg.queue_length(F.lit(5), F.col("event_id") % 6, F.col("user_id") % 3).cast("long").alias("queue"))


@query("t01_model_order", f"WITH {EVENTS}, m AS (SELECT DISTINCT model FROM e) SELECT model, CAST(row_number() OVER (ORDER BY CASE model WHEN 'view' THEN 'aaaaaaa' ELSE model END) - 1 AS BIGINT) AS place FROM m")
def t01(d):
    from pyspark.sql import Window

    rows = rg.model_list(_pool(d)).withColumn("k", F.coalesce(F.create_map(F.lit("view"), F.lit("aaaaaaa"))[F.col("model")], F.col("model")))
    return rows.select("model", (F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("place"))  # a row for each model of a pool


@query("z12_model_page", f"WITH {LATEST} SELECT DISTINCT unnest(model_names) AS model FROM pool WHERE worker % 10 <> 0")
def z12(d):
    return rg.model_list(_pool(d).where("worker % 10 <> 0"))


@query("z13_manual_registration", f"WITH {LATEST} SELECT worker, queue_length FROM pool UNION ALL SELECT -1, 0")
def z13(d):
    e = _events(d).select("worker", "ts", "event_id", "queue_length")
    hand = d.spark.sql("select cast(-1 as bigint) worker, timestamp'2024-02-01' ts, cast(-1 as bigint) event_id, 0 queue_length")
    return rg.latest(e.unionByName(hand), "worker", ["ts", "event_id"]).select("worker", "queue_length")


# ---- weights: rows of embeddings as tensors

NAMED = "CASE WHEN vec_id % 50 = 0 THEN 'model.mm_projector.w' || vec_id WHEN vec_id % 7 = 0 THEN 'layers.' || vec_id || '.lora_A.weight' WHEN vec_id % 5 = 0 THEN 'layers.' || (vec_id + 2) || '.bias' WHEN vec_id % 11 = 0 THEN 'vision_tower.b' || vec_id || '.norm' ELSE 'layers.' || vec_id || '.proj' END"


def _weights(d):
    v = F.col("vec_id")
    return d.embeddings.withColumn("name", F.expr("CASE WHEN vec_id % 50 = 0 THEN concat('model.mm_projector.w', vec_id) WHEN vec_id % 7 = 0 THEN concat('layers.', vec_id, '.lora_A.weight') WHEN vec_id % 5 = 0 THEN concat('layers.', vec_id + 2, '.bias') WHEN vec_id % 11 = 0 THEN concat('vision_tower.b', vec_id, '.norm') ELSE concat('layers.', vec_id, '.proj') END")).withColumn("requires_grad", v % 13 != 0)


_round = lambda c: F.transform(c, lambda x: rounded_binary(x, 6))


def _tensor(d, cond, shape, scale):
    size = shape[0] * shape[1]
    return d.embeddings.where(cond).select(F.concat(F.lit("t"), "vec_id").alias("name"), F.array(*(F.lit(x) for x in shape)).alias("shape"), F.transform(F.slice("embedding", 1, size), lambda x: x.cast("double") * scale).alias("data"))


@query("j06_weight_delta", "SELECT 't' || vec_id AS name, list_transform(embedding, lambda x, i: round(CASE WHEN vec_id % 9 = 0 THEN CAST(x AS DOUBLE) WHEN vec_id % 2 = 0 THEN CAST(x AS DOUBLE) - CAST(x AS DOUBLE) * 0.5 WHEN i <= 32 THEN CAST(x AS DOUBLE) - CAST(x AS DOUBLE) * 0.5 ELSE CAST(x AS DOUBLE) END, 6)) AS data, CASE WHEN vec_id % 9 = 0 THEN 'not in base' WHEN vec_id % 2 = 1 THEN 'dimension mismatch' END AS problem FROM embeddings")
def j06(d):
    base = _tensor(d, "vec_id % 9 <> 0 and vec_id % 2 = 0", (8, 8), 0.5).unionByName(_tensor(d, "vec_id % 9 <> 0 and vec_id % 2 = 1", (4, 8), 0.5))
    out = wt.weight_delta(_tensor(d, "true", (8, 8), 1.0), base)
    return out.select("name", _round("data").alias("data"), "problem")


@query("k08_delta_round_trip", "SELECT 't' || vec_id AS name, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS data FROM embeddings")
def k08(d):
    full, base = _tensor(d, "true", (8, 8), 1.0), _tensor(d, "true", (8, 8), 0.5)
    delta = wt.weight_delta(full, base).select("name", F.array(F.lit(8), F.lit(8)).alias("shape"), "data")
    return wt.weight_delta(delta, base, 1).select("name", _round("data").alias("data"))


@query("p15_adapter_targets", f"WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings) SELECT DISTINCT string_split(name, '.')[-1] AS module FROM w WHERE vec_id % 3 <> 0 AND NOT contains(name, 'mm_projector') AND NOT contains(name, 'vision_tower') AND NOT contains(name, 'vision_resampler') AND string_split(name, '.')[-1] <> 'lm_head'")
def p15(d):
    return wt.adapter_targets(_weights(d).withColumn("is_linear", F.col("vec_id") % 3 != 0))


@query("p16_state_filters", f"WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings), s AS (SELECT DISTINCT string_split(name, 'lora_')[1] || 'bias' AS b FROM w WHERE contains(name, 'lora_')) SELECT vec_id, contains(name, 'lora_') AS lora, contains(name, 'lora_') OR contains(name, 'bias') AS lora_all, contains(name, 'lora_') OR name IN (SELECT b FROM s) AS lora_only, NOT contains(name, 'lora_') AND vec_id % 13 <> 0 AS non_lora, contains(name, 'mm_projector') AS adapter FROM w")
def p16(d):
    return wt.state_filters(_weights(d).select("vec_id", "name", "requires_grad")).drop("name", "requires_grad")


_RATES = {"mm_projector": 1e-3, "vision_tower": 2e-6}


@query("p17_optimizer_groups", f"WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings WHERE vec_id % 13 <> 0) SELECT name, CASE WHEN contains(name, 'mm_projector') THEN 'mm_projector' WHEN contains(name, 'vision_tower') THEN 'vision_tower' END AS rate_key, CASE WHEN contains(name, 'bias') OR contains(name, 'norm') THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS weight_decay FROM w")
def p17(d):
    return wt.optimizer_groups(_weights(d).withColumn("is_norm", F.col("name").contains("norm")), _RATES, 0.1)


@query("j07_rate_by_keyword", f"WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings) SELECT vec_id, CASE WHEN contains(name, 'mm_projector') THEN 0.001::DOUBLE WHEN contains(name, 'vision_tower') THEN 0.000002::DOUBLE END AS rate FROM w")
def j07(d):
    rates = d.spark.createDataFrame(list(_RATES.items()), "keyword string, rate double")
    return _weights(d).join(F.broadcast(rates), F.col("name").contains(F.col("keyword")), "left").select("vec_id", "rate")  # a row for each option


@query("z18_freeze_flags", f"WITH w AS (SELECT {NAMED} AS name, vec_id FROM embeddings) SELECT vec_id, NOT contains(name, 'vision_tower') AS trains FROM w")
def z18(d):
    return _weights(d).select("vec_id", (~wt.any_part(F.col("name"), ("vision_tower",))).alias("trains"))


@query("a11_embedding_mean", "SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY i")
def a11(d):
    return wt.mean_rows(d.embeddings).select("dim", rounded_binary(F.col("mean"), 6).alias("mean"))


# ---- pixel kernels, at eight values of a vector

W1 = [[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(3)] for i in range(4)]
B1 = [0.1, -0.2, 0.0, 0.3]
W2 = [[((i * 5 + j * 2) % 7 - 3) / 10.0 for j in range(4)] for i in range(3)]
B2 = [0.0, 0.1, -0.1]
WZ = [[((i * 3 + j) % 5 - 2) / 10.0 for j in range(6)] for i in range(4)]


def _pixels(d):
    x = [(F.col(c) % 256) / 255.0 for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    return d.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("px"), F.array(*x).alias("rgb"))


def _lin(w, b, x):
    return ["(" + " + ".join(f"({float(v)}::DOUBLE) * {xi}" for v, xi in zip(row, x, strict=True)) + f" + ({float(bi)}::DOUBLE))" for row, bi in zip(w, b, strict=True)]


_P = "p AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS px, CAST(l_orderkey % 256 AS DOUBLE) / 255.0::DOUBLE AS r, CAST(l_partkey % 256 AS DOUBLE) / 255.0::DOUBLE AS g, CAST(l_suppkey % 256 AS DOUBLE) / 255.0::DOUBLE AS b FROM lineitem)"
_H = f"{_P}, h AS (SELECT image_id, px, " + ", ".join(f"greatest({e}, 0.0::DOUBLE) AS h{i}" for i, e in enumerate(_lin(W1, B1, ("r", "g", "b")))) + " FROM p), m AS (SELECT *, (h0 + h1 + h2 + h3) / 4 AS mean FROM h), v AS (SELECT *, ((h0 - mean) * (h0 - mean) + (h1 - mean) * (h1 - mean) + (h2 - mean) * (h2 - mean) + (h3 - mean) * (h3 - mean)) / 4 AS var FROM m), n AS (SELECT image_id, px, " + ", ".join(f"(h{i} - mean) / sqrt(var + 1e-5::DOUBLE) AS x{i}" for i in range(4)) + " FROM v)"


def _out_sql(add="", act="1 / (1 + exp(-({0})))"):
    xs = [f"(x{i}{add.format(i)})" for i in range(4)]
    return "[" + ", ".join(f"round({act.format(e)}, 6)" for e in _lin(W2, B2, xs)) + "] AS out"


@query("n07_pixel_mlp", f"WITH {_H} SELECT image_id, px, {_out_sql()} FROM n")
def n07(d):
    return rn.pixel_mlp(_pixels(d), [(W1, B1)], (W2, B2)).select("image_id", "px", _round("out").alias("out"))


_Z = "z AS (SELECT vec_id, " + ", ".join(f"{e} AS k{i}" for i, e in enumerate(_lin(WZ, [0.0] * 4, [f"greatest(CAST(embedding[{j + 1}] AS DOUBLE), 0.0::DOUBLE)" for j in range(6)]))) + " FROM embeddings)"


def _conditioned(d, bias=(0.0,) * 4):
    z = d.embeddings.select("vec_id", rn.linear(rn.relu(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))), WZ, bias).alias("k"))
    # a picture's vector is projected once; pictures and vectors meet in a join by key
    return _pixels(d).withColumn("vec_id", F.col("image_id") % 500).join(z, "vec_id")


W3 = [[((i * 3 + j * 5) % 9 - 4) / 10.0 for j in range(4)] for i in range(4)]
W4 = [[((i * 2 + j * 7) % 13 - 6) / 10.0 for j in range(4)] for i in range(4)]
WY = [[((i + j * 2) % 7 - 3) / 10.0 for j in range(6)] for i in range(4)]
WX = [[((i * 4 + j) % 3 - 1) / 10.0 for j in range(6)] for i in range(4)]


def _layer_sql(to: str, source: str, w, x: str, k: str) -> str:
    """A layer of four after ``source``: rectified, normed, and a picture's vector added."""
    made = ", ".join(f"greatest({e}, 0.0::DOUBLE) AS h{i}" for i, e in enumerate(_lin(w, B1, [f"{x}{j}" for j in range(len(w[0]))])))
    mean = "(h0 + h1 + h2 + h3) / 4"
    var = "((h0 - mean) * (h0 - mean) + (h1 - mean) * (h1 - mean) + (h2 - mean) * (h2 - mean) + (h3 - mean) * (h3 - mean)) / 4"
    return f"{to} AS (SELECT * EXCLUDE (h0, h1, h2, h3, mean, var), " + ", ".join(f"(h{i} - mean) / sqrt(var + 1e-5::DOUBLE) + {k}{i} AS {to}{i}" for i in range(4)) + f" FROM (SELECT *, {var} AS var FROM (SELECT *, {mean} AS mean FROM (SELECT *, {made} FROM {source}))))"


_ZS = "z AS (SELECT vec_id, " + ", ".join(f"{e} AS {n}{i}" for n, w in (("j", WZ), ("k", WY), ("l", WX)) for i, e in enumerate(_lin(w, [0.0] * 4, [f"greatest(CAST(embedding[{c + 1}] AS DOUBLE), 0.0::DOUBLE)" for c in range(6)]))) + " FROM embeddings)"
_THREE = f"{_P}, {_ZS}, q AS (SELECT image_id, px, r AS c0, g AS c1, b AS c2, z.* FROM p JOIN z ON p.image_id % 500 = z.vec_id), {_layer_sql('u', 'q', W1, 'c', 'j')}, {_layer_sql('v', 'u', W3, 'u', 'k')}, {_layer_sql('w', 'v', W4, 'v', 'l')}"


@query("n01_conditional_renderer", f"WITH {_THREE} SELECT image_id, px, [" + ", ".join(f"round((least(greatest({e}, -1), 1) * 1.1 + 1) * 0.5, 6)" for e in _lin(W2, B2, [f"w{i}" for i in range(4)])) + "] AS out FROM w")
def n01(d):
    z = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    k = d.embeddings.select("vec_id", *(rn.linear(rn.relu(z), w, [0.0] * 4).alias(n) for n, w in (("j", WZ), ("k", WY), ("l", WX))))
    rows = _pixels(d).withColumn("vec_id", F.col("image_id") % 500).join(k, "vec_id")
    return rn.pixel_mlp(rows, [(W1, B1), (W3, B1), (W4, B1)], (W2, B2), "hard_tanh", conditions=[("add", "j"), ("add", "k"), ("add", "l")]).select("image_id", "px", _round("out").alias("out"))


@query("n02_condition_add", f"WITH {_Z} SELECT vec_id, [" + ", ".join(f"round(k{i} + 1.0, 6)" for i in range(4)) + "] AS x FROM z")
def n02(d):
    z = d.embeddings.select("vec_id", rn.linear(rn.relu(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))), WZ, [0.0] * 4).alias("k"))
    return z.select("vec_id", _round(rn.condition(rn.vector([1.0] * 4), F.col("k"), "add")).alias("x"))


@query("n03_condition_kinds", "SELECT vec_id, [round(CAST(embedding[1] AS DOUBLE), 6), round(CAST(embedding[2] AS DOUBLE), 6), round(CAST(embedding[3] AS DOUBLE), 6), round(CAST(embedding[4] AS DOUBLE), 6)] AS cat, [round(CAST(embedding[1] AS DOUBLE) * (1 + CAST(embedding[3] AS DOUBLE)) + CAST(embedding[5] AS DOUBLE), 6), round(CAST(embedding[2] AS DOUBLE) * (1 + CAST(embedding[4] AS DOUBLE)) + CAST(embedding[6] AS DOUBLE), 6)] AS adain FROM embeddings")
def n03(d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return d.embeddings.select("vec_id", _round(rn.condition(F.slice(e, 1, 2), F.slice(e, 3, 2), "cat")).alias("cat"), _round(rn.condition(F.slice(e, 1, 2), F.slice(e, 3, 4), "adain")).alias("adain"))


@query("n04_chunked_render", f"WITH {_H} SELECT image_id, px, {_out_sql()} FROM n")
def n04(d):
    chunks = [rn.pixel_mlp(_pixels(d).where(F.col("px") % 2 == i), [(W1, B1)], (W2, B2)) for i in range(2)]
    return chunks[0].unionByName(chunks[1]).select("image_id", "px", _round("out").alias("out"))


@query("n12_retouch_head", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
h1 AS (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE * x[j + 1])) + (i % 5 - 2) / 10.0::DOUBLE) AS h FROM e),
n1 AS (SELECT vec_id, list_transform(h, lambda v: (v - m) / sqrt(s + 1e-5::DOUBLE)) AS n FROM (SELECT *, list_avg(h) AS m, list_var_pop(h) AS s FROM h1)),
g1 AS (SELECT vec_id, list_transform(n, lambda v: 0.5::DOUBLE * v * (1 + exp(-v * v / 2) * list_sum(list_transform(range(120), lambda k: pow(v / sqrt(2.0::DOUBLE), 2 * k + 1) / gamma(k + 1.5::DOUBLE))))) AS x FROM n1),
h2 AS (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: ((i * 5 + j * 2) % 13 - 6) / 10.0::DOUBLE * x[j + 1])) + (i % 3 - 1) / 10.0::DOUBLE) AS h FROM g1),
n2 AS (SELECT vec_id, list_transform(h, lambda v: (v - m) / sqrt(s + 1e-5::DOUBLE)) AS n FROM (SELECT *, list_avg(h) AS m, list_var_pop(h) AS s FROM h2)),
g2 AS (SELECT vec_id, list_transform(n, lambda v: 0.5::DOUBLE * v * (1 + exp(-v * v / 2) * list_sum(list_transform(range(120), lambda k: pow(v / sqrt(2.0::DOUBLE), 2 * k + 1) / gamma(k + 1.5::DOUBLE))))) AS x FROM n2)
SELECT vec_id, list_transform(range(8), lambda i: round(list_sum(list_transform(range(64), lambda j: ((i * 3 + j) % 7 - 3) / 10.0::DOUBLE * x[j + 1])) + i / 10.0::DOUBLE, 6) + 0.0::DOUBLE) AS out FROM g2""")
def n12(d):
    made = lambda n, a, b, m, c: ([[((i * a + j * b) % m - m // 2) / 10.0 for j in range(64)] for i in range(n)], [(i % c - c // 2) / 10.0 for i in range(n)] if c else [i / 10.0 for i in range(n)])
    layers = [made(64, 7, 3, 11, 5), made(64, 5, 2, 13, 3)]
    return rn.latent_head(d.embeddings, layers, made(8, 3, 1, 7, 0), "vec_id", "embedding").select("vec_id", F.transform("out", lambda x: F.round(x, 6) + 0.0).alias("out"))


@query("n12_wide_pixels", f"WITH {_H} SELECT image_id, px, {_out_sql()} FROM n")
def n12_pixels(d):
    return rn.wide_pixels(_pixels(d), [(W1, B1)], (W2, B2)).select("image_id", "px", _round("out").alias("out"))


@query("n10_slider_prediction", f"SELECT vec_id, [" + ", ".join(f"round(1 / (1 + exp(-{e})), 6)" for e in _lin(W2, B2, [f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(4)])) + "] AS sliders FROM embeddings")
def n10(d):
    return d.embeddings.select("vec_id", _round(rn.slider_prediction(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")), W2, B2)).alias("sliders"))


@query("n23_projector_depth", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN CAST(p_size AS INTEGER) WHEN 2 THEN 0 END AS depth FROM part")
def n23(d):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "linear").when(k == 1, F.concat(F.lit("mlp"), F.col("p_size").cast("string"), F.lit("x_gelu"))).when(k == 2, "identity").otherwise("conv")
    return d.part.select("p_partkey", rn.projector_depth(kind).alias("depth"))


@query("g13_activations", "SELECT l_orderkey, l_linenumber, greatest(x, 0) AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(least(greatest(x / 6 + 0.5, 0), 1), 6) AS hard_sigmoid, round((least(greatest(x, -1), 1) * 1.1 + 1) * 0.5, 6) AS hard_tanh FROM (SELECT *, l_quantity / 5.0::DOUBLE - 5 AS x FROM lineitem)")
def g13(d):
    x = F.col("l_quantity") / 5.0 - 5
    return d.lineitem.select("l_orderkey", "l_linenumber", F.greatest(x, F.lit(0.0)).alias("relu"), *(rounded_binary(rn.ACTIVATIONS[a](x), 6).alias(a) for a in ("sigmoid", "hard_sigmoid", "hard_tanh")))


@query("g14_delta_features", "SELECT vec_id, list_transform(range(1, 4), lambda i: round(CAST(embedding[i + 3] AS DOUBLE) - CAST(embedding[i] AS DOUBLE), 6)) AS diff, list_transform(range(1, 4), lambda i: round(CAST(embedding[i + 3] AS DOUBLE) / (CAST(embedding[i] AS DOUBLE) + 1e-6::DOUBLE), 6) + 0.0::DOUBLE) AS ratio FROM embeddings")
def g14(d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    diff, ratio = rn.delta_features(F.slice(e, 1, 3), F.slice(e, 4, 3))
    return d.embeddings.select("vec_id", _round(diff).alias("diff"), F.transform(ratio, lambda x: rounded_binary(x, 6) + 0.0).alias("ratio"))


@query("r06_masked_latent", "SELECT vec_id, list_transform(range(1, 64), lambda i: round(CAST(embedding[i] AS DOUBLE) * CASE WHEN (i - 1) // 21 = 0 THEN 1 WHEN (i - 1) // 21 = 1 THEN vec_id % 2 ELSE 1 END, 6) + 0.0::DOUBLE) AS latent FROM embeddings")
def r06(d):
    e = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double"))
    mask = F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double"), F.lit(1.0))
    return d.embeddings.select("vec_id", F.transform(rn.masked_latent(e, mask, 21), lambda x: F.round(x, 6) + 0.0).alias("latent"))


@query("a12_channel_pools", "SELECT vec_id, CAST((i - 1) % 4 AS INTEGER) AS channel, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(max(CAST(embedding[i] AS DOUBLE)), 6) AS max FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def a12(d):
    rows = d.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("vec_id", (F.col("i") % 4).alias("channel")).agg(rounded_binary(F.avg(F.col("v").cast("double")), 6).alias("mean"), rounded_binary(F.max(F.col("v").cast("double")), 6).alias("max"))


@query("a13_layer_norm", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), m AS (SELECT *, list_avg(x) AS mean, list_var_pop(x) AS var FROM e) SELECT vec_id, list_transform(x, lambda v: round((v - mean) / sqrt(var + 1e-5::DOUBLE), 6)) AS x FROM m")
def a13(d):
    return d.embeddings.select("vec_id", _round(rn.layer_norm(F.transform("embedding", lambda x: x.cast("double")))).alias("x"))


@query("r07_channels_last", "SELECT vec_id, list_transform(range(48), lambda k: embedding[(k % 3) * 16 + k // 3 + 1]) AS hwc FROM embeddings")
def r07(d):
    return d.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.get("embedding", (k % 3) * 16 + F.floor(k / 3).cast("int"))).alias("hwc"))


@query("r11_unpad_features", "SELECT vec_id, list_concat(list_transform(range(8, 16), lambda i: embedding[i + 1]), [CAST(0 AS FLOAT)], list_transform(range(16, 24), lambda i: embedding[i + 1]), [CAST(0 AS FLOAT)]) AS merged FROM embeddings")
def r11(d):
    row = lambda y: F.concat(F.slice("embedding", y * 8 + 1, 8), F.array(F.lit(0.0).cast("float")))
    return d.embeddings.select("vec_id", F.flatten(F.transform(F.sequence(F.lit(1), F.lit(2)), row)).alias("merged"))


@query("r12_flat_merge", "SELECT vec_id, list_concat(embedding[1:2], embedding[3:4]) AS flat FROM embeddings")
def r12(d):
    return d.embeddings.select("vec_id", F.flatten(F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2))).alias("flat"))


# ---- substrate: not from the reference, a check of the harness


@query("substrate_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def substrate(d):
    rows = d.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))


@query("z05_word_counts", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def z05(d):
    return d.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))
