"""A pool of workers, replayed from registration and heartbeat events in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import PART, inside, parted, upto, with_carry

#: Seconds without a heartbeat before a worker is dropped, and between sweeps.
EXPIRATION, SWEEP = 30, 30
#: Seconds between a worker's own heartbeats, and calls that it runs at once.
BEAT, CONCURRENT = 15, 5
ERRORS = {0: "ok", 1: "worker exception", 2: "no worker", 3: "timeout"}


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate that is partial before the shuffle, so a hot key is no hot task."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(key, *(F.col(f"__r.{c}") for c in cols))


def known_beats(beats: DataFrame, registered: DataFrame, key: str = "worker") -> DataFrame:
    """Heartbeats with ``exist``: whether the worker is registered; others must register again."""
    names = registered.select(F.col(key).alias("__k")).distinct()
    return beats.join(names, F.col(key) == F.col("__k"), "left").withColumn("exist", F.col("__k").isNotNull()).drop("__k")


def live_spans(beats: DataFrame, key: str = "worker", ts: str = "ts", gap: int = EXPIRATION) -> DataFrame:
    """(key, span, first_beat, last_beat, beats, removed_after): runs of beats not more than ``gap`` seconds apart, from 1; beats without a time don't count.

    A sweep every ``SWEEP`` seconds removes a silent worker, so it goes at the first sweep after
    the last beat plus the gap.  A worker's beats are parted by time: runs inside parts are joined where the
    last beat of a part and the first of the next are near.
    """
    far = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a) > gap
    rows = parted(beats.where(F.col(ts).isNotNull()), key, ts)
    starts = F.when(far(F.lag(ts).over(inside(ts)), F.col(ts)), 1).otherwise(0)
    runs = rows.withColumn("__s", starts).withColumn("__run", F.sum("__s").over(upto(ts)))
    runs = runs.groupBy(PART, "__run").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.count("*").alias("__n"))
    ends = [F.min("__first").alias("__from"), F.max("__last").alias("__to"), F.max("__run").alias("__runs")]
    opens = lambda w: [F.when(~F.coalesce(~far(F.lag("__to").over(w), F.col("__from")), F.lit(False)), 1).otherwise(0).alias("__open")]
    carried = lambda w: [(F.coalesce(F.sum(F.col("__runs") + F.col("__open")).over(w), F.lit(0)) + F.col("__open")).alias("__before")]
    spans = with_carry(runs, ends, carried, opens).withColumn("span", F.col("__run") + F.col("__before"))
    out = spans.groupBy(F.col(f"{PART}.k").alias(key), "span").agg(F.min("__first").alias("first_beat"), F.max("__last").alias("last_beat"), F.sum("__n").alias("beats"))
    return out.withColumn("removed_after", ((F.floor((F.unix_timestamp("last_beat") + gap) / SWEEP) + 1) * SWEEP).cast("long"))


def alive_at(workers: DataFrame, now: Column, ts: str = "last_heart_beat", gap: int = EXPIRATION) -> DataFrame:
    """Workers that a sweep at ``now`` keeps: unchecked ones, and those with a beat in the last ``gap`` seconds, the limit included."""
    return workers.where(~F.col("check_heart_beat") | (F.unix_timestamp(ts) >= F.unix_timestamp(now) - gap))


def candidates(workers: DataFrame, models: str = "model_names") -> DataFrame:
    """A row for each worker and model it serves."""
    return workers.select("*", F.explode(models).alias("model"))


def model_list(workers: DataFrame, models: str = "model_names") -> DataFrame:
    return workers.select(F.explode(models).alias("model")).distinct()


def status(workers: DataFrame) -> DataFrame:
    """One row: all models, and the sums of speed and queue over workers that answer (queue not null)."""
    answering = workers.where("queue_length is not null")
    sums = answering.agg(F.sum("speed").cast("long").alias("speed"), F.sum("queue_length").alias("queue_length"))
    # distinct names before they are gathered: a row for each model of a pool
    names = model_list(answering).agg(F.array_sort(F.collect_list("model")).alias("model_names"))
    return names.crossJoin(F.broadcast(sums)).select("model_names", "speed", "queue_length")  # one row and one row


def lottery_weights(rows: DataFrame, model: str = "model") -> DataFrame:
    """Adds ``weight``: a worker's share of its model's speed; null where a model's speeds sum to nothing."""
    total = rows.groupBy(F.col(model).alias("__model")).agg(F.sum("speed").alias("__total"))
    both = rows.join(total, F.col(model).eqNullSafe(F.col("__model")), "left")
    return both.withColumn("weight", F.when(F.col("__total") >= 1e-4, F.col("speed") / F.col("__total"))).drop("__model", "__total")


def shortest_queue(rows: DataFrame, model: str = "model", order: str = "registered") -> DataFrame:
    """The worker of each model with the smallest queue over speed, the first registered on ties; it is given one more. Partial minimum, no window."""
    best = rows.groupBy(model).agg(F.min_by(F.struct("worker", "queue_length"), F.struct((F.col("queue_length") / F.col("speed")).alias("load"), F.col(order).alias("at"))).alias("b"))
    return best.select(model, F.col("b.worker").alias("worker"), (F.col("b.queue_length") + 1).alias("queue_length"))


def lottery(rows: DataFrame, seed: int, model: str = "model") -> DataFrame:
    """A worker of each model drawn by speed: the smallest exponential over speed, from a hash that repeats."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), model, "worker")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)
    return rows.where("speed > 0").groupBy(model).agg(F.min_by("worker", F.struct((-F.log(u) / F.col("speed")).alias("e"), F.col("worker").alias("w"))).alias("worker"))


def token_budget(asked: Column, context: Column, prompt: Column, images: Column, patches: int) -> Column:
    """Tokens that may be generated: at most 1024 and what the context leaves."""
    return F.least(F.least(asked, F.lit(1024)), context - prompt - images * patches)


def queue_length(limit: Column, permits: Column, waiters: Column) -> Column:
    return limit - permits + waiters


def admission(calls: DataFrame, step: Column, order: list[str], limit: int = CONCURRENT, key: str = "worker", ts: str = "ts") -> DataFrame:
    """Adds ``running``, ``waiting``, ``queue_length`` and ``timed_beats`` after each call; ``step`` is 1 where a slot is asked for and -1 where one is given back.

    At most ``limit`` calls run and the rest wait; giving back with none out changes nothing, so
    what is out is the running sum above its lowest point.  A worker sends its queue with every
    call and every ``BEAT`` seconds from its first; ``timed_beats`` counts the latter since the call before.
    Parts of a worker's time hand on their sum, lowest point and last call.
    """
    w = upto(ts, *order)
    local = parted(calls, key, ts).withColumn("__s", F.sum(step).over(w)).withColumns({"__low": F.min("__s").over(w), "__prev": F.lag(ts).over(inside(ts, *order))})
    ends = [F.max_by("__s", F.struct(ts, *order)).alias("__sum"), F.min("__s").alias("__least"), F.min(ts).alias("__from"), F.max(ts).alias("__to")]
    sums = lambda w: [F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")]
    carried = lambda w: [F.col("__base"), F.least(F.lit(0), F.min(F.col("__base") + F.col("__least")).over(w)).alias("__floor"), F.max("__to").over(w).alias("__last"), F.least(F.min("__from").over(w), F.col("__from")).alias("__begin")]
    rows = with_carry(local, ends, carried, sums)
    rows = rows.withColumn("queue_length", F.col("__base") + F.col("__s") - F.least(F.col("__floor"), F.col("__base") + F.col("__low")))
    ticks = lambda at: F.floor((F.unix_timestamp(at) - F.unix_timestamp("__begin")) / BEAT)
    beats = ticks(F.col(ts)) - F.coalesce(ticks(F.coalesce("__prev", "__last")), F.lit(0))
    added = {"timed_beats": beats, "running": F.least("queue_length", F.lit(limit)), "waiting": F.greatest(F.col("queue_length") - limit, F.lit(0))}
    return rows.withColumns(added).drop(PART, "__s", "__low", "__prev", "__base", "__floor", "__last", "__begin")


def queue_until_beat(events: DataFrame, dispatch: Column, order: list[str], key: str = "worker", ts: str = "ts", queue: str = "queue_length") -> DataFrame:
    """Adds ``queue_now``: the queue of a worker's last beat and one for each ``dispatch`` since; without a beat, the dispatches alone.

    Parts of a worker's time hand on their dispatches and the last beat with those before it.
    """
    w = upto(ts, *order)
    local = parted(events, key, ts).withColumn("__c", F.sum(F.when(dispatch, 1).otherwise(0)).over(w))
    local = local.withColumn("__beat", F.last(F.when(~dispatch, F.struct(F.col(queue).alias("q"), F.col("__c").alias("c"))), ignorenulls=True).over(w))
    newest = F.struct(ts, *order)
    ends = [F.max_by("__c", newest).alias("__sum"), F.max_by("__beat", newest).alias("__end")]
    sums = lambda w: [F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base")]
    shifted = F.when(F.col("__end").isNotNull(), F.struct(F.col("__end.q").alias("q"), (F.col("__end.c") + F.col("__base")).alias("c")))
    rows = with_carry(local, ends, lambda w: [F.col("__base"), F.last(shifted, ignorenulls=True).over(w).alias("__old")], sums)
    own = F.coalesce("__beat.q", F.lit(0)) + F.col("__c") - F.col("__beat.c")
    old = F.coalesce("__old.q", F.lit(0)) + F.col("__base") + F.col("__c") - F.coalesce("__old.c", F.lit(0))
    now = F.when(F.col("__beat").isNotNull(), own).otherwise(old)
    return rows.withColumn("queue_now", now.cast("long")).drop(PART, "__c", "__beat", "__base", "__old")


def user_text(text: Column, has_image: Column) -> Column:
    """What a chat keeps of a message: 1536 characters, 1200 with an image, whose mark is added if absent."""
    cut = F.substring(text, 1, 1536)
    short = F.substring(cut, 1, 1200)
    return F.when(~has_image, cut).when(short.contains("<image>"), short).otherwise(F.concat(short, F.lit("\n<image>")))


def framed(text: Column, code: Column) -> Column:
    """A chunk of a reply stream: JSON and a NUL."""
    return F.concat(F.to_json(F.struct(text.alias("text"), code.alias("error_code"))), F.lit("\0"))


def cumulative_text(pieces: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds ``so_far``: the key's texts up to each row, as a reply stream repeats them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("so_far", F.array_join(F.collect_list(text).over(w), ""))


def without_stop(text: Column, stop: str) -> Column:
    return F.when(text.endswith(stop), F.substring(text, F.lit(1), F.length(text) - len(stop))).otherwise(text)
