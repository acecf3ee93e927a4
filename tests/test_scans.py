"""Running values of a worker against a replay in order, with one worker that holds most rows."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumiflow.operators import registry as rg
from lumiflow.operators.scans import PART, parted

START = datetime(2024, 3, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def events():
    """(event_id, worker, ts, model, queue_length): worker 1 has most rows, one has none of a kind, one is null; moments recur."""
    draw = random.Random(5)
    rows, at = [], 0
    for i in range(3000):
        at += draw.choice([0, 0, 1, 3, 20, 40])
        worker = 1 if draw.random() < 0.8 else draw.choice([2, 3, 4, None])
        model = "click" if worker == 2 else draw.choice(["click", "view"])
        rows.append((i, worker, at, model, draw.choice([None, 0, 4, 9])))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, events):
    rows = [(i, w, START + timedelta(seconds=at), m, q) for i, w, at, m, q in events]
    return spark.createDataFrame(rows, "event_id long, worker long, ts timestamp, model string, queue_length int").repartition(4).cache()


def by_worker(events):
    groups = {}
    for r in sorted(events, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def test_parts_split_a_hot_worker(frame):
    sizes = [r["count"] for r in parted(frame, "worker", "ts").groupBy(PART).count().collect()]
    assert max(sizes) < 40  # of 2400


@pytest.mark.parametrize("gap", [0, 30, 39, 10**6])
def test_live_spans(frame, events, gap):
    want = set()
    for worker, rows in by_worker(events).items():
        span, last, first, n = 0, None, None, 0
        for r in [*rows, None]:
            if r is None or last is None or r[2] - last > gap:
                if last is not None:
                    want.add((worker, span, first, last, n))
                if r is None:
                    break
                span, first, n = span + 1, r[2], 0
            last, n = r[2], n + 1
    seconds = lambda c: F.unix_timestamp(c) - int(START.timestamp())
    got = rg.live_spans(frame, gap=gap).select("worker", "span", seconds("first_beat"), seconds("last_beat"), "beats").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_admission(frame, events):
    want = {}
    for rows in by_worker(events).values():
        out, begin, ticks = 0, rows[0][2], 0
        for i, _, at, model, _ in rows:
            out = max(0, out + (1 if model == "click" else -1))
            now = (at - begin) // rg.BEAT
            want[i] = (out, min(out, 5), max(out - 5, 0), now - ticks)
            ticks = now
    rows = rg.admission(frame, F.when(F.col("model") == "click", 1).otherwise(-1), ["event_id"])
    assert set(rows.columns) == {*frame.columns, "timed_beats", "running", "waiting"}
    got = {r["event_id"]: (r["queue_length"], r["running"], r["waiting"], r["timed_beats"]) for r in rows.collect()}
    assert got == want


def test_queue_until_beat(frame, events):
    want = {}
    for rows in by_worker(events).values():
        now = 0
        for i, _, _, model, queue in rows:
            now = now + 1 if model == "click" else queue or 0
            want[i] = now
    got = {r["event_id"]: r["queue_now"] for r in rg.queue_until_beat(frame, F.col("model") == "click", ["event_id"]).collect()}
    assert got == want


def test_no_events(frame):
    none = frame.where("false")
    assert rg.live_spans(none).count() == 0
    assert rg.admission(none, F.lit(1), ["event_id"]).count() == 0
    assert rg.queue_until_beat(none, F.col("model") == "click", ["event_id"]).count() == 0


def test_window_by_part_only(frame):
    """No window over the events themselves is parted by the worker alone, and the join needs no shuffle of the events again."""
    plan = rg.queue_until_beat(frame, F.col("model") == "click", ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert f"{PART}" in plan and "hashpartitioning(worker" not in plan
