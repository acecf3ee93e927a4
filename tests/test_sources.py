"""Scans, sinks and the stream of workers."""

import json
import zlib
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumiflow.sources import readers as rd
from lumiflow.sources import writers as wr
from lumiflow.streaming.workers import worker_stream


def test_corpora(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps([{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "image": "x.png"}]))
    b.write_text(json.dumps([{"conversations": [{"from": "human", "value": "z"}]}]))
    df = rd.read_corpora(spark, [str(a), str(b)]).withColumn("k", F.monotonically_increasing_id())
    assert sorted(((r["img_path_idx"], r["image"], r["text"]) for r in rd.corpus_turns(df, "k").collect()), key=str) == [(0, "x.png", "q"), (0, "x.png", "r"), (1, None, "z")]
    assert {r["image"] for r in df.collect()} == {"x.png", None}
    folders = spark.createDataFrame([(0, "/f"), (1, "/g")], "img_path_idx int, folder string")
    assert {r["path"] for r in rd.with_image_path(df, folders).collect()} == {"/f/x.png", None}


def test_sliders_fail_on_malformed(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Exposure2012": {"value": 30}}')
    assert rd.read_sliders(spark, str(tmp_path)).first()["params"]["Exposure2012"]["value"] == 30.0
    (tmp_path / "q.json").write_text("{no")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        rd.read_sliders(spark, str(tmp_path)).collect()


def test_files(spark, tmp_path):
    rgb = bytes(range(12))
    images = spark.createDataFrame([("one", 2, 2, bytearray(rgb))], "name string, width int, height int, rgb binary")
    assert wr.write_png(images, str(tmp_path / "png")).first()["name"] == "one.png"
    raw = (tmp_path / "png/one.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    row = rd.read_images(spark, str(tmp_path / "png")).first()
    bgr = bytes(row["bgr"])
    assert bytes(row["rgb"]) == rgb
    assert (row["width"], row["height"]) == (2, 2) and bytes(b for i in range(0, 12, 3) for b in bgr[i : i + 3][::-1]) == rgb
    wr.write_texts(spark.createDataFrame([("t", "é")], "name string, text string"), str(tmp_path / "txt")).collect()
    assert (tmp_path / "txt/t.txt").read_text(encoding="utf-8") == "é"
    with pytest.raises(Exception, match="not a file name"):
        wr.write_texts(spark.createDataFrame([("../t", "x")], "name string, text string"), str(tmp_path / "txt")).collect()
    assert zlib.crc32(raw) and rd.read_binary(spark, str(tmp_path / "png")).first()["length"] == len(raw)


def test_log_is_appended_by_day(spark, tmp_path):
    ev = spark.createDataFrame([(0.5, "chat"), (86400.5, "upvote")], "tstamp double, type string")
    for _ in range(2):
        wr.append_log(ev, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert back.groupBy("day").count().count() == 2 and back.count() == 4


def test_content_is_stored_once(spark):
    items = spark.createDataFrame([("a",), ("a",), ("b",)], "content string")
    stored = spark.createDataFrame([("b",)], "c string").select(F.md5("c").alias("md5"))
    assert [r["content"] for r in wr.new_content(items, stored).collect()] == ["a"]


def test_weights_and_events(spark, tmp_path):
    w = spark.createDataFrame([("a", [1, 2], [0.5, 1.5])], rd.WEIGHTS)
    wr.write_weights(w, str(tmp_path / "w"))
    assert rd.read_weights(spark, str(tmp_path / "w")).collect() == w.collect()
    (tmp_path / "e.json").write_text('{"event": "register", "worker": "w", "model_names": ["m"], "speed": 1}')
    row = rd.read_events(spark, str(tmp_path / "e.json")).first()
    assert row["model_names"] == ["m"] and row["ts"] is None
    assert rd.read_events(spark, str(tmp_path), streaming=True).isStreaming


def test_fallback_repeats_the_first_record(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True)], "k long, v string, bad boolean")
    assert sorted((r["asked"], r["v"]) for r in rd.with_fallback(df, "bad", "k").collect()) == [(1, "a"), (2, "a")]


def test_worker_stream_answers_and_removes(spark, tmp_path):
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    steps = [[("w", "heartbeat", 1, 0)], [("w", "register", 2, 1), ("w", "heartbeat", 3, 2)], [("x", "register", 0, 300)], [("x", "heartbeat", 0, 600)]]
    src = tmp_path / "in"
    src.mkdir()
    df = spark.readStream.schema("worker string, event string, queue_length int, check_heart_beat boolean, ts timestamp").json(str(src))
    q = worker_stream(df).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(steps):
            (src / f"{i}.json").write_text("\n".join(json.dumps({"worker": w, "event": e, "queue_length": n, "check_heart_beat": w == "w", "ts": (t0 + timedelta(seconds=s)).isoformat()}) for w, e, n, s in rows))
            q.processAllAvailable()
        got = {(r["worker"], r["event"], r["exist"], r["queue_length"]) for r in spark.table("answers").collect()}
    finally:
        q.stop()
    assert ("w", "heartbeat", False, None) in got  # unknown before it registers
    assert ("w", "heartbeat", True, 3) in got and ("w", "removed", False, 3) in got
    assert not any(w == "x" and e == "removed" for w, e, _, _ in got)  # unchecked workers stay


def test_a_late_beat_does_not_set_the_clock_back(spark, tmp_path):
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    # the second batch has a beat older than the first one's, within the watermark
    steps = [[("w", "register", 1, 100)], [("w", "heartbeat", 2, 50)], [("x", "register", 0, 185)], [("x", "heartbeat", 0, 189)], [("x", "heartbeat", 0, 300)], [("x", "heartbeat", 0, 400)]]
    src = tmp_path / "in"
    src.mkdir()
    df = spark.readStream.schema("worker string, event string, queue_length int, check_heart_beat boolean, ts timestamp").json(str(src))
    q = worker_stream(df).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(steps):
            (src / f"{i}.json").write_text("\n".join(json.dumps({"worker": w, "event": e, "queue_length": n, "check_heart_beat": w == "w", "ts": (t0 + timedelta(seconds=s)).isoformat()}) for w, e, n, s in rows))
            q.processAllAvailable()
        got = [(r["event"], r["queue_length"], r["last_beat_ms"]) for r in spark.table("late").where("worker = 'w'").collect()]
    finally:
        q.stop()
    at = int(t0.timestamp() * 1000) + 100_000
    assert got == [("register", 1, at), ("heartbeat", 2, at), ("removed", 2, at)]
