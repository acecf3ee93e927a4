"""Low-rank and 8-bit weights, blockwise attention, decoding, pictures, kernels, exact rounding."""

import base64
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiflow.operators import attention as at
from lumiflow.operators import batching as bt
from lumiflow.operators import convolution as cv
from lumiflow.operators import decoding as dc
from lumiflow.operators import lowrank as lr
from lumiflow.operators import params as pm
from lumiflow.operators import render as rn
from lumiflow.operators import weights as wt
from lumiflow.sources import icc, png


def matrix(spark, **named):
    return spark.createDataFrame([(n, i, [float(x) for x in row]) for n, m in named.items() for i, row in enumerate(m)], "name string, row long, values array<double>")


@pytest.mark.parametrize("inner, rows", [(1, 1), (3, 4), (256, 4096)])
def test_block_product(spark, inner, rows):
    rng = np.random.default_rng(0)
    b, a = {"p": rng.normal(size=(11, 7)), "q": rng.normal(size=(5, 2))}, {"p": rng.normal(size=(7, 9)), "q": rng.normal(size=(2, 4))}
    base = {"p": rng.normal(size=(11, 9)), "q": rng.normal(size=(5, 3)), "r": rng.normal(size=(2, 2))}
    got = {(r["name"], r["row"]): r for r in lr.lora_merged(matrix(spark, **base), matrix(spark, **b), matrix(spark, **a), 0.5, inner, rows).collect()}
    assert len(got) == 18
    for i in range(11):
        assert np.allclose(got["p", i]["values"], (base["p"] + 0.5 * b["p"] @ a["p"])[i])
    assert got["q", 0]["problem"] == "dimension mismatch" and got["q", 0]["values"] is None
    assert got["r", 1]["values"] == base["r"][1].tolist()  # no update


def test_inner_rows_that_lack_count_as_zeros(spark):
    b, a = np.ones((2, 5)), np.arange(10.0).reshape(5, 2)
    gone = matrix(spark, p=a).where("row <> 3")
    got = {r["row"]: r["values"] for r in lr.block_product(matrix(spark, p=b), gone, 2, 1).collect()}
    assert got == {i: [0 + 2 + 4 + 8.0, 1 + 3 + 5 + 9.0] for i in range(2)}


def test_8bit_round_trip_is_bounded(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = {"a": rng.normal(size=(20, 130)) * 10.0 ** rng.integers(-6, 6, size=(20, 1)), "zero": np.zeros((1, 70)), "odd": [[]]}
    lr.write_8bit(matrix(spark, **m), str(tmp_path / "w"))
    got = {(r["name"], r["row"]): r for r in lr.read_8bit(spark, str(tmp_path / "w")).collect()}
    assert got["odd", 0]["values"] == [] and set(got["zero", 0]["values"]) == {0.0}
    for i, row in enumerate(m["a"]):
        for k in range(0, 130, 64):
            part = row[k : k + 64]
            assert np.abs(np.array(got["a", i]["values"][k : k + 64]) - part).max() <= np.abs(part).max() / 254 * (1 + 1e-9)
            assert max(map(abs, got["a", i]["codes"][k : k + 64])) == 127


@pytest.mark.parametrize("block", [3, 2048])
@pytest.mark.parametrize("scale", [0.3, 700.0])
def test_attention_in_blocks(spark, block, scale):
    rng = np.random.default_rng(2)
    q, k, v = rng.normal(size=(13, 4)), rng.normal(size=(29, 4)), rng.normal(size=(29, 6))
    q, k = q / np.linalg.norm(q, axis=1, keepdims=True), k / np.linalg.norm(k, axis=1, keepdims=True)
    group = lambda i: i % 2
    queries = spark.createDataFrame([(group(i), i, x.tolist()) for i, x in enumerate(q)] + [(9, 99, [1.0] * 4)], "grp int, qid long, q array<double>")
    keys = spark.createDataFrame([(group(i), i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(k, v, strict=True))] + [(None, 77, [1.0] * 4, [1.0] * 6)], "grp int, kid long, k array<double>, v array<double>")
    got = {r["qid"]: r["out"] for r in at.block_attention(queries, keys, scale, block).collect()}
    assert set(got) == set(range(13))  # a group without keys has no row
    for i in range(13):
        s = k[group(i) :: 2] @ q[i] * scale
        w = np.exp(s - s.max())
        assert np.allclose(got[i], w @ v[group(i) :: 2] / w.sum())


@pytest.mark.parametrize("part", [4, 11, 2048])
def test_states_of_small_blocks_are_merged_where_they_are_made(spark, part):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(0, i, x.tolist(), x.tolist()) for i, x in enumerate(v)], "grp int, kid long, k array<double>, v array<double>")
    queries = rows.select("grp", F.col("kid").alias("qid"), F.col("k").alias("q"))
    assert at.attention_states(queries, rows, 700.0, 2, part).groupBy("qid").count().agg(F.max("count")).first()[0] <= -(-60 // part)
    got = {r["qid"]: r["out"] for r in at.block_attention(queries, rows, 700.0, 2, part).collect()}
    for i in range(60):
        s = v @ v[i] * 700.0
        w = np.exp(s - s.max())
        assert np.allclose(got[i], w @ v / w.sum())


LOGITS = [("a", "x", 2.0), ("a", "y", 2.0), ("a", "z", 0.0), ("b", "x", -700.0), ("b", "y", 700.0), ("x", ".", 1.0), ("y", "a", 1.0)]


def logits(spark):
    return spark.createDataFrame(LOGITS, "context string, token string, logit double")


def test_pairs_of_characters_in_long_texts(spark):
    """Each place was once found by walking from the start of the text, which took minutes here."""
    import time
    from collections import Counter

    text = "aé漢😀b c" * 60_000
    df = spark.createDataFrame([(text,), ("x",), ("",), (None,), ("ab",)], "text string")
    began = time.perf_counter()
    got = {(r["context"], r["token"]): round(math.exp(r["logit"])) for r in dc.bigram_logits(df, "text").collect()}
    assert time.perf_counter() - began < 30
    assert got == Counter(zip(text, text[1:], strict=False)) + Counter([("a", "b")])


def test_nucleus_edges(spark):
    kept = lambda t, p: {(r["context"], r["token"]): r["p"] for r in dc.nucleus(logits(spark), t, p).collect()}
    assert kept(0, 0.9) == {("a", "x"): 1.0, ("b", "y"): 1.0, ("x", "."): 1.0, ("y", "a"): 1.0}  # ties: the smallest token
    assert set(kept(1.0, 1e-9)) == set(kept(0, 1.0))  # one token at least
    both = kept(1.0, 0.6)
    assert both["a", "x"] == both["a", "y"] == 0.5 and ("a", "z") not in both and ("b", "x") not in both
    everything = kept(1.0, 1.1)
    assert len(everything) == 7 and math.isclose(everything["a", "z"], 1 / (1 + 2 * math.exp(2)))
    assert kept(0.01, 1.1)["a", "z"] < 1e-80


def test_draws_follow_the_probabilities(spark):
    asked = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit("a").alias("context"))
    kept = dc.nucleus(logits(spark), 1.0, 1.1)
    drawn = {r["token"]: r["n"] for r in dc.drawn(asked, kept, 3).groupBy("token").agg(F.count("*").alias("n")).collect()}
    p = {r["token"]: r["p"] for r in kept.where("context = 'a'").collect()}
    assert sum(drawn.values()) == 20_000 and all(abs(drawn[t] / 20_000 - p[t]) < 0.015 for t in p)
    first = dc.drawn(asked, kept, 3).orderBy("key").limit(50).collect()
    assert first == dc.drawn(asked, kept, 3).orderBy("key").limit(50).collect() != dc.drawn(asked, kept, 4).orderBy("key").limit(50).collect()


def test_beams_equal_all_sequences(spark):
    rng = random.Random(4)
    table = [(c, t, rng.uniform(-3, 3)) for c in "abcd" for t in "abcd." if rng.random() < 0.8]
    steps = dc.log_steps(spark.createDataFrame(table, "context string, token string, logit double"))
    cost = {(r["context"], r["token"]): r["step"] for r in steps.collect()}

    def follow(start):
        at_, width = [(0, start)], 4
        for _ in range(4):
            moved = [(s + v, q + t) for s, q in at_ if q[-1] != "." for (c, t), v in cost.items() if c == q[-1]] + [(s, q) for s, q in at_ if q[-1] == "."]
            at_ = sorted(moved, key=lambda x: (-x[0], x[1]))[:width]
        return [(q, s) for s, q in at_]

    starts = spark.createDataFrame([(c, c) for c in "abcd"], "start string, context string")
    got = dc.beams(starts, steps, 4, 4, ".").orderBy("start", "rank").collect()
    for c in "abcd":
        assert [(r["sequence"], r["score"]) for r in got if r["start"] == c] == follow(c)


def test_png_round_trip(spark):
    rng = np.random.default_rng(3)
    smooth = np.add.outer(np.arange(9), np.arange(14))[:, :, None] * np.array([3, 5, 7]) % 256
    for channels in (1, 2, 3, 4):
        for pixels in (rng.integers(0, 256, size=(9, 14, channels)), np.resize(smooth, (9, 14, channels))):
            pixels = pixels.astype(np.uint8)
            want = np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]
            for filters in ((0,), (1,), (2,), (3,), (4,), (4, 2, 0, 3, 1)):
                assert (png.decode(png.encode(pixels, filters)) == want).all()
    table = bytes(range(30))
    index = rng.integers(0, 10, size=(3, 5, 1)).astype(np.uint8)
    assert (png.decode(png.encode(index, (1,), table)) == np.frombuffer(table, np.uint8).reshape(-1, 3)[index[:, :, 0]]).all()


def test_png_agrees_with_sparks_reader_and_fails_on_damage(spark, tmp_path):
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, size=(6, 8, 3)).astype(np.uint8)
    data = png.encode(pixels, (0, 1, 2, 3, 4))
    (tmp_path / "p.png").write_bytes(data)
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (np.frombuffer(bytes(row["data"]), np.uint8).reshape(6, 8, 3)[:, :, ::-1] == pixels).all()
    damaged = data[:60] + bytes([data[60] ^ 1]) + data[61:]
    rows = spark.createDataFrame([("good", base64.b64encode(data).decode()), ("bad", base64.b64encode(damaged).decode()), ("text", base64.b64encode(b"no").decode()), ("null", None)], "name string, content string")
    got = {r["name"]: r["rgb"] for r in png.decoded(rows, strict=False).collect()}
    assert bytes(got["good"]) == pixels.tobytes() and got["bad"] is got["text"] is got["null"] is None
    with pytest.raises(Exception, match="checksum"):
        png.decoded(rows.where("name = 'bad'")).collect()


def test_stencil_is_the_same_for_any_tile(spark):
    rng = np.random.default_rng(6)
    v, kernel = rng.normal(size=(11, 17, 2)), rng.normal(size=(2, 7, 7))
    padded = np.pad(v, ((3, 3), (3, 3), (0, 0)))
    want = sum(padded[dy : dy + 11, dx : dx + 17] @ kernel[:, dy, dx] for dy in range(7) for dx in range(7))
    maps = spark.createDataFrame([(1, y, x, v[y, x].tolist()) for y in range(11) for x in range(17)] + [(2, 0, 0, [1.0, 2.0])], "image long, y long, x long, planes array<double>")
    for tile in (1, 2, 5, 8, 32):
        got = {(r["image"], r["y"], r["x"]): r["s"] for r in cv.stencil(maps, kernel, tile).collect()}
        assert len(got) == 11 * 17 + 1
        assert all(math.isclose(got[1, y, x], want[y, x], abs_tol=1e-9) for y in range(11) for x in range(17))
        assert math.isclose(got[2, 0, 0], kernel[0, 3, 3] + 2 * kernel[1, 3, 3])


def test_spatial_attention_in_one_pass_over_sorted_tiles(spark):
    """Tiles end anywhere in a batch; pixels are not joined to their windows, and no tile is a call of its own."""
    rng = np.random.default_rng(8)
    pictures, kernel = {i: rng.normal(size=(h, w, 3)) for i, (h, w) in enumerate(((11, 17), (1, 1), (23, 8)))}, rng.normal(size=(2, 7, 7))
    rows = [(i, y, x, v[y, x].tolist()) for i, v in pictures.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    pixels = spark.createDataFrame(rows, "image int, y long, x long, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = cv.spatial_attention(pixels, kernel, 5)
        got = {(r["image"], r["y"], r["x"]): r["v"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan
    assert len(got) == len(rows)
    for i, v in pictures.items():
        padded = np.pad(np.stack([v.mean(axis=2), v.max(axis=2)]), ((0, 0), (3, 3), (3, 3)))
        s = sum(np.tensordot(kernel[:, dy, dx], padded[:, dy : dy + v.shape[0], dx : dx + v.shape[1]], axes=1) for dy in range(7) for dx in range(7))
        assert all(np.allclose(got[i, y, x], v[y, x] / (1 + np.exp(-s[y, x]))) for y in range(v.shape[0]) for x in range(v.shape[1]))


def test_pixels_of_pictures_larger_than_a_batch(spark):
    """Each pixel once walked through its whole picture in hexadecimal digits."""
    rng = np.random.default_rng(9)
    pictures = {"large": rng.integers(0, 256, size=(300, 500, 3)).astype(np.uint8), "small": rng.integers(0, 256, size=(2, 3, 3)).astype(np.uint8)}
    rows = spark.createDataFrame([(n, n + "!", p.shape[1], p.shape[0], bytearray(p.tobytes())) for n, p in pictures.items()] + [("null", "", None, None, None)], "name string, more string, width int, height int, rgb binary")
    got = png.pixel_rows(rows, "name", ["more"]).toPandas()
    for n, p in pictures.items():
        own = got[got["name"] == n].sort_values("px")
        assert list(own["px"]) == list(range(p.size // 3)) and set(own["more"]) == {n + "!"}
        assert (np.array(own["rgb"].tolist()) == p.reshape(-1, 3)).all()
    assert len(got) == 150_006


def test_profiles_go_along_with_their_pictures(spark):
    """No join of pictures or pixels with their own profiles."""
    from lumiflow.sources import icc

    own = icc.build(icc.ADOBE, [icc.gamma_tag(1.8)] * 3)
    data = png.encode(np.arange(18, dtype=np.uint8).reshape(2, 3, 3), (4, 3))
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(icc.with_profile(data, own)))], "picture long, content binary")
    found = icc.profiles_of(rows, "picture", keep=["content"])
    pixels = png.pixel_rows(png.decoded(found, "picture", keep=["profile"]), "picture", ["profile"])
    assert "Join" not in pixels._jdf.queryExecution().executedPlan().toString()
    got = pixels.orderBy("picture", "px").collect()
    assert [tuple(r["rgb"]) for r in got] == [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(6)] * 2
    assert {r["picture"]: r["profile"] == "" for r in got} == {1: True, 2: False}


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    values = [rng.randint(-2_000_000, 2_000_000) / 2000 for _ in range(30_000)] + [rng.uniform(-200, 200) for _ in range(30_000)] + [rng.randint(-100_000, 100_000) / 1000 / 100 for _ in range(30_000)] + [(2 * rng.randint(-50_000, 50_000) + 1) / 16 for _ in range(10_000)]
    values += [0.0, -0.0, 0.0005, -0.0005, 0.0015, 2.675, 1e-320, -1e-9, 1e300, -1e15, 2.5e-3, 0.5, 1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3):
        got = [r["r"] for r in df.select(pm.rounded(F.col("v"), digits).alias("r")).collect()]
        wrong = [(v, g) for v, g in zip(values, got, strict=True) if repr(round(v, digits) if digits else float(f"{v:.0f}")) != repr(g)]
        assert wrong == []


def test_layer_norm_at_a_large_mean(spark):
    df = spark.createDataFrame([([1e8 + i for i in range(1, 5)],), ([5.0] * 4,), ([1e8] * 3,)], "x array<double>")
    a, b, c = (r[0] for r in df.select(rn.layer_norm(F.col("x"))).collect())
    assert np.allclose(a, [-1.3416353, -0.4472118, 0.4472118, 1.3416353], atol=1e-6)
    assert set(b) == set(c) == {0.0}


def test_ranges_of_texts_with_a_common_beginning(spark):
    df = spark.range(5000).select(F.format_string("img-%05d", "id").alias("name"), "id")
    ranges = df.withColumn("b", bt.range_of(df, "name")).groupBy("b").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).orderBy("b").collect()
    assert len(ranges) > 500 and max(r["n"] for r in ranges) < 100
    assert all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:], strict=False))
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("k"), "id")).alias("name"), "id").union(spark.sql("select null, 3000L"))
    placed = bt.global_position(hot, ["name", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(3001)) and placed[0]["name"] is None
    assert [(r["name"], r["id"]) for r in placed[1:]] == sorted((r["name"], r["id"]) for r in placed[1:])


@pytest.mark.parametrize("most", [1, 100, 777, 10**9])
def test_shards_hold_all_tensors_in_order(spark, most):
    df = spark.range(50).select(F.format_string("layers.%02d.w", "id").alias("name"), (F.col("id") * 7 % 90 + 1).alias("bytes"))
    rows = sorted((r["name"], r["bytes"], r["file"]) for r in wt.sharded(df, most, F.col("bytes")).collect())
    at_, files = 0, []
    for _, n, file in rows:
        files.append((at_ // most, file))
        at_ += n
    numbers = {s: i for i, s in enumerate(sorted({s for s, _ in files}), 1)}
    assert [f for _, f in files] == [f"model-{numbers[s]:05d}-of-{len(numbers):05d}" for s, _ in files] and len(rows) == 50


def _converted(spark, rgb, profile):
    known = spark.createDataFrame([("p", None if profile is None else bytearray(profile))], "profile string, icc binary")
    pixels = spark.createDataFrame([(i, "p", list(c)) for i, c in enumerate(rgb)], "i long, profile string, rgb array<int>")
    fallback = icc.build(icc.ADOBE, [icc.gamma_tag(icc.ADOBE_GAMMA)] * 3)
    return [tuple(r["rgb"]) for r in icc.to_srgb(pixels, known, fallback).orderBy("i").collect()]


def _para(form, *values):
    import struct

    return b"para\0\0\0\0" + struct.pack(">HH", form, 0) + b"".join(struct.pack(">i", round(v * 65536)) for v in values)


def test_srgb_profiles_change_nothing(spark):
    rng = random.Random(8)
    colours = [(i, i, i) for i in range(256)] + [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)]
    assert _converted(spark, colours, icc.build(icc.SRGB, [_para(3, *icc.SRGB_CURVE)] * 3)) == colours


def test_adobe_profile_and_fallback(spark):
    colours = [(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 255, 0), (128, 128, 128), (200, 100, 50)]
    m = np.linalg.inv(np.array(icc.SRGB)) @ np.array(icc.ADOBE)
    want = []
    for c in colours:
        v = np.clip(m @ (np.array(c) / 255) ** icc.ADOBE_GAMMA, 0, 1)
        want.append(tuple(int(x) for x in np.floor(np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5)))
    assert want[2] == (255, 0, 0) and want[0] == (255, 255, 255) and want[5][0] > 200  # red and orange get stronger
    adobe = icc.build(icc.ADOBE, [icc.gamma_tag(icc.ADOBE_GAMMA)] * 3)
    assert _converted(spark, colours, adobe) == want
    for broken in (None, b"", b"no profile", adobe[:150], adobe.replace(b"acsp", b"xxxx"), adobe.replace(b"gTRC", b"gTRX")):
        assert _converted(spark, colours, broken) == want


def test_curves():
    import struct

    x = np.arange(256) / 255
    table = b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 16384, 65535)
    assert np.allclose(icc.curve(table), np.interp(x, [0, 0.5, 1], [0, 16384 / 65535, 1]))
    assert np.allclose(icc.curve(b"curv\0\0\0\0" + struct.pack(">I", 0)), x)
    assert np.allclose(icc.curve(_para(0, 2.0)), x**2)
    assert np.allclose(icc.curve(_para(1, 2.0, 2.0, -1.0)), np.where(x >= 0.5, (2 * x - 1) ** 2, 0))
    assert np.allclose(icc.curve(_para(4, 2.0, 1.0, 0.0, 0.5, 0.25, 0.125, 0.0625)), np.where(x >= 0.25, x**2 + 0.125, 0.5 * x + 0.0625))
    with pytest.raises(ValueError):
        icc.curve(b"mft2")


def test_wide_renderer_equals_the_narrow_one(spark):
    """Tiles of a picture of 700 pixels, one of 3, one without a latent, conditions of both kinds."""
    rng = np.random.default_rng(4)
    m = lambda r, c: (rng.normal(size=(r, c)).tolist(), rng.normal(size=r).tolist())
    layers, conditions, out = [m(6, 3), m(6, 6)], [("adain", m(12, 5)), ("add", m(6, 5))], m(3, 6)
    latents = {7: rng.normal(size=5).tolist(), 9: rng.normal(size=5).tolist(), 11: [0.0] * 5}
    places = [(7, i) for i in rng.permutation(700).tolist()] + [(9, i) for i in (0, 255, 256)] + [(8, 0)]
    pixels = spark.createDataFrame([(i, p, rng.random(3).tolist()) for i, p in places], "image_id long, px long, rgb array<double>").repartition(5)
    z = spark.createDataFrame(list(latents.items()), "image_id long, z array<double>")
    ks = z.select("image_id", *(rn.linear(rn.relu(F.col("z")), *p).alias(f"k{i}") for i, (_, p) in enumerate(conditions)))
    want = rn.pixel_mlp(pixels.join(ks, "image_id"), layers, out, conditions=[("adain", "k0"), ("add", "k1")])
    want = {(r["image_id"], r["px"]): r["out"] for r in want.collect()}
    rows = rn.wide_renderer(pixels, z, layers, conditions, out).collect()
    assert len(rows) == len(want) == 703
    for r in rows:
        assert np.allclose(r["out"], want[r["image_id"], r["px"]], atol=1e-12)
    assert rn.wide_renderer(pixels.where("false"), z, layers, conditions, out).count() == 0
    with pytest.raises(ValueError, match="add or adain"):
        rn.wide_renderer(pixels, z, layers, [("cat", m(6, 5)), conditions[1]], out)


def test_storages_are_counted_once_a_module(spark):
    rows = [("b", "x", 10), ("b", "x", 10), ("b", "y", 4), ("a", "x", 10), ("c", None, 3), ("c", None, 3)]
    got = wt.skipped_parameters(spark.createDataFrame(rows, "module string, storage string, values int")).orderBy("module").collect()
    assert [tuple(r) for r in got] == [("a", 10, 10), ("b", 14, 24), ("c", 3, 27)]


def test_decoded_text(spark):
    """A frequent id, unknown and special ones, nothing at all, a null key."""
    rows = [(1, [5] * 300 + [6]), (2, [900, 6, 77, 5, 901]), (3, []), (4, None), (None, [7, 5, 7])]
    words = spark.createDataFrame([(5, " a"), (6, "b "), (7, "\n")], "id int, piece string")
    got = dc.decoded_text(spark.createDataFrame(rows, "k int, ids array<int>"), words, [900, 901], ["k"]).collect()
    assert {r["k"]: r["text"] for r in got} == {1: (" a" * 300 + "b").strip(), 2: "b  a", 3: "", 4: "", None: "a"} and len(got) == 5
