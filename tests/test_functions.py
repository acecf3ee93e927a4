"""Scalar rules against Python's own."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumiflow.functions import geometry as g
from lumiflow.functions import templates as tp
from lumiflow.functions import text as tx
from lumiflow.operators import params as pm
from lumiflow.operators import registry as rg

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def _column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr).collect()]


def test_white_space(spark):
    words = [f"{s}a{s}{s}b c{s}" for s in SPACES] + ["", " ", "one"]
    assert _column(spark, words, tx.word_count(F.col("x"))) == [len(w.split()) for w in words]
    assert _column(spark, words, tx.strip(F.col("x"))) == [w.strip() for w in words]


def test_strip_left_takes_characters(spark):
    words = ["<s><s>x", "s<>x", "x<s>", ""]
    assert _column(spark, words, tx.strip_left(F.col("x"), "<s>")) == [w.lstrip("<s>") for w in words]


def test_whole_sliders_round_as_python(spark):
    values = [float(v) for v in range(-100, 101)]
    assert _column(spark, values, pm.scaled(F.col("x")), "double") == [round(v / 100.0, 3) for v in values]
    assert [x if x != "-0.0" else "0.0" for x in _column(spark, values, tx.python_float(pm.scaled(F.col("x"))), "double")] == [str(round(v / 100.0, 3) + 0.0) for v in values]


def test_golden_slider_document(spark):
    doc = {"Exposure2012": {"value": 30.0}, "IncrementalTemperature": {"value": -40.0}, "Saturation": {"value": 30.0}, "Other": {"value": 9.0}}
    row = spark.range(1).select(F.from_json(F.lit(json.dumps(doc)), pm.DOCUMENT).alias("p")).select(pm.control_mask(F.col("p")).alias("mask"), pm.param_prompt(F.col("p")).alias("prompt")).first()
    assert row["mask"] == [1.0, 1.0, 0.0]
    printed = eval(row["prompt"].split("Instruction: ")[1])  # a dict as Python prints it
    assert printed["Light Adjustment"]["Exposure2012"] == 0.3 and printed["Color and Temperature Adjustment"]["IncrementalTemperature"] == -0.4 and len(printed["Specific Color Adjustment"]) == 24


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 5000))
def test_fit_is_inside(spark, w, h):
    row = spark.range(1).select(*(c.alias(n) for n, c in g.fit(F.lit(w), F.lit(h), F.lit(672), F.lit(336)).items())).first()
    assert 0 < row["new_w"] <= 672 and 0 < row["new_h"] <= 336
    assert 0 <= row["paste_x"] and row["paste_x"] + row["new_w"] <= 672 and row["paste_y"] + row["new_h"] <= 336


def test_tiles_cover(spark):
    rows = spark.range(1).select(F.inline(g.tiles(F.lit(700), F.lit(300), 336))).collect()
    assert [(r["x0"], r["y0"]) for r in rows] == [(0, 0), (336, 0), (672, 0)] and rows[-1]["x1"] == 1008


def test_half_bytes_round_to_even(spark):
    assert _column(spark, [0.5 / 255, 1.5 / 255, 2.5 / 255, -1.0, 2.0], g.to_byte(F.col("x")), "double") == [0, 2, 2, 0, 255]


def test_templates_and_styles():
    assert len(tp.TEMPLATES) == 17
    with pytest.raises(ValueError):
        tp.Template("x", "OTHER", "", ("", ""), "")


def test_booleans_refuse_other_words(spark):
    with pytest.raises(Exception, match="not a boolean"):
        _column(spark, ["maybe"], tx.truth_of(F.col("x")))


def test_user_text_limits(spark):
    got = _column(spark, ["a" * 2000, "<image>b"], rg.user_text(F.col("x"), F.lit(True)))
    assert got == ["a" * 1200 + "\n<image>", "<image>b"]


def test_an_unknown_mode_fails(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from lumiflow.operators import params

    with pytest.raises(PySparkException, match="no such mode"):
        spark.range(1).select(params.checked_mode(F.lit("other"))).collect()


def test_rounded_as_c_does(spark):
    from lumiflow.functions.numbers import rounded_binary

    wanted = {-1e-7: -0.0, 1e-7: 0.0, -0.0: -0.0, -2.5e-7: -0.0, 0.0078125: 0.007813, -0.0078125: -0.007813, 1.0000005: 1.0 if 1.0000005 * 1e6 < 1000000.5 else 1.000001, 1e305: 1e305, float("inf"): float("inf"), 4503599627.370497: 4503599627.370497}
    df = spark.createDataFrame([(v,) for v in wanted] + [(float("nan"),), (None,)], "v double")
    got = [r["r"] for r in df.select(rounded_binary(F.col("v"), 6).alias("r")).collect()]
    assert [repr(g) for g in got] == [*(repr(w) for w in wanted.values()), "nan", "None"]


@pytest.mark.parametrize("name", ["g14_delta_features", "n05_dual_condition", "j06_weight_delta", "k08_delta_round_trip", "a12_channel_pools"])
def test_small_negative_values_are_as_in_sql(spark, tmp_path, name):
    from oracle import connection, difference, pandas_of

    from lumiflow.plans import data_queries, more_queries, system_queries  # noqa: F401
    from lumiflow.plans.catalog import ORACLE, QUERIES

    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.when(i % 3 == 0, -1e-7).otherwise(-2e-7) * (F.col("id") + 1)).cast("float"))
    spark.range(4).select(F.col("id").alias("vec_id"), v.alias("embedding"), F.lit(1).alias("label")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert difference(pandas_of(QUERIES[name](spark, str(tmp_path))), connection(str(tmp_path)).execute(ORACLE[name]).df()) == ""


def test_best_by_join_ranks_bounded_parts_without_a_sort(spark, tmp_path, monkeypatch):
    from oracle import connection, difference, pandas_of

    from lumiflow.plans import data_queries
    from lumiflow.plans.catalog import ORACLE, QUERIES

    monkeypatch.setattr(data_queries, "PARTS_A_TASK", 100)
    keys = spark.range(1, 1000).select(F.col("id").alias("p_partkey"))
    keys.union(keys.limit(5)).union(spark.sql("select cast(null as bigint)")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["j03_best_by_join"](spark, str(tmp_path))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert difference(pandas_of(got), connection(str(tmp_path)).execute(ORACLE["j03_best_by_join"]).df()) == ""
    assert got.rdd.getNumPartitions() == 11
