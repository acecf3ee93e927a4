"""Permutations, balanced chunks and modality sections."""

import random

from pyspark.sql import functions as F

from lumiflow.operators import batching as bt


def test_position_is_a_permutation(spark):
    rows = bt.shuffled(spark.range(500).withColumnRenamed("id", "k"), "k").collect()
    assert sorted(r["pos"] for r in rows) == list(range(500))


def test_global_position_of_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["pos"] == r["x"] for r in bt.global_position(df, ["x"]).collect())


def test_even_chunks_hold_equal_counts_and_go_to_the_lightest(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(1, 99))) for i in range(24)]
    df = bt.megabatches(spark.createDataFrame(rows, "k long, length double"), 8, "k")
    got = bt.even_chunks(df, 4, "k").collect()
    by = {r["k"]: r for r in df.collect()}
    for m in range(3):
        mine = [r for r in got if r["megabatch"] == m]
        assert sorted([r["chunk"] for r in mine]) == [c for c in range(4) for _ in range(2)]
        load = dict.fromkeys(range(4), 0.0)
        for r in sorted(mine, key=lambda r: by[r["k"]]["rank"]):
            open_ = [c for c in load if load[c] != float("inf")]
            assert r["chunk"] == min(open_, key=lambda c: (load[c], c))
            load[r["chunk"]] += by[r["k"]]["length"]
            if r["place"] == 1:
                load[r["chunk"]] = float("inf")


def test_tails_of_both_modalities_are_merged(spark):
    df = spark.createDataFrame([(i, 5 if i < 16 else -5) for i in range(27)], "k long, modality_length long")
    got = bt.modality_order(df, 8, 2, "k").collect()
    assert len(got) == 27
    # the last megabatch of images is full and goes to the tail all the same
    assert sum(r["section"] == "tail" for r in got) == 8 + 3


def test_one_modality_has_no_tail(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "k long, modality_length long")
    assert {r["section"] for r in bt.modality_order(df, 4, 2, "k").collect()} == {"image"}
