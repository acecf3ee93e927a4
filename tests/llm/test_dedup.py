import random

import numpy as np
import pytest
from cases import docs, empty, spaced

from pyspark.sql import functions as F

from lumiflow.llm import components as cc
from lumiflow.llm import dedup


def brute(rows, k):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = spaced(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=6, copies=14, words=60):
    """Groups about a base text whose copies differ enough to lie on both sides of the limit."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 10_000))
            rows.append((len(rows), " ".join(w)))
    return rows


def run(spark, rows, k):
    d = docs(spark, [(i, t, None) for i, t in rows])
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(d, k=k).collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(spark, k):
    rows = near_copies(k)
    assert run(spark, rows, k) == brute(rows, k)


def test_prefix_join_alone_finds_all_links(spark):
    rows = near_copies(9, groups=3, copies=20)
    d = docs(spark, [(i, t, None) for i, t in rows]).select("doc_id", F.lit(0).cast("long").alias("th"), "text")
    members = dedup._packed(d).select(F.col("doc_id").alias("rep"), "th", F.col("doc_id").alias("label"), "z")
    found = {(r["a"], r["b"]) for r in dedup.prefix_pairs(members, 2, 80).collect()}
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= found and len(found) < len(rows) * (len(rows) - 1) / 2


def test_rows_that_share_an_id_are_linked(spark):
    base = ["w%d" % i for i in range(60)]
    other = ["v%d" % i for i in range(60)]
    near = lambda w: " ".join([*w[:30], "x", *w[31:]])
    rows = [(1, " ".join(base)), (5, near(base)), (5, " ".join(other)), (9, near(other)), (2, "a b c"), (7, "a b c"), (7, "d e f"), (3, "d e f")]
    got = dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2, 3: 2}
    with pytest.raises(TypeError):
        dedup.near_duplicates(docs(spark).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_superminhash_has_less_error_than_minhash():
    """Mean squared error of the estimate at Jaccard 1/2, against that of independent slots."""
    rng = np.random.default_rng(3)
    error = []
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        text = np.repeat([0, 1], 80)
        sig = dedup.superminhash(np.concatenate([h[:80], h[40:]]), text, 2)
        error.append((sig[0] == sig[1]).mean() - 40 / 120)
    plain = 1 / 3 * 2 / 3 / dedup.SLOTS
    assert abs(np.mean(error)) < 0.006 and np.mean(np.square(error)) < 0.8 * plain


def test_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    got = dedup.near_duplicates(d, k=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, 2)
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_odd_cases(spark):
    got = dedup.near_duplicates(docs(spark), k=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 12 and by[1][0]["component_id"] == 1 and by[2][0]["n_shingles"] == 0
    assert by[5][0]["component_id"] == 4 and not by[5][0]["kept"] and by[4][0]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in by[None])
    kept = dedup.without_near_duplicates(docs(spark), k=2)
    assert kept.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "9", "None", "None"])
    twice = dedup.without_near_duplicates(docs(spark, [(4, "one two three four five six", "x")] * 3 + [(9, None, "x")]), k=5)
    assert sorted(r["doc_id"] for r in twice.collect()) == [4, 9]
    assert dedup.near_duplicates(empty(spark)).count() == 0 and dedup.without_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("held", [50, 200_000])
def test_components_of_paths_and_stars(spark, monkeypatch, held):
    monkeypatch.setattr(cc, "PARTITION_LINKS", held)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200) if i % 40 != 39] + [(1000, i) for i in range(1001, 1100)]
    rng.shuffle(links)
    got = {r["vertex"]: r["component"] for r in cc.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == i // 40 * 40 for i in range(200)) and all(got[i] == 1000 for i in range(1000, 1100))


def test_postings_of_one_component_are_not_joined_with_each_other(spark):
    """One large component and three stragglers: joined rows grow with the members, not with their square."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]

    def joined(size):
        rows = []
        for i in range(size + 3):
            w = list(base)
            for j in rng.sample(range(80), 3 if i < size else 16):
                w[j] = f"x{i}_{j}"
            rows.append((i, 0, 0 if i < size else i, len(w) - 1, " ".join(w)))
        d = spark.createDataFrame([(i, t) for i, _, _, _, t in rows], "doc_id long, text string").withColumn("th", F.lit(0).cast("long"))
        labels = F.when(F.col("doc_id") < size, F.lit(0)).otherwise(F.col("doc_id")).cast("long")
        members = dedup._packed(d.select("doc_id", "th", "text")).select(F.col("doc_id").alias("rep"), "th", labels.alias("label"), "z")
        tokens = dedup._shingles(members, 2).select("token", "rep", "label", "n", F.lit(99).alias("least"), F.lit(1).alias("place"))
        few, every = dedup.sides(dedup.stored(tokens))
        return few.join(every, "token").count()

    small, large = joined(100), joined(400)
    assert 0 < small and large < small * 4**1.1
