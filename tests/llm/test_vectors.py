import math

import numpy as np
import pytest

from lumiflow.llm import vector_dedup as vd

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("f1", "f2", "u", "id", "p", "q", "links", "copies", "near")})


def reference(rows, cosine=0.98):
    """Sorted (vec_id, n_links, component_id, kept) by comparing all rows of a label."""

    def unit(i, v, label):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float32).astype(float)
        x = x / np.abs(x).max()
        return x / np.sqrt(x @ x)

    units = [unit(*r) for r in rows]
    n, parent = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= cosine:
                n[a] += 1
                n[b] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted(((r[0], n[i], None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for i, r in enumerate(rows)), key=repr)


def results(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def planted(seed, groups=20, copies=12, alone=600, width=64):
    """Groups about a centre whose members' cosines lie on both sides of the limit, exact copies, and vectors that are alone."""
    rng = np.random.default_rng(seed)
    vectors = [rng.normal(size=width) for _ in range(alone)]
    for _ in range(groups):
        c = rng.normal(size=width)
        vectors += [c + rng.normal(size=width) * rng.uniform(0.02, 0.16) for _ in range(copies)]
        vectors += [vectors[-1]] * 3 + [2 * vectors[-1]]
    order = rng.permutation(len(vectors))
    return [(int(k), [float(x) for x in vectors[i].astype(np.float32)], int(k) % 3 if i < alone else int(i) // 40 % 3) for k, i in enumerate(order)]


@pytest.mark.parametrize("block", [2000, 5])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vd, "BLOCK", block)
    rows = planted(1)
    got, want = results(vd.near_vectors(table(spark, rows))), reference(rows)
    links, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert 0.995 * links <= found <= links and links > 1000
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # none below the limit
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.99 * len(want)


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """A group that holds a third of all rows, dealt into blocks; every link is found, though no pair is listed."""
    monkeypatch.setattr(vd, "BLOCK", 50)
    rng = np.random.default_rng(3)
    c = rng.normal(size=64)
    rows = [(i, (c + rng.normal(size=64) * 0.05).tolist() if i % 3 == 0 else rng.normal(size=64).tolist(), 1) for i in range(900)]
    got = results(vd.near_vectors(table(spark, rows)))
    assert got == reference([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert sum(r[1] for r in got) == 300 * 299


def test_odd_cases(spark):
    inf, nan = float("inf"), float("nan")
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, v, 1), (2, w, 1), (3, w, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 3.0], 1), (9, [1.0, inf, 3.0], 1), (10, [1.0, None, 3.0], 1)]
    rows += [(11, v, 1), (11, v, 1), (11, [-3.0, 1.0, 0.5], 1), (12, [-3.0, 1.0, 0.51], 1), (None, v, 1), (13, [-0.0, 1.0, 0.0], 3), (14, [0.0, 1.0, 0.0], 3), (15, [1.0, 2.0], 1), (16, [2e38, 2e38, 1e38], 4), (17, [1e-40, 1e-40, 5e-41], 4), (18, [3.0] * 5000, 4)]
    assert results(vd.near_vectors(table(spark, rows))) == reference(rows)
    assert vd.near_vectors(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(TypeError):
        vd.near_vectors(table(spark, rows).selectExpr("cast(vec_id as string) as vec_id", "embedding", "label"))


def test_one_row_of_each_group_stays(spark):
    rows = [(3, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]
    kept = vd.without_near_vectors(table(spark, rows))
    assert sorted(r["vec_id"] or 0 for r in kept.collect()) == [0, 1, 2] and "near" in kept.columns


def test_pivots_lie_apart():
    rng = np.random.default_rng(2)
    c = rng.normal(size=16)
    sample = [(c + rng.normal(size=16) * 0.01).tolist() for _ in range(500)] + rng.normal(size=(100, 16)).tolist()
    p = vd.choose_pivots(sample)[16]
    inner = p @ p.T - np.eye(len(p))
    assert len(p) >= vd.LEAST and inner.max() < vd.APART
