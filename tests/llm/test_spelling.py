import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from cases import LOWER, ROWS, docs, empty

from lumiflow.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def reference(rows):
    """word -> (n, n_near, form, form_n, root) by comparing all pairs."""
    counts = collections.Counter()
    for i, t, _ in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def variants(seed=1):
    """Texts whose words have misspellings, chains of forms, words with letters beyond ASCII and of any length."""
    rng = random.Random(seed)
    letters = "abcdeéÀ×ÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12, 13, 24, 25, 60, 200]))) for _ in range(40)]
    said = []
    for w in bases:
        said += [w] * rng.choice([2, 30, 400])
        for _ in range(8):
            v, i = w, rng.randrange(len(w))
            for _ in range(rng.choice([1, 1, 2])):
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + rng.choice(letters) + v[i:], v[:i] + rng.choice(letters) + v[i + 1 :]])
            said += [v] * rng.choice([1, 2, 3, 25])
    said += ["stepsize"] * 2000 + ["stepsizes"] * 150 + ["stepsizesx"] * 12 + ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 40 + ["aaaaaaaaa"] * 3
    rng.shuffle(said)
    return [(k, " ".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in said[k * 50 : k * 50 + 50]), "en") for k in range(len(said) // 50 + 1)]


def results(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_brute_force(spark):
    rows = variants()
    want = reference(rows)
    assert results(sp.spelling_variants(docs(spark, rows))) == want
    assert any(v[4] not in (w, v[2]) for w, v in want.items() if v[2])  # a chain of two forms at least


def test_odd_cases(spark):
    # repeated rows, null ids and texts, a text of one run, words of exactly seven letters, a run cut by a text's end
    rows = [*ROWS, (20, "abcdefg abcdefg", "en"), (20, "abcdefg", "en"), (21, "abcdefg", None), (22, "h abcdefgh-abcdefgh", "en"), (None, "zzzzzzzé ZZZZZZZé", "en"), (23, "y" * 3_000, "en"), (24, "y" * 3_000, "en"), (25, "y" * 2_999 + " " + "y" * 2_999, "en")]
    assert results(sp.spelling_variants(docs(spark, rows))) == reference(rows)


def test_empty(spark):
    assert sp.spelling_variants(empty(spark)).count() == 0


def test_hashes_equal_those_of_whole_keys():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(n)).encode() for n in [1, 2, 7, 30, 31, 32, 33, 60, 64, 65, 200] * 3]
    prefixes = [f"{i}:".encode() for i in (0, 7, 123456789, -5)]
    text, word = np.array([k % 4 for k in range(len(words))]), np.arange(len(words))
    got = sp.hashes(np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32), text, np.array([len(w) for w in words]), words, word)
    assert got.tolist() == [zlib.crc32(prefixes[t] + w) for t, w in zip(text, words, strict=True)]


def test_runs_stop_at_texts_and_other_letters():
    data, start, end, length, text = sp.runs(pa.array(["abcé", "éfgh", None, "abācd", "Àÿ×", "日本é"]))
    got = [(bytes(data[s:e]).decode(), n, t) for s, e, n, t in zip(start, end, length, text, strict=True)]
    assert got == [("abcé", 4, 0), ("éfgh", 4, 1), ("ab", 2, 3), ("cd", 2, 3), ("Àÿ×", 3, 4), ("é", 1, 5)]


def test_candidates_of_a_word_are_bounded(spark):
    """Words that share a half don't all meet: only those that share all but a gap."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = sorted({"inter" + "".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)})
    d = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    keys = d.select(F.explode(sp._keys(F.length("word"), 0)).alias("key")).groupBy("key").count()
    assert keys.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 40 * len(words)
    got = {(r["a"], r["b"]) for r in sp.near_pairs(d).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
