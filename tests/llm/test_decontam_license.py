import hashlib
import re

import pytest
from cases import ALNUM, ROWS, alnum, docs, empty

from lumiflow.llm import decontam, license_scan


def brute(docs_, items, width=10):
    windows = {}
    for i, t in items:
        w = alnum(t)
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add("null" if i is None else str(i))
    out = {}
    for d, t in docs_:
        w = alnum(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                x = windows.get(tuple(w[a : a + k]))
                if x:
                    hit |= set(range(a, a + k))
                    found |= x
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def _got(frame):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in frame.collect()}


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_table(spark, sf, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "HELD_BYTES", 20 * block)
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert _got(decontam.contamination_report(d, b)) == want
    kept = decontam.without_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in want.items() if not v[4]}


ITEMS = [(1, "quick brown"), (2, "QUICK,brown"), (2, "quick brown"), (None, "lazy"), (3, None), (4, " .. "), (5, "de de de"), (6, "the quick brown fox jumps over the lazy dog and runs away"), (7, "é")]


def test_odd_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [*[r for r in ROWS if r[0] is not None], (20, "de de de de", "x"), (21, "lazy", "x"), (22, "quick", "x"), (23, "a quick", "x"), (24, "brown b", "x")]
    assert _got(decontam.contamination_report(docs(spark, rows), items)) == brute([(i, t) for i, t, _ in rows], ITEMS)
    assert decontam.contamination_report(docs(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination_report(empty(spark), items).count() == 0
    assert decontam.contamination_report(docs(spark), items).count() == len(ROWS)
    assert decontam.without_contaminated(docs(spark), items).columns == docs(spark).columns


def brute_license(text):
    w = alnum(text)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    texts |= {10_000 + i: t for i, (_, t, _) in enumerate(ROWS)}
    texts |= {20_000: "gnu gnu general public license general public license cc by cc by mit license" * 3, 20_001: "MIT-License; cc:by", 20_002: "mit é license"}
    got = license_scan.license_report(docs(spark, [(i, t, "x") for i, t in texts.items()])).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[r["doc_id"]]), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        assert (r["labels"] == "") == (r["score"] == 0)
    assert license_scan.license_report(empty(spark)).count() == 0


def test_notices_need_their_key_phrase(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any person obtaining a copy", "x"), (2, "Permission is free of charge to any person", "x"), (3, "Licensed under CC BY-NC 4.0.", "x")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_report(docs(spark, rows)).collect()}
    assert got == {1: "mit-notice", 2: "", 3: "cc-by,cc-by-nc"}


def test_notices_with_several_key_phrases(spark):
    full = next(n for label, n, keys in license_scan.NOTICES if label == "mit")
    moved = full.replace("the software to deal", "hereinafter the software to deal")
    cut = full[: full.index("shall be included")]
    got = {r["doc_id"]: r for r in license_scan.license_report(docs(spark, [(1, full, "x"), (2, moved, "x"), (3, cut, "x"), (None, full, "x"), (1, "", "x"), (5, None, "x")])).collect() if r["score"] or r["doc_id"] != 1}
    assert got[1]["labels"] == "mit,mit-notice" and got[1]["score"] == 1
    assert got[2]["labels"] == "mit,mit-notice" and got[3]["labels"] == "mit-notice" and got[5]["labels"] == ""


def test_anchors_are_the_rarest_words_of_all_files(spark):
    rows = [(i, "gnu general public", "x") for i in range(9)] + [(9, "license gnu", "x")]
    d = docs(spark, rows, clash=False)
    held, files = license_scan._held(d.select("doc_id", "text"), license_scan.Index())
    index = license_scan.Index(held=held, files=files)
    assert files == 10 and held["gnu"] == 10 and held["license"] == 1 and held["mit"] == 0
    assert index.anchors[0][0] == ("license", 3) and index.idf["mit"] > index.idf["license"] > index.idf["gnu"]


def test_word_rule():
    assert ALNUM.pattern and re.fullmatch(r"\w+", "abc") and alnum("A_b-Ç1 [x]") == ["a", "b", "Ç1", "x"]
