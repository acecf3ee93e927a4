import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, docs, empty, spaced
from pyspark.sql import functions as F

from lumiflow.llm import langid, quality_lm, quality_rules, sharding, toxicity


def base(text):
    text = text or ""
    from cases import SPACED

    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


CASES = ROWS + [(30, "a b c a b c d a b c", "x"), (31, "x y " * 40 + "\nline\nline\n \n \nline", "x"), (32, "#*$%&|<> " * 9, "x"), (33, "one two three\none two three", "x")]


def test_quality_measures(spark):
    got = quality_rules.quality_report(docs(spark, CASES)).collect()
    want = {i: base(t) for i, t, _ in CASES if i is not None}
    assert len(got) == len(CASES)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r["doc_id"]
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_report(empty(spark)).count() == 0


def test_quality_filter_agrees_with_report_and_is_native(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality_rules.without_low_quality(d)
    want = {r["doc_id"] for r in quality_rules.quality_report(d).where("kept").select("doc_id").collect()}
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == want
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    odd = quality_rules.without_low_quality(docs(spark, CASES))
    assert odd.columns == docs(spark).columns and {r["doc_id"] for r in odd.collect()} <= {6}


def test_costs_include_measures_and_order_goes_by_rejections(spark):
    d = docs(spark, [(i, "word " * 2000 if i % 2 else "! " * 60, "x") for i in range(40)], clash=False)
    never = quality_rules.Rule("never", "__q_repeat < 0")  # costly, rejects nothing
    often = quality_rules.Rule("often", "4 * regexp_count(__q_text, '!') > __q_n")
    assert [r.name for r in quality_rules.order_rules(d, rules=(never, often))] == ["often", "never"]


def test_a_rejected_row_does_not_run_later_rules(spark):
    boom = quality_rules.Rule("boom", "raise_error('ran') is null")
    few = quality_rules.BASE[0]
    conditions = [(r.name, quality_rules._lazy(r)) for r in (few, boom)]
    short = quality_rules._words(docs(spark, [(1, "a b c", "x")], clash=False), "text")
    assert short.select(quality_rules.cascade(conditions)).first()[0] == "few_words"


def test_rule_order_changes_no_verdict(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (quality_rules.quality_report(d, rules=r).select("doc_id", "kept") for r in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert a.exceptAll(b).count() == 0


def test_quality_sql(spark, sf):
    from oracle import connection, difference

    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert difference(quality_rules.quality_report(d).toPandas(), connection(sf).execute(quality_rules.quality_sql()).df()) == ""


def test_quality_classifier_parts_junk_from_text(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lm.quality_scores(d, labels).join(labels, "doc_id").collect()
    # words said over and over are likely text to a language model; the repetition rule has them
    texts = {r["doc_id"]: base(r["text"]) for r in d.collect()}
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0 and 2 * texts[r["doc_id"]][4] <= texts[r["doc_id"]][0]]
    assert sum(r["accepted"] for r in good) == len(good) and sum(r["accepted"] for r in bad) < 0.35 * len(bad)
    kept = {r["doc_id"] for r in quality_lm.without_unlikely(d, labels).collect()}
    assert kept == {r["doc_id"] for r in quality_lm.quality_scores(d, labels).where("accepted").collect()}


def test_quality_classifier_odd_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_lm.quality_scores(docs(spark), labels).collect()
    assert len(got) == len(ROWS) and all(r["perplexity"] is None and not r["accepted"] for r in got if r["doc_id"] in (1, 2))
    assert quality_lm.without_unlikely(docs(spark), labels).columns == docs(spark).columns
    assert quality_lm.quality_scores(docs(spark), labels.limit(0)).where("accepted").count() == len([t for _, t, _ in ROWS if t])
    assert quality_lm.quality_scores(empty(spark), labels).count() == 0
    assert quality_lm.without_unlikely(empty(spark), labels).count() == 0


def test_ngrams_begin_with_each_text():
    codes, offsets = quality_lm.byte_codes(pa.array(["a", None, "", "bc"]))
    assert offsets.tolist() == [0, 1, 1, 1, 3] and [c.to_bytes(5, "big") for c in codes.tolist()] == [b"\xff\xff\xff\xffa", b"\xff\xff\xff\xffb", b"\xff\xff\xffbc"]


def test_answers_of_codes_that_share_a_slot():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 1 << 40, 50_000))
    table = quality_lm.Answers(code[::-1].copy(), np.arange(len(code))[::-1].astype(np.float32))
    at = rng.integers(0, len(code), 200_000)
    assert (table.of(code[at]) == at).all()
    with pytest.raises(ValueError):
        table.of(np.array([next(c for c in range(1 << 20) if c not in set(code.tolist()))]))


def test_whole_bytes_are_counted_and_joined(spark):
    """Against a plain model in one process; no case, script or context of four bytes is folded."""
    texts = ["the cat SAT", "the dog sat. The cat ran", "кот спал", "пёс ел", "the cat sat", "ran the dog", "кот ел", "a cat"] * 3
    texts = [f"{t} {i}" for i, t in enumerate(texts)] + ["THE CAT", "ток лапс", "", None]
    d = docs(spark, [(i, t, "x") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_lm.quality_scores(d, labels).collect()}
    held = {r[0] for r in d.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD)) == 0).select("doc_id").collect()}
    n = quality_lm.DEPTH
    grams = lambda t: [tuple(x) for x in (lambda s: (s[i : i + n] for i in range(len(s) - n + 1)))([255] * (n - 1) + list(t.encode()))]
    level = Counter(g for i in range(24) if i not in held for g in grams(texts[i]))
    levels = [level]
    for _ in range(n - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    parts = []
    for c in levels[::-1]:
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        ds = [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        sums, back = Counter(), Counter()
        for g, v in c.items():
            sums[g[:-1]] += v
            back[g[:-1]] += ds[min(v, 3) - 1]
        parts.append((c, ds, sums, back))

    def p(g):
        out = 1 / 256
        for k, (c, ds, sums, back) in enumerate(parts, 1):
            s = g[n - k :]
            total = sums.get(s[:-1], 0)
            out = (c[s] - ds[min(c[s], 3) - 1] if s in c else 0) / total + back[s[:-1]] / total * out if total else out
        return out

    for i, t in enumerate(texts):
        want = math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t.encode())) if t else None
        assert got[i]["perplexity"] is None if want is None else math.isclose(got[i]["perplexity"], want, rel_tol=1e-4), i
    assert len({got[i]["perplexity"] for i in (24, 25)} | {got[0]["perplexity"]}) == 3


def test_quality_classifier_rejects_all_kinds_of_bad_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lm.quality_scores(d, labels).join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(r["accepted"] for r in bad) < 0.15 * len(bad) and sum(not r["accepted"] for r in good) < 0.02 * len(good)


def test_counted_ngrams_grow_with_trusted_text(spark):
    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        d, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        own = quality_lm.chunked(d)
        path, _ = quality_lm.train(own, quality_lm.trusted_ids(labels))
        sizes.append(spark.read.parquet(path).select("code").distinct().count())
    assert sizes[1] > 1.5 * sizes[0]


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(d).join(d, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.96 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_sizes_by_hand(spark, sf):
    """Sizes, choice and score of whole texts, recomputed with zstandard alone."""
    import math

    import zstandard as z

    d = spark.read.parquet(f"{sf}/documents.parquet")
    learned = langid.fit_dictionaries(d.where(~langid.held_out(5, 0)).select("doc_id", "text", "lang"))
    rows = {r["doc_id"]: r for r in langid.language_report(d).collect()}
    texts = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    tools = {}
    for name, content in learned.items():
        own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=9)
        tools[name] = z.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
    for i, text in texts.items():
        if not text or not any(c.isalpha() for c in text):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
            continue
        raw = text.lower().encode()
        n = max(1, round(len(raw) / 400))
        cuts = [len(raw) * k // n for k in range(n + 1)]
        sizes = {name: sum(len(t.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) for name, t in tools.items()}
        best = min(sorted(sizes), key=sizes.get)
        share = 1 / sum(math.exp(max(-700.0, (sizes[best] - s) / 12)) for s in sizes.values())
        assert rows[i]["lang_pred"] == best and abs(rows[i]["score"] - share) < 1e-12


def test_language_odd_cases(spark):
    rows = [*ROWS, (40, "1234 !!", "en"), (41, "wort " * 50, "de")]
    got = langid.language_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 8, 40) or (r["doc_id"] is None and r["score"] == 0)), r
    nothing = langid.language_report(docs(spark, rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.language_report(empty(spark)).count() == 0


def test_kernel_tolerates_insertions_and_gaps():
    k = toxicity.kernel(["idiot", "idxiot", "i.d.i.o.t", "i d i o t", "1D10T", "garden"], ["idiot"])[:, 0]
    assert k[0] == k[2] == k[3] == k[4] and 0.4 * k[0] < k[1] < k[0] and k[5] == 0


def test_kernel_is_a_sum_over_subsequences():
    def features(w):
        s = [toxicity.EDGE, *(ord(c) - 96 for c in w), toxicity.EDGE]
        out = Counter()
        for i in range(len(s)):
            for a, b, c in toxicity._STEPS:
                if i + c < len(s):
                    out[s[i], s[i + a], s[i + b], s[i + c]] += toxicity.DECAY ** (c + 1)
        return out

    a, b = features("banana"), features("bandana")
    n = toxicity._norms(np.array([6, 7]))
    assert math.isclose(toxicity.kernel(["banana"], ["bandana"])[0, 0], sum(a[f] * b[f] for f in a) / n[0] / n[1], rel_tol=1e-5)


def test_toxicity_held_out(spark):
    """Stems of some insults in this table are syllables of clean words too, hence the limits."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_report(d, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in hit) > 0.85 * len(hit) and sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    above = np.array([r["score"] for r in hit])[:, None] - np.array([r["score"] for r in clean])
    assert (above > 0).mean() + (above == 0).mean() / 2 > 0.95


def test_scores_match_brute_force(spark, sf):
    """A small table is fitted; margins of 50 texts word by word, subsequence by subsequence."""
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(d.select("doc_id", "text"), labels)
    assert scorer.table is not None
    texts = [t[:3000] for (t,) in d.where("text is not null").orderBy("doc_id").select("text").limit(50).collect()]
    got, _ = scorer.margins(texts)
    for text, margin in zip(texts, got, strict=True):
        best = None
        sym, _ = toxicity.stream([text])
        for word in " ".join(str(x) if x != toxicity.EDGE else "|" for x in sym.tolist()).split("|"):
            letters = [int(x) for x in word.split()]
            if letters:
                s = [toxicity.EDGE, *letters, toxicity.EDGE]
                total = 0.0
                for i in range(len(s)):
                    for a, b, c in toxicity._STEPS:
                        if i + c < len(s):
                            code = ((s[i] * toxicity.BASE + s[i + a]) * toxicity.BASE + s[i + b]) * toxicity.BASE + s[i + c]
                            total += float(scorer.table[code]) * toxicity.DECAY ** (c + 1)
                m = total / toxicity._norms(np.array([len(letters)]))[0] + scorer.bias
                best = m if best is None or m > best else best
        assert math.isclose(margin, scorer.bias if best is None else best, abs_tol=1e-3)
    scores = scorer.scores(np.sort(got))
    assert (np.diff(scores) >= 0).all() and 0 <= scores[0] and scores[-1] <= 1


def test_isotonic_shares():
    at, share = toxicity._isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 0, 1, 0, 1, 1]))
    assert np.allclose(share, [0, 0.5, 1]) and np.allclose(at, [1 / 3, 2.5, 14 / 3])


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs(spark), labels).collect()
    assert len(got) == len(ROWS) and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity_report(empty(spark), labels).count() == 0
    rows = [(i, f"you are an {'idiot' if i % 2 else 'artist'} and more words here {i}", "en") for i in range(60)] + ROWS
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs(spark, rows), known).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("texts", [[None], ["", ""], ["\x00"], [" "], ["a b c d"], ["é" * 3000]])
def test_streams_of_odd_texts(texts):
    s = toxicity.Scorer(np.ones(toxicity.BASE**4, dtype=np.float32), -1.0)
    m, w = s.margins(texts)
    assert len(m) == len(w) == len(texts) and np.isfinite(m).all()


def test_shards(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_documents(d).collect()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_weights_draw_in_proportion(spark):
    got = Counter(r[0] for r in spark.range(4000).select(sharding.rendezvous_shard(F.col("id"), (1.0, 3.0))).collect())
    assert abs(got[1] / 4000 - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.lit(1), (1.0, 0.0))


def test_shards_by_hand(spark, sf):
    """Shard, grown shard, size and checksum, made again outside Spark."""
    import hashlib

    def costs(key, n):
        return [(-math.log((int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52), s) for s in range(n)]

    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in d.collect()}
    rows = sharding.shard_documents(d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw, key = texts[r["doc_id"]], r["doc_id"]
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), min(costs(key, 8))[1], min(costs(key, 9))[1])


def test_shards_odd_cases(spark, tmp_path):
    rows = sharding.shard_documents(docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] == 2)
    assert sharding.shard_documents(empty(spark)).count() == 0
    sharding.write_shards(docs(spark, clash=False), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
    with pytest.raises(ValueError):
        sharding.write_shards(docs(spark), str(tmp_path / "t"))


def test_spaced_words():
    assert spaced("A\x0bB\xa0c  d") == ["a", "b\xa0c", "d"]
