import functools
import zlib

import numpy as np
import pytest
from cases import ROWS, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lumiflow.llm import packing, tokenfile, tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pieces_give_the_library_ids(encoder, text):
    assert encoder.by_piece and encoder.encode([text])[0] == encoder._raw([text])[0]


@pytest.mark.parametrize("text", ["0 1 00 a0b́ \n\n x", "<|endoftext|> a<|startoftext|>b 0", "<|ENDOFTEXT|> a b", "A <|EndOfText|>B, <|endoftext|> C", "ΑΣ Σ ας b c", "'s 't don't İI", "a., b.. c , d. e", "ab.́ c, é. ß, ", " \t\r\x0b\x85\x1c x"])
def test_pieces_at_edges(encoder, text):
    assert encoder.encode([text])[0] == encoder._raw([text])[0]


def test_tokenizers_with_blanks_are_encoded_whole():
    import public_tokenizers

    assert not tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")).by_piece


@functools.cache
def _ids(encoder, text, end):
    return np.frombuffer(encoder._raw([text or ""])[0] + end.to_bytes(4, "little"), "<u4")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_places_each_piece_once(histogram):
    plan = packing.plan_packs(histogram, 64)
    placed = {}
    for pattern, packs in plan:
        assert packs > 0 and sum(n * c for n, c in pattern) <= 64
        for n, c in pattern:
            placed[n] = placed.get(n, 0) + c * packs
    assert placed == histogram
    spans = {}
    for length, lo, hi, *_ in packing.pattern_rows(plan):
        assert spans.get(length, 0) == lo
        spans[length] = hi
    assert spans == histogram and len(plan) <= 128


def _check_packing(rows, texts, encoder, capacity):
    at = {}
    for r in rows:
        if r["doc_id"] is not None:
            ids = _ids(encoder, texts[r["doc_id"]], 1)
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at)))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= capacity


def test_packing_table(spark, sf, encoder):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = packing.pack_documents(d).collect()
    _check_packing(rows, texts, encoder, 2048)
    assert sum(r["length"] for r in rows) == sum(len(_ids(encoder, t, 1)) for t in texts.values())
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * len({r["sequence_id"] for r in rows})


def test_packing_odd_cases(spark, encoder):
    rows = packing.pack_documents(docs(spark), capacity=128).collect()
    texts = {i: t for i, t, _ in ROWS if i is not None}
    _check_packing(rows, texts, encoder, 128)
    total = sum(len(_ids(encoder, t, 1)) for _, t, _ in ROWS)
    assert sum(r["length"] for r in rows) == total
    assert [(r["start"], r["length"]) for r in rows if r["doc_id"] == 2] == [(0, 1)]
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packed_sequences_hold_the_ids(spark, encoder):
    d = docs(spark)
    pieces = {(r["sequence_id"], r["offset"]): r for r in packing.pack_documents(d, capacity=128).collect()}
    got = packing.packed_sequences(d, capacity=128).collect()
    assert all(len(r["input_ids"]) == 512 for r in got)
    for r in got:
        for s in r["doc_starts"]:
            p = pieces.get((r["sequence_id"], s["offset"]))
            if p is not None and p["doc_id"] == s["doc_id"]:
                assert zlib.crc32(bytes(r["input_ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])])) == p["ids_crc32"]


def test_token_files_round_trip(spark, sf, encoder, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    at = 0
    for r in sorted(tokenfile.tokens_round_trip(spark, d).collect(), key=lambda r: r["doc_id"]):
        ids = _ids(encoder, texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_random_access(spark, encoder, tmp_path):
    manifest = tokenfile.write_tokens(docs(spark), f"file://{tmp_path}/t", length=64).collect()
    all_ids = []
    for m in sorted(manifest, key=lambda m: m["part"]):
        f = tokenfile.TokenFile(m["tokens"])
        whole = f.read(0, m["n_tokens"])
        assert (f.read(m["n_tokens"] // 3, 7) == whole[m["n_tokens"] // 3 :][:7]).all()
        n = -(-m["n_tokens"] // 64)
        masks = [f.sequence(i) for i in range(n)]
        assert sum(int(x.sum()) for _, x in masks) == m["n_tokens"] and masks[0][0].dtype == np.uint16
        with pytest.raises(EOFError):
            f.read(m["n_tokens"] + 64, 1)
        all_ids.append(whole)
    assert sum(map(len, all_ids)) == sum(len(_ids(encoder, t, 2)) for _, t, _ in ROWS)
    got = tokenfile.tokens_round_trip(spark, docs(spark)).collect()
    assert len(got) == len(ROWS) and [r["start"] for r in got if r["doc_id"] is None][0] in (0, 1)
    assert tokenfile.tokens_round_trip(spark, empty(spark)).count() == 0
