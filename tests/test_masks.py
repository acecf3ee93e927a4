"""Label masks against spans worked out by hand for characters as tokens."""

import pytest
from pyspark.sql import functions as F

from lumiflow.functions import templates as tp
from lumiflow.functions import tokens as tk
from lumiflow.operators import chat, masks

TURNS = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello you"), (1, 2, "user", "And?"), (1, 3, "assistant", "Done")]


def _labels(spark, name, turns=TURNS):
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = masks.label_masks(chat.prompts(d, tp.TEMPLATES[name]), tp.TEMPLATES[name]).first()
    return r["prompt"], r["input_ids"], r["labels"], r["mismatch"]


def _learned(ids, labels):
    return "".join(chr(i) for i, x in zip(ids, labels, strict=True) if x != tk.IGNORE)


def test_mpt_counts_rounds_without_separators(spark):
    prompt, ids, labels, mismatch = _labels(spark, "mpt")
    # each round is short of a separator's length, so the lengths differ and nothing is learned
    assert mismatch and set(labels) == {tk.IGNORE} and len(ids) == len(prompt)


def test_qwen_separator_of_two_ids_learns_only_answers(spark):
    """A template whose separator has two characters: the two that the rule adds to a round."""
    t = tp.Template("x", "QWEN_2", "S", ("u:", "a:"), "|\n", version="qwen_v2")
    d = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    r = masks.label_masks(chat.prompts(d, t), t).first()
    assert r["prompt"] == "S|\nu:Hi|\na:Hello you|\nu:And?|\na:Done|\n"
    assert not r["mismatch"]
    assert _learned(r["input_ids"], r["labels"]) == "Hello you|\nDone|\n"


def test_v1_mask_widths(spark):
    """Begin id and end text: each round has its own begin id, which stands for the end text of one character."""
    t = tp.Template("x", "TWO", "S", ("USER", "ASSISTANT"), " ", "$", "v1")
    d = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    r = masks.label_masks(chat.prompts(d, t), t).first()
    # the rule begins one id late, so the sequence is one longer than the begin ids of the rounds tell
    rounds = r["prompt"].split("$")[:-1]
    assert (1 + sum(len(x) + 1 for x in rounds) != len(r["input_ids"])) == r["mismatch"]


def test_common_prefix_and_images(spark):
    row = spark.range(1).select(tk.common_prefix(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2))).alias("a"), tk.ids_with_images(F.lit("a<image>b"), True).alias("b")).first()
    assert row["a"] == 2 and row["b"] == [1, 97, -200, 98]


def test_user_text_is_never_learned(spark, sf):
    t = tp.Template("x", "QWEN_2", "S", ("\x01", "\x02"), "|\n", version="qwen_v2")
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    d = d.withColumn("text", F.when(F.col("role") == "user", F.upper(F.regexp_replace("text", "[^a-zA-Z]", ""))).otherwise(F.lower(F.regexp_replace("text", "[^a-zA-Z]", ""))))
    for r in masks.label_masks(chat.prompts(d, t), t).collect():
        assert not any(c.isupper() for c in _learned(r["input_ids"], r["labels"]))


@pytest.mark.parametrize("name", ["plain", "v0"])
def test_templates_without_rounds(name):
    with pytest.raises(ValueError):
        masks.rule_of(tp.TEMPLATES[name])


def test_legacy_labels_of_a_long_conversation(spark):
    """No id looks at all lines: 3000 lines took minutes when each did."""
    import time

    text = [("abcdefghij" * 3)[: i % 31] for i in range(3000)]
    lines = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.struct((i % 2 == 0).alias("human"), F.substr(F.lit("abcdefghij" * 3), F.lit(1), (i % 31).cast("int")).alias("text")))
    df = spark.range(1).select(lines.alias("lines"))
    began = time.perf_counter()
    ids, labels = df.select(*(c.alias(n) for n, c in zip(("ids", "labels"), masks.legacy_labels(F.lit("A header."), F.col("lines")), strict=True))).first()
    assert time.perf_counter() - began < 30
    assert ids == [ord(c) for c in "A header." + "".join(text)]
    assert labels == [tk.IGNORE] * 9 + [ord(c) if i % 2 or k < 2 else tk.IGNORE for i, line in enumerate(text) for k, c in enumerate(line)]
