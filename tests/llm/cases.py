"""Documents with every odd case, and columns whose names clash with the operators' own."""

from __future__ import annotations

import re

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
TEXT = "The quick brown fox jumps over the lazy dog and runs away from the small town at night"
ROWS = [
    (1, "", "en"),
    (2, None, "en"),
    (3, " \n\t\x0b ", "de"),
    (4, TEXT, None),
    (5, TEXT, "en"),
    (5, TEXT, "en"),
    (6, LONG, "en"),
    (7, "This file is under the Apache License, Version 2.0. GNU General Public License. CC BY-NC", "en"),
    (8, "...", "fr"),
    (9, "Éèà ñ ß 漢字 \U0001f600 text\x00with nul", "fr"),
    (None, "a text without an id", "en"),
    (None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("kept", "rank", "n", "a", "b", "label", "bucket", "rep", "start", "length", "score", "z", "vertex", "shard", "slot", "size", "perplexity", "t")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows=ROWS, clash=True):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, t, lang, None, len(t) if t else None) for i, t, lang in rows], SCHEMA)
    return d.withColumns({c: F.lit(None).cast("string") for c in CLASHING}) if clash else d


def empty(spark):
    return docs(spark, ROWS).limit(0)


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))
