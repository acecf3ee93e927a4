"""Conversations: roles, ordered messages, and what is made of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import Template, render

#: Role names of corpora and of the turn table.
ROLE_INDEX = {"human": 0, "user": 0, "gpt": 1, "assistant": 1}


def role_index(role: Column) -> Column:
    """0 for the asking role, 1 for the answering one, null for others."""
    out = F.lit(None).cast("int")
    for name, i in ROLE_INDEX.items():
        out = F.when(role == name, i).otherwise(out)
    return out


def usable_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Turns of known roles, without a first one that doesn't ask; adds ``role_no`` and ``pos`` (0, 1, ...) and ``alternates``."""
    w = Window.partitionBy(conv).orderBy(order)
    known = turns.withColumn("role_no", role_index(F.col(role))).where("role_no is not null")
    first = known.withColumn("__at", F.row_number().over(w))
    kept = first.where("not (`__at` = 1 and role_no = 1)").drop("__at")
    return kept.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("alternates", F.col("role_no") == F.col("pos") % 2)


def training_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Turns as the trainer numbers them: after a first turn that answers is dropped, turns of unknown roles are left out but still counted.

    Adds ``role_no``, ``pos`` and ``alternates``.  A conversation whose first role is unknown has no rows.
    """
    w = Window.partitionBy(conv).orderBy(order)
    rows = turns.withColumn("role_no", role_index(F.col(role))).withColumn("__first", F.first("role_no").over(w))
    rows = rows.withColumn("pos", (F.row_number().over(w) - 1 - F.col("__first")).cast("long"))  # null where the first role is
    return rows.where("role_no is not null and pos >= 0").drop("__first").withColumn("alternates", F.col("role_no") == F.col("pos") % 2)


def messages(turns: DataFrame, roles: tuple[str, str], conv: str = "conv_id", text: str = "text") -> DataFrame:
    """(conv, messages): one ordered array<struct<role, text>> for each conversation. A conversation is one record, so the array is as long as it."""
    named = F.when(F.col("role_no") == 0, roles[0]).otherwise(roles[1])
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), named.alias("role"), F.col(text).alias("text")))).alias("__rows"))
    return rows.select(conv, F.transform("__rows", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def prompts(turns: DataFrame, template: Template, open_end: bool = False, conv: str = "conv_id") -> DataFrame:
    """(conv, prompt) of each conversation; ``open_end`` appends the answering role without a text."""
    rows = messages(usable_turns(turns, conv), template.roles, conv)
    said = F.col("messages")
    if template.shots:
        shots = F.array(*(F.struct(F.lit(template.roles[i % 2]).alias("role"), F.lit(s).alias("text")) for i, s in enumerate(template.shots)))
        said = F.concat(shots, said)
    if open_end:
        said = F.concat(said, F.array(F.struct(F.lit(template.roles[1]).alias("role"), F.lit(None).cast("string").alias("text"))))
    return rows.withColumn("messages", said).select(conv, render(template, F.col("messages")).alias("prompt"))


def all_prompts(turns: DataFrame, templates: Iterable[Template], conv: str = "conv_id") -> DataFrame:
    """(conv, template, prompt) of each conversation by each template: turns are ordered once for all of them."""
    rows = messages(usable_turns(turns, conv), ("0", "1"), conv)

    def named(t: Template) -> Column:
        said = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "0", t.roles[0]).otherwise(t.roles[1]).alias("role"), m["text"].alias("text")))
        shots = [F.struct(F.lit(t.roles[i % 2]).alias("role"), F.lit(s).alias("text")) for i, s in enumerate(t.shots)]
        return F.concat(F.array(*shots), said) if shots else said

    return rows.select(conv, F.inline(F.array(*(F.struct(F.lit(t.name).alias("template"), render(t, named(t)).alias("prompt")) for t in templates))))


def chat_pairs(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, pair, asked, answered): turns folded in twos by position."""
    pair = F.floor(F.col("pos") / 2).cast("long")
    return turns.groupBy(conv, pair.alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("text"))).alias("asked"), F.max(F.when(F.col("pos") % 2 == 1, F.col("text"))).alias("answered"))


def legacy_lines(role: Column, text: Column, roles: tuple[str, str]) -> Column:
    """``### role: text`` lines of the oldest format; other roles are unknown."""
    low = F.lower(role)
    name = F.when(low.isin("human", "user"), roles[0]).when(low.isin("gpt", "assistant"), roles[1]).otherwise("unknown")
    return F.concat(F.lit("### "), name, F.lit(": "), text, F.lit("\n"))
