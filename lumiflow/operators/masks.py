"""Label masks of rendered conversations, by the rules of each template family.

A prompt is cut into rounds, a round into what is asked and what is answered, and the labels of
what is asked are ignored.  Lengths run on over rounds, so a mask is one fold over a
conversation's rounds and never leaves its row.  If the lengths don't add up to the
sequence, everything is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import Template
from ..functions.tokens import IGNORE, char_ids, common_prefix, ids_with_images


@dataclass(frozen=True)
class MaskRule:
    """start: ids before the first round; back: ids that an instruction's length gives up; extra: ids between rounds;
    later: added to both lengths from the second round on; bos: the tokenizer begins with an id of its own."""

    start: int
    back: int
    extra: int
    later: int
    bos: bool
    cut: str
    split: str


def rule_of(t: Template, later: int = 0) -> MaskRule:
    """The rule of a template's family; ``later`` is for tokenizers whose rounds differ after the first."""
    if t.style == "QWEN_2":
        return MaskRule(0, 0, 2, 0, False, "pairs", t.sep + t.roles[1])
    if t.style == "MPT":
        return MaskRule(0, 1, 0, later, False, "mpt", t.sep + t.roles[1])
    if t.style == "LLAMA_2":
        return MaskRule(1, 2, 0, 0, True, "sep2", "[/INST] ")
    if t.version.startswith("v1"):
        return MaskRule(1, 2, 0, later, True, "sep2", t.sep + t.roles[1] + ": ")
    raise ValueError(f"{t.name} has no round mask")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def rounds_of(t: Template, prompt: Column) -> Column:
    """A prompt's rounds: one string each."""
    rule = rule_of(t)
    if rule.cut == "sep2":
        return F.split(prompt, _literal(t.sep2))
    parts = F.split(prompt, _literal(t.sep))
    join = lambda lo, n: F.array_join(F.slice(parts, lo, n), t.sep)
    if rule.cut == "mpt":  # system, question and answer, then questions with answers
        more = F.when(F.size(parts) > 3, F.transform(F.sequence(F.lit(4), F.size(parts), F.lit(2)), lambda i: join(i, 2))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(join(F.lit(1), F.lit(3))), more)
    system = parts[0] == t.system
    folded = F.when(system, F.concat(F.array(join(F.lit(1), F.lit(2))), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(parts)
    joined = lambda a, i: F.array_join(F.slice(a, i, 2), t.sep)
    return F.transform(F.sequence(F.lit(1), F.size(folded), F.lit(2)), lambda i: joined(folded, i))


def label_masks(prompts: DataFrame, t: Template, prompt: str = "prompt", images: bool = False, later: int = 0, model_max: int = 1 << 30) -> DataFrame:
    """Adds ``input_ids`` and ``labels`` to rows with a rendered prompt."""
    rule = rule_of(t, later)
    ids = (ids_with_images if images else char_ids)
    of = lambda c: ids(c, rule.bos)
    size = lambda c: F.size(of(c)).cast("long")
    rows = prompts.withColumn("input_ids", of(F.col(prompt))).withColumn("__rounds", rounds_of(t, F.col(prompt)))

    def one(r: Column, i: Column) -> Column:
        parts = F.split(r, _literal(rule.split))
        asked = F.concat(parts[0], F.lit(rule.split))
        add = F.when(i > 0, rule.later).otherwise(0) if rule.later else F.lit(0)
        # both id arrays are bound before the comparison, which would else make them again at each place
        both = F.array(F.struct(of(r).alias("round"), of(asked).alias("asked")))
        instruction = F.transform(both, lambda z: common_prefix(z["round"], z["asked"]))[0] if rule.cut == "pairs" else size(asked) - rule.back
        return F.struct(((r != "") & (F.size(parts) == 2)).alias("ok"), (size(r) + rule.extra + add).cast("long").alias("n"), (instruction + add).cast("long").alias("asked"))

    rows = rows.withColumn("__each", F.transform("__rounds", one))
    # rounds count up to the first that isn't a question with an answer
    start = F.struct(F.lit(rule.start).cast("long").alias("at"), F.lit(True).alias("go"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        go = acc["go"] & r["ok"]
        span = F.array(F.struct(acc["at"].alias("lo"), (acc["at"] + r["asked"]).alias("hi")))
        return F.struct(F.when(go, acc["at"] + r["n"]).otherwise(acc["at"]).alias("at"), go.alias("go"), F.when(go, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = rows.withColumn("__end", F.aggregate("__each", start, step))
    at, total = F.col("__end.at"), F.size("input_ids")
    off = (at != total) & (at < model_max)
    labels = F.transform("input_ids", lambda x, i: F.when(off | (i < rule.start) | (i >= at) | F.exists(F.col("__end.spans"), lambda s: (i >= s["lo"]) & (i < s["hi"])), F.lit(IGNORE).cast("long")).otherwise(x))
    return rows.withColumn("labels", labels).withColumn("mismatch", off).drop("__rounds", "__each", "__end")


def plain_labels(caption: Column, sep: str = "\n") -> tuple[Column, Column]:
    """(ids, labels) of an image with a caption: only the image's own id is ignored."""
    ids = ids_with_images(F.concat(F.lit("<image>"), caption, F.lit(sep)))
    return ids, F.transform(ids, lambda x, i: F.when(i < 1, F.lit(IGNORE).cast("long")).otherwise(x))


def legacy_labels(header: Column, lines: Column) -> tuple[Column, Column]:
    """(ids, labels) of the oldest format; ``lines`` is an array<struct<human, text>>: the header, and human lines but for their first two ids, are ignored."""
    each = F.transform(lines, lambda m: char_ids(m["text"]))
    ignored = lambda ids, first: F.transform(ids, lambda x, i: F.when(i >= first, F.lit(IGNORE).cast("long")).otherwise(x))
    # labels are made line by line, so that no id looks at other lines
    labels = F.transform(lines, lambda m: ignored(char_ids(m["text"]), F.when(m["human"], 2).otherwise(F.length(m["text"]))))
    return F.concat(char_ids(header), F.flatten(each)), F.concat(ignored(char_ids(header), 0), F.flatten(labels))
