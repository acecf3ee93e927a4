"""String rules that differ from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a Python string counts as white space, as a regular-expression class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")).cast("long")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_left(text: Column, characters: str) -> Column:
    """Without any of ``characters`` at the left, in whatever order they stand there."""
    if not characters:
        return text
    return F.regexp_replace(text, "^[" + "".join("\\" + c if not c.isalnum() else c for c in characters) + "]+", "")


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def model_name_of_path(path: Column) -> Column:
    """Last part of a path; a checkpoint's name gets its parent's before it."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-"), F.concat(F.element_at(parts, -2), F.lit("_"), last)).otherwise(last)


def file_stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]


def truth_of(text: Column) -> Column:
    """Boolean words; any other word is an error."""
    low = F.lower(text)
    return F.when(low.isin("yes", "true", "t", "y", "1", "on"), True).when(low.isin("no", "false", "f", "n", "0", "off"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))


def python_float(value: Column) -> Column:
    """A number of at most three decimals as Python prints it."""
    text = value.cast("double").cast("string")
    return F.when(text == "-0.0", F.lit("0.0")).otherwise(text)
