"""Quality rules as a short-circuit cascade of built-in expressions.

Rules are SQL conditions on measures; the rules form one CASE that stops at the first rule that
rejects.  Only the words are made for every row: what else a rule measures stands inside its own
branch, so a row that an earlier rule rejects never pays for it.  The order comes from a bounded
sample (``SAMPLE_ROWS`` rows of ``SAMPLE_CHARS`` characters, whatever size the table is): each rule's
seconds, its measures included and a job's own time taken off, and its rejected share are measured, and rules
go by rejections per second.  The sample moves work only; the verdict is the same in any order.
The report returns all base measures, so there only the rules beyond the base are cut short.

Defined cases: a null or wordless text has zero in every measure and fails (``n_words`` below
the least); null in other columns is not read; repeated rows are judged alone; an empty table
gives no rows; extra columns are kept by the filter, and working columns begin with ``__q_``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000

#: Fixed values of the word rule and the symbol rule.
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """A name and a SQL condition on ``__q_`` columns that is true for rejected rows."""

    name: str
    rejects: str


#: The base rule, in two parts.
BASE = (
    Rule("few_words", f"__q_n < {MIN_WORDS}"),
    Rule("repeated_words", f"100 * __q_repeat > {MAX_REPEAT_PERCENT} * __q_n"),
)

#: Beyond the base rule. Shares are of words, lines or letters of the text; a single line said twice isn't held against it.
RULES = (
    Rule("symbols", "10 * __q_symbols > __q_n"),
    Rule("repeated_lines", "__q_l.dup > 1 and 10 * __q_l.dup > 3 * __q_l.n"),
    Rule("long_words", "__q_chars > 15 * __q_n"),
    Rule("short_words", "2 * __q_chars < 3 * __q_n"),
    Rule("capitals", "2 * regexp_count(__q_text, '\\\\p{Lu}') > regexp_count(__q_text, '\\\\p{L}')"),
    Rule("exclamations", "4 * regexp_count(__q_text, '!') > __q_n"),
    Rule("no_letters", "2 * regexp_count(__q_text, '\\\\p{L}') < __q_chars"),
    Rule("ellipses", "__q_l.n >= 3 and 10 * size(filter(split(__q_text, '\\n'), x -> x rlike '(\\\\.\\\\.\\\\.|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*$')) > 3 * __q_l.n"),
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: it is made once, wherever the optimizer moves the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


# A 3-word window is a 64-bit hash.  Where all differ nothing is repeated; else, sorted with their places, equal
# neighbours are windows found twice, and each adds the words that the one before it didn't cover.
_HASHES = "if(size(__q_ws) < 4, cast(array() as array<bigint>), transform(sequence(0, size(__q_ws) - 3), i -> xxhash64(get(__q_ws, i), get(__q_ws, i + 1), get(__q_ws, i + 2))))"
_SORTED = "sort_array(transform(hs, (h, i) -> struct(h as h, i as i)))"
_PLACES = "sort_array(transform(filter(wins, (x, k) -> x.h = get(wins, k - 1).h or x.h = get(wins, k + 1).h), x -> x.i))"
_COVERED = f"aggregate({_PLACES}, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"

#: Measures that rules name by ``__q_`` and this key, made where they are needed.
MEASURES = {
    "repeat": _let(_HASHES, "hs", f"if(size(array_distinct(hs)) = size(hs), 0L, {_let(_SORTED, 'wins', _COVERED)})"),
    "symbols": f"cast(regexp_count(__q_text, '{SYMBOLS}') as bigint)",
    "l": _let(r"filter(split(__q_text, '\n'), x -> trim(both ' \t\n\u000b\f\r' from x) <> '')", "ls", "named_struct('n', cast(size(ls) as bigint), 'dup', cast(size(ls) - size(array_distinct(ls)) as bigint))"),
}


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the words of a text column, their number and that of their characters."""
    words = F.array_remove(F.split("__q_text", SEPARATORS), "")
    made = docs.withColumn("__q_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__q_ws", words)
    return made.withColumns({"__q_n": F.size("__q_ws").cast("long"), "__q_chars": F.length(F.array_join("__q_ws", "")).cast("long")})


def _lazy(rule: Rule) -> Column:
    """The rule's condition with its measures inside."""
    out = rule.rejects
    for name, made in MEASURES.items():
        if f"__q_{name}" in out.replace("__q_text", ""):
            out = _let(made, f"m_{name}", out.replace(f"__q_{name}", f"m_{name}"))
    return F.expr(out)


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second on a sample: the first ``SAMPLE_ROWS`` rows that Spark finds, of
    ``SAMPLE_CHARS`` characters at most, so it reads a few partitions of a table of any size."""
    texts = [(r[0],) for r in docs.select(F.substring(F.col(text_col), 1, SAMPLE_CHARS)).head(SAMPLE_ROWS)]
    sample = docs.sparkSession.createDataFrame(texts, "text string").coalesce(1).persist()

    def timed(condition: Column) -> tuple[float, int]:
        job = _words(sample, "text").agg(F.count_if(condition))
        job.first()  # code is compiled
        began = time.perf_counter()
        rejected = job.first()[0]
        return time.perf_counter() - began, rejected

    try:
        bare, _ = timed(F.lit(False))
        rate = {}
        for rule in rules:
            seconds, rejected = timed(_lazy(rule))
            rate[rule] = (rejected + 0.5) / max(seconds - bare, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=rate.__getitem__, reverse=True)


def cascade(conditions: list[tuple[str, Column]]) -> Column:
    """The first rejecting rule's name, or null; later rules of a rejected row are not run."""
    out = F.when(conditions[0][1], conditions[0][0])
    for name, condition in conditions[1:]:
        out = out.when(condition, name)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: base measures, the base verdict and the cascade's."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured = _words(own, "text").withColumns({f"__q_{name}": F.expr(made) for name, made in MEASURES.items()})
    failed = F.expr(" or ".join(r.rejects for r in BASE))
    verdict = cascade([(r.name, F.expr(r.rejects)) for r in order_rules(own, "text", rules)]).isNull()
    judged = measured.withColumn("__q_base", failed).withColumn("__q_kept", F.when(F.col("__q_base"), False).otherwise(verdict))
    return judged.select("doc_id", *(F.col(f"__q_{a}").alias(b) for a, b in (("n", "n_words"), ("chars", "word_chars"), ("symbols", "n_symbols"), ("l.dup", "n_dup_lines"), ("repeat", "n_repeat_words"), ("base", "base_failed"), ("kept", "kept"))))


def without_low_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that pass the base rule and every rule of the cascade."""
    # A predicate would be pushed below the words and make them again for each of its terms; Spark
    # leaves it above a projection with a column that isn't deterministic.
    made = _words(docs, text_col).withColumn("__q_task", F.spark_partition_id())
    ordered = order_rules(docs, text_col, (*BASE, *rules))
    passed = (F.col("__q_task") >= 0) & cascade([(r.name, _lazy(r)) for r in ordered]).isNull()
    return made.where(passed).select(*docs.columns)


def quality_sql(table: str = "documents") -> str:
    """The report in DuckDB's SQL."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words} AS words, {lines} AS lines FROM {table}),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
s AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM g),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM s),
p AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c WHERE n > 1),
q AS (SELECT r, sum(least(3, i - coalesce(before, i - 3))) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, t, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  len(regexp_extract_all(t, '\p{{L}}')) AS letters FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * len(lines)) OR word_chars > 15 * n_words OR 2 * word_chars < 3 * n_words
  OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > letters OR 4 * len(regexp_extract_all(t, '!')) > n_words OR 2 * letters < word_chars
  OR (len(lines) >= 3 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines))) AS kept FROM b"""
