"""Decoding from next-token scores: temperature, nucleus cut, seeded draws and beams, as window and join plans.

Scores are a table (context, token, logit).  A context has at most a vocabulary of tokens, so its window is bounded.

Defined cases: temperature 0 leaves the token of the highest score (ties: the smallest token); the nucleus is the shortest prefix, by falling probability and rising
token, whose sum reaches ``top_p``, one token at least; a draw is a function of seed and key alone; a beam whose last token is ``end`` stays as it is; a beam without a next token is dropped; beams of equal score
go by their sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def bigram_logits(texts: DataFrame, text: str) -> DataFrame:
    """(context, token, logit): logarithms of how often a character follows another in whole texts."""
    # a text is cut into its characters once: a place in UTF-8 is found by walking there from the start
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    cut = texts.where(F.length(text) > 1).select(chars.alias("c"), F.length(text).alias("n"))
    pairs = F.zip_with(F.slice("c", F.lit(1), F.col("n") - 1), F.slice("c", F.lit(2), F.col("n") - 1), lambda a, b: F.concat(a, b))
    counts = cut.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.select(F.substring("pair", 1, 1).alias("context"), F.substring("pair", 2, 1).alias("token"), F.log("n").alias("logit"))


def probabilities(logits: DataFrame, temperature: float) -> DataFrame:
    """(context, token, p): softmax of logits / temperature; at 0 the best token alone."""
    own = Window.partitionBy("context")
    best = F.row_number().over(own.orderBy(F.desc("logit"), "token"))
    if temperature == 0:
        return logits.withColumn("r", best).where("r = 1").select("context", "token", F.lit(1.0).alias("p"))
    weight = F.exp((F.col("logit") - F.max("logit").over(own)) / temperature)
    return logits.select("context", "token", weight.alias("w")).select("context", "token", (F.col("w") / F.sum("w").over(own)).alias("p"))


def nucleus(logits: DataFrame, temperature: float, top_p: float) -> DataFrame:
    """(context, token, p, upto): tokens that are kept, with probabilities that sum to 1 and their running sum."""
    falling = Window.partitionBy("context").orderBy(F.desc("p"), "token")
    before = F.coalesce(F.sum("p").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = probabilities(logits, temperature).withColumn("before", before).where(F.col("before") < top_p)
    whole = F.sum("p").over(Window.partitionBy("context"))
    kept = kept.select("context", "token", (F.col("p") / whole).alias("p"))
    return kept.withColumn("upto", F.sum("p").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that any engine can repeat: seven hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 7), 16, 10).cast("double") / 2**28


def drawn(asked: DataFrame, kept: DataFrame, seed: int) -> DataFrame:
    """(key, token) of (key, context): the first token whose running sum lies above the key's number, the last one at the border."""
    rows = asked.withColumn("u", uniform(F.col("key"), seed)).join(kept, "context")
    over = F.col("upto") > F.col("u")
    return rows.groupBy("key").agg(F.coalesce(F.min(F.when(over, F.struct("upto", "token")))["token"], F.max(F.struct("upto", "token"))["token"]).alias("token"))


def log_steps(logits: DataFrame, unit: float = 1e6) -> DataFrame:
    """(context, token, step): log probabilities in whole millionths, so that sums and ties are exact."""
    total = F.log(F.sum(F.exp("logit")).over(Window.partitionBy("context")))
    return logits.select("context", "token", F.round((F.col("logit") - total) * unit).cast("long").alias("step"))


def beams(starts: DataFrame, steps: DataFrame, width: int, length: int, end: str) -> DataFrame:
    """(start, sequence, score, rank): the ``width`` best sequences of up to ``length`` more tokens from each (start, context).

    Each step is a join with what may follow and a top-k of each start; starts that share a context share no work, so ask for distinct ones.
    """
    at = starts.select("start", F.col("context").alias("sequence"), F.col("context").alias("last"), F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("start").orderBy(F.desc("score"), "sequence")
    for _ in range(length):  # a fixed number of steps
        moved = at.where(F.col("last") != end).join(steps, F.col("last") == F.col("context")).select("start", F.concat("sequence", "token").alias("sequence"), F.col("token").alias("last"), (F.col("score") + F.col("step")).alias("score"))
        at = moved.union(at.where(F.col("last") == end)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank")
    return at.select("start", "sequence", "score", F.row_number().over(best).cast("long").alias("rank"))


#: Parts over which the rows of one frequent id are dealt.
SALT = 16


def decoded_text(generated: DataFrame, vocabulary: DataFrame, special: list[int], key: list[str], ids: str = "ids") -> DataFrame:
    """(key, text): the pieces of generated ids without ``special`` ones, joined and stripped. ``vocabulary``: id, piece.

    Ids meet their pieces in a join; a frequent id is dealt over ``SALT`` parts, in each of which the vocabulary stands once.  A reply is one row, as its length has a budget.
    Unknown ids give nothing; null or empty ids give an empty text; keys are unique.
    """
    tokens = generated.select(*key, F.posexplode(ids).alias("__pos", "id")).where(~F.col("id").isin(*special))
    tokens = tokens.withColumn("__salt", F.pmod(F.xxhash64(*key, "__pos"), F.lit(SALT)))
    pieces = vocabulary.select("id", "piece", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALT)))).alias("__salt"))
    found = tokens.join(pieces, ["id", "__salt"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__pos", "piece"))).alias("__p"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    rows = generated.select(*key).join(found.select(*(F.col(k).alias(f"__{k}") for k in key), "__p"), same, "left")
    return rows.select(*key, strip(F.coalesce(F.array_join(F.transform("__p", lambda p: p["piece"]), ""), F.lit(""))).alias("text"))
