"""Tables of model weights: deltas, name filters and optimizer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that may be missing in a base or larger than there, and names that adapters leave out.
ONLY_IN_TARGET = ("model.mm_projector.weight", "model.mm_projector.bias")
MAY_GROW = ("model.embed_tokens.weight", "lm_head.weight")
ADAPTER, EMBEDDINGS = ("mm_projector", "vision_resampler"), ("embed_tokens", "embed_in")
MULTIMODAL = ("mm_projector", "vision_tower", "vision_resampler")


def weight_delta(target: DataFrame, base: DataFrame, sign: int = -1) -> DataFrame:
    """(name, data, problem): target + sign x base by name; larger tensors change in the overlapping rectangle.

    Tables have name, shape (array<int>) and data (array<double>, row by row).  A join by name
    alone: the planner chooses its kind by size.
    """
    b = base.select(F.col("name").alias("b_name"), F.col("shape").alias("b_shape"), F.col("data").alias("b_data"))
    rows = target.join(b, F.col("name") == F.col("b_name"), "left")
    same = F.zip_with("data", "b_data", lambda x, y: x + sign * y)
    cols, b_rows, b_cols = F.col("shape")[1], F.col("b_shape")[0], F.col("b_shape")[1]
    row, col = lambda i: F.floor(i / cols).cast("int"), lambda i: F.pmod(i, cols)
    part = F.transform("data", lambda x, i: F.when((row(i) < b_rows) & (col(i) < b_cols), x + sign * F.get(F.col("b_data"), row(i) * b_cols + col(i))).otherwise(x))
    missing = F.col("b_name").isNull()
    equal = F.col("shape") == F.col("b_shape")
    problem = F.when(missing & ~F.col("name").isin(*ONLY_IN_TARGET), F.lit("not in base")).when(~missing & ~equal & ~F.col("name").isin(*MAY_GROW), F.lit("dimension mismatch"))
    return rows.select("name", F.when(missing, F.col("data")).when(equal, same).otherwise(part).alias("data"), problem.alias("problem"))


def last_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def any_part(name: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def adapter_targets(modules: DataFrame) -> DataFrame:
    """Distinct last names of linear modules outside the multimodal ones, without the output head. ``modules``: name, is_linear."""
    return modules.where(F.col("is_linear") & ~any_part(F.col("name"), MULTIMODAL)).select(last_name(F.col("name")).alias("module")).distinct().where("module <> 'lm_head'")


def state_filters(weights: DataFrame) -> DataFrame:
    """Adds a flag for each set of weights that is saved alone; ``lora_only``'s biases are those beside an adapter."""
    name = F.col("name")
    lora = name.contains("lora_")
    stems = weights.where(lora).select(F.concat(F.split(name, "lora_")[0], F.lit("bias")).alias("__bias")).distinct()
    rows = weights.join(stems, name == F.col("__bias"), "left")
    return rows.select(*weights.columns, lora.alias("lora"), (lora | name.contains("bias")).alias("lora_all"), (lora | F.col("__bias").isNotNull()).alias("lora_only"), (~lora & F.col("requires_grad")).alias("non_lora"), any_part(name, ("mm_projector",)).alias("adapter"))


def sinks(weights: DataFrame, start_end: bool = False) -> DataFrame:
    """(columns of ``weights``, sink): a row for each file that a weight is saved to.

    ``mm_projector`` is the adapter alone, with embeddings where marks of start and end are learned;
    ``adapter_model`` and ``non_lora_trainables`` are the two parts of low-rank training.
    """
    flagged = state_filters(weights)
    adapter = any_part(F.col("name"), ADAPTER + (EMBEDDINGS if start_end else ()))
    names = F.array(F.when(adapter, "mm_projector"), F.when(F.col("lora_only"), "adapter_model"), F.when(F.col("non_lora"), "non_lora_trainables"))
    return flagged.select(*weights.columns, F.explode(F.array_compact(names)).alias("sink"))


def sharded(weights: DataFrame, most: int, size: Column, prefix: str = "model") -> DataFrame:
    """Adds ``file``: tensors in order of their names fill shards of ``most`` bytes; one belongs to the shard in which its first byte lies.

    Positions are running sums over ranges of names, so no task orders all tensors.  The rows (name, file) are the index of the checkpoint.
    """
    from .batching import running_sum

    rows = running_sum(weights.withColumn("__size", size), ["name"], F.col("__size"), "__byte").withColumn("__shard", F.floor(F.col("__byte") / most))
    # numbers without gaps, as a tensor may be longer than a shard; a row a shard
    shards = rows.select("__shard").distinct().select("__shard", F.row_number().over(Window.orderBy("__shard")).alias("__no"))
    count = shards.agg(F.max("__no").alias("__of"))
    no = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    out = rows.join(shards, "__shard").crossJoin(F.broadcast(count))  # one row
    return out.withColumn("file", F.concat(F.lit(f"{prefix}-"), no("__no"), F.lit("-of-"), no("__of"))).select(*weights.columns, "file")


def optimizer_groups(params: DataFrame, rates: dict[str, float], decay: float) -> DataFrame:
    """(name, rate_key, weight_decay) for each parameter that learns; biases and norms don't decay, a keyword in the name sets the rate."""
    name = F.col("name")
    key = F.lit(None).cast("string")
    for k in reversed(list(rates)):
        key = F.when(name.contains(k), k).otherwise(key)
    decays = ~name.contains("bias") & ~F.col("is_norm")
    return params.where("requires_grad").select("name", key.alias("rate_key"), F.when(decays, F.lit(decay)).otherwise(0.0).alias("weight_decay"))


def skipped_parameters(tensors: DataFrame, order: str = "module") -> DataFrame:
    """(module, parameters, skipped): values of each module, those that share a storage counted once in it, and the sum up to the module.

    ``tensors`` has module, storage and values (a count).  A storage that two modules share counts in each, as each reports its own.
    """
    from .batching import running_sum

    once = tensors.groupBy("module", "storage").agg(F.max("values").alias("__n"))
    modules = once.groupBy("module").agg(F.sum("__n").cast("long").alias("parameters"))
    rows = running_sum(modules, [order], F.col("parameters"), "skipped")
    return rows.withColumn("skipped", F.col("skipped") + F.col("parameters"))


def mean_rows(rows: DataFrame, values: str = "embedding") -> DataFrame:
    """(dim, mean): the value that new rows of an embedding take, by dimension."""
    return rows.select(F.posexplode(values).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def loader_of_model(name: Column) -> Column:
    """Which loader a model's name asks for."""
    low = F.lower(name)
    return F.when(low.contains("llava"), F.when(low.contains("lora"), "lora").when(low.contains("mpt"), "mpt").when(low.contains("mistral"), "mistral").when(low.contains("qwen"), "qwen").otherwise("llama")).when(low.contains("mpt"), "mpt_text").otherwise("language")
