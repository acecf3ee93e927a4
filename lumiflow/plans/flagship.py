"""The training-data path end to end: turns to prompts, lengths, megabatches and balanced chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.templates import TEMPLATES
from ..operators import batching, chat
from .catalog import Tables, query
from .chat_queries import TURNS, _prompt_sql
from .data_queries import MEGA

SIZE = 16


def training_batches(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, prompt, modality_length, megabatch and rank of each conversation."""
    turns = Tables(spark, folder).conversations
    lengths = batching.conversation_lengths(turns, F.col("conv_id") % 3 == 0)
    batches = batching.megabatches(lengths, SIZE, "conv_id", "words")
    return chat.prompts(turns, TEMPLATES["qwen_2"]).join(batches, "conv_id").select("conv_id", "prompt", "modality_length", "megabatch", "rank")


query("flagship_training_batches", f"{MEGA}, {TURNS}, g AS ({_prompt_sql(TEMPLATES['qwen_2'])}) SELECT g.conv_id, prompt, CASE WHEN g.conv_id % 3 = 0 THEN words ELSE -words END AS modality_length, CAST(megabatch AS BIGINT) AS megabatch, CAST(rank AS BIGINT) AS rank FROM g JOIN r ON g.conv_id = r.conv_id")(lambda d: training_batches(d.spark, d.folder))
