"""Scans with declared schemas: corpora, slider documents, images, weights and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import read_json_array

CORPUS = "conversations array<struct<`from`: string, value: string>>, image string, id string"
SLIDERS = "map<string, struct<value: double>>"
EVENTS = "event string, worker string, model_names array<string>, speed int, queue_length int, check_heart_beat boolean, ts timestamp"
WEIGHTS = "name string, shape array<int>, data array<double>"


def read_corpora(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of JSON arrays; ``img_path_idx`` is the ordinal of the path a record came from.

    A missing image key is null.  Each path is scanned as it is, so one may be a folder.  Files of any size are split into blocks (``json_arrays``).
    """
    out = None
    for i, path in enumerate(paths):
        rows = read_json_array(spark, [path], CORPUS).drop("file", "block", "place").withColumn("img_path_idx", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path")
    return out


def corpus_turns(corpus: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, text, image, img_path_idx): a row for each message."""
    return corpus.select(key, "image", "img_path_idx", F.posexplode("conversations").alias("turn", "m")).select(key, F.col("turn").cast("long").alias("turn"), F.col("m.from").alias("role"), F.col("m.value").alias("text"), "image", "img_path_idx")


def with_image_path(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds ``path``: folder of ``img_path_idx`` and image. ``folders``: a row for each corpus path, so small by its nature; the planner decides by its size."""
    # a record without an image has no path
    return rows.join(folders, "img_path_idx", "left").withColumn("path", F.when(F.col("image").isNotNull(), F.concat_ws("/", "folder", "image")))


def with_fallback(rows: DataFrame, bad: str, key: str) -> DataFrame:
    """Rows marked ``bad`` give the content of the row with the smallest key, and keep their own key as ``asked``. Opt-in: it repeats data."""
    first = rows.orderBy(key).limit(1).select(F.struct(*rows.columns).alias("__first"))
    return rows.crossJoin(F.broadcast(first)).select(F.col(key).alias("asked"), *(F.when(F.col(bad), F.col(f"__first.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns))  # one row


def read_sliders(spark: SparkSession, path: str) -> DataFrame:
    """(path, params) of slider documents; a malformed one fails the scan."""
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    return texts.select("path", F.from_json("value", SLIDERS, {"mode": "FAILFAST"}).alias("params"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, nChannels, bgr, rgb): decoded images, row by row; ``bgr`` as Spark's image source gives them, ``rgb`` with red first, null unless there are three channels."""
    rows = spark.read.format("image").load(path).select("image.*")
    swapped = F.unhex(F.regexp_replace(F.hex("data"), "(..)(..)(..)", "$3$2$1"))
    return rows.select("origin", "width", "height", "nChannels", F.col("data").alias("bgr"), F.when(F.col("nChannels") == 3, swapped).alias("rgb"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files, without decoding."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Worker events of JSON lines, as a table or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENTS).json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS).parquet(path)


def image_or_zero(image: str, has_image: str, size: int):
    """Pixels, or as many zeros for a record without an image."""
    return F.when(F.col(has_image), F.col(image)).otherwise(F.array_repeat(F.lit(0.0), size))
