"""Folders that every executor can see, and files written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster's setting is used as it is.  Only where it is unset (local tests) a
    temporary folder of this machine is chosen and stored in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumiflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumiflow-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files outlive lost executors, so whatever reads them can be retried anywhere.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(name: str, make):
    """What a Python worker keeps from task to task: ``make()``, made once for ``name``.

    Workers are used again by later stages, so only the last name's state is kept, and a worker never holds
    the sum of all stages.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)
