"""A sink of files with names of their own, which appear only when the whole write is done, and their source.

``save_files`` takes (name, content binary).  A task writes its files under a folder of its own attempt inside a hidden folder of this write, and gives their names as rows of a
Parquet table, in which Spark's committer keeps those of the attempts that count.  When all tasks are done, tasks over that table move the files to their place; what failed or
doubled attempts left goes with the hidden folder.  So neither names nor files pass through the driver.  A write that fails before its files are moved leaves the target as it was.

The table of names is given back: ``read_files`` opens the files by it, in as many tasks as wrote them, where a listing would pass all of them through the driver.

Rows of one name are parts of one file: they must meet in one task and follow each other (``files_of`` sees to that), and are appended in order.

Defined cases: an empty table makes no file; a null content is an empty file, a null name or one that isn't a plain file name fails the write; a name that two tasks
write fails it too; a file that exists is replaced in mode append (by name), and mode overwrite empties the folder's visible files first.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch_folder

#: Bytes of contents in a batch that is read.
BATCH = 4 << 20


def file_system(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{posixpath.abspath(uri)}")


def _writer(folder: str, hidden: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (name, content) below ``hidden``; gives (name, place), each name when its file is closed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = file_system(folder)
        place = f"{hidden}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(f"{base}/{place}", recursive=True)
        given = lambda names: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([place] * len(names), pa.string())], names=["name", "place"])
        last = stream = None
        try:
            for batch in batches:
                closed = []
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name is None or "/" in name or name.startswith(("_", ".")) or not name:
                        raise ValueError(f"not a file name: {name!r}")
                    if name != last:
                        if stream is not None:
                            stream.close()
                            closed.append(last)
                        last, stream = name, system.open_output_stream(f"{base}/{place}/{name}")
                    stream.write(content or b"")
                yield given(closed)
            if stream is not None:
                stream.close()
                yield given([last])
        finally:
            if stream is not None:
                stream.close()

    return write


def _mover(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moves the files of (name, place) into the folder; a task that is run again passes over those that are there."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = file_system(folder)
        for batch in batches:
            for name, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    system.move(f"{base}/{place}/{name}", f"{base}/{name}")
                except FileNotFoundError:
                    if system.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                        raise
            yield batch.slice(0, 0)

    return move


def files_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """(name, content) such that the parts of a file meet in one task, in ``order``."""
    return rows.repartition("name").sortWithinPartitions("name", *order).select("name", "content")


def save_files(rows: DataFrame, folder: str, order: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Write (name, content); ``order`` are the columns by which parts of one file follow each other.  Gives the names of the files."""
    from pyarrow import fs

    spark, folder, schema = rows.sparkSession, folder.rstrip("/"), "name string, place string"
    table, hidden = scratch_folder(spark), f"_writing-{uuid.uuid4().hex}"
    parts = files_of(rows, order) if order is not None else rows.select("name", "content")
    system, base = file_system(folder)
    try:
        parts.mapInArrow(_writer(folder, hidden), schema).write.parquet(table)
        written = spark.read.schema(schema).parquet(table)
        written = written.repartition(max(1, len(written.inputFiles())), "name")  # as many tasks as wrote: its bytes are few, its files are not
        if twice := written.groupBy("name").count().where("count > 1").select("name").head(1):
            raise ValueError(f"two tasks wrote files of one name, or its rows don't follow each other: {twice[0][0]!r}")
        system.create_dir(base, recursive=True)
        if mode == "overwrite":
            for old in system.get_file_info(fs.FileSelector(base)):
                if old.type == fs.FileType.File and not old.base_name.startswith(("_", ".")):
                    system.delete_file(old.path)
        written.mapInArrow(_mover(folder), schema).write.format("noop").mode("overwrite").save()
    finally:
        if system.get_file_info(f"{base}/{hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{hidden}")
    return written.select("name")


def read_files(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """(name, content) of the files of ``names``, as ``save_files`` gives them; one that is missing fails the read.  Without names those of the folder, which Spark's source
    lists in the driver.  Empty files are left out, as that source does."""
    if names is None:
        return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        given = lambda: pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
        for batch in batches:
            found, contents, size = [], [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as file:
                    content = file.read()
                if content:
                    found.append(name)
                    contents.append(content)
                    size += len(content)
                if size >= BATCH:
                    yield given()
                    found, contents, size = [], [], 0
            yield given()

    return names.select("name").mapInArrow(read, "name string, content binary")
