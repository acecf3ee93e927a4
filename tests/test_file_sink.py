"""Files appear when the whole write is done, and only those of attempts that count."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumiflow.sources import file_sink as fs

ROOT = str(Path(__file__).resolve().parent.parent)


def visible(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith(".")}


def rows(spark, pairs):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in pairs], "name string, content binary")


def test_files_of_many_tasks(spark, tmp_path):
    want = {f"f{i}.bin": bytes([i]) * i for i in range(40)}
    fs.save_files(rows(spark, want.items()).repartition(7), str(tmp_path / "out"))
    assert visible(tmp_path / "out") == want
    back = {r["name"]: bytes(r["content"]) for r in fs.read_files(spark, str(tmp_path / "out")).collect()}
    assert back == {n: c for n, c in want.items() if c}  # Spark's source passes over empty files


def test_parts_of_a_file_follow_each_other(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("name"), F.encode(F.concat(F.col("id").cast("string"), F.lit(",")), "UTF-8").alias("content"), "id").repartition(5)
    fs.save_files(df, str(tmp_path / "out"), ["id"])
    assert visible(tmp_path / "out") == {f"f{k}": "".join(f"{i}," for i in range(k, 1000, 3)).encode() for k in range(3)}


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    out = tmp_path / "out"
    fs.save_files(rows(spark, [("kept", b"1")]), str(out))
    for bad in ([("a", b"2"), ("../b", b"3")], [("a", b"2"), (None, b"3")], [("kept", b"2"), ("_hidden", b"")]):
        with pytest.raises(Exception, match="not a file name"):
            fs.save_files(rows(spark, bad).repartition(2), str(out))
        assert visible(out) == {"kept": b"1"}
    with pytest.raises(Exception, match="two tasks|follow each other"):
        fs.save_files(rows(spark, [("a", b"2")]).union(rows(spark, [("a", b"3")])), str(out))
    assert visible(out) == {"kept": b"1"}


def test_modes_and_odd_rows(spark, tmp_path):
    out = tmp_path / "out"
    fs.save_files(rows(spark, [("a", b"1"), ("b", None)]), str(out))
    assert visible(out) == {"a": b"1", "b": b""}
    fs.save_files(rows(spark, [("a", b"2"), ("c", b"3")]), str(out))
    assert visible(out) == {"a": b"2", "b": b"", "c": b"3"}
    fs.save_files(rows(spark, [("d", b"4")]), str(out), mode="overwrite")
    assert visible(out) == {"d": b"4"}
    fs.save_files(rows(spark, [("x", b"")]).limit(0), str(out))
    assert visible(out) == {"d": b"4"}


TWICE = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lumiflow.sources import file_sink as fs

out, mark = sys.argv[1:]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

def once(batches):
    import os
    from pyspark import TaskContext
    for k, batch in enumerate(batches):
        yield batch
        if TaskContext.get().partitionId() == 1 and k == 1 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
df = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
fs.save_files(df.mapInArrow(once, "name string, content binary"), out)
"""


def test_a_task_that_fails_once_leaves_nothing_more(tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", TWICE, str(tmp_path / "out"), str(tmp_path / "failed")], check=True, timeout=120, env=env, capture_output=True)
    assert (tmp_path / "failed").exists()
    assert visible(tmp_path / "out") == {f"f{i}": str(i).encode() for i in range(40)}
    assert not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]


def test_files_are_read_by_their_names(spark, tmp_path):
    out, odd = str(tmp_path / "out"), {"a b%20.txt": b"1", "\u00e9+\u732b.txt": b"2", "none": b""}
    want = odd | {f"f{i}.bin": b"x" * (i % 5) for i in range(400)}
    names = fs.save_files(rows(spark, want.items()).repartition(3), out)
    assert sorted(r["name"] for r in names.collect()) == sorted(want)
    read = fs.read_files(spark, out, names)
    assert read.rdd.getNumPartitions() == 3  # as many as wrote; Spark's source opens some 32 files a task
    assert sorted((r["name"], bytes(r["content"])) for r in read.collect()) == sorted((n, c) for n, c in want.items() if c)
    os.remove(tmp_path / "out" / "f1.bin")
    with pytest.raises(Exception, match="f1.bin"):
        read.collect()


def test_the_tasks_of_a_query_do_not_grow_with_its_files(spark):
    import __spark_entry__ as entry

    read = entry.queries()["k02_text_files"](spark, "/root/testdata/sf0.01")  # 1000 files
    assert read.rdd.getNumPartitions() <= 4
    assert read.count() == 1000


def test_a_move_that_runs_again_passes_over_what_is_there(spark, tmp_path):
    (tmp_path / "_w" / "1").mkdir(parents=True)
    for name in ("a", "b"):
        (tmp_path / "_w" / "1" / name).write_bytes(name.encode())
    schema, move = "name string, place string", fs._mover(str(tmp_path))
    moved = spark.createDataFrame([("a", "_w/1"), ("b", "_w/1")], schema).mapInArrow(move, schema)
    for _ in range(2):
        assert moved.collect() == []
        assert {n: c for n, c in visible(tmp_path).items()} == {"a": b"a", "b": b"b"}
    with pytest.raises(Exception, match="lost"):
        spark.createDataFrame([("lost", "_w/1")], schema).mapInArrow(move, schema).collect()
