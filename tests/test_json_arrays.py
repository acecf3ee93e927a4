"""JSON arrays cut anywhere give the records that a parser of the whole file gives."""

import json
import random

import pytest

from lumiflow.sources import json_arrays as ja

SCHEMA = "id long, text string, tags array<string>, more struct<a: string, b: array<struct<c: string>>>"


def records(n, seed=0, size=60):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "[", "]", "\\\\", '\\"', "é", "日本", "\U0001f600", "\n", "\t", ",", "x", " ", "}{", '"}', "\\u0041"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, size)))
    return [{"id": i, "text": text(), "tags": [text() for _ in range(rng.randint(0, 3))], "more": rng.choice([None, {"a": text(), "b": [{"c": text()}, {"c": "}"}]}])} for i in range(n)]


def read(spark, path, cut):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = ja.read_json_array(spark, [str(path)], SCHEMA).orderBy("file", "block", "place").collect()
        return [r.asDict(recursive=True) for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)


def plain(rows):
    return [{k: r[k] for k in ("id", "text", "tags", "more")} for r in rows]


@pytest.mark.parametrize("cut", [37, 131, 1000, 1 << 27])
@pytest.mark.parametrize("form", ["dense", "ascii", "indented", "lines"])
def test_any_cut(spark, tmp_path, cut, form):
    rows = records(8 if cut < 200 else 60, seed=cut)
    text = {"dense": lambda: json.dumps(rows, ensure_ascii=False, separators=(",", ":")), "ascii": lambda: json.dumps(rows), "indented": lambda: "﻿\n " + json.dumps(rows, ensure_ascii=False, indent=3) + "\n\n", "lines": lambda: "\n".join(json.dumps(r) for r in rows)}[form]()
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    got = read(spark, tmp_path / "x.json", cut)
    assert plain(got) == rows
    if cut < 200:
        assert len({r["block"] for r in got}) > 4


def test_records_longer_than_blocks(spark, tmp_path):
    rows = [{"id": i, "text": "}" * 3000 + '"' + "\\" * 7, "tags": ["{"] * 50, "more": None} for i in range(5)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    assert plain(read(spark, tmp_path / "x.json", 256)) == rows


def test_odd_files(spark, tmp_path):
    for name, text, want in (("empty", "", []), ("none", " [ ]\n", []), ("one", '{"id": 1}', [1]), ("scalars", '[null, 3, "}{", {"id": 4}, true]', [4]), ("two", '[{"id": 5}]', [5])):
        (tmp_path / f"{name}.json").write_text(text)
        assert [r["id"] for r in read(spark, tmp_path / f"{name}.json", 16)] == want, name
    assert sorted(r["id"] for r in read(spark, tmp_path, 16)) == [1, 4, 5]
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="without an end"):
        read(spark, tmp_path / "bad.json", 1 << 20)
    (tmp_path / "nested.json").write_text('[[{"id": 1}]]')
    with pytest.raises(Exception, match="is an array"):
        read(spark, tmp_path / "nested.json", 1 << 20)


def test_many_tasks_read_one_array(spark, tmp_path):
    """200 MB in one file and one line: more than ten tasks, each of a part of the records."""
    body = "x" * 1_000_000 + '}"{'
    path = tmp_path / "big.json"
    with open(path, "w") as f:
        f.write("[" + ", ".join(json.dumps({"id": i, "text": body}) for i in range(200)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        df = ja.read_json_records(spark, [str(path)])
        assert ja._blocks(spark, [str(path)]).rdd.getNumPartitions() > 10
        rows = df.selectExpr("block", "length(body) AS n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert len(rows) == 200 and len({r["block"] for r in rows}) > 10 and {r["n"] for r in rows} <= {len(json.dumps({"id": i, "text": body})) for i in (1, 10, 100)}


def test_round_trip(spark, tmp_path):
    rows = records(100, 5)
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    ja.write_json_array(df, str(tmp_path / "out"), 3)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(files) == 3 and sum(len(json.loads(p.read_text())) for p in files) == 100
    assert sorted(plain(read(spark, tmp_path / "out", 500)), key=lambda r: r["id"]) == rows
