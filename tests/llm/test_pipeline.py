"""The pipeline against brute force, stage by stage, and the repository without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from cases import docs
from oracle import connection
from test_decontam_license import brute as contaminated
from test_dedup import brute as components

from lumiflow.llm import quality_lm, quality_rules

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {r["doc_id"] for r in quality_lm.quality_scores(d, labels).where("accepted").collect()}
    duck = connection(sf)
    good = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality_rules.quality_sql()}) WHERE kept").fetchall()}
    want = [left, left & good]
    comp = components([(i, texts[i]) for i in sorted(want[1])], 5)
    want.append({i for i, (_, c) in comp.items() if c == i})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want.append({i for i, r in contaminated([(i, texts[i]) for i in want[2]], items).items() if not r[4]})
    now = d
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        now = corpus_pipeline.stored(stage(spark, now, sf))
        assert now.columns == d.columns
        assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(ids)
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == want[3]
    assert len(want[3]) > 0.6 * len(texts)


@pytest.mark.parametrize("rows", [[], None])
def test_odd_tables_pass_all_stages(spark, sf, rows, tmp_path):
    d = docs(spark).limit(0) if rows == [] else docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, d, sf))
        assert after.columns == d.columns
        d = after
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert packed.where("start = 0").count() == d.count()


def test_the_rest_stands_without_it(tmp_path):
    for name in ("lumiflow", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "lumiflow/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
