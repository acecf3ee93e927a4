"""Every query with SQL gives what DuckDB gives."""

import pytest
from oracle import connection, difference, pandas_of

from lumiflow.plans import chat_queries, data_queries, flagship, model_queries, more_queries, system_queries  # noqa: F401
from lumiflow.plans.catalog import ORACLE, QUERIES


#: Queries with kernels, formats or block products over Arrow batches.
PYTHON = ("k03_", "n01_wide_", "n12_", "n15_", "n25_generated_", "n26_", "s01_", "s05_base64_pictures", "s06_", "s09_lora_")


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, duck, name):
    assert difference(pandas_of(QUERIES[name](spark, sf)), duck.execute(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_plans_push_down_and_need_no_python(spark, sf):
    """Columns are pruned in the scan and nothing but the wide kernels leaves the JVM."""
    for name, plan in QUERIES.items():
        text = plan(spark, sf)._jdf.queryExecution().toString()
        assert ("InArrow" in text or "Python" in text) == name.startswith(PYTHON), name
    text = QUERIES["a02_modality_lengths"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,text:string>" in text


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True, timeout=60)
