"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def pandas_of(df) -> pd.DataFrame:
    """A Spark frame in pandas, in which null whole numbers stay null instead of turning a column into floats."""
    frame = df.toPandas()
    for f in df.schema:
        if f.dataType.typeName() in ("byte", "short", "integer", "long"):
            frame[f.name] = frame[f.name].astype("Int64").astype(object)
    return frame


def _plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else list(v)
        return tuple(_plain(x) for x in v) if isinstance(v, list) else _plain(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))  # zeros keep their sign
    return None if v is pd.NaT or v is pd.NA else str(v) if isinstance(v, pd.Timestamp) else v


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x!r:.300} and {y!r:.300}"
    return ""
