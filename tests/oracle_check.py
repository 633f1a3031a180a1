"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py SF_DIR [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: [str(float(v)) if isinstance(v, (int, float)) else str(v) for v in row])


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when both sides give the same columns, types and rows."""
    actual = entry_points.queries()[name](spark, sf_dir)
    relation = con.sql(entry_points.oracle_sql()[name])
    got, want = canonical(actual.toPandas()), canonical(relation.df())
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {c: kinds.get(t, t) for c, t in actual.dtypes}
    other = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if types != other:
        return f"types {sorted(set(types.items()) ^ set(other.items()))}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}; extra {extra}; missing {missing}"
    return "" if got else "no rows"


def main() -> None:
    from conftest import session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry_points.queries())
    spark, con = session(), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {time.time() - start:6.1f}s {name} {problem}", flush=True)


if __name__ == "__main__":
    main()
