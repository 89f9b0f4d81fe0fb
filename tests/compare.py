"""Run catalogue queries against their reference SQL and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    out = pd.DataFrame(index=frame.index)
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_bool_dtype(column):
            out[name] = column.astype(str)
        elif pd.api.types.is_numeric_dtype(column):
            out[name] = column.astype(float).round(6) + 0.0
        else:
            out[name] = column.astype(object).where(column.notna(), None).map(str)
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return "no rows to compare"
    a, b = _canonical(got), _canonical(want)
    for name in a.columns:
        same = (a[name] == b[name]) | (a[name].isna() & b[name].isna())
        if not same.all():
            i = same.idxmin()
            return f"{name}: {(~same).sum()} of {len(a)} differ, e.g. {a[name][i]} != {b[name][i]}"
    return None


def main() -> None:
    import __spark_entry__ as entry_points
    from fluxfold.session import local_session

    QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = []
    for name, run in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                problem = difference(got, con.execute(ORACLES[name]).df())
                sql = f"sql {time.time() - start:.1f}s"
            else:
                problem, sql = None, "rows only"
        except Exception as error:  # noqa: BLE001 - report and go on
            took, problem, sql = time.time() - start, f"{type(error).__name__}: {error}"[:600], ""
            got = ()
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {sql} rows={len(got)}",
              problem or "", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
