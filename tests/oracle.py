"""Run registered queries beside their SQL in DuckDB and compare: `python tests/oracle.py [sf] [key-prefix...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v + 0.0:.10g}" if v else "0"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.10g}"
    return str(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str:
    """Empty text when equal, else the first difference."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    for c in spark_pdf.columns:
        kinds = {spark_pdf[c].dtype.kind, sql_pdf[c].dtype.kind}
        if kinds in ({"i", "f"}, {"i", "b"}, {"b", "f"}) and not (spark_pdf[c].isna().any() or sql_pdf[c].isna().any()):
            return f"column {c}: {spark_pdf[c].dtype} vs {sql_pdf[c].dtype}"
    a, b = rows(spark_pdf), rows(sql_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}" if diff else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from varve.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = get_session(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), oracle_sql(), 0
    for key, fn in queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, f"{DATA}/sf{sf}").toPandas()
            took = time.time() - start
            msg = compare(got, con.execute(sql[key]).df()) if key in sql else ("" if len(got) else "no rows")
        except Exception as e:  # report and go on
            took, msg, got = time.time() - start, f"{type(e).__name__}: {str(e)[:900]}", []
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {key} {took:.1f}s rows={len(got)} {'sql' if key in sql else 'rows-only'} {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
