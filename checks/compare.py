"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.registry import QUERIES
from webloom.session import build_session, name_folder


def normalized(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("NULL" if pd.isna(v) else str(v) for v in row)
        for row in frame.itertuples(index=False, name=None)
    )


def difference(spark, con, sf_dir: str, name: str) -> str:
    """'' if both engines give the same rows."""
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = con.sql(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = normalized(ours), normalized(theirs)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} / {len(b)}; only Spark {only_a[:2]}; only SQL {only_b[:2]}"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    return con


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    name_folder(spark, tempfile.mkdtemp(prefix="webloom-compare-"))
    con = connect(sf_dir)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        if name not in ORACLES:
            print(f"{name:24s} {QUERIES[name](spark, sf_dir).count():7d} rows, no SQL", flush=True)
            continue
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:
            found = str(error)[:800]
        failed += bool(found)
        print(f"{name:24s} {time.time() - start:6.2f}s {'same' if not found else found}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
