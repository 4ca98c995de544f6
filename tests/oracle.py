"""Compares registered queries with their SQL: python tests/oracle.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool):
        return str(x)
    return x if isinstance(x, int) else None if x is None else str(x)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_cell(r[k]) for k in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if the DataFrame has the rows of the SQL."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; first only here {[x for x in got[:2000] if x not in want][:2]}, only there {[x for x in want[:2000] if x not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6 for p, q in zip(a, b))]
    exact = sum(a != b for a, b in zip(got, want))
    return f"{len(bad)} rows differ, {bad[:2]}" if bad else f"(rounding differs in {exact} rows)" if exact else ""


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from terrane import registry

    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connection(sf), 0
    for name in args[1:] or registry.QUERIES:
        began = time.time()
        try:
            df = registry.QUERIES[name](spark, sf)
            said = difference(df, con, registry.SQL[name]) if name in registry.SQL else f"rows {df.count()}"
        except Exception:
            said = "ERROR " + " | ".join(traceback.format_exc().strip().splitlines()[-3:])[:700]
        failed += bool(said) and not said.startswith(("rows", "("))
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
