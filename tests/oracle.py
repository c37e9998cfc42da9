"""Compares queries with their SQL in DuckDB: ``python -m tests.oracle SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A hashable value; floats to nine significant digits."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(names, found) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def difference(df, sql: str, sf_dir: str):
    """None if both give the same rows under the same names; else what differs."""
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = db.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows(rel.columns, rel.fetchall())
    if ours == theirs:
        return None
    more, less = ours - theirs, theirs - ours
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; ours only {list(more)[:2]}; theirs only {list(less)[:2]}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from lodestone.session import session

    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or list(queries):
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, sql[name], sf_dir) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001 - a report of each query
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not (said is None or said.startswith("no SQL"))
        print(f"{name:28} {time.time() - t:6.1f}s  {said or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
