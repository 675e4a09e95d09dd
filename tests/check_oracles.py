"""Run every registered query next to its SQL: python tests/check_oracles.py DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(got, got_cols: list[str], want, want_cols: list[str]) -> str | None:
    """First difference of two results, columns by name, rows in any order."""
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} / {sorted(want_cols)}"

    def rows(data, cols):
        order = sorted(range(len(cols)), key=lambda k: cols[k])
        return sorted((tuple(r[k] for k in order) for r in data), key=repr)

    a, b = rows(got, got_cols), rows(want, want_cols)
    if a == b:
        return None
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    return f"rows {len(a)} / {len(b)}, {len(only_a)} only here: {only_a[:2]} / {only_b[:2]}"


if __name__ == "__main__":
    from conftest import make_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, sqls, bad = make_session(), duck(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            got = df.collect()
            mid = time.time()
            rel = con.sql(sqls[name])
            diff = difference(got, df.columns, rel.fetchall(), rel.columns)
        except Exception as e:  # report and go on
            diff, mid = f"{type(e).__name__}: {str(e)[:700]}", time.time()
        bad += diff is not None
        print(f"{name:24s} {mid - start:6.2f}s {'ok' if diff is None else diff[:1500]}", flush=True)
    print("bad:", bad)
