"""Run registered queries beside their SQL in DuckDB. ``python -m tests.oracle [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cells = [tuple(_cell(r[k]) for k in order) for r in rows]
    return sorted(names), sorted(cells, key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return len(got), spent, "no sql"
    t = time.time()
    rel = con.sql(sql)
    want_names, want = _rows(rel.columns, rel.fetchall())
    sql_spent = time.time() - t
    if names != want_names:
        return len(got), spent, f"COLUMNS {names} vs {want_names}"
    if len(got) != len(want):
        return len(got), spent, f"ROWS {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return len(got), spent, f"VALUES {len(diff)} differ, first {diff[:2]}"
    kinds = {n: d for n, d in df.dtypes}
    for n, t_ in zip(rel.columns, rel.types):
        t_ = str(t_)
        if t_ == "HUGEINT" or t_.startswith("DECIMAL"):
            return len(got), spent, f"TYPE {n}: sql {t_}, spark {kinds[n]}"
    return len(got), spent, f"ok (sql {sql_spent:.1f}s)"


def main(names):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from locusmill.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            n, spent, verdict = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            n, spent, verdict = -1, 0.0, f"ERROR {type(err).__name__}: {str(err)[:400]}"
        bad += not verdict.startswith(("ok", "no sql"))
        print(f"{name:40s} rows={n:<7d} {spent:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
