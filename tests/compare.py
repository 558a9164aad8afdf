"""Run registered queries against their SQL on the same tables. Usage: compare.py sf_dir [name-part ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in data], key=repr), [columns[i] for i in order]


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got, cols = rows(df.columns, df.collect())
    t1 = time.time()
    types = dict(df.dtypes)
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0, True
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: str(d[1]) for d in res.description}
    want, wcols = rows(dcols, res.fetchall())
    t2 = time.time()
    notes = []
    if cols != wcols:
        return f"columns {cols} vs {wcols}", t1 - t0, t2 - t1, False
    for c in cols:
        if KINDS.get(types[c], types[c]) != dtypes[c]:
            notes.append(f"type {c}: {types[c]} vs {dtypes[c]}")
    if len(got) != len(want):
        notes.append(f"rows {len(got)} vs {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        notes.append(f"{len(bad)} differ, e.g. {bad[0]}"[:900])
    if not got:
        notes.append("EMPTY")
    return ("; ".join(notes) or f"ok {len(got)}"), t1 - t0, t2 - t1, not notes


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tractwise.session import local_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sys.argv[1])
    qs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            note, a, b, good = compare(spark, con, folder, name, fn, sql.get(name))
        except Exception as exc:  # noqa: BLE001
            note, a, b, good = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0, 0, False
        failed += not good
        print(f"{'  ' if good else '!!'} {name:34s} {a:6.2f}s {b:6.2f}s {note}", flush=True)
    print("failed:", failed)
