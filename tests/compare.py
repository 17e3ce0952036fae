"""Run registered queries beside their DuckDB oracle and compare the rows exactly.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gradelake.plans.fixtures import BASE  # noqa: E402
from gradelake.plans.registry import oracle_queries, spark_queries  # noqa: E402

ROOT = "/root/testdata"


def duck(folder: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return v


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted((tuple(_norm(v) for v in row) for row in zip(*cols)), key=repr)


def compare(spark, con, folder, build, sql):
    got_t = build(spark, folder).toArrow()
    want_t = con.sql(sql).to_arrow_table() if hasattr(con.sql(sql), "to_arrow_table") else con.execute(sql).fetch_arrow_table()
    names, got = _rows(got_t)
    wnames, want = _rows(want_t)
    problems = []
    if names != wnames:
        problems.append(f"columns {names} != {wnames}")
        return problems, len(got)
    for n in names:
        a, b = str(got_t.schema.field(n).type), str(want_t.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            problems.append(f"type of {n}: {a} != {b}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_a = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
        only_b = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else []
        problems.append(f"values differ; {names}\n   spark only {only_a}\n   oracle only {only_b}")
    return problems, len(got)


def main(argv):
    from gradelake.session import build_session

    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    folder = f"{ROOT}/sf{sf}"
    spark = build_session()
    con = duck(folder)
    qs, sqls = spark_queries(), oracle_queries()
    bad = []
    for name, build in qs.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                problems, n = compare(spark, con, folder, build, sqls[name])
            else:
                n, problems = build(spark, folder).toArrow().num_rows, []
            status = "ok" if not problems else "BAD"
        except Exception as e:  # noqa: BLE001
            problems, n, status = [f"{type(e).__name__}: {str(e)[:1500]}"], -1, "ERR"
        kind = "sql" if name in sqls else "rows"
        print(f"{status:4} {kind:4} {name:38} rows={n:<8} {time.time() - t0:5.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
        if status != "ok":
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
