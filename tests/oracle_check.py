"""Compares queries with their SQL over one folder of tables: python tests/oracle_check.py FOLDER [QUERY...]. Not a test module."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from quirework.session import local_session  # noqa: E402


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def main(folder: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or sorted(sql):
        try:
            t = time.time()
            df = queries[name](spark, folder)
            cols = sorted(df.columns)
            got = Counter(plain(tuple(r)) for r in df.select(*cols).collect())
            took = time.time() - t
            rel = con.sql(sql[name])
            if sorted(rel.columns) != cols:
                raise ValueError(f"columns {cols} and {sorted(rel.columns)}")
            want = Counter(plain(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
            if got != want:
                bad += 1
                print(f"DIFFERS {name}: {sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}", flush=True)
            else:
                kinds = dict(df.dtypes)
                print(f"ok {name} {sum(got.values())} rows {took:.1f} s {[(c, kinds[c], str(k)) for c, k in zip(rel.columns, rel.types) if (kinds[c], str(k)) not in SAME]}", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"FAILED {name}: {str(x)[:600]}", flush=True)
    return bad


SAME = {("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"), ("array<string>", "VARCHAR[]"), ("array<double>", "DOUBLE[]"), ("array<bigint>", "BIGINT[]"), ("array<int>", "INTEGER[]"), ("timestamp_ntz", "TIMESTAMP"), ("timestamp", "TIMESTAMP")}

if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
