"""Run registered queries against their check SQL in DuckDB: ``python -m tests.parity [--sf DIR] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(column: pd.Series) -> str:
    values = column.dropna()
    if pd.api.types.is_bool_dtype(values) or (len(values) and isinstance(values.iloc[0], (bool, np.bool_))):
        return "bool"
    if pd.api.types.is_datetime64_any_dtype(values):
        return "time"
    if pd.api.types.is_integer_dtype(values):
        return "int"
    if pd.api.types.is_float_dtype(values):
        return "float"
    return "text"


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=frame.index)
    for name in sorted(frame.columns):
        column = frame[name]
        kind = _kind(column)
        if kind == "time":
            out[name] = pd.to_datetime(column).astype("datetime64[us]")
        elif kind in ("int", "float"):
            out[name] = column.astype("float64")
        else:
            out[name] = column.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return "no rows"
    problems = []
    for name in got.columns:
        a, b = _kind(got[name]), _kind(want[name])
        if a != b and got[name].notna().any() and not {a, b} <= {"int", "float"}:
            problems.append(f"{name}: {a} vs {b}")
    a, b = _normal(got), _normal(want)
    for name in a.columns:
        same = (a[name] == b[name]) | (a[name].isna() & b[name].isna())
        if not same.all():
            where = np.flatnonzero(~same)
            problems.append(f"{name}: {len(where)} of {len(a)} differ, e.g. {a[name][where[0]]!r} vs {b[name][where[0]]!r}")
    return "; ".join(problems)


def main(argv: list[str]) -> int:
    from tidemark.catalog import ORACLES, QUERIES
    from tidemark.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    names = [n for n in QUERIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - t
            if name in ORACLES:
                t = time.time()
                want = con.sql(ORACLES[name]).df()
                problem = compare(got, want)
                note = f"duck {time.time() - t:.2f}s"
            else:
                problem, note = ("" if len(got) else "no rows"), "rows only"
            print(f"{'FAIL' if problem else 'ok  '} {name:32s} {len(got):7d} rows {took:6.2f}s {note} {problem}", flush=True)
            bad += bool(problem)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            bad += 1
            print(f"FAIL {name:32s} {type(error).__name__}: {str(error)[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
