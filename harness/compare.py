"""Compare every query with its SQL: ``python -m harness.compare [directory] [query ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from harness.oracle import oracle
from harness.queries import QUERIES
from tillhouse.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("" if v is None or v is pd.NaT or v != v else str(v) for v in row)
        for row in frame.itertuples(index=False)
    )


def duck_type(name: str) -> str:
    names = {
        "int": "INTEGER",
        "bigint": "BIGINT",
        "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP",
    }
    return names.get(name, name.upper())


class _Exact:
    """A DuckDB result that keeps decimals and dates as Python objects."""

    def __init__(self, relation):
        self.columns, self.types = relation.columns, relation.types
        self._rows = relation.fetchall()

    def df_exact(self) -> pd.DataFrame:
        return pd.DataFrame(self._rows, columns=self.columns, dtype=object)


def main() -> int:
    arguments = sys.argv[1:]
    directory = arguments[0] if arguments else "/root/testdata/sf0.001"
    names = arguments[1:] or list(QUERIES)
    spark, con, sqls = local_session(), database(directory), oracle()
    bad = 0
    for name in names:
        started = time.perf_counter()
        try:
            problem = compare_one(spark, con, directory, name, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:24} {time.perf_counter() - started:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


def compare_one(spark, con, directory: str, name: str, sql: str | None) -> str | None:
    if sql is None:
        return "no SQL"
    got = QUERIES[name](spark, directory)
    want = _Exact(con.sql(sql))
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    expected = dict(zip(want.columns, (str(t) for t in want.types), strict=True))
    actual = {f.name: duck_type(f.dataType.simpleString()) for f in got.schema}
    wrong = {c: (actual[c], expected[c]) for c in expected if actual[c] != expected[c]}
    if wrong:
        return f"types {wrong}"
    rows = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    a, b = canonical(rows), canonical(want.df_exact())
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(a)} rows against {len(b)}; {only_a} against {only_b}"
    return None


if __name__ == "__main__":
    sys.exit(main())
