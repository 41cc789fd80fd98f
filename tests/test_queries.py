"""Every registered query outside the llm subpackage against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from episodica.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        x = float(x)
        return round(x, 5) if math.isfinite(x) else str(x)
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = REGISTRY[name].run(spark, sf).toPandas(), duck.execute(REGISTRY[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_query_without_sql_has_rows(spark, sf, name):
    assert REGISTRY[name].run(spark, sf).count() > 0
