"""The driver's contract: names, SQL, and results against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from mergrove.plans import queries as algebra

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["c", "o", "price"] and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(algebra.SQL))
def test_query_matches_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    answer = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert bag(df.columns, df.collect()) == bag(columns, answer.fetchall())


def test_windowed_distinct_is_a_legal_answer(spark):
    df = entry.queries()["distinct_window"](spark, SF)
    rows = Counter(tuple(r) for r in df.collect())
    exact = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct()
    assert set(rows) == {tuple(r) for r in exact.collect()}
