"""Queries against their SQL twins on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(float(r[i]), 6) + 0.0 if isinstance(r[i], float) and not math.isnan(r[i]) or type(r[i]).__name__ == "Decimal" else r[i] for i in at]) for r in rows)


def names():
    from netmine.plans import catalogue, library_queries, model_queries, scan_queries  # noqa: F401  each adds its queries

    return sorted(catalogue.SQL)


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from netmine.plans import catalogue

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = catalogue.QUERIES[name](spark, DATA)
    other = db.sql(catalogue.SQL[name])
    assert sorted(mine.columns) == sorted(other.columns)
    number = lambda rows: [[float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x for x in r] for r in rows]
    assert plain(number(mine.collect()), mine.columns) == plain(number(other.fetchall()), other.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    root = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
