"""Every registered query against its SQL on the smallest tables; the others must give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from waymark.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def rows(values):
    return sorted(tuple(map(plain, r)) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(columns).collect()) == rows(duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_identifier_flags_of_odd_pages(spark, tmp_path):
    texts = ["CIÓNES!!", "ÑABC", "ABCñ", "ABC\u0301", "Ü A-123é", "éCVE-2020-12345", "http://\x0bx", "http:// x", "x_ABC", "ABC", "ABCDEFG", "e /a/b", "", None]
    odd = [(i, "u", t) for i, t in enumerate(texts)] + [(len(texts), None, "ABC")]
    spark.createDataFrame(odd, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    name = "fn23_identifier_flags"
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = own.sql(ORACLES[name]).fetchall()
    got = QUERIES[name](spark, str(tmp_path))
    assert rows(got.collect()) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
