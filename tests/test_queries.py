"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from tidemill.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A comparable form: nested values as tuples, floats to nine digits, times without zone."""
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compared(spark, name, query, sql, sf_dir=SF):
    """Both sides as sorted lists of rows, columns by name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    want = sorted((tuple(plain(row[k]) for k in order) for row in found.fetchall()), key=repr)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names), name
    got = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in df.collect()), key=repr)
    return got, want


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = compared(spark, name, core.QUERIES[name], core.ORACLES[name])
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = core.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert {"domain_type", "pages", "mean_words"} <= set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_brand_sheets_of_numbers_of_five_hexadecimal_digits(spark, tmp_path):
    given = spark.createDataFrame([(k, "HOUSEHOLD") for k in (0, 14, 65534, 65536, 89998, 89999)], "c_custkey long, c_mktsegment string")
    given.write.parquet(f"{tmp_path}/customer.parquet")
    got = core.QUERIES["brand_sheets"](spark, str(tmp_path)).filter("usage = 'Text'").collect()
    assert {r.row: r.hex for r in got} == {0: "#0000A1", 14: "#000EA1", 65534: "#FFFEA1", 65536: "#0000A1", 89998: "#5F8EA1"}
