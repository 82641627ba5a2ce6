"""Every registered query over bouts against its SQL."""

import math

import duckdb
import pytest

from boutflow.oracle import SQL
from boutflow.queries import QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events pages".split():
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.collect()
    out = con.sql(SQL[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    text = lambda v: norm(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else norm(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == sorted(tuple(text(r[k]) for k in at) for r in out.fetchall())


def test_entry_module_without_text_operators():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries()) and set(SQL) == set(QUERIES)


def test_bouts_are_written_again_if_their_folder_goes(spark):
    import shutil

    from boutflow.sources import tables

    before = tables.Tables(spark, SF).bouts.count()
    key = (spark.sparkContext.applicationId, SF, "bouts")
    first = tables._WRITTEN[key][0]
    assert tables.Tables(spark, SF).bouts is tables._WRITTEN[key][1] and tables._WRITTEN[key][0] == first
    shutil.rmtree(first.removeprefix("file:"))
    assert tables.Tables(spark, SF).bouts.count() == before and tables._WRITTEN[key][0] != first
