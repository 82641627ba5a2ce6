"""Rounded numbers and their texts against DuckDB, at every age where the exact value decides."""

import duckdb
from pyspark.sql import functions as F

from boutflow.functions import dates, numbers


def test_rounded_ages_and_texts(spark):
    seconds = [*range(1, 400_000, 37), *range(108, 60_000_000, 540), *range(0, 60_000_000, 5400), 3_240_000, 13_198_788, 11_275_200]
    age = F.col("s") / 86400.0
    got = {r.s: (r.age, r.age_text) for r in spark.createDataFrame([(s,) for s in set(seconds)], "s long").select("s", numbers.rounded(age, 4).alias("age"), dates.age_text(age).alias("age_text")).collect()}
    con = duckdb.connect()
    con.execute("create table t as select unnest(?) as s", [sorted(set(seconds))])
    want = con.sql("""select s, round(age, 4), case when age < 1 then printf('%.0f hours', age * 24) when age < 30 then printf('%.0f days', age) when age < 365 then printf('%.1f months', age / 30) else printf('%.1f years', age / 365) end
    from (select s, s / 86400.0::double as age from t)""").fetchall()
    assert len(want) == len(got) and {s: (a, x) for s, a, x in want} == got
    assert got[13_198_788] == (152.7637, "5.1 months") and got[11_275_200][1] == "4.3 months" and got[3_240_000][1] == "1.2 months"
