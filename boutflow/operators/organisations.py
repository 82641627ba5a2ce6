"""The dimension of organisations: names, staleness, names of former years, short names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutflow.functions.dates import age_days

#: Days after which an organisation's page is read again.
STALE_DAYS = 365


def numbered(names: DataFrame) -> DataFrame:
    """``names`` (org) with ``org_id``, dense from 1 in the order of the names. A dimension: the window is over these few."""
    return names.select("org").distinct().withColumn("org_id", F.dense_rank().over(Window.orderBy("org")).cast("long"))


def looked_up(keys: DataFrame, organisations: DataFrame, as_of: str) -> DataFrame:
    """Per key (org_id): the name (default: the id as text), whether it is known, its last update in seconds (0: never) and whether it is stale."""
    rows = keys.select("org_id").distinct().join(organisations.withColumn("known", F.lit(True)), "org_id", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("org_id").cast("string"))
    epoch = F.coalesce(F.unix_timestamp("last_updated"), F.lit(0)).cast("long")
    return rows.select("org_id", name.alias("name"), F.coalesce("known", F.lit(False)).alias("known"), epoch.alias("updated"), is_stale(as_of).alias("stale"))


def is_stale(as_of: str):
    """Of ``last_updated``: never, or more than STALE_DAYS before ``as_of``."""
    return F.coalesce(age_days(F.col("last_updated"), F.lit(as_of).cast("timestamp")) > STALE_DAYS, F.lit(True))


def former_names(renames: DataFrame) -> DataFrame:
    """name, from_year, to_year (exclusive; nulls: open), name_then: what each renamed organisation was called when.

    ``renames``: name, change_year, old_name; old names may have older ones, which a recursive query follows.
    """
    return renames.sparkSession.sql(
        """
        WITH RECURSIVE chain(name, name_then, to_year, from_year) AS (
          SELECT name, name, CAST(NULL AS INT), change_year FROM {renames}
          UNION ALL
          SELECT c.name, r.old_name, c.from_year, n.change_year
          FROM chain AS c JOIN {renames} AS r ON c.name_then = r.name LEFT JOIN {renames} AS n ON r.old_name = n.name
        )
        SELECT name, from_year, to_year, name_then FROM chain
        """,
        renames=renames,
    )


def named_for_year(rows: DataFrame, former: DataFrame, org: str = "primary_org") -> DataFrame:
    """``rows`` (``org``, year) with the organisation under its name of the year.

    Renames are a list kept by hand, of tens of rows, so each task gets it: a few organisations have all the rows.
    """
    then = former.select(F.col("name").alias("__name"), "from_year", "to_year", "name_then")
    during = (F.col(org) == F.col("__name")) & (F.col("from_year").isNull() | (F.col("year") >= F.col("from_year"))) & (F.col("to_year").isNull() | (F.col("year") < F.col("to_year")))
    return rows.join(F.broadcast(then), during, "left").withColumn(org, F.coalesce("name_then", org)).drop("__name", "from_year", "to_year", "name_then")


def with_short(rows: DataFrame, abbreviations: DataFrame, org: str = "primary_org", short: str = "short_org") -> DataFrame:
    """``rows`` with the short name of ``org``, or the name where there is none; short names are kept by hand too."""
    known = abbreviations.select(F.col("name").alias(org), F.col("short").alias("__short"))
    return rows.join(F.broadcast(known), org, "left").withColumn(short, F.coalesce("__short", org)).drop("__short")
