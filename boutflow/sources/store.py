"""Upserts of profiles, bout lists and organisations, as joins; each function returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_profiles(old: DataFrame, new: DataFrame, key: str = "competitor_id", keep: tuple[str, ...] = ("country",)) -> DataFrame:
    """``new`` rows replace those of their key; columns of ``keep`` stay as they were where new ones are null."""
    kept = old.select(key, *[F.col(c).alias(f"__{c}") for c in keep])
    filled = new.join(kept, key, "left").select(*[(F.coalesce(c, f"__{c}") if c in keep else F.col(c)).alias(c) for c in old.columns])
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(filled)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` go, then ``new`` comes in: bout lists and edges of a (competitor, year)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), at).alias("r"))
    return packed.select("r.*")


def year_spans(competitors: DataFrame, this_year: int, first: str = "first_year", last: str = "last_year") -> DataFrame:
    """competitor_id, year for each year from the first (else the last) to the last (else the previous) year."""
    end = F.coalesce(F.col(last), F.lit(this_year - 1))
    start = F.coalesce(F.col(first), end)
    return competitors.where(start <= end).select("competitor_id", F.explode(F.sequence(start, end)).alias("year"))


def missing_stubs(spans: DataFrame, lists: DataFrame, as_of: str) -> DataFrame:
    """(competitor, year) of ``spans`` without a list: empty ones, last updated two years before ``as_of``."""
    stale = F.date_sub(F.lit(as_of).cast("date"), 730).cast("timestamp")
    return spans.join(lists.select("competitor_id", "year").distinct(), ["competitor_id", "year"], "left_anti").select("competitor_id", "year", F.lit(0).cast("long").alias("n_bouts"), stale.alias("last_updated"))


def drop_empty(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """``lists`` without the empty ones among ``targets`` (competitor_id, year)."""
    gone = lists.where("n_bouts = 0").join(targets, ["competitor_id", "year"], "left_semi").select("competitor_id", "year")
    return lists.join(gone, ["competitor_id", "year"], "left_anti")


def write_lists(lists: DataFrame, folder: str) -> None:
    """Writes bout lists by year, replacing the years that ``lists`` holds and no other."""
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(folder)


def read_lists(spark, folder: str) -> DataFrame:
    """Reads lists whose files may lack columns that came later."""
    return spark.read.option("mergeSchema", "true").parquet(folder)


def split_history(history: DataFrame, lists: DataFrame) -> DataFrame:
    """The lists (competitor_id, year, n_bouts) after whole histories (competitor_id, bout_date) came in.

    A history replaces the lists of its years; rows of an unknown year are skipped; empty lists of years that
    a fetched history lacks go.
    """
    new = history.where("bout_date is not null").groupBy("competitor_id", F.year("bout_date").alias("year")).agg(F.count(F.lit(1)).alias("n_bouts"))
    fetched = history.select("competitor_id").distinct()
    vanished = lists.where("n_bouts = 0").join(fetched, "competitor_id", "left_semi").join(new.select("competitor_id", "year"), ["competitor_id", "year"], "left_anti")
    return replace_keys(drop_empty(lists, vanished), new, ["competitor_id", "year"])


def encoded_lists(listings: DataFrame) -> DataFrame:
    """competitor_id, year and ``bouts_json``: each list as the JSON text of an array of bouts."""
    bout = F.struct("bout_id", F.col("bout_date").cast("string").alias("date"), "org", "country", "is_victory", "participants")
    return listings.groupBy("competitor_id", "year").agg(F.to_json(F.array_sort(F.collect_list(bout))).alias("bouts_json"))


def decoded_lists(stored: DataFrame) -> DataFrame:
    """A row for each bout of stored lists; a list that is null or empty gives none."""
    schema = "array<struct<bout_id:bigint,date:string,org:string,country:string,is_victory:boolean,participants:array<bigint>>>"
    rows = stored.select("competitor_id", "year", F.explode(F.from_json(F.coalesce("bouts_json", F.lit("[]")), schema)).alias("b"))
    return rows.select("competitor_id", "year", "b.bout_id", F.try_to_date("b.date").alias("bout_date"), "b.org", "b.country", "b.is_victory", "b.participants")


def encoded_counters(rollup: DataFrame, columns: list[str]) -> DataFrame:
    """Counters (``key=n`` text of a roll-up) as the JSON text of a map; an empty counter is stored as null."""
    as_map = lambda c: F.transform_values(F.str_to_map(c, F.lit(","), F.lit("=")), lambda _, v: v.cast("long"))
    return rollup.select("competitor_id", "year", *[F.when(F.col(c) != "", F.to_json(as_map(F.col(c)))).alias(c) for c in columns])


def decoded_counters(stored: DataFrame, columns: list[str]) -> DataFrame:
    """competitor_id, year, counter, key, n of stored counters; null ones count as empty."""

    def entries(name: str):
        counter = F.coalesce(F.from_json(name, "map<string,bigint>"), F.from_json(F.lit("{}"), "map<string,bigint>"))
        return F.transform(F.map_entries(counter), lambda e: F.struct(F.lit(name).alias("counter"), e["key"].alias("key"), e["value"].alias("n")))

    pairs = [entries(c) for c in columns]
    return stored.select("competitor_id", "year", F.explode(F.concat(*pairs)).alias("e")).select("competitor_id", "year", "e.*")
