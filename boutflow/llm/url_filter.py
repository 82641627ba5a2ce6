"""Operator 2: URL filters by a temporal list join.

A list holds dated entries: from that day on, a domain (with what stands below it) is blocked or allowed,
until the domain's next entry. Entries become validity intervals, and each capture meets the intervals
that hold on the day it was fetched: as-of join on the host and its parent domains. Of these the longest
domain decides; without any, the capture passes.

Captures are first summed up to distinct (host, day), so a host with a third of all captures has as many
rows as days. Intervals are laid out over ``BUCKET_DAYS``-day buckets, which makes the as-of join an
equi-join on (domain, bucket) with a range test on the few intervals there; open ones reach to the last capture's
bucket. All hosts have a few top-level labels in common, so hosts are also dealt into ``SALTS`` parts, for each of which an interval has
a row. The decisions join back to the captures by (host, day). A domain's entries are reduced to its last of each day before the window
that pairs each with the next, so a window holds at most the days of the list.

Edge cases: a capture with a null or unreadable URL, or a null day, passes with null ``listed``; a null
entry domain or day is left out; entries of one domain and day count by the largest ``entry_id``; repeated
captures each give a row; captures keep their other columns, but for those named like an added one, which
that one replaces; empty lists and empty captures are no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32
#: Parts that a domain's hosts are dealt into, so that a label that all hosts share, listed or not, isn't one key.
SALTS = 16


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Of entries (entry_id, domain, day, action): domain, action, valid_from, valid_to (exclusive; null: open)."""
    last = entries.where("domain is not null and day is not null").groupBy("domain", "day").agg(F.max_by("action", "entry_id").alias("action"))
    after = Window.partitionBy("domain").orderBy("day")
    return last.select("domain", "action", F.col("day").alias("valid_from"), F.lead("day").over(after).alias("valid_to"))


#: Columns that the decision adds.
ADDED = ("host", "listed", "action", "valid_from", "valid_to")


def decide(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` with ``host``, ``listed`` (the domain that decides), ``action``, ``valid_from``, ``valid_to``."""
    known = captures.select(F.struct(*[captures[f"`{c}`"] for c in captures.columns]).alias("capture"), host_of(captures[url_col]).alias("host"), captures[day_col].cast("int").alias("day"))
    asked = known.where("host is not null and day is not null").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")
    names = asked.select("host", "day", salt.alias("salt"), F.explode(suffixes).alias("domain")).withColumn("bucket", F.floor(F.col("day") / BUCKET_DAYS))
    last_day = asked.agg(F.max("day")).first()[0]
    end = F.coalesce(F.col("valid_to") - 1, F.greatest("valid_from", F.lit(last_day)))  # open intervals reach to the last capture
    days = F.sequence(F.floor(F.col("valid_from") / BUCKET_DAYS), F.floor(end / BUCKET_DAYS))
    lasting = intervals(entries).select("*", F.explode(days).alias("bucket")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = names.join(lasting, ["domain", "bucket", "salt"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    best = met.groupBy("host", "day").agg(F.max_by(F.struct("domain", "action", "valid_from", "valid_to"), F.length("domain")).alias("by"))
    out = known.join(best, ["host", "day"], "left")
    kept = [F.col(f"capture.`{c}`") for c in captures.columns if c.lower() not in ADDED]
    return out.select(*kept, "host", F.col("by.domain").alias("listed"), *[F.col(f"by.{c}") for c in ADDED[2:]])
