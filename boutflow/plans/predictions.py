"""Stored predictions: a confidence for each subject, with the time and the version of the rule that made it.

A prediction holds if it has the rule's version and is not older than HOURS. ``refresh`` computes those of the
wanted subjects that lack one and keeps all others; stale ones stay stored until ``purge``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.plans.refresh import valid_predictions
from boutflow.sources.snapshots import Snapshots

VERSION, HOURS = 1, 2.0
SCHEMA = "subject_id long, confidence double, made_at timestamp, version int"


class Predictions:
    def __init__(self, spark: SparkSession, folder: str, version: int = VERSION, hours: float = HOURS):
        self.table, self.version, self.hours = Snapshots(spark, folder, SCHEMA, "subject_id"), version, hours

    def all(self) -> DataFrame:
        return self.table.read()

    def valid(self, as_of: str) -> DataFrame:
        """The predictions that hold at ``as_of``."""
        return valid_predictions(self.all(), self.version, as_of, self.hours)

    def put(self, rows: DataFrame, as_of: str, version: int | None = None) -> None:
        """Stores ``rows`` (subject_id, confidence), made now, in place of those of their subjects."""
        made = rows.select("subject_id", "confidence", F.lit(as_of).cast("timestamp").alias("made_at"), F.lit(self.version if version is None else version).alias("version"))
        self.table.write(self.all().join(made.select("subject_id"), "subject_id", "left_anti").unionByName(made))

    def refresh(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], as_of: str) -> None:
        """Stores what ``compute`` gives (subject_id, confidence) for the ``wanted`` (subject_id) without a valid prediction."""
        lacking = wanted.select("subject_id").distinct().join(self.valid(as_of).select("subject_id"), "subject_id", "left_anti")
        self.put(compute(lacking), as_of)

    def purge(self, as_of: str) -> int:
        """Removes predictions that are too old, of whatever version, and says how many."""
        old = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("made_at") > self.hours * 3600
        gone = self.all().where(old).count()
        if gone:
            self.table.write(self.all().where(~old))
        return gone

    def count(self) -> int:
        return self.all().count()

    def clear(self) -> None:
        self.table.write(self.all().limit(0))
