"""Glicko-2 rankings by period.

Periods follow one another, so the driver loops over them: 12 months, or at most 53 weeks, of a year. Years
don't wait for each other: each has its own run, seeded by a plain run of the year before, so one loop
takes a period of all years at once, with the state keyed by (year, competitor). Within a period all
competitors are updated at once from the ratings before it. A competitor enters in its first period with a
bout; in later periods without one only the deviation grows.

After each period the state is written as Parquet to the folder that the cluster shares and read from there,
so that a lost executor costs no more than the period, and the next plan starts from a table of known size
(a checkpointed frame would keep the size estimate of its old plan, which grows with each period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutflow.functions import glicko
from boutflow.functions.dates import iso_week_key, month_key
from boutflow.functions.text import record_text
from boutflow.sources.steps import Steps

KEY = ["year", "competitor_id"]
STATE = "year int, competitor_id long, mu double, phi double, sigma double, wins long, losses long, draws long"


def results(singles: DataFrame, by_week: bool = False) -> DataFrame:
    """year, period, competitor_id, opponent_id, score: each bout from both sides; draws score a half.

    An ISO week that reaches over the turn of the year belongs to the run of its bouts' own year.
    """
    key = iso_week_key(F.col("bout_date")) if by_week else month_key(F.col("bout_date"))
    won = F.when(F.col("is_victory"), F.lit(1.0)).otherwise(F.lit(0.5)).cast("double")
    sides = F.array(F.struct(F.col("a").alias("competitor_id"), F.col("b").alias("opponent_id"), won.alias("score")), F.struct(F.col("b").alias("competitor_id"), F.col("a").alias("opponent_id"), (1.0 - won).alias("score")))
    return singles.select(F.year("bout_date").alias("year"), key.alias("period"), F.explode(sides).alias("r")).select("year", "period", "r.*")


def terms(games: DataFrame, state: DataFrame) -> DataFrame:
    """Per player of ``games``: v, the improvement sum, and the record, from the state before (defaults for newcomers)."""
    mu0, phi0 = F.lit(0.0), F.lit(glicko.START_DEVIATION / glicko.SCALE)
    own = state.select(*KEY, "mu")
    other = state.select("year", F.col("competitor_id").alias("opponent_id"), F.col("mu").alias("mu_o"), F.col("phi").alias("phi_o"))
    rows = games.join(other, ["year", "opponent_id"], "left").join(own, KEY, "left")
    rows = rows.select(*KEY, "score", F.coalesce("mu", mu0).alias("mu"), F.coalesce("mu_o", mu0).alias("mu_o"), F.coalesce("phi_o", phi0).alias("phi_o"))
    e, gj = glicko.expected(F.col("mu"), F.col("mu_o"), F.col("phi_o")), glicko.g(F.col("phi_o"))
    per = rows.groupBy(*KEY).agg(
        F.sum(gj * gj * e * (1 - e)).alias("information"), F.sum(gj * (F.col("score") - e)).alias("improvement"),
        F.count_if(F.col("score") == 1).alias("won"), F.count_if(F.col("score") == 0).alias("lost"), F.count_if(F.col("score") == 0.5).alias("drawn"),
    )
    return per.withColumn("v", F.when(F.col("information") == 0, 1.0).otherwise(1 / F.col("information")))


def play(games: DataFrame, state: DataFrame) -> DataFrame:
    """The state after one period of ``games``, of one or several years."""
    joined = state.join(terms(games, state), KEY, "full_outer")
    now = joined.select(
        *KEY, F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("phi", F.lit(glicko.START_DEVIATION / glicko.SCALE)).alias("phi"), F.coalesce("sigma", F.lit(glicko.START_VOLATILITY)).alias("sigma"),
        *[(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("wins", "won"), ("losses", "lost"), ("draws", "drawn"))],
        F.col("v").isNotNull().alias("played"), F.coalesce("v", F.lit(1.0)).alias("v"), F.coalesce("improvement", F.lit(0.0)).alias("improvement"),
    )
    solved = now.withColumn("solved", glicko.volatility(F.col("sigma"), F.col("phi"), F.col("v"), F.col("v") * F.col("improvement")))
    new_sigma = F.when(F.col("played"), F.col("solved")).otherwise(F.col("sigma"))
    wide = F.sqrt(F.col("phi") * F.col("phi") + new_sigma * new_sigma)
    new_phi = F.when(F.col("played"), 1 / F.sqrt(1 / (wide * wide) + 1 / F.col("v"))).otherwise(wide)
    new_mu = F.when(F.col("played"), F.col("mu") + new_phi * new_phi * F.col("improvement")).otherwise(F.col("mu"))
    return solved.select(*KEY, new_mu.alias("mu"), new_phi.alias("phi"), new_sigma.alias("sigma"), "wins", "losses", "draws")


def numbered_periods(games: DataFrame) -> DataFrame:
    """``games`` with ``step``: the place, from 1, of the period among those of its year that have a bout."""
    periods = games.select("year", "period").distinct()  # at most 53 rows a year
    step = F.row_number().over(Window.partitionBy("year").orderBy("period"))
    return games.join(F.broadcast(periods.withColumn("step", step)), ["year", "period"])


def run(spark: SparkSession, singles: DataFrame, by_week: bool = False, start: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """The state after all periods of each year of ``singles`` (bout_date, a, b, is_victory). ``start`` gives ratings to begin with.

    A year whose periods are over is left as it is by the later steps of others.
    """
    steps = steps or Steps(spark)
    games = steps.save(numbered_periods(results(singles, by_week)))
    ends = {r.year: r.n for r in games.groupBy("year").agg(F.max("step").alias("n")).collect()}
    state = start if start is not None else spark.createDataFrame([], STATE)
    done = None
    for step in range(1, max(ends.values(), default=0) + 1):  # 12 or 53 at most
        state = steps.save(play(games.where(F.col("step") == step).drop("step", "period"), state))
        over = [y for y, n in ends.items() if n == step]
        if over and step < max(ends.values()):
            part = state.where(F.col("year").isin(over))
            done = part if done is None else done.unionByName(part)
            state = state.where(~F.col("year").isin(over))
    return state if done is None else state.unionByName(done)


def seed(state: DataFrame, least: int = 8) -> DataFrame:
    """The start of each next year: rating and deviation of those ranked, volatility and record anew."""
    ranked = state.where(F.col("wins") + F.col("losses") + F.col("draws") >= least)
    zero = F.lit(0).cast("long")
    return ranked.select((F.col("year") + 1).cast("int").alias("year"), "competitor_id", "mu", "phi", F.lit(glicko.START_VOLATILITY).alias("sigma"), zero.alias("wins"), zero.alias("losses"), zero.alias("draws"))


def by_year(spark: SparkSession, singles: DataFrame, years: list[int], least: int = 8, by_week: bool = False) -> DataFrame:
    """The state after each of ``years``, each seeded by the plain ranking of the year before."""
    steps = Steps(spark)
    singles = steps.save(singles)
    of = lambda ys: singles.where(F.year("bout_date").isin(sorted(ys)))
    before = run(spark, of([y - 1 for y in years]), by_week, steps=steps)
    played = of(years)
    known = [r.year for r in played.select(F.year("bout_date").alias("year")).distinct().collect()]
    start = seed(before, least).where(F.col("year").isin(known))
    return steps.save(run(spark, played, by_week, start, steps))


def table(state: DataFrame, names: DataFrame, orgs: DataFrame, least: int = 8) -> DataFrame:
    """Ranked competitors of each year: rank, name, organisation (of ``year``), rounded rating and deviation, and the record as text.

    ``names`` (competitor_id, name) may have a ``year`` too: the name most used in it.
    """
    ranked = state.where(F.col("wins") + F.col("losses") + F.col("draws") >= least).withColumn("rating", F.col("mu") * glicko.SCALE + 1500)
    out = ranked.join(names, [c for c in KEY if c in names.columns], "left").join(orgs, KEY, "left")
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("rating"), "competitor_id"))  # the competitors of one ranking
    return out.select("year", rank.alias("rank"), "competitor_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "org", F.round("rating", 3).alias("rating"), F.round(F.col("phi") * glicko.SCALE, 3).alias("deviation"), record_text(F.col("wins"), F.col("losses"), F.col("draws")).alias("record"))


def surprises(singles: DataFrame, state: DataFrame) -> DataFrame:
    """Decisive bouts with ``upset`` (the winner was rated below) and ``squash`` (the loser below the winner less two deviations).

    Ratings are of the bout's own year in ``state``; bouts of unrated competitors are neither.
    """
    rated = lambda x: state.select("year", F.col("competitor_id").alias(x), (F.col("mu") * glicko.SCALE + 1500).alias(f"rating_{x}"), (F.col("phi") * glicko.SCALE).alias(f"deviation_{x}"))
    rows = singles.where("is_victory").withColumn("year", F.year("bout_date")).join(rated("a"), ["a", "year"], "left").join(rated("b"), ["b", "year"], "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("bout_date", "a", "b", sure(F.col("rating_a") < F.col("rating_b")).alias("upset"), sure(F.col("rating_b") < F.col("rating_a") - 2 * F.col("deviation_a")).alias("squash"))


def write_report(report: DataFrame, folder: str) -> None:
    """A per-year report (rankings, workloads) as JSON, a folder a year; years that the report lacks stay as they were."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").json(folder)
