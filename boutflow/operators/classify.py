"""Mixed bouts, and the classification of competitors without a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutflow.functions.scoring import cohort_confidence, mixed_probability
from boutflow.functions.text import bout_type
from boutflow.operators.audit import upper_medians


def with_probability(bouts: DataFrame, cohort_orgs: tuple[str, ...], home: str, raised: tuple[str, ...]) -> DataFrame:
    """``bouts`` with size, cohort_org, at_home and probability."""
    sized = bouts.withColumns({"size": F.size("participants"), "cohort_org": F.col("org").isin(*cohort_orgs), "at_home": F.col("country") == home})
    p = mixed_probability(F.col("size"), F.col("cohort_org"), F.col("year"), F.col("at_home"), F.col("country").isin(*raised), F.size("sides") > 2)
    return sized.withColumn("probability", p)


def distinct_bouts(bouts: DataFrame) -> DataFrame:
    """One bout for each (bout_date, participants): that of the smallest id."""
    first = bouts.groupBy("bout_date", "participants").agg(F.min("bout_id").alias("bout_id"))
    return bouts.where(F.size("participants") > 0).join(first.select("bout_id"), "bout_id", "left_semi")


def compositions(bouts: DataFrame, competitors: DataFrame) -> DataFrame:
    """Distinct bouts of known competitors with ``mixed``: both in-cohort and others take part; bouts without the cohort are left out."""
    distinct = distinct_bouts(bouts)
    flags = competitors.select("competitor_id", "in_cohort")
    sides = distinct.select("bout_id", F.explode("participants").alias("competitor_id")).join(flags, "competitor_id")
    per = sides.groupBy("bout_id").agg(F.count_if("in_cohort").alias("inside"), F.count_if(~F.col("in_cohort")).alias("outside")).where("inside > 0")
    return distinct.join(per, "bout_id").withColumn("mixed", F.col("outside") > 0)


def compare(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """For each feature of ``by`` and value (as text): mixed and cohort-only bouts, and the mixed share."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("string").alias("value")) for n, c in by.items()]))
    flat = rows.select("mixed", pairs.alias("f")).select("mixed", "f.feature", "f.value")
    both = flat.groupBy("feature", "value").agg(F.count_if("mixed").alias("n_mixed"), F.count_if(~F.col("mixed")).alias("n_cohort_only"))
    return both.withColumn("mixed_share", F.round(F.col("n_mixed") / (F.col("n_mixed") + F.col("n_cohort_only")), 6))


def compare_features(rows: DataFrame) -> DataFrame:
    return compare(rows, {"size": F.size("participants"), "type": bout_type(F.col("sides")), "multi_sided": F.size("sides") > 2, "org": F.col("org"), "country": F.col("country"), "year": F.col("year")})


def mixed_share_by_year(rows: DataFrame) -> DataFrame:
    """Per year: bouts, mixed ones, share, and the share over the year with the present years beside it (inner years)."""
    years = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_bouts"), F.count_if("mixed").alias("n_mixed"))
    w = Window.orderBy("year").rowsBetween(-1, 1)  # a row a year
    smooth = F.when(F.count(F.lit(1)).over(w) == 3, F.round(F.sum("n_mixed").over(w) / F.sum("n_bouts").over(w), 6))
    return years.select("year", "n_bouts", "n_mixed", F.round(F.col("n_mixed") / F.col("n_bouts"), 6).alias("mixed_share"), smooth.alias("smoothed_share"))


def appearances(scored: DataFrame, listings: DataFrame, competitors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each list that holds a bout and each unprofiled participant (``subject_id``) in it.

    A bout counts once for each opponent's list that contains it. ``wanted`` (competitor_id) names other
    subjects than the unprofiled.
    """
    rows = listings.select("competitor_id", "bout_id").join(scored, "bout_id").withColumn("subject_id", F.explode("participants")).where("subject_id <> competitor_id and subject_id <> -1")
    if wanted is None:
        return rows.join(competitors.select(F.col("competitor_id").alias("subject_id")), "subject_id", "left_anti")
    return rows.join(wanted.select(F.col("competitor_id").alias("subject_id")), "subject_id", "left_semi")


def confidence(rows: DataFrame) -> DataFrame:
    """Per subject: rows, shares, mean probability, and the confidence that it is in the cohort."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    per = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_rows"), share("cohort_org").alias("co"), share("at_home").alias("jp"), F.avg("probability").alias("p"))
    out = cohort_confidence(F.col("co"), F.col("jp"), F.round("p", 9), F.col("n_rows"))
    return per.select("subject_id", "n_rows", *[F.round(c, 6).alias(n) for c, n in (("co", "cohort_share"), ("jp", "home_share"), ("p", "mean_probability"))], F.round(out, 6).alias("confidence"))


def features(rows: DataFrame) -> DataFrame:
    """Per subject: the feature vector of what opponents' lists tell."""
    single = (F.size("sides") == 2) & F.forall("sides", lambda s: F.size(s) == 1)
    yes = lambda c: F.avg(c.cast("double"))
    per = rows.groupBy("subject_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"), F.count_distinct("competitor_id").cast("double").alias("n_opponents"), yes(F.col("cohort_org")).alias("cohort_share"),
        yes(F.col("at_home")).alias("home_share"), F.avg("size").alias("mean_size"), yes(single).alias("singles_share"), yes(F.size("sides") > 2).alias("multi_share"),
        F.count_distinct("country").cast("double").alias("n_countries"), F.count_distinct("org").cast("double").alias("n_orgs"), F.avg("probability").alias("mean_probability"),
    )
    return per.withColumn("likelihood_ratio", (1 - F.col("mean_probability")) / F.col("mean_probability"))


def summarise_features(vectors: DataFrame, label: str) -> DataFrame:
    """Per feature and class: rows, mean, upper median and share of non-zero values."""
    names = [c for c in vectors.columns if c not in ("subject_id", label)]
    flat = vectors.unpivot(["subject_id", label], names, "feature", "value")
    agg = flat.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") != 0).cast("double")), 6).alias("non_zero_share"))
    return agg.join(upper_medians(flat, ["feature", label], "value"), ["feature", label], "left").select("feature", label, "n", "mean", F.round("upper_median", 6).alias("upper_median"), "non_zero_share")


#: Rules whose precision is measured: (name, feature, at least or below, value).
RULES = [
    *((f"cohort_share>={v}", "cohort_share", ">=", v) for v in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    *((f"home_share>={v}", "home_share", ">=", v) for v in (0.02, 0.04, 0.06, 0.1, 0.2, 0.3)),
    *((f"mean_probability<{v}", "mean_probability", "<", v) for v in (0.05, 0.08, 0.1, 0.15, 0.2, 0.25)),
]


def rule_precision(vectors: DataFrame, label: str) -> DataFrame:
    """Per rule: true and false positives, precision and recall for the boolean ``label``."""
    holds = lambda f, op, v: F.round(F.col(f), 9) >= v if op == ">=" else F.round(F.col(f), 9) < v
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), holds(f, op, v).alias("hit")) for n, f, op, v in RULES]))
    flat = vectors.select(F.col(label).alias("truth"), rules.alias("r")).select("truth", "r.rule", "r.hit")
    agg = flat.groupBy("rule").agg(F.count_if(F.col("hit") & F.col("truth")).alias("true_positives"), F.count_if(F.col("hit") & ~F.col("truth")).alias("false_positives"), F.count_if("truth").alias("n_true"))
    hits = F.col("true_positives") + F.col("false_positives")
    return agg.select("rule", "true_positives", "false_positives", F.round(F.when(hits > 0, F.col("true_positives") / hits), 6).alias("precision"), F.round(F.when(F.col("n_true") > 0, F.col("true_positives") / F.col("n_true")), 6).alias("recall"))


def reclassify(competitors: DataFrame, shares: DataFrame, overrides: list[int] = ()) -> DataFrame:
    """``in_cohort`` anew for "diverse" competitors: more than half of the neighbours in the cohort. One pass over a snapshot."""
    joined = competitors.join(shares.select("competitor_id", "cohort_share"), "competitor_id", "left")
    change = F.col("diverse") & ~F.col("competitor_id").isin(*overrides)
    return joined.select("competitor_id", "diverse", F.col("in_cohort").alias("was_in_cohort"), F.when(change, F.coalesce(F.col("cohort_share"), F.lit(0.0)) > 0.5).otherwise(F.col("in_cohort")).alias("in_cohort"))
