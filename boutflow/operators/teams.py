"""Team combinations and partners, by organisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_outcomes(bouts: DataFrame) -> DataFrame:
    """One row for each (bout_date, org, sides): the winner's place in the order of sides counts."""
    return bouts.select("bout_date", "org", "sides").distinct()


def combinations(bouts: DataFrame) -> DataFrame:
    """org, team (sorted ids as text), members, size, n_bouts: equal sides of two or three members, each side counts."""
    sides = F.col("sides")
    equal = (F.size(sides) == 2) & (F.size(sides[0]) == F.size(sides[1])) & F.size(sides[0]).between(2, 3)
    return distinct_outcomes(bouts).where(equal).select("org", F.explode("sides").alias("members")).groupBy("org", "members").agg(F.count(F.lit(1)).alias("n_bouts")).withColumns({"size": F.size("members"), "team": F.array_join(F.transform("members", lambda x: x.cast("string")), "-")})


def within(bouts: DataFrame, members: DataFrame) -> DataFrame:
    """Bouts with a side all of whose members are among ``members`` (org, competitor_id) of the bout's organisation."""
    sides = bouts.select("bout_id", "org", F.posexplode("sides").alias("side", "ids")).withColumn("competitor_id", F.explode("ids"))
    known = members.select("org", "competitor_id").distinct().withColumn("known", F.lit(True))
    whole = sides.join(known, ["org", "competitor_id"], "left").groupBy("bout_id", "side").agg(F.count_if(F.col("known").isNull()).alias("others")).where("others = 0")
    return bouts.join(whole.select("bout_id").distinct(), "bout_id", "left_semi")


def ends(teams: DataFrame, n: int = 10, parts: int = 64) -> DataFrame:
    """Per organisation and size: the ``n`` most and least frequent teams, with their rank from either end.

    Teams are dealt into parts by hash, each part keeps its own ``n`` at either end, and only these are
    ranked together.
    """
    keys = ["org", "size"]
    dealt = teams.select(*keys, "members", "team", "n_bouts", F.pmod(F.xxhash64("team"), F.lit(parts)).alias("part"))
    out = None
    for end, order in (("top", F.desc("n_bouts")), ("bottom", F.asc("n_bouts"))):
        rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(order, "members"))  # noqa: E731, B023
        some = dealt.withColumn("rank", rank([*keys, "part"])).where(F.col("rank") <= n)
        last = some.withColumn("rank", rank(keys)).where(F.col("rank") <= n).select(*keys, F.lit(end).alias("end"), "rank", "team", "n_bouts")
        out = last if out is None else out.unionByName(last)
    return out


def partners(teams: DataFrame) -> DataFrame:
    """org, member, partner, n_bouts: how often the two were on one side."""
    pairs = teams.select("org", F.explode("members").alias("member"), "members", "n_bouts").select("org", "member", F.explode("members").alias("partner"), "n_bouts").where("member <> partner")
    return pairs.groupBy("org", "member", "partner").agg(F.sum("n_bouts").alias("n_bouts"))


def participation(pairs: DataFrame, best: int = 5) -> DataFrame:
    """Per org and member: partners, appearances, and the ``best`` partners as ``id:n`` text."""
    rank = F.row_number().over(Window.partitionBy("org", "member").orderBy(F.desc("n_bouts"), "partner"))
    named = F.when(F.col("rank") <= best, F.struct("rank", F.concat_ws(":", "partner", "n_bouts").alias("text")))
    agg = pairs.withColumn("rank", rank).groupBy("org", "member").agg(F.count(F.lit(1)).alias("n_partners"), F.sum("n_bouts").alias("appearances"), F.array_sort(F.collect_list(named)).alias("named"))
    return agg.select("org", "member", "n_partners", "appearances", F.array_join(F.transform("named", lambda x: x["text"]), ",").alias("best_partners"))


def never_partners(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per org and active member: how many other active members were never on its side.

    All pairs less the observed ones, counted without laying the pairs out.
    """
    size = active.groupBy("org").agg(F.count(F.lit(1)).alias("n_active"))
    members = active.select("org", F.col("competitor_id").alias("member"))
    seen = pairs.join(members, ["org", "member"], "left_semi").join(members.withColumnRenamed("member", "partner"), ["org", "partner"], "left_semi")
    met = seen.groupBy("org", "member").agg(F.count(F.lit(1)).alias("n_met"))
    out = members.join(met, ["org", "member"], "left").join(size, "org")
    return out.select("org", "member", "n_active", F.coalesce("n_met", F.lit(0)).alias("n_met"), (F.col("n_active") - 1 - F.coalesce("n_met", F.lit(0))).alias("n_never"))


def possible_combinations(active: DataFrame) -> DataFrame:
    """Per org: how many pairs and trios its active members could form."""
    return active.groupBy("org").agg(F.count(F.lit(1)).alias("n_active")).select("org", "n_active", F.expr("n_active * (n_active - 1) div 2").alias("pairs"), F.expr("n_active * (n_active - 1) * (n_active - 2) div 6").alias("trios"))
