"""Scores and rule ladders, as column expressions. The numbers are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed_probability(size: Column, cohort_org: Column, year: Column, home: Column, raised: Column, multi_sided: Column) -> Column:
    """How likely a bout is mixed: a base rate times factors for size, organisation, era, country and sides."""
    p = F.lit(0.28)
    p = p * F.when(size == 2, 0.6).when(size >= 5, 1.8).otherwise(1.0)
    p = p * F.when(cohort_org, 0.2).otherwise(1.0)
    p = p * F.when(year >= 2023, 1.1).when(year >= 2010, 1.0).when(year >= 2000, 0.7).when(year.isNotNull(), 0.3).otherwise(1.0)
    p = p * F.when(home, 0.85).when(raised, 1.2).otherwise(1.0)
    p = p * F.when(multi_sided, 1.3).otherwise(1.0)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))


def cohort_confidence(cohort_share: Column, home_share: Column, p: Column, rows: Column) -> Column:
    """Confidence that an unprofiled competitor is in the cohort; 0.5 without rows. The first rule that holds decides."""
    curve = F.when(p <= 0.309, 0.5 + (0.309 - p) * 0.5).when(p <= 0.426, 0.5 - (p - 0.309) * (0.2 / 0.117)).otherwise(F.greatest(0.3 - (p - 0.426) * 0.5, F.lit(0.05)))
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, 0.5)
        .when(cohort_share >= 0.1, 0.95)
        .when(home_share >= 0.3, 0.95)
        .when(p < 0.15, 0.95)
        .when((p < 0.20) & ((home_share >= 0.3) | (cohort_share >= 0.05)), 0.95)
        .when(p < 0.20, 0.85)
        .when(home_share >= 0.2, 0.80)
        .when((rows >= 50) & (p < 0.30), 0.75)
        .when(p < 0.25, 0.70)
        .when(p < 0.35, 0.55)
        .when(p > 0.50, 0.20)
        .when((p > 0.45) & (home_share < 0.1), 0.15)
        .when(p > 0.55, 0.10)
        .otherwise(curve)
    )


def missing_priority(n: Column, c: Column) -> Column:
    """Priority (1 is first) of fetching a missing profile, from its opponents and the confidence (null: none)."""
    base = F.when(n >= 20, 1).when(n >= 10, 10).when(n >= 5, 30).when(n >= 3, 60 + (4 - n)).otherwise(90 + (2 - n))
    step = lambda x: F.floor(x).cast("int")
    sure = (
        F.when(n >= 20, 1 + F.least(step((1 - c) * 20), F.lit(2)))
        .when(n >= 10, 5 + F.least(step((1 - c) * 30), F.lit(3)))
        .otherwise(10 + F.least(step((1 - c) * 50), F.lit(5)))
    )
    likely = F.when(n >= 20, 10 + step((0.95 - c) * 10)).when(n >= 10, 15 + step((0.95 - c) * 15)).otherwise(20 + step((0.95 - c) * 25))
    return (
        F.when(c.isNull(), base)
        .when((n < 5) & (c >= 0.75), F.greatest(F.lit(40), base))
        .when(n < 5, base)
        .when(c >= 0.95, sure)
        .when(c >= 0.75, likely)
        .when(c >= 0.5, base)
        .when(c >= 0.3, F.greatest(F.lit(70), F.least(F.lit(95), base + 20)))
        .otherwise(F.greatest(F.lit(80), F.least(F.lit(98), base + 40)))
        .cast("int")
    )


def importance(bouts: Column, opponents: Column) -> Column:
    return 0.6 * F.least(bouts / 100.0, F.lit(1.0)) + 0.4 * F.least(opponents / 50.0, F.lit(1.0))


def adjusted(base: Column, importance: Column) -> Column:
    return F.greatest(F.lit(1), base - F.floor(5 * importance).cast("int"))


def stale_year_priority(year: Column, this_year: Column, active: Column, in_cohort: Column) -> Column:
    """Priority of a stale year of bouts: current, previous and older years, for active and inactive competitors."""
    age = this_year - year
    idle = F.when(age == 0, 99).when(age <= 2, 80).otherwise(80 + F.least(age, F.lit(19)))
    busy = F.when(age == 0, 10).when(age == 1, 30).otherwise(F.least(50 + age, F.lit(99)))
    return F.when(~in_cohort, 99).when(active, busy).otherwise(idle).cast("int")


def year_refresh_priority(year: Column, this_year: Column, active: Column, transition: Column, importance: Column) -> Column:
    """Priority of refreshing a year of bouts; in the first two weeks of January the previous year goes first."""
    age = this_year - year
    current = F.when(~active, 999).otherwise(adjusted(F.when(transition, 90).otherwise(10), importance))
    previous = F.when(transition, adjusted(F.lit(10), importance)).otherwise(30)
    return F.when(age == 0, current).when(age == 1, previous).otherwise(F.least(F.lit(99), 50 + age)).cast("int")


def profile_is_stale(age_days: Column, in_cohort: Column) -> Column:
    """Never updated, or older than 90 days in the cohort and 365 outside it."""
    return age_days.isNull() | (age_days > F.when(in_cohort, 90).otherwise(365))


def bouts_are_stale(age_days: Column, year: Column, this_year: Column, active: Column, in_cohort: Column, diverse: Column) -> Column:
    limit = F.when(year == this_year, F.when(active, 14)).when(year == this_year - 1, 90).otherwise(F.when(active, 180).otherwise(365))
    return (in_cohort | diverse) & (age_days.isNull() | F.coalesce(age_days > limit, F.lit(False)))
