"""Operators on hand-made frames."""

import datetime as dt
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutflow.functions import dates, glicko, scoring, text
from boutflow.functions.quantiles import exclusive_quartile
from boutflow.operators import audit, classify, dossier, neighbours, network, rollup, teams, workload
from boutflow.plans import ranking, refresh
from boutflow.sources import pages, store


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def listings(spark):
    data = [(100, 1, 2023, "A", "Japan", [100, 200]), (100, 2, 2023, "A", "USA", [100, 200, 300]), (100, 3, 2023, None, "Japan", [100, 200]), (200, 1, 2023, "A", "Japan", [100, 200]), (200, 4, 2024, "B", "UK", [200, 900])]
    return spark.createDataFrame([(c, b, y, o, k, p, c == 100) for c, b, y, o, k, p in data], "competitor_id long, bout_id long, year int, org string, country string, participants array<long>, in_cohort boolean")


@pytest.fixture(scope="module")
def competitors(spark):
    return spark.createDataFrame([(100, "Ann", "Japan", True, False), (200, "Bea", "USA", False, False), (300, "", "UK", True, True)], "competitor_id long, name string, country string, in_cohort boolean, diverse boolean")


def test_rollup(spark, listings):
    names = spark.createDataFrame([(100, 1, 2023, "x")], "competitor_id long, bout_id long, year int, name_used string")
    got = {(r.competitor_id, r.year): r for r in rollup.yearly_rollup(listings, names).collect()}
    r = got[100, 2023]
    assert (r.n_bouts, r.n_opponents, r.opponents, r.countries, r.orgs, r.names) == (3, 2, "200,300", "Japan=2,USA=1", "A=2", "x=1")
    primary = {(r.competitor_id, r.year): r.primary_org for r in rollup.primary_orgs(listings, 0.7).collect()}
    assert primary == {(100, 2023): "Freelancer (Japan)", (200, 2023): "A", (200, 2024): "B"}


def test_modal_ties_go_to_the_smaller_key(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1)], "competitor_id long, key string, n long")
    assert rollup.modal(counts, ["competitor_id"], "k").first().k == "a"


def test_neighbours(listings, competitors):
    edges = neighbours.edge_weights(listings)
    assert {(r.src, r.dst, r.year): r.n_bouts for r in edges.collect()} == {(100, 200, 2023): 3, (100, 300, 2023): 1, (200, 100, 2023): 1, (200, 900, 2024): 1}
    assert {r.competitor_id: r.cohort_share for r in neighbours.cohort_share(edges, competitors).collect()} == {100: 0.5, 200: 0.5, 300: 0.0}
    assert [tuple(r) for r in neighbours.missing(edges, competitors).collect()] == [(900, 1, 1)]
    assert {r.competitor_id for r in neighbours.org_members(listings).where("org = 'A'").collect()} == {100, 200, 300}


def test_network(listings, competitors):
    links = network.links(listings, 1).collect()
    assert [(r.source, r.target, r.n_listed) for r in links] == [(100, 200, 4)]
    nodes = network.nodes(listings, rollup.primary_orgs(listings), competitors.select("competitor_id", "name"), 1).collect()
    assert {(r.year, r.competitor_id, r["group"]) for r in nodes} == {(2023, 100, 0), (2023, 200, 0)}


def test_network_sink(spark, listings, competitors, tmp_path):
    nodes = network.nodes(listings, rollup.primary_orgs(listings), competitors.select("competitor_id", "name"), 1)
    network.write_graph(nodes, network.links(listings, 1), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/links").count() == 1 and spark.read.json(f"{tmp_path}/nodes").count() == 2


def test_exclusive_quartiles(spark):
    import statistics

    for values in ([1, 2, 3, 4, 5, 6], [3, 9], [1, 5, 5, 8, 13, 40, 41]):
        got = [value(spark, exclusive_quartile(F.array(*map(F.lit, values)), i)) for i in (1, 2, 3)]
        assert got == pytest.approx(statistics.quantiles(values, n=4))


def test_histogram_edges(spark):
    rows = [(c, 1, 2020, True, k) for c, n in ((1, 120), (2, 121), (3, 6), (4, 5)) for k in range(n)]
    frame = spark.createDataFrame(rows, "competitor_id long, bout_id long, year int, in_cohort boolean, k int")
    assert {r.bin: r.n_competitors for r in workload.histogram(frame).collect()} == {20: 1, 2: 1, 1: 1}


def test_dates(spark):
    d = lambda s: value(spark, dates.flexible_date(F.lit(s)))
    assert (d("05.06.2001"), d("06.2001"), d("2001"), d("31.02.2001"), d("x")) == (dt.date(2001, 6, 5), dt.date(2001, 6, 1), dt.date(2001, 1, 1), None, None)
    assert value(spark, dates.iso_week_key(F.lit(dt.date(2021, 1, 1)))) == "2020-W53"
    assert value(spark, dates.anniversary(F.lit(dt.date(2000, 2, 29)), F.lit(dt.date(2023, 3, 1)))) == dt.date(2023, 2, 28)
    assert not value(spark, dates.near_anniversary(F.lit(dt.date(2000, 12, 31)), F.lit(dt.date(2023, 1, 1)), 60))
    assert value(spark, dates.year_of_text(F.lit("Unknown"))) is None


def test_text(spark):
    assert value(spark, text.record_text(F.lit(3), F.lit(2), F.lit(3))) == "3-2-3" and value(spark, text.record_text(F.lit(3), F.lit(2), F.lit(0))) == "3-2"
    assert value(spark, text.venue_country(F.lit("Event @ Hall in Town, Region, Germany."))) == "Germany" and value(spark, text.venue_country(F.lit("Event"))) == "Unknown"
    assert value(spark, text.is_proxy_org(F.lit("wrestling in Peru - freelance shows")))


def test_missing_priorities(spark):
    p = lambda n, c: value(spark, scoring.missing_priority(F.lit(n), F.lit(c).cast("double")))
    assert 1 <= p(25, 0.95) <= 3 and p(25, 0.1) >= 70 and 1 <= p(25, 0.55) <= 5 and p(25, None) == 1 and 15 <= p(15, 0.8) <= 18
    assert p(25, 0.95) < p(15, 0.95) < p(7, 0.95) and p(4, 0.9) >= 40


def test_confidence_ladder(spark):
    c = lambda co, jp, p, n: value(spark, scoring.cohort_confidence(*map(F.lit, (co, jp, p)), F.lit(n)))
    assert [c(0.1, 0.0, 0.9, 5), c(0.0, 0.3, 0.9, 5), c(0.0, 0.0, 0.14, 5), c(0.05, 0.0, 0.19, 5), c(0.0, 0.0, 0.19, 5), c(0.0, 0.2, 0.4, 5), c(0.0, 0.0, 0.29, 60), c(0.0, 0.0, 0.24, 5), c(0.0, 0.0, 0.3, 5), c(0.0, 0.0, 0.51, 5), c(0.0, 0.0, 0.46, 5), c(0.0, 0.0, 0.0, 0)] == [0.95, 0.95, 0.95, 0.95, 0.85, 0.80, 0.75, 0.70, 0.55, 0.20, 0.15, 0.5]
    assert c(0.0, 0.15, 0.4, 5) == pytest.approx(0.5 - (0.4 - 0.309) * (0.2 / 0.117))


def test_mixed_probability(spark):
    p = lambda *a: value(spark, scoring.mixed_probability(*map(F.lit, a)))
    assert p(2, True, 2024, True, False, False) == pytest.approx(0.28 * 0.6 * 0.2 * 1.1 * 0.85)
    assert p(6, False, 2012, False, True, True) == pytest.approx(0.28 * 1.8 * 1.2 * 1.3)


def test_published_rating_example(spark):
    to = lambda r, d: ((r - 1500) / glicko.SCALE, d / glicko.SCALE)
    state = spark.createDataFrame([(2020, i, *to(r, d), 0.06, 0, 0, 0) for i, r, d in ((1, 1500, 200), (2, 1400, 30), (3, 1550, 100), (4, 1700, 300))], ranking.STATE)
    games = spark.createDataFrame([(2020, 1, 2, 1.0), (2020, 1, 3, 0.0), (2020, 1, 4, 0.0)], "year int, competitor_id long, opponent_id long, score double")
    r = {r.competitor_id: r for r in ranking.play(games, state).collect()}
    assert r[1].mu * glicko.SCALE + 1500 == pytest.approx(1464.06, abs=0.02) and r[1].phi * glicko.SCALE == pytest.approx(151.52, abs=0.02)
    assert r[1].sigma == pytest.approx(0.05999, abs=1e-5) and (r[1].wins, r[1].losses) == (1, 2)
    assert r[2].phi == pytest.approx(math.hypot(30 / glicko.SCALE, 0.06))
    assert ranking.terms(games, state).first().v == pytest.approx(1.7785, abs=2e-3)


def _volatility(sigma, phi, v, delta, tau=0.5):
    """The root by halving, for one player."""
    a = math.log(sigma**2)

    def f(x):
        e = math.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / tau**2

    low, high = a - 40 * tau, a + 40 * tau  # f falls from above zero to below
    for _ in range(200):
        low, high = ((low + high) / 2, high) if f((low + high) / 2) > 0 else (low, (low + high) / 2)
    return math.exp(low / 2)


def _plain_glicko(games, start=None):
    """games: (period, a, b, decisive); plain loops over players."""
    s = {k: list(v) for k, v in (start or {}).items()}
    for period in sorted({g[0] for g in games}):
        now = [g for g in games if g[0] == period]
        for _, a, b, _ in now:
            for x in (a, b):
                s.setdefault(x, [0.0, 400 / glicko.SCALE, 0.06])
        before = {k: list(v) for k, v in s.items()}
        for x, (mu, phi, sigma) in before.items():
            met = [(b, 1.0 if d else 0.5) for _, a, b, d in now if a == x] + [(a, 0.0 if d else 0.5) for _, a, b, d in now if b == x]
            if met:
                g = [1 / math.sqrt(1 + 3 * before[o][1] ** 2 / math.pi**2) for o, _ in met]
                e = [1 / (1 + math.exp(-gi * (mu - before[o][0]))) for gi, (o, _) in zip(g, met, strict=True)]
                v = 1 / sum(gi * gi * ei * (1 - ei) for gi, ei in zip(g, e, strict=True))
                up = sum(gi * (sc - ei) for gi, ei, (_, sc) in zip(g, e, met, strict=True))
                sigma = _volatility(sigma, phi, v, v * up)
                phi = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
                mu += phi**2 * up
            else:
                phi = math.hypot(phi, sigma)
            s[x] = [mu, phi, sigma]
    return s


def test_ranking_equals_plain_loops(spark):
    rng = np.random.default_rng(1)
    bouts = sorted({(dt.date(2020, int(m), 1 + int(d)), int(a), int(b), bool(w)) for m, d, a, b, w in zip(rng.integers(1, 5, 40), rng.integers(0, 27, 40), rng.integers(0, 6, 40), rng.integers(0, 6, 40), rng.integers(0, 2, 40), strict=True) if a != b})
    frame = spark.createDataFrame(bouts, "bout_date date, a long, b long, is_victory boolean")
    want = _plain_glicko([(d.strftime("%Y-%m"), a, b, w) for d, a, b, w in bouts])
    got = {r.competitor_id: r for r in ranking.run(spark, frame).collect()}
    assert set(got) == set(want)
    for k, (mu, phi, sigma) in want.items():
        assert (got[k].mu, got[k].phi, got[k].sigma) == pytest.approx((mu, phi, sigma), abs=1e-6)
    assert sum(r.wins for r in got.values()) == sum(r.losses for r in got.values())


def test_rankings_and_upsets_of_each_year(spark):
    bouts = [(dt.date(y, m, 1), *ab, True) for y, ab in ((2019, (1, 2)), (2020, (2, 1)), (2021, (3, 1))) for m in (1, 2, 3)] + [(dt.date(2022, 1, 1), 1, 9, True)]
    frame = spark.createDataFrame(bouts, "bout_date date, a long, b long, is_victory boolean")
    state = ranking.by_year(spark, frame, [2019, 2020, 2021], 3)
    alone = {r.competitor_id: r.mu for r in ranking.run(spark, frame.where("year(bout_date) = 2020"), start=ranking.seed(ranking.run(spark, frame.where("year(bout_date) = 2019")), 3)).collect()}
    assert {r.competitor_id: r.mu for r in state.where("year = 2020").collect()} == pytest.approx(alone)
    names = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3)], "competitor_id long, name string")
    orgs = spark.createDataFrame([(1, 2019, "A"), (1, 2020, "B")], "competitor_id long, year int, org string")
    got = {(r.year, r["rank"]): (r.competitor_id, r.org) for r in ranking.table(state, names, orgs, 3).collect()}
    assert got[2019, 1] == (1, "A") and {y for y, _ in got} == {2019, 2020, 2021} and got[2021, 1][0] == 3
    rows = ranking.surprises(frame, state).collect()
    assert len(rows) == len(bouts)
    assert [(r.upset, r.squash) for r in rows if r.bout_date.year == 2022] == [(False, False)]


def test_ranking_by_week_and_over_years_equals_plain_loops(spark):
    rng = np.random.default_rng(2)
    bouts = sorted({(dt.date(int(y), int(m), 1 + int(d)), int(a), int(b), bool(w)) for y, m, d, a, b, w in zip(rng.integers(2019, 2022, 90), rng.integers(1, 4, 90), rng.integers(0, 27, 90), rng.integers(0, 6, 90), rng.integers(0, 6, 90), rng.integers(0, 2, 90), strict=True) if a != b})
    frame = spark.createDataFrame(bouts, "bout_date date, a long, b long, is_victory boolean")
    of = lambda y: [("{0:04}-{1:02}".format(*d.isocalendar()[:2]), a, b, w) for d, a, b, w in bouts if d.year == y]
    ranked = lambda y: {k for k, n in Counter(x for _, a, b, _ in of(y) for x in (a, b)).items() if n >= 8}
    for year in (2020, 2021):
        before = _plain_glicko(of(year - 1))
        want = _plain_glicko(of(year), {k: (before[k][0], before[k][1], 0.06) for k in ranked(year - 1)})
        got = {r.competitor_id: r for r in ranking.by_year(spark, frame, [2020, 2021], 8, by_week=True).where(F.col("year") == year).collect()}
        assert set(got) == set(want)
        for k, (mu, phi, sigma) in want.items():
            assert (got[k].mu, got[k].phi, got[k].sigma) == pytest.approx((mu, phi, sigma), abs=1e-6)


def test_periods_take_the_same_time(spark, tmp_path):
    bouts = [(dt.date(2000 + y, m, 1 + k), k % 7, 7 + k % 5, True) for y in range(2) for m in range(1, 13) for k in range(20)]
    steps = ranking.Steps(spark)
    games = ranking.numbered_periods(ranking.results(spark.createDataFrame(bouts, "bout_date date, a long, b long, is_victory boolean")))
    state, took, sizes = spark.createDataFrame([], ranking.STATE), [], []
    for step in range(1, 13):
        start = time.time()
        state = steps.save(ranking.play(games.where(F.col("step") == step).drop("step", "period"), state))
        took.append(time.time() - start)
        sizes.append(len(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert sum(took[-4:]) < 2 * sum(took[:4]) and max(sizes) < 10


def test_teams(spark):
    d = dt.date(2020, 1, 1)
    bouts = spark.createDataFrame([(1, d, "A", [[1, 2], [3, 4]]), (2, d, "A", [[1, 2], [3, 4]]), (3, dt.date(2020, 1, 2), "A", [[1, 2], [3, 5]]), (4, d, "A", [[1, 2, 3], [4, 5]])], "bout_id long, bout_date date, org string, sides array<array<long>>")
    found = teams.combinations(bouts)
    assert {r.team: r.n_bouts for r in found.collect()} == {"1-2": 2, "3-4": 1, "3-5": 1}
    pairs = teams.partners(found)
    assert {(r.member, r.partner): r.n_bouts for r in pairs.collect()}[1, 2] == 2
    active = spark.createDataFrame([("A", i) for i in (1, 2, 3)], "org string, competitor_id long")
    assert {r.member: r.n_never for r in teams.never_partners(active, pairs).collect()} == {1: 1, 2: 1, 3: 2}
    assert [(r.pairs, r.trios) for r in teams.possible_combinations(active).collect()] == [(3, 1)]


def test_audits(spark):
    bouts = spark.createDataFrame([(1, "A", [[1], [1, 2]], [1, 2], True), (2, "A", [[-1], []], [-1], False)], "bout_id long, org string, sides array<array<long>>, participants array<long>, is_victory boolean")
    assert {r.issue: r.n_bouts for r in audit.quality_issues(bouts).collect()} == {"sentinel": 1, "sides_differ": 0, "empty_side": 1, "no_winner": 1, "on_both_sides": 1, "large": 0}
    new = bouts.where("bout_id = 1").withColumn("sides", F.array(F.array(F.lit(1).cast("long")), F.array(F.lit(2).cast("long")), F.array(F.lit(3).cast("long"))))
    assert {r.kind: r.n for r in audit.parse_differences(bouts, new).collect()} == {"only_old": 1, "only_new": 0, "sides": 2, "victory": 1, "newly_multi_sided": 1, "all": 2}
    rows = spark.createDataFrame([(1, 2025, 0), (1, 2026, 0), (2, 2025, 0), (2, 2020, 0), (3, 2025, 4)], "competitor_id long, year int, n_bouts long")
    only = audit.stub_only(rows, (2025, 2026))
    assert [r.competitor_id for r in only.collect()] == [1]
    gone, left = audit.purge(rows, only)
    assert (gone.count(), left.count()) == (2, 3)


def test_search_ignores_case(competitors):
    assert [r.name for r in dossier.find_by_name(competitors, "A").collect()] == ["Ann", "Bea"]
    assert dossier.find_by_name(competitors, "bea", cohort_only=True).count() == 0


def test_reclassify(competitors, listings):
    shares = neighbours.cohort_share(neighbours.edge_weights(listings), competitors)
    assert {r.competitor_id: r.in_cohort for r in classify.reclassify(competitors, shares).collect()} == {100: True, 200: False, 300: False}
    assert classify.reclassify(competitors, shares, [300]).where("competitor_id = 300").first().in_cohort


def stored(spark, *rows):
    return spark.createDataFrame([(c, y, n, None if at is None else dt.datetime.fromisoformat(at)) for c, y, n, at in rows], "competitor_id long, year int, n_bouts long, last_updated timestamp")


def items(plan):
    return {(r.operation, r.object_id, r.year): (r.priority, r.stage) for r in plan.collect()}


def test_plan_order_and_first_wins(spark, listings, competitors):
    updates = spark.createDataFrame([(100, dt.datetime(2020, 1, 1))], "competitor_id long, last_updated timestamp")
    edges = neighbours.edge_weights(listings)
    guess = spark.createDataFrame([(900, 0.96)], "subject_id long, confidence double")
    lists = stored(spark, (100, 2023, 3, "2025-05-30"), (200, 2024, 1, None))
    plan = refresh.build(competitors, listings, lists, updates, neighbours.missing(edges, competitors), guess, neighbours.org_frequency(listings), 2025, "2025-06-01 00:00:00")
    rows = [tuple(r) for r in refresh.in_order(plan).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4] or 0))
    keys = [(r[2], r[3], r[4]) for r in rows]
    assert len(set(keys)) == len(keys) and ("refresh_profile", "900", None) in keys and ("refresh_bouts", "300", 2025) in keys
    assert ("refresh_bouts", "100", 2025) in keys and refresh.in_order(plan, 2).count() == 2
    # 900 occurs in the list of 200 alone, which is outside the cohort
    inside = competitors.where("in_cohort")
    assert neighbours.missing(edges, competitors, inside).count() == 0 and neighbours.missing(edges, competitors).count() == 1


def test_lists_are_judged_by_their_own_time(spark, listings, competitors):
    fresh = spark.createDataFrame([(100, dt.datetime(2025, 5, 31)), (200, dt.datetime(2025, 5, 31)), (300, dt.datetime(2025, 5, 31))], "competitor_id long, last_updated timestamp")
    none, guess = spark.createDataFrame([], "missing_id long, n_referrers long, appearances long"), spark.createDataFrame([], "subject_id long, confidence double")
    orgs = spark.createDataFrame([], "org string, n_bouts long")
    build = lambda lists, **modes: items(refresh.build(competitors, listings, lists, fresh, none, guess, orgs, 2025, "2025-06-01 00:00:00", **modes))
    # 100 is active: 180 days for old years, 90 for 2024, 14 for 2025; a stub counts as a list of its year
    aged = stored(spark, (100, 2023, 3, "2024-12-04"), (100, 2024, 0, "2025-03-02"), (100, 2025, 0, "2025-05-18"), (200, 2023, 1, None), (300, 2025, 0, "2025-05-30"))
    assert build(aged) == {("refresh_bouts", "100", 2024): (30, 4)}
    stale = stored(spark, (100, 2023, 3, "2024-12-02"), (100, 2025, 0, "2025-05-17"), (300, 2025, 0, "2025-05-17"))
    # the profile is fresh, the lists aren't; 300 is inactive, but as a diverse one it counts as active for this year
    assert build(stale) == {("refresh_bouts", "100", 2023): (52, 4), ("refresh_bouts", "100", 2025): (10, 4), ("refresh_bouts", "300", 2025): (10, 6)}
    never = stored(spark, (100, 2021, 0, None), (100, 2022, 0, None), (100, 2023, 3, None), (300, 2025, 0, "2025-05-30"))
    assert build(never) == {("refresh_all_bouts", "100", None): (10, 4)}  # with this year's, which is lacking
    assert build(aged, force=True, only_bouts=True) == {("refresh_all_bouts", "100", None): (10, 4), ("refresh_bouts", "300", 2025): (999, 4)}
    january = build(stored(spark, (100, 2023, 3, "2025-05-30"), (300, 2025, 0, "2025-05-30")), transition=True)
    assert january == {("refresh_bouts", "100", 2025): (90, 4)}


def test_restricted_plan_is_built_for_its_targets(spark, listings, competitors):
    updates = spark.createDataFrame([(100, dt.datetime(2025, 5, 31))], "competitor_id long, last_updated timestamp")
    lists = stored(spark, (100, 2023, 3, None), (200, 2023, 1, None))
    targets = spark.createDataFrame([(200,), (900,), (900,)], "competitor_id long")
    orgs = spark.createDataFrame([("A", None)], "org string, last_updated timestamp")
    got = items(refresh.restricted(competitors, listings, lists, updates, targets, 2025, "2025-06-01 00:00:00", organisations=orgs))
    # 200 is outside the cohort: its profile and this year's list come, its old lists don't; organisations are those of its lists
    assert got == {("refresh_profile", "200", None): (10, 2), ("refresh_profile", "900", None): (10, 1), ("refresh_bouts", "200", 2025): (10, 4), ("refresh_org", "A", None): (95, 5), ("refresh_org", "B", None): (95, 5)}


def test_stub_audit(spark, competitors):
    careers = spark.createDataFrame([(100, 2020), (300, 2024)], "competitor_id long, career_start int")
    lists = stored(spark, (100, 2023, 5, None), (100, 2022, 0, "2025-05-01"), (300, 2024, 2, None), (300, 2019, 0, None), (300, 2020, 0, "2020-01-01"), (300, 2021, 0, "2020-01-01"), (200, 2023, 1, None))
    got = {r.competitor_id: (r.n_stubs, r.single, r.several, r.career_length, r.stub_years) for r in audit.stub_audit(lists, competitors, careers, 2025, "2025-06-01 00:00:00").collect()}
    assert got == {100: (0, True, False, 5, ""), 300: (3, False, True, 1, "2019,2020,2021")}


def test_latest_org_of_ended_careers(spark, competitors):
    primary = spark.createDataFrame([(100, 2024, "A"), (200, 2024, "B"), (200, 2025, "C"), (300, 2019, "D")], "competitor_id long, year int, primary_org string")
    ends = spark.createDataFrame([(100, 2024)], "competitor_id long, career_end int")
    got = {r.competitor_id: r.latest_org for r in rollup.latest_orgs(competitors, primary, 2025, ends).collect()}
    assert got == {100: "Inactive", 200: "C", 300: "Inactive"}


def test_prediction_cache(spark):
    at = dt.datetime(2025, 1, 1, 12)
    cache = spark.createDataFrame([(1, 0.9, at - dt.timedelta(hours=1), 1), (2, 0.9, at - dt.timedelta(hours=3), 1), (3, 0.9, at, 0)], "subject_id long, confidence double, made_at timestamp, version int")
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    asked = []

    def compute(ids):
        asked.extend(sorted(r.subject_id for r in ids.collect()))
        return ids.withColumn("confidence", F.lit(0.5))

    new = refresh.refresh_predictions(cache, wanted, compute, 1, str(at))
    assert {r.subject_id: r.confidence for r in new.collect()} == {1: 0.9, 2: 0.5, 3: 0.5} and asked == [2, 3]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "X"), (2, "b", "Y")], "competitor_id long, name string, country string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "Z")], "competitor_id long, name string, country string")
    assert {tuple(r) for r in store.upsert_profiles(old, new).collect()} == {(1, "a", "X"), (2, "B", "Y"), (3, "c", "Z")}
    lists = spark.createDataFrame([(1, 2020, 3), (1, 2021, 0)], "competitor_id long, year int, n_bouts long")
    spans = store.year_spans(spark.createDataFrame([(1, 2019, None), (2, None, 2020)], "competitor_id long, first_year int, last_year int"), 2022)
    assert {(r.competitor_id, r.year) for r in store.missing_stubs(spans, lists, "2022-01-01").collect()} == {(1, 2019), (2, 2020)}
    assert store.drop_empty(lists, lists).count() == 1
    store.write_lists(lists, str(tmp_path / "lists"))
    store.write_lists(lists.where("year = 2020").withColumn("n_bouts", F.lit(9).cast("long")), str(tmp_path / "lists"))
    assert {(r.year, r.n_bouts) for r in store.read_lists(spark, str(tmp_path / "lists")).collect()} == {(2020, 9), (2021, 0)}


ROW = '<tr><td>05.06.2023</td><td><span class="MatchType">Tag: </span><span class="MatchCard">{}</span><div class="MatchEventLine"><a href="?id=8&amp;nr=77">Org</a> Event @ Hall, City, Japan.</div></td></tr>'
LINK = '<a href="?id={}&nr={}">{}</a>'


def link(n, kind=2):
    return LINK.format(kind, n, f"Name{n}")


@pytest.mark.parametrize(
    ("card", "sides", "won"),
    [
        (f"{link(1)} defeats {link(2)}", [[1], [2]], True),
        (f"{link(2)} &amp; {link(1)} defeat {link(4)} &amp; Stranger (10:00)", [[1, 2], [-1, 4]], True),
        (f"{link(1)} vs. {link(2)} vs. {link(3)}", [[1], [2], [3]], False),
        (f"{link(1)} defeats {link(2)} and {link(3)}", [[1], [2], [3]], True),
        (f"{link(9, 28)} ({link(2)} &amp; {link(1)}) defeat {link(3)} &amp; {link(4)}", [[1, 2], [3, 4]], True),
    ],
)
def test_bout_markup(spark, card, sides, won):
    row = pages.bouts(spark.createDataFrame([(1, "u", f"<table>{ROW.format(card)}</table>")], "page_id long, url string, html string")).first()
    assert ([list(s) for s in row.sides], row.is_victory, row.bout_date, row.country) == (sides, won, dt.date(2023, 6, 5), "Japan")
    if "id=28" in card:
        assert [(t.team_id, list(t.members)) for t in row.teams] == [(9, [1, 2])]


def test_profile_pages(spark):
    html = '<div class="InformationBoxTitle">Gender:</div>\n<div class="InformationBoxContents">Female</div><div class="InformationBoxTitle">Current gimmick:</div><div class="InformationBoxContents"><b>Ann</b> A</div><select><option value="2020"><option value="2021"><option value="x"></select>'
    frame = spark.createDataFrame([(1, "u", html), (2, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.labelled(frame).select("page_id", pages.profile_name(F.col("profile")).alias("name"), pages.in_cohort(F.col("profile"), F.col("page_id")).alias("c")).collect()}
    assert (got[1].name, got[1].c, got[2].name, got[2].c) == ("Ann A", True, "Unknown", False)
    assert pages.year_options(frame).where("page_id = 1").first().years == [2020, 2021]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from boutflow.streaming.ingest import current, ingest

    def land(k, rows):
        pages = [(i, "u", html, dt.datetime(2025, 1, day)) for i, html, day in rows]
        spark.createDataFrame(pages, "page_id long, url string, html string, fetched_at timestamp").write.parquet(f"{tmp_path}/landing/{k}")
        ingest(spark, f"{tmp_path}/landing/*", f"{tmp_path}/bouts", f"{tmp_path}/bad", f"{tmp_path}/progress")
        return {r.page_id: [list(s) for s in r.sides] for r in current(spark, f"{tmp_path}/bouts").collect()}

    assert current(spark, f"{tmp_path}/bouts").count() == 0
    assert land(1, [(1, ROW.format(f"{link(1)} defeats {link(2)}"), 5), (2, "nothing", 5)]) == {1: [[1], [2]]}
    assert land(2, [(1, ROW.format(f"{link(1)} defeats {link(3)}"), 6), (3, ROW.format(f"{link(5)} vs. {link(6)}"), 5)]) == {1: [[1], [3]], 3: [[5], [6]]}
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 1
    # what page 3 gave before stays, and an older version of page 1 that lands later loses
    got = land(3, [(3, "nothing any more", 7), (4, ROW.format(f"{link(7)} defeats {link(8)}"), 7), (1, ROW.format(f"{link(1)} defeats {link(9)}"), 4)])
    assert got == {1: [[1], [3]], 3: [[5], [6]], 4: [[7], [8]]}
    assert sorted((r.page_id, r.error) for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [(2, "no row"), (3, "no row")]
    ingest(spark, f"{tmp_path}/landing/*", f"{tmp_path}/bouts", f"{tmp_path}/bad", f"{tmp_path}/again")  # progress is lost: all comes again as batch 0
    assert {r.page_id: [list(s) for s in r.sides] for r in current(spark, f"{tmp_path}/bouts").collect()} == got
