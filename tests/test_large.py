"""Work that would be done twice, or in pieces too small, on large tables."""

import datetime as dt

from pyspark.sql import functions as F

from boutflow import queries
from boutflow.operators import audit
from boutflow.sources import maintained, pages, steps
from boutflow.sources.tables import Tables
from boutflow.streaming import maintain
from tests.test_kept import ROW, UNIT, person, rows_of

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_that_stay_cancel_before_their_pairs_are_laid_out(spark):
    old = [(1, 2020, 10, "A", "X", [1, 2, 3], ["n"]), (1, 2020, 11, "A", "X", [1, 2], None)]
    new = [(1, 2020, 10, "A", "X", [1, 2, 3], ["n"]), (1, 2020, 11, "B", "X", [1, 2], None), (1, 2020, 12, None, "X", [1, 4], [])]
    found = maintained.changed(rows_of(spark, new), rows_of(spark, old))
    assert sorted((r.bout_id, r.org, r.n) for r in found.where("bout_id < 12").collect()) == [(11, "A", -1), (11, "B", 1)] and found.count() == 3
    assert {(r.src, r.dst): r.n_bouts for r in maintained.edges_of(found).collect()} == {(1, 4): 1}
    assert {(r.counter, r.key): r.n for r in maintained.counts_of(found).collect()} == {("bouts", ""): 1, ("countries", "X"): 1, ("orgs", "A"): -1, ("orgs", "B"): 1}
    assert exchanges(maintained.edges_of(maintained.changed(rows_of(spark, new), None))) == 1  # a first load adds its pairs up once


def test_a_null_year_keeps_its_own_rollup(spark):
    counters = spark.createDataFrame([(1, None, "bouts", "", 2), (1, 2020, "bouts", "", 1), (1, 2020, "orgs", "A", 1)], maintained._COUNTERS)
    edges = spark.createDataFrame([(1, 2, None, 2), (1, 3, 2020, 1), (1, 3, 2020, -1)], maintained._EDGES)
    got = {(r.year, r.n_bouts, r.n_opponents, r.opponents, r.orgs) for r in maintained.as_rollup(counters, edges).collect()}
    assert got == {(None, 2, 1, "2", ""), (2020, 1, 0, "", "A=1")}


def test_an_upsert_reads_the_edges_it_wrote(spark, tmp_path, monkeypatch):
    calls, count = [], maintained.edges_of
    monkeypatch.setattr(maintained, "edges_of", lambda rows: calls.append(1) or count(rows))
    store = maintained.Maintained(spark, str(tmp_path / "s"), *UNIT, buckets=4)
    store.apply(0, rows_of(spark, [(1, 2020, 10, "A", "X", [1, 2], ["n"]), (None, 2020, 10, "A", "X", [1, 2], ["n"])]))
    assert len(calls) == 1 and store.rows().count() == 1  # a row without its unit isn't stored
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(store._read("edges_out")._jdf).isDefined()


def test_landing_files_follow_the_cores_and_not_the_rows(spark):
    from boutflow import queries_kept

    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if each partition were large
    try:
        files = spark.read.parquet(queries_kept._landed(Tables(spark, SF))).inputFiles()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) <= 3 * spark.sparkContext.defaultParallelism


def test_copies_of_a_version_count_once(spark, tmp_path):
    page = (1, "u", ROW.format(f"{person(1)} defeats {person(2)}", "X"), dt.datetime(2025, 1, 1))
    for _ in range(2):
        spark.createDataFrame([page, page, (2, "u", "gone", dt.datetime(2025, 1, 1)), (2, "u", "gone", dt.datetime(2025, 1, 1))], maintain.PAGES).write.mode("append").parquet(str(tmp_path / "landing"))
    kept = maintain.store_of(spark, str(tmp_path / "kept"), 4)
    maintain.maintain(spark, str(tmp_path / "landing"), kept, str(tmp_path / "bad"), str(tmp_path / "progress"))
    assert [(r.n_bouts, r.opponents) for r in kept.rollup().orderBy("competitor_id").collect()] == [(1, "2"), (1, "1")] and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_links_of_odd_markup(spark):
    cards = {
        '<a class="x" href="?id=2&nr=5">Bob</a> vs. <a href="?id=2&amp;nr=6">Al</a>': ([[5], [6]], False), '<a href="?x=1&amp;id=2&nr=7">A</a> defeats <a href="/nr=3?id=28&nr=9">T</a> (<a href="?id=2&nr=8">B</a> and <a href="?id=2&nr=4">C</a>)': ([[7], [4, 8]], True),
        '<a href="?id=8&nr=1">Org</a> &amp; <a href="?id=2">No number</a>': ([[-1]], False), " Tom  \t& &quot;Jim&quot; vs. ( Al ) and <b>": ([[-1], [-1]], False), "": ([], False),
    }
    rows = spark.createDataFrame([(c,) for c in cards], "card string").select("card", pages.fold_sides(pages.tokens(F.col("card"))).alias("s"))
    got = {r.card: (r.s.sides, r.s.is_victory) for r in rows.collect()}
    assert got == cards
    kinds = spark.createDataFrame([(next(iter(cards)),)], "card string").select(pages.tokens(F.col("card")).alias("t")).first().t
    assert [(k.kind, k.id) for k in kinds] == [("competitor", 5), ("versus", None), ("competitor", 6)]


def saves(monkeypatch):
    found, save = [], steps.Steps.save
    monkeypatch.setattr(steps.Steps, "save", lambda self, df: found.append(df.columns) or save(self, df))
    return found


def test_feature_vectors_are_made_once(spark, monkeypatch):
    t = Tables(spark, SF)
    assert t.bouts.count() and t.listings.count()
    found = saves(monkeypatch)
    df = queries.QUERIES["feature_summary"](spark, SF)
    assert [c for c in found if "subject_id" in c] and "bout_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_reparse_report_reads_its_parse_once(spark, monkeypatch):
    html = [ROW.format(f"{person(1)} defeats {person(2)}", "X"), "gone", None]
    parsed = pages.parsed(spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string"))
    old = spark.createDataFrame([(0, 1, None), (1, 3, [[1], [2]]), (2, None, None), (7, 2, [[1], [2]])], "bout_id long, version int, sides array<array<long>>")
    found = saves(monkeypatch)
    df = audit.reparse_report(old, parsed)
    assert len(found) == 1 and "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.kind: (r.n, r.examples) for r in df.collect()} == {"all": (4, "0,1,2"), "reparsed": (1, "0"), "parse_error": (3, "1,2,7"), "missing_sides": (2, "0,2"), "newly_multi_sided": (0, ""), "side_differences": (0, ""), "version 1 to 3": (1, "0")}
