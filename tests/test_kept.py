"""Tables that are kept up to date, lookups in them, and parses with errors."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from boutflow.functions.bounded import k_smallest
from boutflow.operators import audit, dossier, rollup, search
from boutflow.plans.predictions import Predictions
from boutflow.sources import migrate, pages, store
from boutflow.sources.maintained import ROWS, Maintained, bucket_of
from boutflow.streaming import maintain

UNIT = (["competitor_id", "year"], "competitor_id long, year int")
AS_OF = "2025-01-01 12:00:00"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def as_text(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def recount(rows):
    """The roll-up of ``rows`` by the operator that counts all of them."""
    names = rows.select("competitor_id", "year", "bout_id", F.explode("names").alias("name_used"))
    return rollup.yearly_rollup(rows, names)


@pytest.fixture
def lists(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "lists"), *UNIT, buckets=4)
    store.apply(0, rows_of(spark, [(1, 2020, 10, "A", "X", [1, 2], ["n"]), (1, 2020, 11, None, "Y", [1, 2, 3], []), (1, 2021, 12, "A", None, [1, -1], ["n", "m"]), (2, 2020, 10, "A", "X", [1, 2], None)]))
    return store


def test_upserts_equal_a_recount(spark, lists):
    assert as_text(lists.rollup()) == as_text(recount(lists.rows()))
    assert lists.apply(1, rows_of(spark, [(1, 2020, 13, "B", "X", [1, 4], ["n"])]))
    assert as_text(lists.rollup()) == as_text(recount(lists.rows())) and lists.rows().count() == 3
    # an upsert of an empty list, of a list as it is, and of a new competitor
    units = spark.createDataFrame([(2, 2020), (1, 2021), (5, 2022)], "competitor_id long, year int")
    lists.apply(2, rows_of(spark, [(1, 2021, 12, "A", None, [1, -1], ["n", "m"]), (5, 2022, 14, "C", "Z", [5, 1], [])]), units)
    got = {(r.competitor_id, r.year): (r.n_bouts, r.opponents, r.orgs, r.names) for r in lists.rollup().collect()}
    assert got == {(1, 2020): (1, "4", "B=1", "n=1"), (1, 2021): (1, "-1", "A=1", "m=1,n=1"), (5, 2022): (1, "1", "C=1", "")}
    assert as_text(lists.rollup()) == as_text(recount(lists.rows()))
    # what stayed as it was left no delta
    assert lists._read("counters").where("batch = 2 and competitor_id = 1").count() == 0


def test_a_batch_counts_once(spark, lists):
    change = rows_of(spark, [(1, 2020, 13, "B", "X", [1, 4], ["n"])])
    assert lists.apply(1, change) and not lists.apply(1, change) and not lists.apply(0, change)
    once = as_text(lists.rollup())
    # a batch that failed before its commit left files, which readers don't see and its second run writes over
    _, _, batches = lists._commits()
    lists._write("counters", lists.spark.createDataFrame([(1, 2020, "bouts", "", 99)], "competitor_id long, year int, counter string, key string, n long"), 0, 2)
    assert as_text(lists.rollup()) == once and batches == [0, 1]
    assert lists.apply(2, change) and as_text(lists.rollup()) == once


def test_compaction_keeps_everything(spark, lists):
    lists.apply(3, rows_of(spark, [(1, 2020, 13, "B", "X", [1, 4], ["n"])]))
    before, edges = as_text(lists.rollup()), as_text(lists.edges())
    lists.compact()
    assert lists._commits()[0] == 1 and as_text(lists.rollup()) == before and as_text(lists.edges()) == edges
    assert lists._read("counters").select("batch").distinct().count() == 1
    assert not lists.apply(3, rows_of(spark, [(9, 2020, 1, "B", "X", [9, 4], ["n"])])) and lists.apply(4, rows_of(spark, [(1, 2020, 10, "A", "X", [1, 2], ["n"])]))
    assert as_text(lists.rollup()) == as_text(recount(lists.rows()))


def test_lookup_reads_one_bucket(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "lists"), *UNIT, buckets=8)
    store.apply(0, rows_of(spark, [(i, 2020, 100 + i, "A", "X", [i, i % 7 + 1], []) for i in range(1, 60)]))
    for one, found, end in ((3, store.edges_from(3), "src"), (3, store.edges_to(3), "dst")):
        assert as_text(found) == as_text(store.edges().where(F.col(end) == one)) and found.count() > 0
        bucket = spark.range(1).select(bucket_of(F.lit(one).cast("long"), 8).alias("b")).first().b
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[.*\(bucket#\d+ = {bucket}\)", plan), plan  # a folded constant: other folders aren't read
    assert store.edges_from(12345).count() == 0
    # an upsert looks up what its units gave in their buckets
    plan = store._read("rows", [2, 5])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(2,5\)", plan), plan


def test_empty_store(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "none"), *UNIT)
    assert store.rollup().count() == 0 and store.rows().count() == 0 and store.edges_from(1).count() == 0
    store.compact()
    store.apply(0, rows_of(spark, []))
    assert store.rollup().count() == 0 and store.apply(1, rows_of(spark, [(1, 2020, 10, "A", "X", [1, 2], ["n"])])) and store.rollup().count() == 1


# Stream

ROW = '<table><tr><td>01.02.2020</td><td><span class="MatchType">Bout: </span><span class="MatchCard">{}</span><div class="MatchEventLine"><a href="?id=8&amp;nr=3">Org</a> House Show @ Hall, City, {}.</div></td></tr></table>'
person = lambda i: f'<a href="?id=2&amp;nr={i}">P{i}</a>'
day = lambda n: dt.datetime(2025, 1, n)


def land(spark, folder, rows):
    spark.createDataFrame(rows, maintain.PAGES).coalesce(1).write.mode("append").parquet(folder)


def test_stream_keeps_the_latest_version(spark, tmp_path):
    landing, bad, progress = (str(tmp_path / n) for n in ("landing", "bad", "progress"))
    kept = maintain.store_of(spark, str(tmp_path / "kept"), 4)
    run = lambda: maintain.maintain(spark, landing, kept, bad, progress, files=1)
    page = lambda i, a, b, at, country="X": (i, "u", ROW.format(f"{person(a)} defeats {person(b)}", country), day(at))
    land(spark, landing, [page(1, 1, 2, 5), page(1, 1, 9, 4), page(2, 3, 4, 5), (3, "u", "nothing", day(5)), (None, "u", "x", day(5)), (2, "u", "gone", day(8)), (4, "u", "x", None), page(1, 1, 2, 5)])
    run()
    edges = lambda: {(r.src, r.dst): r.n_bouts for r in kept.edges().collect()}
    assert edges() == {(1, 2): 1, (2, 1): 1, (3, 4): 1, (4, 3): 1}  # the last readable one of the versions in a batch
    land(spark, landing, [page(1, 1, 7, 3), page(2, 3, 5, 6)])
    run()
    assert edges() == {(1, 2): 1, (2, 1): 1, (3, 5): 1, (5, 3): 1}  # an older version that lands later loses
    land(spark, landing, [(2, "u", None, day(9)), page(3, 6, 1, 4, "Y")])
    run()
    assert edges() == {(1, 2): 1, (2, 1): 1, (3, 5): 1, (5, 3): 1, (6, 1): 1, (1, 6): 1}  # an unreadable version changes nothing
    got = sorted(((r.page_id, r.error) for r in spark.read.parquet(bad).collect()), key=lambda x: (x[0] is None, x))
    assert got == [(2, "no markup"), (2, "no row"), (3, "no row"), (4, "no time"), (None, "no id")]
    assert as_text(kept.rollup().drop("names")) == as_text(recount(kept.rows()).drop("names"))


def test_repeated_batches_of_the_stream_change_nothing(spark, tmp_path):
    landing, bad = str(tmp_path / "landing"), str(tmp_path / "bad")
    kept = maintain.store_of(spark, str(tmp_path / "kept"), 4)
    land(spark, landing, [(i, "u", ROW.format(f"{person(i)} defeats {person(i + 1)}", "X"), day(5)) for i in range(1, 8)])
    maintain.maintain(spark, landing, kept, bad, str(tmp_path / "p1"))
    once = as_text(kept.rollup())
    maintain.maintain(spark, landing, kept, bad, str(tmp_path / "p2"))  # progress is lost: the batch comes again under its number
    assert as_text(kept.rollup()) == once and len(once) == 8


# Parses


def test_parse_with_errors(spark):
    good = ROW.format(f"{person(1)} defeats {person(2)} and {person(3)}", "X")
    team = ROW.format(f'<a href="?id=28&amp;nr=5">Duo</a> ({person(1)} and {person(2)}) vs. {person(3)} &amp; Somebody vs. {person(4)}', "X")
    rows = [(1, good), (2, None), (3, " "), (4, "<p>x</p>"), (5, "<table><tr><td>x</td></tr></table>"), (6, ROW.format("-", "X")), (7, good.replace("01.02.2020", "40.02.2020")), (8, good + team)]
    got = pages.parsed(spark.createDataFrame(rows, "page_id long, html string").withColumn("extra", F.lit(1))).collect()
    assert {(r.page_id, r.error) for r in got if r.error} == {(2, "no markup"), (3, "no markup"), (4, "no row"), (5, "no card"), (6, "no participant"), (7, "no date")}
    sides = sorted((r.page_id, r.position, [list(s) for s in r.sides], r.is_victory, len(r.teams)) for r in got if not r.error)
    assert sides == [(1, 0, [[1], [2], [3]], True, 0), (8, 0, [[1], [2], [3]], True, 0), (8, 1, [[1, 2], [-1, 3], [4]], False, 1)]
    assert {r.version for r in got} == {pages.PARSE_VERSION} and {r.extra for r in got} == {1}


def test_reparse_report(spark):
    old = spark.createDataFrame([(1, 1, None), (2, 2, [[1], [2]]), (3, 3, [[1], [2]]), (4, None, None), (5, 2, [[1], [2, 3]])], "bout_id long, version int, sides array<array<long>>")
    new = spark.createDataFrame([(1, 3, [[1], [2]], None), (2, 3, [[1], [2]], None), (3, 3, None, "no date"), (5, 3, [[1], [2], [3]], None)], "page_id long, version int, sides array<array<long>>, error string")
    got = {r.kind: (r.n, r.examples) for r in audit.reparse_report(old, new).collect()}
    assert got == {"all": (5, "1,2,3"), "reparsed": (3, "1,2,5"), "parse_error": (2, "3,4"), "missing_sides": (2, "1,4"), "newly_multi_sided": (1, "5"), "side_differences": (1, "5"), "version 1 to 3": (1, "1"), "version 2 to 3": (2, "2,5")}


def test_k_smallest(spark):
    rows = [("a", x) for x in (5, 3, 9, 3, 1, None)] + [("b", 7), (None, 2), (None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    assert {r.g: list(r.examples) for r in k_smallest(df, ["g"], "v", 3).collect()} == {"a": [1, 3, 3], "b": [7], None: [1, 2]}
    assert k_smallest(df.limit(0), ["g"], "v", 3).count() == 0


# Search


def test_search_by_grams(spark, tmp_path):
    names = [(1, "Anna Lee"), (2, "anna"), (3, "Hanna B"), (4, "Bo"), (5, ""), (6, None), (7, "ANNA"), (8, "Ana"), (9, "Жанна"), (10, "a%_b")]
    df = spark.createDataFrame(names, "competitor_id long, name string").withColumn("in_cohort", F.lit(True))
    search.write_index(search.index(df), str(tmp_path / "grams"), 4)
    for text in ("anna", "ANN", "an", "a", "lee", "zzz", "b", "%_", "жан", "na l"):
        want = [(r.competitor_id, r.name) for r in dossier.find_by_name(df, text).collect()]
        got = [(r.competitor_id, r.name) for r in search.find_one(spark, str(tmp_path / "grams"), df, text, buckets=4).orderBy("rank").collect()]
        assert got == want, text
    many = search.find(spark.createDataFrame([("anna",), ("anna",), ("",), (None,), ("Bo",)], "text string"), search.read_index(spark, str(tmp_path / "grams")), df, 2).collect()
    assert sorted((r.text, r.rank, r.competitor_id) for r in many) == [("Bo", 1, 4), ("anna", 1, 7), ("anna", 2, 2)]


# Columns that came later


def test_filled_column(spark, tmp_path):
    folder, scratch = str(tmp_path / "t"), str(tmp_path / "s")
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "id long, text string")
    fill = lambda df: df.withColumn("size", F.length("text"))
    old, new = rows.where("id < 6"), rows.where("id >= 6").withColumn("size", F.lit(None).cast("int"))  # a null that a later file has is an answer
    migrate.append(old, folder, "id", 16)
    migrate.append(new, folder, "id", 16, 2)
    files = lambda: {f for f in spark.read.parquet(folder).inputFiles()}
    before = files()
    touched = migrate.add_column(spark, folder, scratch, fill, 3)
    assert 0 < len(touched) <= 6
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= files()  # other buckets' files are the same
    got = {r.id: (r.size, r.generation) for r in migrate.read(spark, folder).collect()}
    assert got == {i: ((2, 3) if i < 6 else (None, 2)) for i in range(20)}
    assert migrate.add_column(spark, folder, scratch + "2", fill, 4) == []


def test_column_that_no_file_has(spark, tmp_path):
    migrate.append(spark.createDataFrame([(1, "ab")], "id long, text string"), str(tmp_path / "t"), "id", 4)
    assert migrate.read(spark, str(tmp_path / "t")).columns == ["id", "text", "bucket"]
    migrate.add_column(spark, str(tmp_path / "t"), str(tmp_path / "s"), lambda df: df.withColumn("size", F.length("text")), 1)
    assert migrate.read(spark, str(tmp_path / "t")).select("id", "size", "generation").collect()[0][:] == (1, 2, 1)


# Stored predictions


def test_predictions(spark, tmp_path):
    stored = Predictions(spark, str(tmp_path / "p"))
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "subject_id long")
    asked = []

    def compute(df):
        asked.append(sorted(r.subject_id for r in df.collect()))
        return df.withColumn("confidence", F.lit(0.5))

    assert stored.count() == 0 and stored.valid(AS_OF).count() == 0 and stored.purge(AS_OF) == 0
    stored.put(ids(1).withColumn("confidence", F.lit(0.9)), "2025-01-01 11:00:00")
    stored.put(ids(2).withColumn("confidence", F.lit(0.9)), "2025-01-01 09:00:00")
    stored.put(ids(3).withColumn("confidence", F.lit(0.9)), "2025-01-01 11:30:00", version=0)
    stored.put(ids(4).withColumn("confidence", F.lit(0.9)), "2025-01-01 10:00:00")  # two hours: still holds
    assert sorted(r.subject_id for r in stored.valid(AS_OF).collect()) == [1, 4]
    stored.refresh(ids(1, 2, 3, 3, 5), compute, AS_OF)
    assert asked == [[2, 3, 5]]
    assert {r.subject_id: (r.confidence, r.version) for r in stored.all().collect()} == {1: (0.9, 1), 2: (0.5, 1), 3: (0.5, 1), 4: (0.9, 1), 5: (0.5, 1)}
    stored.put(ids(6).withColumn("confidence", F.lit(0.1)), "2025-01-01 01:00:00", version=0)
    assert stored.count() == 6 and stored.purge(AS_OF) == 1 and stored.count() == 5
    # a snapshot without its mark isn't read
    spark.createDataFrame([(9, 0.1, None, 1)], "subject_id long, confidence double, made_at timestamp, version int").write.parquet(f"{tmp_path}/p/snapshot=99")
    assert stored.count() == 5
    stored.clear()
    assert stored.count() == 0


def test_replaced_lists_stay_the_old_way(spark):
    old = spark.createDataFrame([(1, 2020, 3), (2, 2020, 1)], "competitor_id long, year int, n_bouts long")
    new = spark.createDataFrame([(1, 2020, 5)], "competitor_id long, year int, n_bouts long")
    assert {tuple(r) for r in store.replace_keys(old, new, ["competitor_id", "year"]).collect()} == {(1, 2020, 5), (2, 2020, 1)}
