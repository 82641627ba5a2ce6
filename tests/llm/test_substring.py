"""Repeated passages against brute force, and on awkward rows."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boutflow.llm import substring_dedup
from boutflow.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words string, `__text` string, kept_text int"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(SQL["op11_substring_dedup"])
    got = QUERIES["op11_substring_dedup"](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum(r.n_removed for r in got) > 0


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    rank = lambda i: substring_dedup.LAST if i is None else i
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < rank(i) for p in range(k, k + window)}
        out.append((i is None, i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def got_of(spark, rows, window, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = substring_dedup.remove_repeats(df, window, **options).collect()
    for r in out:
        assert sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2])) == r.n_removed
    return sorted([(r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out], key=str)


@pytest.mark.parametrize("window,options", [(13, {}), (13, {"part_bytes": 700, "most": 3}), (5, {"part_bytes": 1500}), (7, {"most": 1})])
def test_random_passages(spark, window, options):
    rng = np.random.default_rng(window)
    vocabulary = [*"abcdefgh", "é", "日本", "Longer", "..", "\x00", "x" * 50]
    passages = [" ".join(rng.choice(vocabulary, rng.integers(3, 40))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary, rng.integers(0, 25))))
        rows.append((int(rng.integers(0, 120)), rng.choice([" ", "\n", " \t\r\x0b\x0c "]).join(parts), "n", "t", 1))
    common = " ".join(f"c{k}" for k in range(20))
    rows += [(1000 + k, f"{k} {common} {k * k}", "n", "t", 1) for k in range(70)]  # one passage in a third of all rows
    rows += [(None, passages[0], None, None, None), (None, passages[0] + " end", None, None, None), (2000, None, None, None, None), (2001, "", None, None, None), (2002, " \n ", None, None, None)]
    rows += rows[:10]
    assert got_of(spark, rows, window, **options) == brute(rows, window)


def test_long_repeated_and_reverse_ordered_rows(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in rng.integers(0, 300, 40_000))
    rows = [(9, long, None, None, None), (5, "start " + long[: len(long) // 2], None, None, None), (7, "z " * 30_000, None, None, None), (8, "z " * 12, None, None, None), (6, "z " * 20 + "y", None, None, None)]
    assert got_of(spark, rows, 13) == brute(rows, 13)


def test_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got_of(spark, [(1, None, None, None, None), (None, "a b", None, None, None)], 13) == brute([(1, None), (None, "a b")], 13)


def test_kept_columns_make_way(spark):
    df = spark.createDataFrame([(1, "a b c", "n", "t", 1)], SCHEMA)
    out = substring_dedup.remove_repeats(df, keep=df.columns)
    assert out.columns == ["doc_id", "text", "__text", "n_words", "n_removed", "removed", "kept_text"]
    assert out.select(F.sha2("kept_text", 256)).first()[0] == hashlib.sha256(b"a b c").hexdigest()


def test_subtree_orders_windows_and_finds_equal_ones():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2, (400, 5)).astype(np.int32)
    lead = rng.integers(0, 2, 400)
    order, common = substring_dedup.subtree(codes, lead)
    turned = [(*np.roll(c, -x).tolist(), int(x)) for c, x in zip(codes, lead)]
    assert [turned[k] for k in order] == sorted(turned)
    for k in range(1, 400):
        a, b = turned[order[k - 1]], turned[order[k]]
        same = next((j for j in range(6) if a[j] != b[j]), 6)
        assert common[k] == same


def test_groups_keep_prefixes_whole(monkeypatch):
    monkeypatch.setattr(substring_dedup, "TREE_WINDOWS", 10)
    rng = np.random.default_rng(6)
    prefix, size = rng.integers(0, 30, 200), rng.integers(1, 9, 200)
    groups = list(substring_dedup._groups(prefix, size))
    assert sorted(np.concatenate(groups).tolist()) == list(range(200)) and len(groups) > 20
    assert sum(len(set(prefix[g].tolist())) for g in groups) == len(set(prefix.tolist()))
    assert all(size[g].sum() <= 10 or len(set(prefix[g].tolist())) == 1 for g in groups)


def test_anchors_are_the_same_in_equal_windows():
    text = b"one two three four five six seven eight nine ten eleven twelve thirteen"
    found = [substring_dedup.Anchored(substring_dedup.Words([lead + text]), 13) for lead in (b"", b"some other words before this ")]
    place = [f.anchors[-1] - f.windows[f.run_first[-1] + f.run_size[-1] - 1] for f in found]
    assert place[0] == place[1]
