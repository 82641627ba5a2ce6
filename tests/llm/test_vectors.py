"""The operators on embeddings against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boutflow.llm import hard_negatives, whitening
from boutflow.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, `component` string"
NAN, INF = float("nan"), float("inf")


def rows_of(n, dims=6, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.normal(size=dims).round(1))], int(rng.integers(labels)), "x", "y") for i in range(n)]


BAD = [(1001, None, 1, "x", "y"), (1002, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1, "x", "y"), (1003, [NAN] * 6, 1, "x", "y"), (1004, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x", "y"), (None, [0.5] * 6, None, None, None)]


def test_query_12_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = QUERIES["op12_hard_negatives"](spark, SF)
    want = con.sql(SQL["op12_hard_negatives"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall()) and got.count() > 0


def mined(rows, anchor, n_pos, n_neg, low, high):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, v)), (label, v))
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, (_, v) in good.items()}
    dot = lambda a, b: sum(p * q for p, q in zip(x[a], x[b]))  # noqa: E731  short vectors end early
    out = []
    for a in filter(anchor, good):
        others = sorted((-dot(a, b), b) for b in good if b != a)
        for s, p in [(-s, b) for s, b in others if good[b][0] == good[a][0]][:n_pos]:
            hard = [(-t, b) for t, b in others if good[b][0] != good[a][0] and low * s <= -100 * t <= high * s][:n_neg]
            out += [(a, p, k + 1, b, s, t) for k, (t, b) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16, 7])
def test_hard_negatives_equal_brute_force(spark, block):
    rows = rows_of(200) + BAD + [(5, [0.0] * 6, 1, "x", "y"), (5, [0.1], 2, "x", "y"), (300, [], 0, "x", "y"), (310, [0.4, 0.1], 0, "x", "y")]
    rows += [(400 + k, [0.3, -0.2, 0.5, 0.1, 0.0, 0.2], k % 2, "x", "y") for k in range(60)]  # a common vector: ties
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(df, lambda i: i % 10 == 0, 3, 4, 30, 90, block=block)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (5000, 4))
    x[:30] += 200
    lists, ids = hard_negatives.Lists(x), np.arange(5000)
    best = hard_negatives.Best(10)
    scored = hard_negatives.scan(lists, ids, np.ones(5000, bool), np.array([3, 1, 2, 2]), [best])
    want = sorted((-(x @ np.array([3, 1, 2, 2]))[i], i) for i in range(5000))[:10]
    assert list(zip(-best.scores, best.ids)) == want and scored < 500


def test_large_scores_are_exact():
    x = np.array([[2**30, 1], [2**30, 2], [-(2**30), 5]])
    assert hard_negatives.Lists(x).scores(np.arange(3), np.array([2**31, 1])).tolist() == [2**61 + 1, 2**61 + 2, -(2**61) + 5]


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(df, lambda i: i % 10 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(BAD, SCHEMA), lambda i: i % 10 == 0).count() == 0


# 13


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(2)
    for d, rank in ((8, 8), (8, 3), (1, 1), (5, 0)):
        x = rng.normal(size=(50, rank)) @ rng.normal(size=(rank, d)) if rank else np.zeros((50, d))
        c = x.T @ x
        factor = whitening.pivoted_cholesky(c)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, c)
        pivots = [int(np.flatnonzero(np.abs(factor[:, k]) > 0)[0]) if rank else 0 for k in range(rank)]
        assert all((factor[:, k + 1 :] == 0).all(axis=1).any() for k in range(rank - 1)) and len(pivots) == rank  # triangular up to the rows' order
        rotated = whitening.one_sided_jacobi(factor)
        values = np.sort(np.linalg.eigvalsh(c))[::-1][:rank]
        assert np.allclose((rotated**2).sum(axis=0), values) and np.allclose(rotated @ rotated.T, c)


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), centred @ u / np.sqrt(e), e / np.trace(v), u


def test_query_13(spark):
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, SF).collect()}
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()))
    deviation, white, explained, _ = plain_whitening([v for _, v in rows], 32)
    assert len(got) == len(rows) * 32
    mine = np.array([[got[i, c + 1].whitened for c in range(32)] for i, _ in rows])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-6
    for k, (i, _) in enumerate(rows):
        r = got[i, 1]
        assert r.n == len(rows) and r.deviation == deviation[k] and r.identity_error < 1e-9
    assert np.allclose([got[rows[0][0], c + 1].explained for c in range(32)], explained, rtol=1e-9)


def test_whitening_of_awkward_rows(spark):
    rows = [r for r in rows_of(40) + rows_of(3)] + BAD + [(None, [0.5] * 6, None, None, None), (77, [1.0, 2.0], 1, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(df)
    out = whitening.whiten(df, model, whitening.identity_error(df, model)).collect()
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    assert model.n == len(good) and len(out) == len(good) * 6 and out[0].identity_error < 1e-9
    vectors = [v + [0.0] * (6 - len(v)) for _, v, *_ in good]
    deviation, *_ = plain_whitening(vectors, 6)
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in out if r.component == 1) == sorted((i is None, i, d) for (i, *_), d in zip(good, deviation.tolist()))


def test_whitening_below_full_rank(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, "x", "y") for i in range(20)], SCHEMA)
    model = whitening.fit(flat)
    assert len(model.eigenvalues) == 1 and whitening.identity_error(flat, model) < 1e-9
    for rows in ([], BAD[:4], [(1, [0.5, 0.5], 1, "x", "y")], [(i, [0.5, 0.5], 1, "x", "y") for i in range(5)], [(1, [], 1, "x", "y")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert whitening.fit(df) is None and whitening.whiten(df, None).count() == 0


def test_deviation_beyond_a_long():
    y = np.array([[2**31, 2**31], [2**40, 1], [3, 4]])
    assert whitening._deviations(y) == [None, None, 25]


def test_is_anchor_takes_the_id(spark):
    df = spark.createDataFrame(rows_of(30), SCHEMA)
    got = hard_negatives.mine(df, lambda i: i == F.lit(4), 1, 1, -1000, 1000)
    assert {r.anchor_id for r in got.collect()} <= {4}
