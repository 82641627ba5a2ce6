"""Hard negatives by Fagin's threshold algorithm.

A vector's entries become floor(256 entry), so scores are whole numbers. All rows, in blocks, meet all
anchors, in blocks. Where two blocks meet, the rows are sorted by each dimension once. An anchor then goes
down all lists at a time, from the end that its sign makes large (sorted access), scores each row that comes
up for the first time in full (random access), and adds up what a row further down can score at most: the
threshold. It stops once that is strictly below the score that the last of each window's best has, or below
what the window admits. Accesses come in rounds of doubling depth. The blocks' best are merged by window.
First an anchor's positives are found so (a window of the rows of its label), then the negatives of each
positive in one scan of the anchor.

Rows whose id, label or vector is null, or whose vector has a null or non-finite entry, take no part. Of rows
that repeat an id the one with the smallest (label, vector) takes part. Vectors shorter than the longest are
filled with zeros. Ties go to the smaller id. Anchors without a positive, and positives whose range of scores
holds no negative (negative scores do not: the range is empty), give no rows, as does an empty table. Scores
are to fit a long. Each block is of BLOCK rows on average, by a hash of the id, whatever labels and vectors are
common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutflow.llm.common import bounded_batches, cut_lineage
from boutflow.llm.vectors import dimensions, is_usable, scaled

SCALE = 256
#: Rows, or anchors, in a block on average.
BLOCK = 2048
#: Depth of the first round of sorted access.
FIRST_DEPTH = 16


class Best:
    """The first ``k`` of the rows that are offered, by falling score and rising id, whose score is within [least, most]."""

    def __init__(self, k: int, least: float = -np.inf, most: float = np.inf):
        self.k, self.least, self.most = k, least, most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.least) & (scores <= self.most)
        if len(self.scores) >= self.k:
            good &= scores >= self.scores[-1]
        if good.any():
            s, i = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
            first = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[first], i[first]

    def settled(self, threshold: int) -> bool:
        """No row that scores ``threshold`` at most can come in any more."""
        return threshold < self.least or len(self.scores) >= self.k and threshold < self.scores[-1]


class Lists:
    """A block of rows, sorted by each dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.largest = float(np.abs(x).max(initial=0))
        self.double = x.astype(np.float64)

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        bound = self.largest * float(np.abs(a).max(initial=0)) * len(a)
        if bound < 2.0**53:  # doubles add whole numbers exactly up to here
            return (self.double[rows] @ a.astype(np.float64)).astype(np.int64)
        if bound < 2.0**63:
            return self.x[rows] @ a
        raise ArithmeticError("scores beyond a long")

    def accessed(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Rounds of (rows seen for the first time, their scores, the threshold of all others)."""
        n, up, down = len(self.x), np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, depth = np.zeros(n, bool), 0
        if not len(up) and not len(down):  # every row scores 0
            yield np.arange(n), np.zeros(n, np.int64), 0
            return
        while depth < n and not seen.all():
            to = min(n, 2 * depth or FIRST_DEPTH)
            new = np.zeros(n, bool)
            new[self.order[n - to : n - depth, up].ravel()] = True
            new[self.order[depth:to, down].ravel()] = True
            rows, depth = np.flatnonzero(new & ~seen), to
            seen |= new
            threshold = sum(int(a[d]) * int(self.sorted[n - to, d]) for d in up) + sum(int(a[d]) * int(self.sorted[to - 1, d]) for d in down)
            yield rows, self.scores(rows, a), threshold


def scan(lists: Lists, ids: np.ndarray, admitted: np.ndarray, a: np.ndarray, windows: list[Best]) -> int:
    """Fills ``windows`` with the best ``admitted`` rows for the anchor ``a``; returns how many rows it scored."""
    scored = 0
    for rows, scores, threshold in lists.accessed(a):
        scored += len(rows)
        good = admitted[rows]
        for w in windows:
            w.offer(scores[good], ids[rows[good]])
        if all(w.settled(threshold) for w in windows):
            break
    return scored


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks(), dtype=np.int64)


def _in_cell(dims: int, make: Callable, admits: Callable, schema: list[str], anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """A block of anchors against a block of rows; ``make`` gives an anchor's windows as (first columns, Best)."""
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        ids, labels = _ints(rows, "id"), _ints(rows, "label")
        lists, a = Lists(scaled(rows.column("vector"), dims, SCALE)), scaled(anchors.column("vector"), dims, SCALE)
        for k, r in enumerate(anchors.drop_columns(["vector"]).to_pylist()):
            windows = make(r)
            if windows:
                scan(lists, ids, admits(r, ids, labels), a[k], [w for _, w in windows])
            out += [(*head, int(i), int(s)) for head, w in windows for i, s in zip(w.ids, w.scores, strict=True)]
    columns = list(zip(*out, strict=True)) or [[]] * len(schema)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(schema, columns, strict=True)})


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], columns: list[str]) -> DataFrame:
    """Each block of ``anchors`` with each block of ``rows``."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("__a", block(blocks[0])).withColumn("__r", every(blocks[1]))
    rows = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns]).toDF(*rows.columns)  # both sides can be of one frame: cogroup needs columns of their own
    r = rows.withColumn("__r", block(blocks[1])).withColumn("__a", every(blocks[0]))
    # the keys go along with the groups and are dropped there
    inner = lambda left, right: work(left.drop_columns(["__a", "__r"]), right.drop_columns(["__a", "__r"]))
    return a.groupBy("__a", "__r").cogroup(r.groupBy("__a", "__r")).applyInArrow(inner, ", ".join(f"{c} long" for c in columns))


def _first(found: DataFrame, keys: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The first ``k`` of each key, with ``rank``; a key has ``k`` rows from each block at most."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_col))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _positive_window(k: int, r: dict) -> list[tuple[tuple, Best]]:
    return [((r["id"],), Best(k))]


def _negative_windows(k: int, low: int, high: int, r: dict) -> list[tuple[tuple, Best]]:
    """Scores from ``low`` to ``high`` hundredths of the positive's."""
    return [((r["id"], p["positive_id"], p["positive_score"]), Best(k, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100)) for p in r["positives"]]


def _same_label(r: dict, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return (labels == r["label"]) & (ids != r["id"])


def _other_label(r: dict, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return labels != r["label"]


def mine(
    rows: DataFrame, is_anchor: Callable[[Column], Column], n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor (``is_anchor`` of the id) the best ``n_positives`` of its label, and for each of them the best
    ``n_negatives`` of other labels whose score is from ``low`` to ``high`` hundredths of the positive's.
    """
    bounded_batches(rows.sparkSession)
    usable = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & is_usable(F.col(vector_col)))
    one = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))).alias("r"))
    base = cut_lineage(one.select("id", "r.label", "r.vector"))
    anchors = base.where(is_anchor(F.col("id")))
    dims, n, n_anchors = dimensions(base, "vector"), base.count(), anchors.count()
    blocks = (max(1, -(-n_anchors // block)), max(1, -(-n // block)))

    columns = ["anchor_id", "positive_id", "positive_score"]
    met = _met(anchors, base, blocks, partial(_in_cell, dims, partial(_positive_window, n_positives), _same_label, columns), columns)
    positives = _first(met, ["anchor_id"], "positive_score", "positive_id", n_positives)
    listed = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # n_positives at most
    with_windows = cut_lineage(anchors.join(listed, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "positives"))

    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    met = _met(with_windows, base, blocks, partial(_in_cell, dims, partial(_negative_windows, n_negatives, low, high), _other_label, columns), columns)
    best = _first(met, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
