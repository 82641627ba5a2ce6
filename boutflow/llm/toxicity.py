"""Operator 6: toxicity by a classifier chain.

Categories come one after the other. Each has a linear model (logistic regression) over the text's hashed
words and over the probabilities of the categories before it. Those probabilities, in training, are
out-of-fold: each row's come from a model that did not see the row, nor chose its features by it, so the
later model meets earlier probabilities as uncertain as they will be on new texts. Categories here are
those that the label table has: ``low_quality``, then ``toxic``.

A text is a vector of its distinct words, each with the square root of the word's share of the text, so its
length is 1 whatever the text's; the runs of ``GRAM`` bytes in a word (its start marked) carry the word's
value too, so that forms of one stem are known by it. A model keeps the ``KEPT`` features whose shares of
documents with and without the category differ most clearly, by ``LEAST_Z`` standard errors at least. The fit takes a documented, bounded sample of
labelled rows: the ``MAX_ROWS`` labels of the smallest hash, or all if they are fewer. Features are counted
and chosen in Spark, and the driver gets the chosen features of the sample alone. Scoring covers all rows
and whole texts: a model's score of a text is the sum of its words' scores, which a task works out once
for each word.

Edge cases: a null or wordless text has no features and scores as the models' constants; a category
without both outcomes in the sample has its share as a constant probability; without labelled rows all
probabilities are 0; repeated rows each give a row; of several texts with one id, the least is learnt from;
labels that are null are left out; ``drop_toxic`` keeps all columns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import cut_lineage, filter_batches, per_batch
from boutflow.llm.decontamination import words

BUCKETS = 1 << 18
#: Labels that the fit takes at most.
MAX_ROWS = 6_000
#: Category and the SQL condition on the label table (id, quality, toxic) that tells it.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
FOLDS = 3
STEPS = 60
GRAM = 5
KEPT = 3_000
#: Standard errors by which a feature's shares must differ: in a small sample most others are chance.
LEAST_Z = 2.0
THRESHOLD = 0.35

#: Words whose scores a task holds at once, and their length in bytes, at most.
MAX_WORDS, MAX_HELD = 100_000, 64


def buckets(word: bytes) -> list[int]:
    """The hash buckets of a word and of its parts."""
    marked = b"^" + word
    grams = {marked[k : k + GRAM] for k in range(len(marked) - GRAM + 1)}
    return [zlib.crc32(x) % BUCKETS for x in (word, *(b"~" + g for g in grams))]


def values(counts: Counter) -> np.ndarray:
    """A value for each distinct word of a text."""
    n = np.fromiter(counts.values(), np.float64, len(counts))
    return np.sqrt(n / max(1.0, n.sum()))


class Rows:
    """Sparse rows of text features, with dense columns for earlier categories."""

    def __init__(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, dense: np.ndarray):
        """Of each feature that occurs: its row, place and value; ``dense``: row times earlier category."""
        self.row, self.at, self.value, self.dense = row, at, value, dense

    def where(self, places: np.ndarray, rows: np.ndarray | None = None) -> Rows:
        """Those features that the mask ``places`` has, of the rows of a mask, renumbered."""
        keep = places[self.at]
        if rows is None:
            return Rows(self.row[keep], self.at[keep], self.value[keep], self.dense)
        keep &= rows[self.row]
        return Rows((np.cumsum(rows) - 1)[self.row[keep]], self.at[keep], self.value[keep], self.dense[rows])

    def with_column(self, column: np.ndarray) -> Rows:
        return Rows(self.row, self.at, self.value, np.column_stack([self.dense, column]))


class Linear:
    """Logistic regression, by full-batch gradient steps with a step size for each weight (Adam)."""

    def __init__(self, rows: Rows, label: np.ndarray, places: int, penalty: float = 2e-4, rate: float = 0.5):
        n, share = len(label), label.mean() if len(label) else 0.0
        self.dense, self.weights = np.zeros(rows.dense.shape[1]), np.zeros(places)
        self.constant = float(np.log(share / (1 - share))) if 0 < share < 1 else (-50.0 if share == 0 else 50.0)
        if not 0 < share < 1:
            return
        parts = [self.weights, self.dense, np.array([self.constant])]
        mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, STEPS + 1):
            self.constant = float(parts[2][0])
            error = (self.probability(rows) - label) / n
            slopes = [np.bincount(rows.at, rows.value * error[rows.row], places) + penalty / 10 * parts[0], rows.dense.T @ error + penalty * parts[1], np.array([error.sum()])]
            for p, g, m, s, r in zip(parts, slopes, mean, square, (rate, rate / 5, rate / 5), strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= r * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        self.constant = float(parts[2][0])

    def probability(self, rows: Rows) -> np.ndarray:
        return logistic(np.bincount(rows.row, rows.value * self.weights[rows.at], len(rows.dense)) + rows.dense @ self.dense + self.constant)


def logistic(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


class Chain:
    """The fitted models: bucket weights by category, weights of earlier probabilities, constants."""

    def __init__(self, names: list[str], at: np.ndarray, models: list[Linear]):
        """``at``: the bucket of each place of the models' weights."""
        self.categories = names
        self.weights = np.zeros((BUCKETS, len(names)), np.float32)
        for k, model in enumerate(models):
            self.weights[at, k] = model.weights
        self.dense, self.constants = [m.dense for m in models], [m.constant for m in models]
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((MAX_WORDS, len(names)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "scores": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.scores = np.zeros((MAX_WORDS, len(self.categories)))

    def _linear(self, text: str | None) -> np.ndarray:
        counts = Counter(words(text))
        v = values(counts)
        known = self.known
        at = [known.get(w, -1) for w in counts]
        if -1 in at:
            new = [w for w, k in zip(counts, at, strict=True) if k < 0]
            parts = [buckets(w) for w in new]
            starts = np.cumsum([0, *map(len, parts[:-1])])
            own = np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(parts), np.int64)], starts)
            at = np.array(at)
            missing = at < 0
            total = v[missing] @ own + v[~missing] @ self.scores[at[~missing]]
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
            for w, x in zip(new, own, strict=True):
                if len(w) <= MAX_HELD and len(known) < MAX_WORDS:
                    self.scores[len(known)] = x
                    known[w] = len(known)
            return total
        return v @ self.scores[at]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.categories)))
        if not self.constants or not texts:
            return out
        linear = np.array([self._linear(t) for t in texts])
        for k, (dense, constant) in enumerate(zip(self.dense, self.constants, strict=True)):
            out[:, k] = logistic(linear[:, k] + out[:, :k] @ dense + constant)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """id, text, fold and a column y<k> for each category: ``max_rows`` rows at most, written to the shared folder."""
    known = labels.select(F.col(id_col).alias("id"), "quality", "toxic").dropna().distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(max_rows)
    found = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).join(F.broadcast(chosen), "id")  # max_rows rows of three numbers
    once = found.groupBy("id", "quality", "toxic").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    return cut_lineage(once.select("id", "text", fold.alias("fold"), *[F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(CATEGORIES.values())]).repartition(4 * FOLDS, "id"))


def telling(sample: DataFrame, models: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """For each (category, fold left out; -1: none), the KEPT buckets whose shares of documents differ most, in standard errors, between the outcomes."""
    ys = [f"y{k}" for k in range(len(CATEGORIES))]

    def make():
        def work(batches):
            for batch in batches:
                fold, y = batch.column("fold").to_numpy(), [batch.column(c).to_numpy() for c in ys]
                found = [np.unique(np.array([b for w in set(words(t)) for b in buckets(w)], np.int64)) for t in batch.column("text").to_pylist()]
                key = np.concatenate([x * FOLDS + f for x, f in zip(found, fold, strict=True)])
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                at, place = np.unique(key, return_inverse=True)
                sums = [np.bincount(place, c[row], len(at)).astype(np.int64) for c in (np.ones(len(found)), *y)]
                yield pa.RecordBatch.from_arrays([pa.array(at // FOLDS), pa.array(at % FOLDS), *map(pa.array, sums)], names=["bucket", "fold", "n", *ys])

        return work

    parts = sample.mapInArrow(make(), f"bucket long, fold long, n long, {', '.join(f'{c} long' for c in ys)}")
    counts = cut_lineage(parts.groupBy("bucket").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in ("n", *ys) for f in range(FOLDS)]))
    rows = {r.fold: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ys]).collect()}
    best = None
    for k, out in models:
        folds = [f for f in range(FOLDS) if f != out]
        n, yes = (sum(rows[f][c] for f in folds if f in rows) for c in ("n", f"y{k}"))
        if not 0 < yes < n:
            continue
        every, with_label = (reduce(lambda a, b: a + b, [F.col(f"{c}_{f}") for f in folds]) for c in ("n", f"y{k}"))
        z = F.abs(with_label / yes - (every - with_label) / (n - yes)) / F.sqrt((every + 1) / n * (1 / yes + 1 / (n - yes)))
        part = counts.where((every > 1) & (z >= LEAST_Z)).orderBy(F.desc(z), "bucket").limit(KEPT).select(F.lit(k).alias("k"), F.lit(out).alias("fold"), "bucket")
        best = part if best is None else best.unionByName(part)
    got = best.toArrow() if best is not None else None  # KEPT rows a model
    pick = lambda k, f: got.filter(pc.and_(pc.equal(got["k"], k), pc.equal(got["fold"], f)))["bucket"].to_numpy()
    return {m: np.sort(pick(*m)) if got is not None else np.zeros(0, np.int64) for m in models}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """Fits the chain on at most ``max_rows`` labels (id, quality, toxic) of documents."""
    names = list(CATEGORIES)
    sample = labelled_sample(docs, labels, id_col, text_col, max_rows)
    last = len(names) - 1
    models = [(k, f) for k in range(len(names)) for f in (range(-1, FOLDS) if k < last else (-1,))]
    chosen = telling(sample, models)
    at = np.unique(np.concatenate(list(chosen.values())))
    lists = T.ArrayType(T.IntegerType()), T.ArrayType(T.FloatType())

    def make():
        place = {int(b): k for k, b in enumerate(at)}

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            ats, vals = [], []
            for t in batch.column("text").to_pylist():
                counts = Counter(words(t))
                found = [(place[b], v) for w, v in zip(counts, values(counts), strict=True) for b in buckets(w) if b in place]
                ats.append([a for a, _ in found])
                vals.append([v for _, v in found])
            return {"at": pa.array(ats, pa.list_(pa.int32())), "value": pa.array(vals, pa.list_(pa.float32()))}

        return work

    ys = [f"y{k}" for k in range(len(names))]
    got = per_batch(sample, make, ["id", "fold", *ys], [("at", lists[0]), ("value", lists[1])]).toArrow().sort_by([(c, "ascending") for c in ("id", *ys)])
    if not len(got):
        return Chain(names, at, [])
    flat = lambda c: pc.list_flatten(got[c]).to_numpy()
    row = np.repeat(np.arange(len(got), dtype=np.int32), pc.list_value_length(got["at"]).to_numpy())
    rows, fold = Rows(row, flat("at"), flat("value"), np.zeros((len(got), 0))), got["fold"].to_numpy()
    labels_of = [got[f"y{k}"].to_numpy().astype(float) for k in range(len(names))]
    del got
    pa.default_memory_pool().release_unused()  # the driver needs the flat arrays only
    mask = lambda m: np.isin(at, chosen[m])
    out = []
    for k in range(len(names)):
        y = labels_of[k]
        out.append(Linear(rows.where(mask((k, -1))), y, len(at)))
        if k < last:
            earlier = np.zeros(len(y))
            for f in range(FOLDS):
                held = fold == f
                own = mask((k, f))
                earlier[held] = Linear(rows.where(own, ~held), y[~held], len(at)).probability(rows.where(own, held))
            rows = rows.with_column(earlier)
    return Chain(names, at, out)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``p_<category>`` for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            p = model.probabilities(batch.column(text_col).to_pylist())
            return {n: pa.array(p[:, k]) for k, n in enumerate(names)}

        return work

    return per_batch(docs.select(id_col, text_col), make, [id_col], [(n, T.DoubleType()) for n in names])


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of ``toxic`` is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        model = shared.value
        at = model.categories.index("toxic")
        return lambda batch: (model.probabilities(batch.column(text_col).to_pylist())[:, at] < threshold).tolist()

    return filter_batches(docs, make)
