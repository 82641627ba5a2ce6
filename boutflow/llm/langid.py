"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams (1 to 3 characters, lower case) per language come from all training rows: each
task sums its rows in numpy and Spark adds the tasks' sums. The log-probabilities form a matrix of
``BUCKETS`` times the number of languages, which is broadcast; a batch of
texts is a sparse matrix of texts and n-grams, multiplied with it in numpy. A matrix has at most ``BLOCK`` languages
(67 MB); where there are more, each block of languages has its own, and the texts are scored block by block. Texts are
hashed ``PIECE`` characters at a time.

Edge cases: ``und`` with score 0 for a null text, a text without a letter, and where there is nothing to
learn from; equal scores go to the first language in order; repeated rows each give a row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import bounded_batches, cut_lineage, per_batch

BUCKETS = 1 << 15
NGRAMS = (1, 2, 3)
#: Languages in one matrix.
BLOCK = 256
#: Characters that are hashed at a time.
PIECE = 100_000


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def buckets(text: str) -> Iterator[np.ndarray]:
    """The hash buckets of all n-grams of a text, in any order, of those that begin in PIECE characters at a time."""
    text = text.lower()
    for s in range(0, len(text), PIECE):
        codes = np.frombuffer(text[s : s + PIECE + NGRAMS[-1] - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        out, key = [], codes
        for n in NGRAMS:
            if n > 1:
                key = key[:-1] * np.uint64(0x110000 + 1) + codes[n - 1 :]
            mixed = (key[:PIECE] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            out.append((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15))
        yield np.concatenate(out).astype(np.int64)


class Model:
    """The languages of a block, in order."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, total: float | None = None):
        """``counts``: language times bucket; ``documents``: training rows by language; ``total``: those of all blocks."""
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).T.copy()
        self.prior = np.log(documents / (documents.sum() if total is None else total))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language of each text, and its share of the probability of all of the block."""
        names, best, sums = self.scores(texts)
        return [n or "und" for n in names], [1 / s if s else 0.0 for s in sums]

    def scores(self, texts: list[str | None]) -> tuple[list[str | None], list[float], list[float]]:
        """Of each text the best language (None: no letter), its log-probability, and the sum of all languages' probabilities over its own."""
        names, most, sums = [None] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        total = np.tile(self.prior, (len(rows), 1)) if rows else np.zeros((0, 1))
        for at, starts, grams in self._pieces(texts, rows):
            np.add.at(total, at, np.add.reduceat(self.log[grams], starts, axis=0))
        best = total.argmax(1)
        over = np.exp(total - total[np.arange(len(rows)), best, None]).sum(1)
        for i, k in enumerate(rows):
            names[k], most[k], sums[k] = self.languages[best[i]], float(total[i, best[i]]), float(over[i])
        return names, most, sums

    @staticmethod
    def _pieces(texts: list[str | None], rows: list[int]):
        """The batch as a sparse matrix of texts and n-grams, in pieces of about PIECE: rows, where each starts, and its buckets."""
        at, parts, size = [], [], 0
        for place, k in enumerate(rows):
            for b in buckets(texts[k]):
                at.append(place)
                parts.append(b)
                size += len(b)
                if size >= PIECE:
                    yield at, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)
                    at, parts, size = [], [], 0
        if parts:
            yield at, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> list[Model]:
    """Learns from all rows with a language and a letter; a model for each ``block`` of languages."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def all_of(lang: str) -> pa.RecordBatch:
            c, n = sums.pop(lang), seen.pop(lang)
            at = np.flatnonzero(c)
            return pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at], pa.int32()), pa.array([n, *c[at]], pa.int64())], names=["lang", "bucket", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang is None or not has_letter(text):
                    continue
                if lang not in sums:
                    while len(sums) >= block:  # a task holds a block's sums at once
                        yield all_of(next(iter(sums)))
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                seen[lang] = seen.get(lang, 0) + 1
                for b in buckets(text):
                    sums[lang] += np.bincount(b, minlength=BUCKETS)
        for lang in list(sums):
            yield all_of(lang)

    bounded_batches(rows.sparkSession)
    parts = rows.select(text_col, lang_col).where(F.col(lang_col).isNotNull()).mapInArrow(count, "lang string, bucket int, n long")
    summed = cut_lineage(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    documents = {r.lang: r.n for r in summed.where("bucket = -1").select("lang", "n").collect()}  # a row a language
    every, models = sorted(documents), []
    for k in range(0, len(every), block):
        languages = every[k : k + block]
        found = summed.where(F.col("lang").isin(languages)).toArrow()  # at most block * (BUCKETS + 1) rows
        lang, bucket, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
        place = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), BUCKETS + 1))
        counts[np.array([place[x] for x in lang], dtype=np.int64), bucket] = n  # the number of rows stands under -1, the last column
        models.append(Model(languages, counts[:, :-1], counts[:, -1], sum(documents.values())))
    return models


def _score(docs: DataFrame, model: Model, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with what ``Model.scores`` gives in the columns ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = model.scores(batch.column(text_col).to_pylist())
            return {names[0]: pa.array(found[0], pa.string()), names[1]: pa.array(found[1], pa.float64()), names[2]: pa.array(found[2], pa.float64())}

        return work

    return per_batch(docs, make, docs.columns, [(names[0], T.StringType()), (names[1], T.DoubleType()), (names[2], T.DoubleType())])


def predict(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``keep`` (the id column), ``lang_pred`` and ``score``."""
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    renamed = [f"__kept_{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, renamed, strict=True)], F.col(text_col).alias("__text"))
    for k, model in enumerate(models):
        rows = _score(rows, model, "__text", (f"__lang_{k}", f"__best_{k}", f"__over_{k}"))
    blocks = range(len(models))
    if models:
        # the block with the greatest best has the language; its share is taken of all blocks' sums
        first = F.array_max(F.array(*[F.struct(F.col(f"__best_{k}").alias("b"), F.lit(-k).alias("k"), F.col(f"__lang_{k}").alias("lang")) for k in blocks]))
        rows = rows.withColumn("__first", first)
        total = sum((F.col(f"__over_{k}") * F.exp(F.col(f"__best_{k}") - F.col("__first.b")) for k in blocks), F.lit(0.0))
        found = F.col("__first.lang").isNotNull()
        added = [F.coalesce("__first.lang", F.lit("und")).alias("lang_pred"), F.when(found, 1 / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("score")]
    else:
        added = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")]
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, renamed, strict=True)], *added)


def held_out(id_col: str = "doc_id"):
    """True for rows that the contract keeps out of the training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
