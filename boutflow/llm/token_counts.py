"""Operator 7: token counts by an exact length histogram.

Each whole text is encoded once for its length. Documents are summed up by length, so the table that
answers questions has a row for each length that occurs, whatever the number of documents. Suffix sums
over it give, for every context limit, how many documents are longer, all tokens, and the tokens that stay
when texts are cut at the limit; shares of documents give exact quantiles.

Edge cases: a null or empty text has no tokens and counts under length 0; repeated rows count each time;
other columns are not read; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import per_batch


def lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``n_tokens`` under the byte-level vocabulary at ``ranks_path``."""

    def make():
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {"n_tokens": pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(text_col).to_pylist()], pa.int64())}

        return work

    return per_batch(docs.select(id_col, text_col), make, [id_col], [("n_tokens", T.LongType())])


def histogram(counted: DataFrame) -> DataFrame:
    """Of rows with ``n_tokens``: ``n_tokens`` and ``n_docs``."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: exact totals.

    ``n_docs`` of that very length, ``n_longer``, ``n_fitting``, ``fitting_share``, ``tokens_total``,
    ``tokens_kept`` (texts cut at the limit) and ``tokens_cut``. A limit between two lengths L < M keeps
    what L keeps and one more token of each document longer than L for each step from L (``at_limits``).
    The window runs over the histogram, a row a length.
    """
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = hist.select(
        "n_tokens", "n_docs", F.sum("n_docs").over(upto).alias("n_fitting"), F.sum(tokens).over(upto).alias("within"),
        F.sum("n_docs").over(every).alias("docs"), F.sum(tokens).over(every).alias("tokens_total"),
    )
    longer = F.col("docs") - F.col("n_fitting")
    kept = F.col("within") + F.col("n_tokens") * longer
    return sums.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", longer.alias("n_longer"), "n_fitting", (F.col("n_fitting") / F.col("docs")).alias("fitting_share"),
        "tokens_total", kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_cut"),
    )


def at_limits(report: DataFrame, context_limits: list[int]) -> DataFrame:
    """The totals of ``limits`` for any context limits, whether a text has that length or not; no rows for an empty report."""
    asked = report.sparkSession.createDataFrame([(c,) for c in sorted(set(context_limits))], "asked long")
    whole = report.agg(F.max("n_fitting").alias("docs"), F.max("tokens_total").alias("total")).where("docs is not null")
    below = F.max_by(F.struct("context_limit", "n_fitting", "tokens_kept"), "context_limit")  # of the greatest length within the limit
    last = asked.join(report, F.col("context_limit") <= F.col("asked")).groupBy("asked").agg(below.alias("b"))
    rows = asked.join(whole).join(last, "asked", "left")  # one row of totals
    fitting, length, kept = (F.coalesce(f"b.{c}", F.lit(0)) for c in ("n_fitting", "context_limit", "tokens_kept"))
    cut_at = kept + (F.col("asked") - length) * (F.col("docs") - fitting)
    return rows.select(
        F.col("asked").alias("context_limit"), (F.col("docs") - fitting).alias("n_longer"), fitting.alias("n_fitting"), (fitting / F.col("docs")).alias("fitting_share"),
        F.col("total").alias("tokens_total"), cut_at.alias("tokens_kept"), (F.col("total") - cut_at).alias("tokens_cut"),
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least that share of all documents don't exceed."""
    asked = report.sparkSession.createDataFrame([(s,) for s in sorted(set(shares))], "share double")
    return asked.join(report, F.col("fitting_share") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("length"))


def quantile(report: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents don't exceed."""
    return report.where(F.col("fitting_share") >= share).agg(F.min("context_limit").alias("length"))
