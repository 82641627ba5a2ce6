"""From raw documents to token ids, in five stages, each of which calls one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the folder that the cluster shares and reads it again as the next stage's documents. The first four
return the columns of ``documents``; the last adds the encoding.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boutflow.llm import decontamination, exact_dedup, sentencepiece_codec, simhash, toxicity
from boutflow.llm.common import shared_folder, small_tasks, table

#: SQL can't express the fitted model, the fingerprints or the tokenizer.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small(stage: Stage) -> Stage:
    """``stage`` with tasks that hold little at once: the stages share executors, whose memory grows to what the greediest of their tasks take."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_tasks(spark)
        return stage(spark, docs, sf_dir)

    return run


@_small
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_small
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, one stays."""
    return exact_dedup.drop_copies(docs)


@_small
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a similarity of 0.8 or more in shingles of five words, one stays."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


@_small
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in windows of benchmark items go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_small
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and the text that they decode to."""
    return sentencepiece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=docs.columns)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever it is that Spark reads and writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. A stage's result goes once the next one's is written, so two copies are there at most."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
