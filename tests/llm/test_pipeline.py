"""The corpus pipeline, stage by stage and in all, with planted documents."""

import os
from glob import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from boutflow.llm import common, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_catch_what_is_planted(spark, tmp_path):
    rng = np.random.default_rng(8)
    plain = [f"w{k}" for k in range(2000)]
    text = lambda n=80: " ".join(rng.choice(plain, n))
    docs = [(i, text(), "en", "s", i) for i in range(300)]
    toxic = set(range(0, 300, 7))
    docs = [(i, t + " grobolta grobolmu grobolke" if i in toxic else t, *rest) for i, t, *rest in docs]
    item = text(30)
    docs += [(1000, docs[1][1].replace(" ", "\n"), "en", "s", 1), (1001, docs[2][1] + " tail", "en", "s", 1), (1002, text(20) + " " + item + " " + text(20), "en", "s", 1), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", [(1, item)], "item_id long, text string"),
        ("labels", [(i, 1, int(i in toxic)) for i in range(300) if i % 3], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path))
    out = {r.doc_id: r for r in left.collect()}
    folder = left.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 2)[0]
    assert [d for d in os.listdir(folder) if not d.startswith(".")] == [str(len(corpus_pipeline.STAGES) - 1)]  # what stages in between wrote is gone
    assert not toxic & set(out) and 1002 not in out
    assert len({1, 1000} & set(out)) == 1 and {2, 1001} & set(out) == {2}
    assert len({1003, 1004} & set(out)) == 1
    clean = set(range(300)) - toxic - {1}
    assert clean <= set(out)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in list(out.values())[:50]:
        assert list(r.token_ids) == [*model.encode(r.text or ""), model.eos_id()] and r.decoded == model.decode(list(r.token_ids))


def test_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns


def test_tasks_of_the_stages_hold_little_at_once(spark, tmp_path):
    """Executors grew beyond 3000 MB on check_h: batches, row groups and the tables of chunks are bounded."""
    for name in common.SMALL_TASKS:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")  # lower already, so it stays
    text = F.concat(*[F.sha2(F.concat_ws(" ", "id", F.lit(k)), 256) for k in range(16)])
    docs = spark.range(0, 60_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))  # 61 MB
    corpus_pipeline.drop_exact_copies(spark, docs, SF).coalesce(1).write.parquet(f"{tmp_path}/out")
    (file,) = glob(f"{tmp_path}/out/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 60_000 and groups.num_row_groups > 1
    assert max(groups.row_group(k).total_byte_size for k in range(groups.num_row_groups)) < 40 << 20
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")

    sizes = common.per_batch(docs.limit(2000).coalesce(1), lambda: lambda b: {"n": pa.array([b.num_rows] * b.num_rows)}, ["doc_id"], [("n", common.T.LongType())])
    seen = [r.n for r in sizes.collect()]
    assert len(seen) == 2000 and max(seen) <= 256


def test_a_small_table_of_chunks_gives_the_same(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    codec, whole = sentencepiece_codec.Codec(model, 100), sentencepiece.SentencePieceProcessor(model_file=model)
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = " ".join(f"w{k}é\n" for k in rng.integers(0, 300, 70)) + "  \t x ▁y \ufb01 "
        ids = [*whole.encode(text), whole.eos_id()]
        assert codec.both(text) == (" ".join(map(str, ids)), whole.decode(ids))
        assert len(codec.table) <= 100
    assert any(d is c for c, (_, d) in codec.table.items())
