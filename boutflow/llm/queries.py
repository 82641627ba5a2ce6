"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutflow.llm import decontamination, exact_dedup, hard_negatives, langid, secrets_crf, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, toxicity, url_filter, whitening
from boutflow.llm.common import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages table has no dates and no list; both are derived from it.

    A page was fetched on day ``page_id % 365``. Every fifth page says something of its host, on day
    ``page_id * 7 % 365``; every tenth speaks for the domain above the host.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") % 365).cast("int"))
    host = url_filter.host_of(F.col("url"))
    domain = F.when(F.col("page_id") % 10 == 0, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    entries = pages.where("page_id % 5 = 0").select(
        F.col("page_id").alias("entry_id"), domain.alias("domain"), (F.col("page_id") * 7 % 365).cast("int").alias("day"),
        F.when(F.col("page_id") % 3 == 0, "allow").otherwise("block").alias("action"),
    )
    return captures, entries


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _captures_and_entries(spark, sf_dir)
    out = url_filter.decide(captures, entries)
    return out.select("page_id", "host", "day", "listed", "action", "valid_from", "valid_to", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))


SQL["op2_url_filter"] = r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         CAST(page_id % 365 AS INTEGER) AS day
  FROM pages
), e AS (
  SELECT page_id AS entry_id, CASE WHEN page_id % 10 = 0 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS domain,
         CAST(page_id * 7 % 365 AS INTEGER) AS day, CASE WHEN page_id % 3 = 0 THEN 'allow' ELSE 'block' END AS action
  FROM p WHERE page_id % 5 = 0
), last AS (
  SELECT domain, day, arg_max(action, entry_id) AS action FROM e WHERE domain IS NOT NULL GROUP BY domain, day
), held AS (
  SELECT domain, action, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM last
), met AS (
  SELECT p.page_id, h.domain, h.action, h.valid_from, h.valid_to,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(h.domain) DESC) AS rn
  FROM p JOIN held AS h ON (p.host = h.domain OR ends_with(p.host, '.' || h.domain))
   AND h.valid_from <= p.day AND (h.valid_to IS NULL OR p.day < h.valid_to)
)
SELECT p.page_id, p.host, p.day, m.domain AS listed, m.action, m.valid_from, m.valid_to, coalesce(m.action = 'block', false) AS blocked
FROM p LEFT JOIN met AS m ON p.page_id = m.page_id AND m.rn = 1
"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_copies(table(spark, sf_dir, "documents"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_crf.find_secrets(docs, secrets_crf.fit(docs))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("rejected", F.col("p_toxic") >= toxicity.THRESHOLD)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.limits(token_counts.histogram(counted))


def _length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.limits(cut_lineage(token_counts.histogram(counted)))


@query
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What context limits of powers of two keep and cut."""
    return token_counts.at_limits(_length_report(spark, sf_dir), [1 << k for k in range(5, 18)])


@query
def token_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.quantiles(_length_report(spark, sf_dir), [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0])


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), w AS (
  SELECT doc_id, n,
         row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id ASC NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(n) AS text_sha256 FROM w
"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.summary(found)


@query
def cut_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items hold: those of 13 words or more, or all where they are over a twentieth of the text."""
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id", "text"])
    cut = decontamination.cut_spans(found.withColumn("text", F.coalesce("text", F.lit(""))))
    return cut.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), F.sha2("cut_text", 256).alias("cut_sha256"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+')"

SQL["op10_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS words
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), places AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS words
  FROM (SELECT d.r, s.n, d.w, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) AS s WHERE len(d.w) >= s.n)
), found AS (
  SELECT p.r, p.k, p.n, v.item FROM places AS p JOIN windows AS v ON p.n = v.n AND p.words = v.words
), hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits AS h ON d.r = h.r LEFT JOIN items AS x ON d.r = x.r
"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op11_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT r, p FROM (
    SELECT v.r, unnest(range(v.k, v.k + 13)) AS p FROM windows AS v JOIN firsts AS f ON v.s = f.s WHERE v.doc_id > f.least OR v.doc_id IS NULL AND f.least IS NOT NULL
  )
), words AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept AS k ON d.r = k.r
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, lambda i: i % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.other_id) AS INTEGER) AS rank,
       m.other_id AS negative_id, p.positive_score, m.score AS negative_score
FROM positives AS p JOIN met AS m ON p.anchor_id = m.anchor_id AND NOT m.same AND 30 * p.positive_score <= 100 * m.score AND 100 * m.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.other_id) <= 10
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    return whitening.whiten(rows, model, model and whitening.identity_error(rows, model))
