"""Operator 9: exact de-duplication by progressive refinement, with DataFrame functions only.

Texts are equal when they agree after every white-space character is deleted. Rows are told apart in
three steps, each of which looks at those rows only that the step before left in a group of two or more:
the length, then a hash of the first ``PREFIX`` characters, then the SHA-256 of the full text. The first
two send a few bytes a row through the shuffle, though they read each text to normalise it; the full content
is hashed for the survivors alone.

Hot groups: every step counts with map-side sums, the survivors' keys are joined by plain equi-joins that
adaptive execution can split, and the row that stays is found by an aggregate, never by a window over a
group. Of a group, the row with the most characters stays, then the one with the smallest id (null last);
rows that agree in both are repeats of which one stays, the one of the smallest hash of its text and then of
its other columns (maps apart, which have no hash).

Edge cases: a null text counts as empty; empty tables give empty results; ``classes`` reads the id and the
text alone; ``drop_copies`` keeps all columns whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutflow.llm.common import SPACES, cut_lineage

#: Characters of the normalised text that the second step hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c)), SPACES, F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    norm = docs.withColumn("__norm", normalised(F.col(text)))
    return norm.withColumns({"__length": F.octet_length("__norm"), "__prefix": F.xxhash64(F.substring("__norm", 1, PREFIX))})


def survivors(keyed: DataFrame) -> DataFrame:
    """The (length, prefix hash) pairs of two rows or more, by way of the lengths of two rows or more."""
    counts = keyed.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    lengths = counts.groupBy("__length").agg(F.sum("__n").alias("__rows")).where("__rows > 1").select("__length")
    return counts.where("__n > 1").join(lengths, "__length", "left_semi").select("__length", "__prefix", F.lit(True).alias("__survives"))


def refine(docs: DataFrame, text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """``docs`` with ``__full``: the hash of the full normalised text of survivors, else null.

    ``hash_all`` also gives ``__sha256``, the same hash for every row, where a report needs it.
    """
    keyed = _keyed(docs, text_col)
    keep = [*docs.columns, "__length", "__prefix"]
    if hash_all:  # the text itself need not cross the network then
        rows = keyed.select(*[c for c in keep if c != text_col], F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__chars"), F.sha2("__norm", 256).alias("__sha256"))
        return rows.join(survivors(keyed), ["__length", "__prefix"], "left").withColumn("__full", F.when(F.col("__survives"), F.col("__sha256")))
    rows = keyed.select(*keep).join(survivors(keyed), ["__length", "__prefix"], "left")
    text = F.col(text_col)  # normalised anew on this side, so that one copy of the text crosses the network
    return rows.withColumns({"__full": F.when(F.col("__survives"), F.sha2(normalised(text), 256)), "__chars": F.char_length(F.coalesce(text, F.lit("")))})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    rows = refine(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", hash_all=True)
    rows = cut_lineage(rows.select("__id", "__chars", "__sha256", "__full"))  # a few bytes a row, so that texts are read no more
    each = rows.where("__full is not null").groupBy("__full", "__chars", "__id").agg(F.count(F.lit(1)).alias("__n"))
    order = F.struct((-F.col("__chars")).alias("less"), F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__n").alias("n"))
    groups = each.groupBy(F.col("__full").alias("__group")).agg(F.sum("__n").alias("__size"), F.min(order).alias("__best"))
    joined = rows.join(groups, F.col("__sha256") == F.col("__group"), "left")  # lone rows too have keys of their own
    alone = F.col("__group").isNull()
    best = ~alone & (F.col("__chars") == -F.col("__best.less")) & F.col("__id").eqNullSafe(F.col("__best.id"))
    marked = joined.select("*", best.alias("__is_best"), (best & (F.col("__best.n") > 1)).alias("__repeats"))
    # of a best row that comes several times one stays; no others meet in a window
    first = F.row_number().over(Window.partitionBy("__sha256").orderBy(F.lit(1))) == 1
    once = marked.where("not __repeats").withColumn("__kept", alone | F.col("__is_best"))
    several = marked.where("__repeats").withColumn("__kept", first)
    return once.unionByName(several).select(
        F.col("__id").alias(id_col), F.when(alone, F.col("__id")).otherwise(F.col("__best.id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each class of equal texts."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = refine(inner, f"__row.`{text_col}`")
    alone = rows.where("__full is null").select("__row.*")
    row = F.col("__row")
    hashed = [row[f.name] for f in docs.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(-F.col("__chars"), row[id_col].isNull(), row[id_col], F.xxhash64(row[text_col]), F.xxhash64(*hashed))
    kept = rows.where("__full is not null").groupBy("__full").agg(F.min_by("__row", order).alias("__row")).select("__row.*")
    return alone.unionByName(kept)
