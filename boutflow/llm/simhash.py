"""Operator 8: near-duplicates by SimHash, with a byte-position inverted index and count filtering.

A text's fingerprint has the majority bits of the XXH64 hashes of its word shingles. Two 64-bit
fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share a byte at 4
positions at least. A posting list of one position and byte would hold a 256th of all rows, and tallying
over such lists costs the square of the rows. The index therefore posts each distinct fingerprint under
each choice of 4 positions with its bytes there: a pair that shares m bytes meets in C(m, 4) lists, and
m >= 4 in one at least. In a list, the pair's shared positional bytes are tallied, pairs with fewer than 4
are dropped, a pair is taken up in the first list that it shares only, and the Hamming distance verifies it.

A list of more than ``HOT_LIST`` fingerprints is not paired. Each of its fingerprints is put under every
value at up to 2 bits from it instead: two fingerprints at 4 bits or fewer share such a value, and two
that share one are at 4 bits or fewer, so one link from each to the smallest under the value keeps the
components exact, at a cost in proportion to the rows.

Equal fingerprints are collapsed before the index. ``near_copies`` is the form that asks for a similarity
of the shingle sets: links come from the fingerprints by the same index and are verified on the sets, and
what is similar beyond the index's guarantee is looked up by shingles; see there.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; null ids take no
part in choosing a component's id; repeated rows each give a row; other columns are not read;
``drop_near_copies`` keeps all columns; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import bounded_batches, cut_lineage, filter_batches, per_batch
from boutflow.llm.components import components

SEED = 42
#: Fingerprints in a list beyond which radius-2 values are cheaper than pairs.
HOT_LIST = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words, A-Z in lower case, repeats included."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in ws))
    if len(ws) <= shingle:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    starts = [0, *ends[: len(ws) - shingle]]
    return np.frombuffer(b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of an array of rows of 64-bit words: the words of bits set in over half the rows."""
    n = len(hashes)
    if not n:
        return np.zeros(hashes.shape[1], np.uint64)
    counts = np.zeros(hashes.shape[1] * 64, np.int64)
    for s in range(0, n, 255):  # counts of 255 rows fit a byte
        bits = np.unpackbits(np.ascontiguousarray(hashes[s : s + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and ``fp``, its 64-bit fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            out = [majority(shingle_hashes(t, shingle)[:, None])[0] for t in batch.column(text_col).to_pylist()]
            return {"fp": pa.array(np.array(out, np.uint64).view(np.int64))}

        return work

    return per_batch(docs.select(id_col, text_col), make, [id_col], [("fp", T.LongType())])


def _shared_bytes(x: Column) -> Column:
    """Of the exclusive or of two fingerprints: a bit for each byte position that both share."""
    out = F.lit(0)
    for p in range(8):
        out = out + F.when(x.bitwiseAND(F.lit(_signed(255 << 8 * p))) == 0, 1 << p).otherwise(0)
    return out


def links(fps: DataFrame, max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` at ``max_bits`` or fewer.

    Pairs from lists of up to ``hot_list``; from larger ones, links that connect the same components.
    """
    least = 8 - max_bits  # positions that such a pair shares at least
    if not 1 <= least <= 7 or max_bits % 2:
        raise ValueError("2, 4 or 6 bits")
    choices = list(combinations(range(8), least))
    masks = [sum(255 << 8 * p for p in c) for c in choices]
    first = [next((k for k, c in enumerate(choices) if all(m >> p & 1 for p in c)), -1) for m in range(256)]
    posted = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "bytes"))
    size = F.count(F.lit(1)).over(Window.partitionBy("choice", "bytes"))
    shared = cut_lineage(posted.withColumn("n", size).where("n > 1"))  # the lists of two or more: few of all
    listed = shared.where(F.col("n") <= hot_list)
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    tally = _shared_bytes(x)
    met = (F.col("l.choice") == F.col("r.choice")) & (F.col("l.bytes") == F.col("r.bytes")) & (F.col("l.fp") < F.col("r.fp"))
    enough = (F.bit_count(tally) >= least) & (F.get(F.array(*map(F.lit, first)), tally) == F.col("l.choice"))
    pairs = listed.alias("l").join(listed.alias("r"), met & enough & (F.bit_count(x) <= max_bits)).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    hot = shared.where(F.col("n") > hot_list).select("fp").distinct()
    if hot.isEmpty():
        return pairs
    near = [sum(1 << p for p in c) for r in range(max_bits // 2 + 1) for c in combinations(range(64), r)]
    around = hot.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(m)) for m in near]), lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    met = around.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most len(near) in a set
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", hot_list: int = HOT_LIST) -> DataFrame:
    """Per row of ``docs``: the id, ``fingerprint`` (hex) and ``component_id`` (smallest id reachable)."""
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(distinct.select("fp"), max_bits, hot_list))
    labelled = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(ids, "component").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("__fp")).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The form by shingles ---------------------------------------------------------------------------------------

#: Longs of a text's short parity print.
SHORT = 8
#: Buckets (as bits) of the shingles' hashes whose occurrences are counted over all texts.
ORDER_BITS = 16
#: Members of a list that meet each other in one group of rows.
BLOCK = 512
#: Texts' keys that are sent to all tasks, at most; more are shuffled with the texts.
SENT_KEYS = 1_000_000


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` (a power of two) parts of the hashes' values, whether an odd number of ``shingles`` is in it; packed.

    A shingle that only one of two sets has turns one bit, so the sets differ in as many shingles at least as
    their parities differ in bits. The exclusive or of a parity's halves is the parity of half the bits.
    """
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    while len(parity) > size:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def parity_bits(n: int) -> int:
    """Bits of a long parity: at least four times the shingles, so that few fall together."""
    return max(64 * SHORT, 1 << (4 * n - 1).bit_length() if n else 0)


def prefix(shingles: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of (occurrences of the hash's bucket, hash), that a near copy must meet.

    A set of n shingles has ceil(similarity n) in common with each near copy of it, so of two near copies'
    first n - ceil(similarity n) + 1 at least one is in both. This is so in any order that is the same for
    all texts; with common shingles last the lists are short. A set without shingles is in list 0.
    """
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64)
    take = n - math.ceil(similarity * n - 1e-9) + 1
    return shingles[np.lexsort((shingles, counts[shingles >> np.uint64(64 - ORDER_BITS)]))[:take]].view(np.int64)


def occurrences(sources: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts are in each bucket: tasks count their own texts, Spark adds up the tasks."""

    def count(batches):
        sums = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            found = [shingle_hashes(t, shingle) for t in batch.column(0).to_pylist()]
            sums += np.bincount((np.concatenate(found) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    bounded_batches(sources.sparkSession)
    got = sources.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _sent(df: DataFrame) -> DataFrame:
    """``df``, which is written already, marked to be sent to all tasks where it has at most SENT_KEYS rows."""
    return F.broadcast(df) if df.count() <= SENT_KEYS else df


def _may_be_near(similarity: float) -> Column:
    """What holds for the sizes (n_a, n_b) and short parities (fp_a, fp_b) of every two near copies."""
    na, nb = F.col("n_a"), F.col("n_b")
    bits = sum(F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(SHORT))
    return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-6) & (bits <= (1 - similarity) / (1 + similarity) * (na + nb) + 1e-6)


def _similar(pairs: DataFrame, rows: DataFrame, sources: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` of keys whose shingle sets have that similarity: by their long parities first, then by the texts."""
    long = lambda x: rows.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    met = pairs.join(long("a"), "a").join(long("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")

    def make_bounds():
        def work(batch: pa.RecordBatch) -> list[bool]:
            most = (1 - similarity) / (1 + similarity) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            out = []
            for x, y, k in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                out.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= k)
            return out

        return work

    likely = cut_lineage(filter_batches(met, make_bounds).select("a", "b"))
    ends = likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct()
    ends = cut_lineage(rows.select("key", "sha").join(_sent(cut_lineage(ends)), "key", "left_semi"))
    texts = cut_lineage(sources.join(_sent(ends), "sha").select("key", "text").dropDuplicates(["key"]))
    of = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}"))

    def make():
        def work(batch: pa.RecordBatch) -> list[bool]:
            out, last, s = [], None, None
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ta != last:
                    last, s = ta, np.unique(shingle_hashes(ta, shingle))
                t = np.unique(shingle_hashes(tb, shingle))
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(both >= similarity * (len(s) + len(t) - both))
            return out

        return work

    return filter_batches(likely.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b"), make).select("a", "b")


def print_pairs(rows: DataFrame, max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """Pairs ``a`` < ``b`` of keys of ``rows``, whose ``simhash`` differ in at most ``max_bits`` bits, by the index of ``links``.

    Of an equal fingerprint, all keys meet the smallest; of two linked ones, the smallest keys meet.
    """
    heads = cut_lineage(rows.groupBy("simhash").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("copies")))
    equal = rows.select("simhash", "key").join(heads.where("copies > 1"), "simhash").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    of = lambda x: heads.select(F.col("simhash").alias(x), F.col("head").alias(f"head_{x}"))
    met = links(heads.select(F.col("simhash").alias("fp")), max_bits, hot_list).join(of("a"), "a").join(of("b"), "b")
    return equal.unionByName(met.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).distinct())  # a list and a value may give a pair both


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """Per distinct text of ``docs`` with a near copy: ``sha`` (the SHA-256 of the text) and ``group``.

    Texts are linked when the Jaccard similarity of their sets of word shingles is ``similarity`` or more,
    and the groups are the components of all such links. The first links are those of the SimHash fingerprints
    at 4 bits or fewer, by the byte-position index and its tally (``print_pairs``). A small distance of
    fingerprints that repeated shingles make alike is no proof, so each pair is verified on the sets.

    At 0.8 about a seventh of a SimHash's bits differ, too many for a guarantee over its bytes. So that no
    link is lost, an index over the shingles themselves completes the components: each text
    is in the lists of its ``prefix``, of which two near copies share one at least. A pair
    has to reach the least agreement of sizes and parity bits that near copies
    are sure to have, first in a short print and then in one as long as the text asks for, and what is left
    is verified on the sets.

    A list's members don't all meet. First all meet its head, the member of which most of the prefix is in
    other texts too: in a group of near copies, the one that is nearest to all; those that the fingerprints linked
    to it, or to a text that it is linked to, need not. Where members of a list are
    then in different components, these meet, in blocks; two of one component need not, since their link would change nothing.
    """
    sources = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(occurrences(sources, shingle))

    def make():
        counts = known.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            sets, majorities = [], np.zeros(batch.num_rows, np.uint64)
            for k, t in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes(t, shingle)
                majorities[k] = majority(hashes[:, None])[0]
                sets.append(np.unique(hashes))
            longs, prints = pa.list_(pa.int64()), [parity(s, parity_bits(len(s))) for s in sets]
            return {
                "simhash": pa.array(majorities.view(np.int64)),
                "n": pa.array([len(s) for s in sets], pa.int32()), "parity": pa.array([p.tobytes() for p in prints], pa.binary()),
                "fp": pa.array([folded(p, 8 * SHORT).view(np.int64) for p in prints], longs), "lists": pa.array([prefix(s, similarity, counts) for s in sets], longs),
            }

        return work

    longs = T.ArrayType(T.LongType())
    wide = cut_lineage(per_batch(sources, make, ["sha"], [("simhash", T.LongType()), ("n", T.IntegerType()), ("parity", T.BinaryType()), ("fp", longs), ("lists", longs)]))
    wide = wide.withColumn("key", F.monotonically_increasing_id())  # of written rows, so the same each time
    repeats = cut_lineage(wide.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first")).where("copies > 1"))
    again = cut_lineage(wide.select("sha", "key").join(_sent(repeats), "sha").where("key <> first").select("key"))
    rows = wide.join(_sent(again), "key", "left_anti")  # one for each text
    info = rows.select("key", "n", "fp", F.size("lists").alias("k"))

    of = lambda x: info.select(F.col("key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("fp").alias(f"fp_{x}"))

    def close(pairs):
        met = pairs.join(of("a"), F.col("a") == F.col("key_a")).join(of("b"), (F.col("b") == F.col("key_b")) & _may_be_near(similarity))
        return cut_lineage(met.select("a", "b"))

    printed = cut_lineage(_similar(close(print_pairs(rows)), rows, sources, shingle, similarity))
    both = printed.union(printed.select("b", "a")).toDF("key", "other")
    by_print = both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("hook"))  # two of one hook are in one component

    posted = rows.select("key", F.explode("lists").alias("list"))
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = cut_lineage(posted.join(sizes, "list"))
    own = shared.groupBy("key").agg(F.count(F.lit(1)).alias("met")).join(info.select("key", "k"), "key").join(by_print, "key", "left")
    ranked = shared.join(own.select("key", (F.col("k") - F.col("met")).alias("alone"), F.coalesce("hook", "key").alias("hook")), "key")
    heads = ranked.groupBy("list").agg(F.min(F.struct("alone", F.xxhash64("list", "key"), "key", "hook")).alias("head")).select("list", F.col("head.key").alias("head"), F.col("head.hook").alias("head_hook"))
    stars = ranked.join(heads, "list").where("head <> key and hook <> head_hook").select(F.least("head", "key").alias("a"), F.greatest("head", "key").alias("b")).distinct()
    linked = cut_lineage(printed.unionByName(_similar(close(stars), rows, sources, shingle, similarity)))
    group = cut_lineage(components(linked))

    placed = shared.where("members > 2").join(group, F.col("key") == F.col("node"), "left").select("list", "members", "key", F.coalesce("component", "key").alias("component"))
    mixed = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("list")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    left = placed.join(mixed, "list", "left_semi").join(info, "key").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("block", j).alias("u"), F.greatest("block", j).alias("v")))
    left = cut_lineage(left.withColumn("unit", F.explode(units)))
    side = lambda x: left.select("list", "unit", F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("component", "block", "n", "fp")])
    x, y = side("a").alias("x"), side("b").alias("y")
    meet = (F.col("x.list") == F.col("y.list")) & (F.col("x.unit") == F.col("y.unit")) & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
    across = x.join(y, meet & ((F.col("block_a") != F.col("block_b")) | (F.col("x.unit.u") == F.col("x.unit.v"))) & _may_be_near(similarity)).select("a", "b").distinct()
    second = _similar(cut_lineage(across), rows, sources, shingle, similarity)
    return components(linked.unionByName(second)).join(rows.select("key", "sha"), F.col("node") == F.col("key")).select("sha", F.col("component").alias("group"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies, exact ones included: that of the smallest id (null last).

    Repeats of the document that stays, equal in the id and the text, are left as they are.
    """
    groups = cut_lineage(near_copies(docs, shingle, similarity, text_col))
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "sha")
    texts = docs.select(sha.alias("sha"), docs[id_col].alias("id")).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    texts = cut_lineage(texts.join(groups, "sha", "left").where("copies > 1 or group is not null").select("sha", F.col("first.id").alias("id"), "group"))
    stays = texts.where("group is not null").groupBy("group").agg(F.min(best).alias("best")).select(F.col("best.sha").alias("kept"))
    marked = texts.join(stays, F.col("sha") == F.col("kept"), "left")
    gone = cut_lineage(marked.select(F.col("sha").alias("__sha"), F.col("id").alias("__id"), (F.col("group").isNull() | F.col("kept").isNotNull()).alias("__stays")))
    return docs.join(_sent(gone), (sha == gone["__sha"]) & ~(gone["__stays"] & docs[id_col].eqNullSafe(gone["__id"])), "left_anti")
