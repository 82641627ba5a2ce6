"""Operator 3: sharding by balanced label propagation, with DataFrame functions only.

Documents start in equal shards by a gapless number. Then, in rounds, each linked document looks for the
shard that holds most of its neighbours, and moves there as far as quotas allow: between two shards as
many documents go one way as the other, so the number of rows of each shard never changes (the law is
``rows``: counts at most one apart). Where more want to go one way than back, documents without links
make up the difference.

Links are given as (document, hub) rows: documents with a hub in common are neighbours. That is linear in
the size of a group of copies, where pairs would be its square. A hub of more documents than a whole shard
is split into parts of up to about a shard by a hash; a smaller one fits one shard and stays whole. A hub's
counts are summed up and sent back by (hub, salt), so that no key holds a large part of all rows. Ties
between shards go by a hash of the hub and shard, which is the same for all of a hub's documents, so that
they don't swap places.

Propagation ends when no document may move, or after ``rounds`` rounds: the law holds after each of them, and
a round more only brings more linked documents together (``cut_links`` tells how many are apart).

What the driver collects is the table of wishes by pair of shards, ``shards`` squared rows at most, and once
the counts of split hubs' parts, of which there are fewer than twice the shards; each is drawn to a shard
with room for it.

Edge cases: a null text has size 1 and crc32 0; null texts are neighbours of empty ones; repeated rows are
rows of their own; columns other than the id and the text are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutflow.llm.common import cut_lineage, gapless, text_bytes

#: A salt's documents of a hub are at most about this part of a shard.
SHARD_PARTS = 4


def split_hubs(links: DataFrame, whole: int, most: int) -> DataFrame:
    """``links`` (row, hub) with each hub of more than ``whole`` rows split by a hash of the row, ``salt``, and whether the hub is ``split``.

    A salt of a hub has about ``most`` rows.
    """
    sizes = links.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(whole)).cast("long")
    salts = F.ceil(F.col("n") / parts / F.lit(most)).cast("long")
    return links.join(sizes, "hub").select("row", F.xxhash64("hub", F.pmod(F.xxhash64("row"), parts)).alias("hub"), F.pmod(F.xxhash64("row", F.lit(1)), salts).alias("salt"), (parts > 1).alias("split"))


def homes(held: dict[int, list[int]], whole: int) -> dict[int, int]:
    """A shard for each part of a split hub: that which holds most of it, of those with room for it.

    Without that, two parts that each fit a shard would both be drawn to the same one, and stay scattered.
    """
    out, room = {}, {}
    for hub, counts in sorted(held.items(), key=lambda x: (-sum(x[1]), x[0])):
        n = sum(counts)
        out[hub] = max(range(len(counts)), key=lambda s: (min(room.get(s, whole), n), counts[s], -s))
        room[out[hub]] = room.get(out[hub], whole) - n
    return out


def allowed(wishes: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(from, to, linked documents that may move, unlinked ones that move) for each pair of shards.

    For each pair, both directions add up to the same number.
    """
    out, left = [], dict(free)
    for i in range(shards):
        for j in range(i + 1, shards):
            there, back = wishes.get((i, j), 0), wishes.get((j, i), 0)
            swap = min(there, back)
            more_there = min(there - swap, left.get(j, 0))
            more_back = min(back - swap, left.get(i, 0))
            left[j], left[i] = left.get(j, 0) - more_there, left.get(i, 0) - more_back
            out += [(i, j, swap + more_there, more_back), (j, i, swap + more_back, more_there)]
    return [x for x in out if x[2] or x[3]]


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = 6) -> DataFrame:
    """``nodes`` (row: 0 to n - 1, without gaps) with ``shard``; links as (row, hub).

    Counts of shards are at most one apart. Ends when no document may move, or after ``rounds``.
    """
    n = nodes.count()
    links = cut_lineage(split_hubs(links, max(1, n // shards), max(1, n // shards // SHARD_PARTS)))
    linked = links.select("row").distinct().withColumn("linked", F.lit(True))
    start = nodes.join(linked, "row", "left").select("row", F.coalesce("linked", F.lit(False)).alias("linked"))
    placed = cut_lineage(start.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")))
    held = lambda s: F.count_if(F.col("shard") == s)
    home = None
    for _ in range(rounds):
        if home is None:  # parts of hubs beyond a shard: two for each shard at most
            parts = links.where("split").join(placed, "row").groupBy("hub").agg(F.array(*[held(s) for s in range(shards)]).alias("held"))
            home = homes({r.hub: list(r.held) for r in parts.collect()}, n // shards)
            wanted = nodes.sparkSession.createDataFrame([*home.items()], "part long, home int")
        by_salt = links.join(placed, "row").groupBy("hub", "salt").agg(*[held(s).alias(f"c{s}") for s in range(shards)])
        by_hub = by_salt.groupBy("hub").agg(F.array(*[F.sum(f"c{s}") for s in range(shards)]).alias("held"), F.collect_list("salt").alias("salts"))
        drawn = F.transform("held", lambda x, s: x + F.when(s == F.col("home"), n).otherwise(0))
        by_hub = by_hub.join(F.broadcast(wanted), F.col("hub") == F.col("part"), "left").select("hub", drawn.alias("held"), F.explode("salts").alias("salt"))
        seen = links.join(by_hub, ["hub", "salt"]).groupBy("row").agg(F.min("hub").alias("hub"), F.count(F.lit(1)).alias("hubs"), *[F.sum(F.col("held")[s]).alias(f"h{s}") for s in range(shards)])
        here = lambda s: F.when(F.col("shard") == s, F.col("hubs")).otherwise(0)  # noqa: E731  a document isn't its own neighbour
        near = F.array_max(F.array(*[F.struct((F.col(f"h{s}")).alias("n"), F.xxhash64("hub", F.lit(s)), F.lit(s).alias("to")) for s in range(shards)]))
        at = F.coalesce(*[F.when(F.col("shard") == s, F.col(f"h{s}") - here(s)) for s in range(shards)])
        wish = placed.where("linked").join(seen, "row").select("row", "shard", near.alias("best"), at.alias("at")).where("best.n > at and best.to <> shard")
        wish = cut_lineage(wish.select("row", "shard", F.col("best.to").alias("to")))
        wishes = {(r.shard, r.to): r.n for r in wish.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        free = {r.shard: r.n for r in placed.where("not linked").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        moves = allowed(wishes, free, shards)
        if not moves:
            break
        spark = nodes.sparkSession
        quota = spark.createDataFrame([(i, j, k) for i, j, k, _ in moves], "shard int, to int, most long")
        ranked = gapless(wish, "place", ["shard", "to"], ["row"], sum(wishes.values()))
        going = ranked.join(F.broadcast(quota), ["shard", "to"]).where("place < most").select("row", "to")
        ranges, ends = [], {}
        for i, j, _, k in moves:
            if k:
                ranges.append((i, j, ends.get(i, 0), ends.get(i, 0) + k))
                ends[i] = ends.get(i, 0) + k
        if ranges:
            spans = spark.createDataFrame(ranges, "shard int, to int, lo long, hi long")
            ranked = gapless(placed.where("not linked").select("row", "shard"), "place", ["shard"], ["row"], sum(free.values()))
            going = going.unionByName(ranked.join(F.broadcast(spans), "shard").where("place >= lo and place < hi").select("row", "to"))
        placed = cut_lineage(placed.join(going, "row", "left").select("row", "linked", F.coalesce("to", "shard").alias("shard")))
    return placed.select("row", "shard")


def cut_links(placed: DataFrame, links: DataFrame) -> int:
    """How many documents stand apart from the largest part of their hub, summed up over hubs."""
    parts = links.join(placed, "row").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shard_copies(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless in the shard) and grown_shard (null).

    Equal texts are neighbours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (text_bytes(F.col(text_col)) + 1).alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("hub"))
    base = cut_lineage(base)
    n = base.count()
    nodes = cut_lineage(gapless(base, "row", [], ["id", "crc", "size", "hub"], n))
    placed = propagate(nodes.select("row"), nodes.select("row", "hub"), shards, rounds)
    out = gapless(nodes.join(placed, "row"), "slot", ["shard"], ["row"], n)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
