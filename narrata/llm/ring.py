"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.llm.common import staged

#: Equal slots of the ring: the unit of planning on the driver, and the group within which rows are ranked.
RING_SLOTS = 65_536
#: Bytes that a stored row takes besides its text.
ROW_BYTES = 16


def virtual_nodes(shards: int, replicas: int = 128, slots: int = RING_SLOTS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in clockwise order. A node's place depends on its shard's number alone, except
    that a slot already taken by a lower shard passes it to the next free one, so further shards move no earlier node."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{replica}".encode()).digest()[:8], "big") % slots
            while at in taken:
                at = (at + 1) % slots
            taken[at] = shard
    return sorted(taken.items())


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may hold: load_factor times the mean, rounded up; at 1.0 the counts are at most one apart."""
    if load_factor <= 1.0:
        q, r = divmod(total, shards)
        return [q + (s < r) for s in range(shards)]
    return [-(-int(total * load_factor) // shards) + 1] * shards


def assign_slots(counts: dict[int, int], shards: int, replicas: int = 128, load_factor: float = 1.0, slots: int = RING_SLOTS) -> list[tuple[int, int, int, int]]:
    """Segments (slot, first, end, shard): rows ranked first <= rank < end in the slot go to the shard.

    Works on one count a slot, however many rows there are. In each round every shard takes, in clockwise order, what
    waits at its virtual nodes until it is full; the rest goes on clockwise to the next node of a shard with room.
    """
    nodes = virtual_nodes(shards, replicas, slots)
    room = capacities(sum(counts.values()), shards, load_factor)
    after: list[int] = []
    at = 0
    for slot in sorted(counts):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        after.append(at % len(nodes))
    waiting = [(node, slot, 0, counts[slot]) for node, slot in zip(after, sorted(counts), strict=True) if counts[slot]]
    segments: list[tuple[int, int, int, int]] = []
    while waiting:
        rest = []
        for node, slot, first, end in waiting:
            shard = nodes[node][1]
            take = min(room[shard], end - first)
            if take:
                segments.append((slot, first, first + take, shard))
                room[shard] -= take
            if first + take < end:
                rest.append((node, slot, first + take, end))
        waiting = []
        for node, slot, first, end in rest:
            while not room[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            waiting.append((node, slot, first, end))
        waiting.sort()
    return sorted(segments)


def ring_shards(docs: DataFrame, shards: int = 40, replicas: int = 128, load_factor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs; slots count from 0 in each shard without gaps.

    A row's place on the ring is the hash of its id, so equal texts spread out like others. Rows equal in id, size and
    checksum are counted before they are shuffled and told apart only at the end. The driver sees one count for each
    of the ring's slots, a fixed number. Cases: a null text has size 16 and checksum 0; a row without id takes its place
    from its checksum and size; rows that repeat an id each get a slot; an empty table gives no rows; other columns of
    docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = F.when(F.col("id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("place", place).withColumn("ring", F.pmod("place", F.lit(RING_SLOTS)).cast("int"))
    counted = staged(rows.groupBy("ring", "place", "id", "size", "text_crc32").agg(F.count("*").alias("copies")), "ring")
    counts = {r.ring: r.n for r in counted.groupBy("ring").agg(F.sum("copies").alias("n")).collect()}  # RING_SLOTS rows at most
    segments = []
    used = [0] * shards
    for ring, first, end, shard in assign_slots(counts, shards, replicas, load_factor):
        segments.append((ring, first, end, shard, used[shard]))
        used[shard] += end - first
    plan = spark.createDataFrame(segments, "ring int, first long, end long, shard int, base long")
    in_ring = Window.partitionBy("ring").orderBy("place", "id", "size", "text_crc32")
    ranked = counted.withColumn("to", F.sum("copies").over(in_ring.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("copies"))
    met = ranked.join(plan, "ring").withColumn("lo", F.greatest("from", "first")).withColumn("hi", F.least("to", "end")).where("lo < hi")
    one = met.withColumn("rank", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    return one.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
