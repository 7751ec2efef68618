import zlib
from collections import Counter

from pyspark.sql import functions as F

from narrata.llm import ring as R


def test_counts_are_one_apart_and_slots_without_gaps(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd_docs, docs.union(docs)):
        rows = R.ring_shards(df, shards=7).collect()
        counts = Counter(r.shard for r in rows)
        assert sum(counts.values()) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in df.collect())
        assert Counter((r.id, r.size, r.text_crc32) for r in rows) == want
    assert R.ring_shards(no_docs).count() == 0


def test_one_row_many_times(spark):
    df = spark.range(1).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("n"))
    assert Counter(Counter(r.shard for r in R.ring_shards(df, shards=8).collect()).values()) == {125: 8}


def test_planning_keeps_loads_and_moves_little():
    counts = {s: (s * 7919) % 13 for s in range(0, R.RING_SLOTS, 11)}
    total = sum(counts.values())
    homes = {}
    for n in (40, 41):
        segments = R.assign_slots(counts, n, load_factor=1.25)
        load = Counter()
        for slot, first, end, shard in segments:
            load[shard] += end - first
            homes.setdefault((slot, n), []).extend([shard] * (end - first))
        assert sum(load.values()) == total and max(load.values()) <= R.capacities(total, n, 1.25)[0]
    moved = sum(a != b for s in counts for a, b in zip(homes.get((s, 40), []), homes.get((s, 41), [])))
    assert moved < 0.1 * total
    assert set(R.virtual_nodes(40)) >= set(x for x in R.virtual_nodes(41) if x[1] < 40)
