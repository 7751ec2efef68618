"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import releasing, slices, staged, texts_of
from narrata.llm.graph import connected_components

#: Buckets of more fingerprints than this are linked by common neighbours instead of pairs.
PAIR_BUCKET = 64


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles; 0 where there is no word.

    A-Z become lower case, words end at ASCII white space, shorter texts are one shingle, repeated shingles count
    again, and a bit is set if it is set in over half of the shingles' XXH64.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, seed) for s in shingles])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long. A null text counts as an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, words, seed) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def blocks(bits: int) -> list[list[tuple[int, int]]]:
    """Sets of (shift, width) blocks of a fingerprint such that two that differ in at most `bits` bits agree on one whole set.

    The 64 bits are cut into 2 * bits blocks, of which at least `bits` stay whole; each choice of as many blocks is a
    key of about 32 bits, so that buckets stay small at any corpus size.
    """
    parts = max(1, 2 * bits)
    ends = [round(64 * i / parts) for i in range(parts + 1)]
    pieces = [(lo, hi - lo) for lo, hi in zip(ends, ends[1:], strict=False)]
    return [list(c) for c in combinations(pieces, max(1, parts - bits))]


def _block_key(fp: Column, pieces: list[tuple[int, int]]) -> Column:
    mask = 0
    for shift, width in pieces:
        mask |= ((1 << width) - 1) << shift
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(distinct: DataFrame, bits: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that join all that differ in at most `bits` bits.

    Fingerprints are joined on blocks and verified by Hamming distance. A bucket of over pair_bucket fingerprints isn't
    joined pair by pair: there, two fingerprints meet at a common neighbour, which is exact for one or two bits (they
    are at most two bits apart just if both are within one bit of some value) and makes at most 65 rows a fingerprint.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2: a larger radius has no exact way for large buckets")
    fp = F.col("fp")
    keys = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("set"), _block_key(fp, b).alias("value")) for i, b in enumerate(blocks(bits))))
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.set", "key.value")
    crowded = keyed.groupBy("set", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(crowded, ["set", "value"]), "blocks")
    small = shared.where(F.col("n") <= pair_bucket)
    other = small.select("set", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= bits
    pairs = small.join(other, ["set", "value"]).where((F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    large = shared.where(F.col("n") > pair_bucket).select("fp").distinct()
    flipped = [fp.bitwiseXOR(F.lit(m)) for m in [*(1 << i for i in range(63)), -(1 << 63)]]
    if bits == 2:  # within one bit of the value `at`
        meeting = large.select("fp", F.lit(0).alias("bit"), F.explode(F.array(fp, *flipped)).alias("at"))
    else:  # both ends of an edge of the cube, which its lower end and its bit name
        meeting = large.select("fp", F.posexplode(F.array(*(F.least(fp, x) for x in flipped))).alias("bit", "at"))
    # at most 65 distinct fingerprints meet at one place
    stars = meeting.groupBy("bit", "at").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    hub = F.array_min("all")
    spokes = stars.select(hub.alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs.union(spokes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the smallest id that can be reached over links of at most `bits` differing bits, the row's own
    included. Equal fingerprints are first counted as one, so copies never make pairs. Cases: null and empty texts
    have fingerprint 0 and are linked like others; rows that repeat an id each get a row; a null id stays null and is
    not chosen as component_id unless a component has no other; an empty table gives no rows; other columns of docs are
    ignored, whatever their names.
    """
    found = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    heads = staged(found.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    # a node is ordered by its smallest id, so a component's name holds the id that is wanted, and no join by component is needed
    node = F.struct(F.col("head").isNull().alias("unnamed"), F.col("head").alias("id"), "fp")
    edges = links(heads.select("fp"), bits, pair_bucket)
    for end in ("a", "b"):
        edges = edges.withColumnRenamed(end, "fp").join(heads.withColumn(end, node).drop("head"), "fp").drop("fp")
    components = connected_components(edges).select("node.fp", F.col("component.id").alias("least"))
    final = heads.join(components, "fp", "left").select("fp", F.coalesce("least", "head").alias("component_id"))
    return found.join(final, "fp").select("id", "fp", "component_id")
