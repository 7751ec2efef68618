"""SimHash near-duplicates at a lower similarity: long fingerprints, blocks with their weakest bits tried both ways, and
an exact comparison of the shingles of every proposed pair."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import discard, new_name, releasing, slices, staged, texts_of
from narrata.llm.graph import connected_components, forest_roots

#: Bits of each block that are tried both ways.
WEAK = 2
PAIR_BUCKET = 8
#: Texts of so few shingles are proposed at any distance, as theirs scatter more than the formula says.
FEW = 16
COMPARED = 2048
#: Bits of a set's parity: as powers of two, four to eight for each shingle within these.
LEAST_PARITY, MOST_PARITY = 6, 16


@dataclass(frozen=True)
class Blocks:
    """A fingerprint is cut into `count` blocks of `width` bits; it has as many bits as these need.

    Two unlike texts share a block's key by chance once in 2^width, so a corpus of many times 2^width texts needs wider blocks;
    these agree less often, so there must be more of them: see `of_width`.
    """

    width: int
    count: int

    @property
    def lanes(self) -> int:
        return -(-self.width * self.count // 64)

    @staticmethod
    def of_width(width: int) -> Blocks:
        """As many blocks of this width as find about the same share of near copies at every width."""
        return Blocks(width, round(44 * 1.17 ** (width - 26)))


#: For up to some hundred million texts: a bucket holds one or two of them by chance at 2^26 texts.
DEFAULT_BLOCKS = Blocks.of_width(26)


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles; a text with fewer words is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(parts)] if len(parts) <= words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64))


def sketch(h: np.ndarray, cut: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of a shingle set as signed 64-bit words, and its block keys; all zero and no key for an empty set.

    As in the short fingerprint a bit is set if it is set in over half of the hashes, here of the distinct shingles. Each
    block gives 2^WEAK keys: its bits, with those whose counts are nearest to a half taken both ways.
    """
    if not len(h):
        return np.zeros(cut.lanes, np.int64), np.zeros(0, np.int64)
    ones = np.empty((cut.lanes, 64), np.int64)
    for lane in range(cut.lanes):  # further hashes of a shingle by a public 64-bit mixer
        z = h + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones[lane] = np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    lead = (2 * ones - len(h)).ravel()
    fp = np.packbits(lead > 0).view(">i8").astype(np.int64)
    counts = lead[: cut.count * cut.width].reshape(cut.count, cut.width)
    powers = 1 << np.arange(cut.width, dtype=np.int64)
    keys = ((counts > 0) @ powers)[:, None]
    weakest = np.argsort(np.abs(counts), axis=1, kind="stable")[:, :WEAK]
    for k in range(WEAK):
        keys = np.concatenate([keys, keys ^ powers[weakest[:, k]][:, None]], axis=1)
    return fp, (keys + (np.arange(cut.count, dtype=np.int64) << cut.width)[:, None]).ravel()


def radius(similarity: float, bits: int) -> int:
    """Differing bits of fingerprints of texts whose shingle sets have this Jaccard similarity: the mean and three deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def parity(h: np.ndarray) -> bytes:
    """For each value of the hashes' low bits whether an odd number of the set's hashes has it.

    Where the parities of two sets differ, one set holds a hash that the other doesn't, so they differ in as many bits as the
    sets differ in shingles at most; shingles that both hold cancel out, however many there are.
    """
    level = min(MOST_PARITY, max(LEAST_PARITY, (4 * len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64((1 << level) - 1)).astype(np.int64), minlength=1 << level) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """The parities of a table's rows, of one size or another; one is made smaller by adding its halves."""

    def __init__(self, raw: list[bytes]):
        self.level = np.array([(8 * len(r)).bit_length() - 1 for r in raw], np.int64)
        self.raw, self.made = raw, {}

    def of_level(self, level: int) -> np.ndarray:
        """A row of 64-bit words for each parity of this size or more, zeros for others."""
        if level not in self.made:
            out = np.zeros((len(self.raw), 1 << level - 6), np.uint64)
            for own in np.unique(self.level[self.level >= level]):
                at = np.flatnonzero(self.level == own)
                words = np.frombuffer(b"".join([self.raw[i] for i in at]), np.uint64).reshape(len(at), -1, out.shape[1])
                out[at] = np.bitwise_xor.reduce(words, axis=1)
            self.made[level] = out
        return self.made[level]


def differ_by(a: Parities, b: Parities, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows x of a and y of b, in how many shingles their sets differ at least."""
    level, least = np.minimum(a.level[x], b.level[y]), np.zeros(len(x), np.int64)
    for k in np.unique(level):
        at, left, right = np.flatnonzero(level == k), a.of_level(k), b.of_level(k)
        step = max(1, (1 << 20) // left.shape[1])
        for i in range(0, len(at), step):
            some = at[i : i + step]
            least[some] = np.bitwise_count(left[x[some]] ^ right[y[some]]).sum(axis=1, dtype=np.int64)
    return least


def _differing(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs(a, b) whose sets(node, shingles) have a Jaccard similarity of `similarity` or more."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                hold.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(hold, pa.bool_()))

    of_a, of_b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def wide_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", blocks: Blocks = DEFAULT_BLOCKS) -> DataFrame:
    """(id, component_id) per row of docs: the smallest id that can be reached over links of `similarity` or more.

    Fingerprints are joined on blocks, which proposes pairs; those whose Hamming distance and numbers of shingles leave
    the similarity possible are verified by the Jaccard similarity of their shingle sets, and only pairs that have it
    are links. Texts with equal sets are first counted as one. Only links between different components can change the
    result, so each set is first verified against one partner, the first of the buckets that it shares most of; then against
    one such partner in another component; then, in buckets that still hold several components, against the bucket's first; and then those outside the first's
    component against all of the bucket in other components, in buckets of over PAIR_BUCKET sets block by block, where pairs whose
    parities show that they are less similar go before they become rows. No proposed link that joins components is lost, and a
    group of near copies doesn't verify its pairs. Cases: texts without words are one group; rows that repeat an id each get a row; a null id is chosen only where
    a component has no other; an empty table gives no rows; other columns are ignored.
    """
    rows, heads = _grouped(docs, words, similarity, id_col, text_col, blocks)
    least = heads.select(F.col("node").alias("part"), F.col("head.id").alias("component_id"))
    named = heads.select("digest", "part").join(least, "part").select("digest", "component_id")
    return rows.select("id", "digest").join(named, "digest").select("id", "component_id")


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, cut: Blocks) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, digest), and for each digest of a shingle set (digest, node, head, part).

    head is the set's first row, by (id is null, id, text_hash). Nodes are numbered in the order of their heads, so the
    smallest node of a component, its part, is that of its first row.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lanes = [f"f{i}" for i in range(cut.lanes)]
    key_type, key_kind = ("int", np.int32) if cut.count << cut.width <= 1 << 31 else ("long", np.int64)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, words) for t in texts_of(batch, "text")]
            found = [sketch(h, cut) for h in sets]
            fps = np.array([fp for fp, _ in found], np.int64).reshape(-1, cut.lanes)
            digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            keys = np.concatenate([np.zeros(0, key_kind), *(k.astype(key_kind) for _, k in found)])
            ends = np.cumsum([0, *(len(k) for _, k in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), digests, pa.array([len(h) for h in sets], pa.int32()), pa.array([parity(h) for h in sets], pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in fps.T), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=["id", "text_hash", "digest", "m", "parity", *lanes, "keys"])

    @releasing
    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in texts_of(batch, "text")], pa.binary())], names=["node", "shingles"])

    limit = radius(similarity, 64 * cut.lanes)
    rows = given.mapInArrow(run, f"id {id_type}, text_hash long, digest binary, m int, parity binary, {', '.join(f'{c} long' for c in lanes)}, keys array<{key_type}>")
    rows = staged(rows, "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    heads = rows.groupBy("digest").agg(first.alias("head"), F.min("text_hash").alias("text_hash"), F.min("m").alias("m"), F.min("parity").alias("parity"), *(F.min(c).alias(c) for c in lanes), F.min("keys").alias("keys"))
    heads = staged(heads.orderBy("head").withColumn("node", F.monotonically_increasing_id()), "heads")
    prints = heads.select("node", "m", *lanes)
    # Nearly all keys occur once, so nothing can be combined before the shuffle: counts and join read one and the same.
    keyed = heads.select("node", F.explode("keys").alias("key")).repartition("key")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = staged(keyed.join(crowded, "key"), "blocks")
    other = [f"g{i}" for i in range(cut.lanes)]
    close = (_differing([F.col(c) for c in lanes], [F.col(c) for c in other]) <= limit) | (F.least("m", "m_b") <= FEW)
    near = close & (F.least("m", "m_b") >= similarity * F.greatest("m", "m_b") - 1e-9)
    as_other = prints.select(F.col("node").alias("b"), F.col("m").alias("m_b"), *(F.col(c).alias(o) for c, o in zip(lanes, other, strict=True)))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = heads.select("node", "text_hash").join(nodes, "node")
        texts = given.select("text_hash", "text").join(wanted, "text_hash").select("node", "text").dropDuplicates(["node"])
        sets = staged(texts.mapInArrow(read_sets, "node long, shingles binary"), "sets")
        found = staged(similar(pairs, sets, similarity), "links")
        discard(pairs, sets)
        return found

    def possible(pairs: DataFrame) -> DataFrame:
        return pairs.join(prints.withColumnRenamed("node", "a"), "a").join(as_other, "b").where(near).select("a", "b")

    def placed_now() -> DataFrame:
        """The buckets' nodes with their component and that of the bucket's first."""
        of_node = shared.join(parts, "node", "left").select("key", "node", "n", "hub", F.coalesce("component", "node").alias("part"))
        of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part"))
        return staged(of_node.join(of_hub, "hub", "left").withColumn("hub_part", F.coalesce("hub_part", "hub")), "placed")

    def most_shared(rows: DataFrame) -> DataFrame:
        """For each node the first of the most of its buckets among the rows."""
        often = rows.groupBy("node", "hub").agg(F.count("*").alias("times"))
        best = often.groupBy("node").agg(F.max(F.struct("times", (-F.col("hub")).alias("first"))).alias("best"))
        return best.select((-F.col("best.first")).alias("a"), F.col("node").alias("b"))

    def grown(parts: DataFrame, links: DataFrame) -> DataFrame:
        """(node, component) with the links added: only components that they join are followed, by their smallest nodes."""
        for end in ("a", "b"):
            of_end = parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            links = links.join(of_end, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        links = staged(links, "joined")
        joined = connected_components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_a").alias("component")), F.struct(F.col("b").alias("node"), F.col("of_b").alias("component")))).alias("e")).select("e.*")
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
        whole = staged(parts.union(ends).distinct().join(to, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "grown")
        discard(links)
        return whole

    # each node is verified against one smaller one, so these links are a forest
    parts = forest_roots(verified(possible(most_shared(shared.where("node <> hub")))).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    placed = placed_now()
    parts = grown(parts, verified(possible(most_shared(placed.where("part <> hub_part")))))
    discard(placed)
    placed = placed_now()
    parts = grown(parts, verified(possible(placed.where("part <> hub_part").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())))
    discard(placed)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    group = ["key", "x", "y"]

    def first_shared(apart: np.ndarray) -> np.ndarray:
        """The first block whose bits don't differ, for each row of differing bits (lanes); the number of blocks if none."""
        bits = np.unpackbits(apart.astype(">u8").view(np.uint8).reshape(len(apart), -1), axis=1)
        same = ~bits[:, : cut.count * cut.width].reshape(-1, cut.count, cut.width).any(axis=2)
        return np.where(same.any(axis=1), same.argmax(axis=1), cut.count)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of a bucket. Two that agree on an earlier block meet in its bucket too, so they are left to that one."""
        block = left["key"][0].as_py() >> cut.width if len(left) else 0
        a, b = (np.column_stack([np.asarray(t[c], np.int64) for c in lanes]).view(np.uint64) if len(t) else np.zeros((0, cut.lanes), np.uint64) for t in (left, right))
        (na, pa_, ma), (nb, pb, mb) = ([np.asarray(t[c], np.int64) for c in ("node", "part", "m")] for t in (left, right))
        odd_a, odd_b = (Parities(t["parity"].to_pylist() if len(t) else []) for t in (left, right))
        out = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(a), 32):
            apart = np.bitwise_count(a[i : i + 32, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
            less, more = np.minimum(ma[i : i + 32, None], mb), np.maximum(ma[i : i + 32, None], mb)
            r, c = np.nonzero(((apart <= limit) | (less <= FEW)) & (less >= similarity * more - 1e-9) & (pa_[i : i + 32, None] != pb[None, :]))
            for j in range(0, len(r), 8192):
                x, y = i + r[j : j + 8192], c[j : j + 8192]
                may = differ_by(odd_a, odd_b, x, y) <= (ma[x] + mb[y]) * (1 - similarity) / (1 + similarity) + 1e-6
                if not may.any():
                    continue
                x, y = x[may], y[may]
                here = first_shared(a[x] ^ b[y]) >= block
                out.append(np.sort(np.column_stack([na[x[here]], nb[y[here]]]), axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table([found[:, 0], found[:, 1]], schema=schema)

    placed = placed_now()
    outside = placed.where("part <> hub_part AND n > 2")
    if not outside.isEmpty():
        few = outside.where(F.col("n") <= PAIR_BUCKET).select("key", "node", "part")
        rest = placed.where((F.col("n") <= PAIR_BUCKET) & (F.col("node") != F.col("hub"))).select("key", F.col("node").alias("c"), F.col("part").alias("c_part"))
        met = few.join(rest, "key").where("part <> c_part").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        large = placed.where(F.col("n") > PAIR_BUCKET)
        sizes = large.groupBy("key").agg(F.count_if(F.col("part") != F.col("hub_part")).alias("apart")).where("apart > 0")
        sized = staged(large.join(sizes, "key"), "large")
        blocks_all = F.greatest(F.lit(1), F.ceil(F.col("n") / COMPARED)).cast("int")
        blocks_out = F.greatest(F.lit(1), F.ceil(F.col("apart") / COMPARED)).cast("int")
        some = sized.where("part <> hub_part").withColumn("x", F.pmod(F.xxhash64("node"), blocks_out).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), blocks_all - 1)))
        full = sized.withColumn("y", F.pmod(F.xxhash64("node"), blocks_all).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), blocks_out - 1)))
        some, full = (staged(x.select(*group, "node", "part").join(heads.select("node", "m", "parity", *lanes), "node"), "compared") for x in (some, full))
        joins = some.groupBy(*group).cogroup(full.groupBy(*group)).applyInArrow(compare, "a long, b long")
        parts = grown(parts, verified(possible(met).union(joins).distinct()))
        discard(sized, some, full)
    discard(placed)

    return rows.select("id", "text_hash", "digest"), heads.join(parts, "node", "left").select("digest", "node", "head", F.coalesce("component", "node").alias("part"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", blocks: Blocks = DEFAULT_BLOCKS) -> DataFrame:
    """The rows of docs that stay, one of each group of near copies: the one with the smallest id.

    Rows are told apart by id and text, so different texts under one id, or without any, are documents of their own; of
    rows equal in both one stays. Of a group's rows one without id stays only where there is no other. Null and empty texts
    are one group; an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    rows, heads = _grouped(docs, words, similarity, id_col, text_col, blocks)
    stay = heads.where("node = part").select("digest", "head")
    met = rows.join(stay, "digest", "left").withColumn("stays", F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.text_hash") == F.col("text_hash")))
    marks = staged(met.groupBy("id", "text_hash").agg(F.coalesce(F.bool_or("stays"), F.lit(False)).alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "marks")
    key, digest = (new_name(docs, n) for n in ("id", "text_hash"))
    named = docs.withColumns({key: F.col(id_col), digest: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})

    def same(marked: DataFrame) -> Column:
        return named[key].eqNullSafe(marked["id"]) & (named[digest] == marked["text_hash"])

    once = named.join(marks, same(marks), "left_anti")
    repeated = marks.where("stays")
    if not repeated.isEmpty():
        once = once.union(named.join(repeated, same(repeated), "left_semi").dropDuplicates([key, digest]))
    return once.drop(key, digest)
