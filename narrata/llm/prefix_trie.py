"""The prefix trie of conversations, found by fixed-length block digests and refined only where siblings diverge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import discard, releasing, staged
from narrata.operators.ordered import numbered

#: Turns of a block, and blocks of a block of the next level.
BLOCK = 4
#: The first turns that a conversation takes from its base: fewer than this.
HEADS = 6
ROOT = b""


def turns_of(convs: DataFrame) -> DataFrame:
    """(conv, place, digest, len) of the turns of each conversation; place counts from 0 by turn (null first)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("len"))
    return numbered(slim, ["conv"], ["turn", "role", "digest"]).select("conv", "place", "digest", "len")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth from 0, digest, len) of the rebuilt conversations, and (conv, total) for each, the turnless included.

    The first h turns are those of the conversation conv - conv % 100, h being the unsigned crc32 of the decimal conv
    modulo 6; the conversation's own turns after its first h follow.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    hundred = F.col("conv") - F.col("conv") % 100
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = own.withColumn("h", h).withColumn("base", hundred).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = staged(plan.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total")), "plan")
    first = turns.where(F.col("place") < HEADS - 1).withColumnRenamed("conv", "base")
    head = first.join(plan.select("conv", "base", "h"), "base").where("place < h").select("conv", F.col("place").alias("depth"), "digest", "len")
    rest = turns.join(plan.select("conv", "h", "taken"), "conv").where("place >= h").select("conv", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "digest", "len")
    return head.union(rest), plan.select("conv", "total")


def _blocks(rows: DataFrame, at: str) -> DataFrame:
    """(conv, k, items, digest, len): BLOCK rows of a conversation that follow each other, in order."""
    item = F.struct(F.col(at).alias("at"), "digest", "len")
    grouped = rows.groupBy("conv", F.floor(F.col(at) / BLOCK).alias("k")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = F.aggregate("items", F.lit(b""), lambda acc, i: F.concat(acc, i["digest"]))
    return grouped.select("conv", "k", "items", F.unhex(F.md5(joined)).alias("digest"), F.aggregate("items", F.lit(0).cast("long"), lambda acc, i: acc + i["len"]).alias("len"))


def _named(until: Column) -> Column:
    """The name of the prefix that ends with items[until]; the last of a full block has the name that the level above gives."""
    inner = F.aggregate(F.slice("items", F.lit(1), until + 1), F.concat(F.lit(b"/"), F.col("before")), lambda acc, i: F.concat(acc, i["digest"]))
    return F.when(until + 1 == BLOCK, F.col("after")).otherwise(F.unhex(F.md5(inner)))


def _steps() -> Column:
    """Each item of a block with the names of the prefixes before and after it and the code points before it."""

    def step(item: Column, j: Column) -> Column:
        before = F.when(j == 0, F.col("before")).otherwise(_named(j - 1))
        cum = F.aggregate(F.slice("items", F.lit(1), j), F.col("cum"), lambda acc, i: acc + i["len"])
        return F.struct(item["at"].alias("at"), before.alias("before"), _named(j).alias("after"), cum.alias("cum"), item["len"].alias("len"))

    return F.transform("items", step)


def prefixed_blocks(rows: DataFrame, longest: int) -> DataFrame:
    """(conv, k, items, digest, len, before, after, cum): blocks of turns with the name of the prefix before each (and after
    it, where it is full) and the code points before it.

    Blocks are grouped to blocks of blocks until a conversation is one of them, and names then go down level by level, so a
    conversation of any length takes groups of BLOCK rows and as many rounds as the logarithm of its length.
    """
    levels = [staged(_blocks(rows, "depth"), "blocks")]
    while longest > BLOCK:
        longest = -(-longest // BLOCK)
        levels.append(staged(_blocks(levels[-1], "k"), "blocks"))
    top = levels.pop().withColumn("before", F.lit(ROOT)).withColumn("cum", F.lit(0).cast("long"))
    whole = F.aggregate("items", F.lit(b"/"), lambda acc, i: F.concat(acc, i["digest"]))
    top = top.withColumn("after", F.unhex(F.md5(whole)))
    while levels:
        below = top.select("conv", F.inline(_steps())).select("conv", F.col("at").alias("k"), "before", "after", "cum")
        top = levels.pop().join(below, ["conv", "k"])
    return staged(top, "prefixed")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ends(name, conv): SHA-256 of the decimal convs, ascending, joined by commas.

    Ranges of (name, conv) are joined to texts of a batch each; the digest of a name, which by its nature is one sequence,
    then reads its texts in order as a stream and holds none of them.
    """

    @releasing
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            texts = [",".join(map(str, convs[a:b])) for a, b in zip(starts, [*starts[1:], len(names)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in starts], pa.binary()), pa.array([convs[i] for i in starts], pa.int64()), pa.array(texts, pa.string())], names=["name", "first", "ids"])

    @releasing
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and n == name:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    texts = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(joined, "name binary, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Conversations that agree on a block of turns and all before it are one group; turns are looked at only for the groups
    that have siblings, and only once a group. Sums over subtrees need no walk: a conversation that isn't a node's smallest
    member saves in the node's subtree the code points from the node to the turn where it parts from all smaller ones.
    Cases: rows without conv_id take no part; null role or text is empty; turns that tie are ordered by role, then by the
    digest of role and text; repeated rows are turns of their own; a negative conv_id takes the remainder of its own sign;
    an empty table has no nodes; other columns are ignored.
    """
    turns = staged(turns_of(convs), "turns")
    rows, totals = rebuilt(turns)
    found = totals.agg(F.min("conv").alias("least"), F.count("*").alias("n"), F.max("total").alias("longest")).first()
    least = F.lit(found["least"]).cast("long")
    blocks = prefixed_blocks(rows, found["longest"] or 0)
    heads = F.first("items").alias("items"), F.first("after").alias("after"), F.first("cum").alias("cum")
    groups = staged(blocks.groupBy("before", "digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), *heads), "groups")
    lone = groups.groupBy("before").agg(F.count("*").alias("siblings"), F.min("digest").alias("digest")).where("siblings = 1").drop("siblings")
    straight, parting = (groups.join(lone, ["before", "digest"], how) for how in ("left_semi", "left_anti"))

    def spread(of: DataFrame, *more: str) -> DataFrame:
        """The turns of groups as nodes."""
        cells = of.select("conv", "n", *more, F.inline(_steps()))
        return cells.select(F.col("after").alias("name"), F.col("before").alias("parent"), (F.col("at") + 1).alias("depth"), "conv", "n", "cum", *more)

    met = spread(parting).groupBy("name").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.min("cum").alias("cum"))
    root = totals.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), least.alias("conv"), "n", F.lit(0).cast("long").alias("cum"))
    nodes = staged(spread(straight).unionByName(met).unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    deep = nodes.where("depth > 1").join(nodes.where("depth > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv")), "parent")
    shallow = nodes.where("depth < 2").withColumn("parent_conv", F.when(F.col("depth") == 1, least))
    placed = staged(deep.unionByName(shallow).join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "placed")

    last = totals.where("total > 0").select("conv", F.floor((F.col("total") - 1) / BLOCK).alias("k"))
    end = blocks.join(last, ["conv", "k"]).select("conv", _named(F.size("items") - 1).alias("name"), (F.col("cum") + F.col("len")).alias("until"))
    turnless = totals.where("total = 0").select("conv", F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("until"))
    parted = placed.where("parent_conv <> conv").select("conv", F.col("cum").alias("shared"))
    leaves = placed.where("n_children = 0").select("conv", F.lit(1).cast("long").alias("leaf"))
    shared = F.when(F.col("conv") == least, F.lit(0).cast("long")).otherwise(F.coalesce("shared", "until"))
    ends = end.union(turnless).join(parted, "conv", "left").join(leaves, "conv", "left")
    ends = staged(ends.select("conv", "name", shared.alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "ends")

    # of each group and then of each node: what its members share with smaller ones, that of its smallest member, and its leaves
    def sums(own: Column) -> list[Column]:
        return [F.sum("shared").alias("shared"), F.min(own).alias("own"), F.sum("leaf").alias("leaf")]

    of_group = blocks.select("conv", "before", "digest").join(ends.select("conv", "shared", "leaf"), "conv").groupBy("before", "digest").agg(*sums(F.struct("conv", "shared")))
    more = ("shared", "own", "leaf")
    straight, parting = (g.join(of_group, ["before", "digest"]) for g in (straight, parting))
    of_node = spread(straight, *more).select("name", *more)
    of_node = of_node.unionByName(spread(parting, *more).groupBy("name").agg(*sums(F.col("own"))))
    of_root = ends.agg(F.sum("shared").alias("shared"), F.min(F.struct("conv", "shared")).alias("own"), F.sum("leaf").alias("leaf")).where("own IS NOT NULL")
    of_node = of_node.unionByName(of_root.select(F.lit(ROOT).alias("name"), *more))
    saved = F.col("shared") - F.col("own.shared") - (F.col("n") - 1) * F.col("cum")
    none = hashlib.sha256(b"").hexdigest()
    whole = placed.join(of_node, "name").join(ends_digests(ends.select("name", "conv")), "name", "left")
    out = whole.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    discard(turns)
    return out
