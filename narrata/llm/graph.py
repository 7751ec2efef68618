"""Connected components over an edge table, without hot groups in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Each round hooks a node and its parent under the smallest parent among the neighbours, then halves the paths, so
    the rounds grow as the logarithm of a component's size. Minima are combined before each shuffle, and the joins are
    plain equi-joins whose skewed partitions adaptive execution can split, so a node of very many edges is harmless.
    Rounds are written to the shared folder; an empty edge table gives an empty result; self-loops and repeated
    edges change nothing; edges with a null end are ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")), "parents")
    while True:
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("parent_b"))
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("parent_a"))
        seen = both.join(of_b, "b").groupBy("a").agg(F.min("parent_b").alias("low"))
        offers = seen.join(of_a, "a").select(F.explode(F.array(F.struct(F.col("a").alias("node"), "low"), F.struct(F.col("parent_a").alias("node"), "low"))).alias("o")).select("o.node", F.col("o.low").alias("parent"))
        hooked = staged(offers.union(parents).groupBy("node").agg(F.min("parent").alias("parent")), "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        halved = staged(hooked.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "parents")
        same = halved.join(parents.withColumnRenamed("parent", "before"), "node", "left").where("before IS NULL OR before <> parent").limit(1).count() == 0
        discard(hooked, parents)
        parents = halved
        if same:
            discard(both)
            return parents.withColumnRenamed("parent", "component")


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component) for every node of a forest parents(node, parent) in which each node has one row at most, with a smaller
    parent; component is the root of the node's tree, a root's own included.

    Each round replaces a node's parent by that one's parent, so the rounds grow as the logarithm of the depth, with one join
    each; its side of parents is unique, so a root of very many nodes is harmless. An empty table gives an empty result.
    """
    roots = parents.select(F.col("parent").alias("node"), "parent")
    at = staged(parents.select("node", "parent").union(roots).groupBy("node").agg(F.min("parent").alias("parent")), "forest")
    while True:
        up = at.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        higher = staged(at.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")), "forest")
        discard(at)
        at = higher
        if at.where("moved").isEmpty():
            return at.select("node", F.col("parent").alias("component"))
