"""Connected components of a table of links, distributed.

Each partition first reduces its links to stars by union-find, a bounded number of nodes at a time; rounds of large-star and small-star then join every node to
the least node of its component, until all links form stars. A round's tables are written in as many files as their size
asks for, not in one for each shuffle partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, partitions

LINKS_PER_TASK = 100_000
NODES_AT_ONCE = 1_000_000  # of one union-find; its stars are then written and a new one begins


class Forest:
    """Union-find; a root is the least node of its set."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while p.get(root, root) != root:
            root = p[root]
        while p.get(x, x) != x:
            p[x], x = root, p[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the nodes of each component of a symmetric boolean matrix."""
    out, open_ = [], near.any(axis=1)
    for root in np.flatnonzero(open_).tolist():
        if not open_[root]:
            continue
        front, open_[root] = np.array([root]), False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & open_)
            open_[front] = False
            out += [(root, x) for x in front.tolist()]
    return out


def groups(batches, keys: list[str]):
    """(key values, table) of consecutive rows with equal keys, across batches."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.append(np.flatnonzero(change), batch.num_rows)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held).combine_chunks()
                held = []
            held, held_key = [*held, batch.slice(a, b - a)], key
    if held:
        yield held_key, pa.Table.from_batches(held).combine_chunks()


def _stars_of(forest: Forest) -> pa.RecordBatch:
    pairs = np.array([(x, forest.find(x)) for x in list(forest.parent)], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _local_stars(batches, most: int = NODES_AT_ONCE):
    """Links of one partition -> a link from each node to the least node that it reaches in a stretch of the partition.

    A stretch ends after the batch in which its nodes exceed `most`; later rounds join what stretches have in common.
    """
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > most:
            yield _stars_of(forest)
            forest = Forest()
    yield _stars_of(forest)


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link and no smaller end is also a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.agg(F.max((F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0)) > 1)).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links (a, b) long, a <> b -> (node, component): every linked node, with the least node it reaches."""
    spark = links.sparkSession
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_local_stars, "a long, b long").distinct(), "links")
    width = min(partitions(spark), max(spark.sparkContext.defaultParallelism, edges.count() // LINKS_PER_TASK))
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, last = cut(large.coalesce(width), "large-star"), edges
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(width), "small-star")
        drop(spark, [f.rsplit("/", 1)[0] for f in [*large.inputFiles()[:1], *last.inputFiles()[:1]]])  # a round needs the one before alone
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct().toDF("node", "component"))
