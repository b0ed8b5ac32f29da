"""Connected components of a table of links, by union-find in tasks and star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citedspark.session import staged

#: Links of a task.
LINKS = 50_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links; a link to its root for each node that is none."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    pairs = np.array([(node, root(node)) for node in list(parent)], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _stars(links: DataFrame, own_only: bool, tasks: int) -> DataFrame:
    """Move links (u > v) to the least neighbour: of all neighbours, or of the smaller ones only.

    A node of many links is a minimum in one aggregate and rows of a join, never a list.
    """
    seen = links if own_only else links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = seen.join(least, "u")
    if own_only:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").coalesce(tasks).distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, root: the least node reachable, for every node that a link names.

    Links are longs; self-links and repeats are allowed, an empty table gives an empty one.
    Each round is a checkpoint, so a lost executor costs the current round at most. The number
    of tasks follows the number of links that are left.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    current = staged(pairs.mapInArrow(_forest, "u long, v long").distinct())
    count, mark = current.count(), None
    for _ in range(rounds):
        tasks = 1 + count // LINKS
        current = staged(_stars(_stars(current, False, tasks), True, tasks).coalesce(tasks))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        count, mark = now[0], now
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
