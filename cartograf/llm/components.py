"""Connected components of links by union-find inside partitions and star contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

ONE_TASK = 1 << 20  # links that one task may hold


def union_find(edges) -> dict[int, int]:
    """Smallest reachable number of each number in ``edges``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the links a - b, sorted, and the smallest one reachable from each: minima over links, then halving of paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    for batch in batches:
        node, least = least_reachable(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        go = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[go]), pa.array(least[go])], ["a", "b"])


def _whole(batches):
    """Stars of all links that a task gets."""
    held = [pa.Table.from_batches([batch]) for batch in batches]
    if held:
        links = pa.concat_tables(held)
        node, least = least_reachable(links.column("a").to_numpy(), links.column("b").to_numpy())
        go = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[go]), pa.array(least[go])], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node long, component long) of all nodes in links (a long, b long): the smallest node reachable.

    Links are contracted within each batch. If no more than ONE_TASK are left (16 MB), one task joins them; beyond that, each
    round hangs every node's larger neighbours, then the node itself with its smaller ones, below the smallest neighbour. Minima
    are aggregated before the shuffle; the joins are plain equi-joins, so a node with very many links is split by adaptive
    execution. Links never come to the driver, only their number and a checksum. Rounds are written to the shared folder.
    """
    own = "a long, b long"
    edges = materialise(links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, own).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == last:
            break
        if mark.n <= ONE_TASK:
            new = materialise(edges.coalesce(1).mapInArrow(_whole, own), "links")
            discard(edges)
            edges = new
            break
        last = tuple(mark)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = materialise(small.filter("a <> b").distinct(), "links")
        discard(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
