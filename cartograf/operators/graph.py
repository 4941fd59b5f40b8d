"""Traversals: neighbours, degrees, reachability, shortest paths, neighbourhoods, components.

Reachability is a breadth-first search by levels. A shortest path is simple, and its last hop starts on
the level before, so the distance and the kinds of edges by which a node is first reached are those of an
enumeration of all simple paths, at the cost of one join a level. Each level is aggregated before it is
compared with what was visited and is written to the shared folder; frontiers are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.shared import cut

ENDS = {"outbound": ("from_id", "to_id"), "inbound": ("to_id", "from_id")}


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, direction: str = "outbound", kinds: list[str] | None = None) -> DataFrame:
    """Edges at a node with what stands at the other end; ends that are no node keep their edge. Both directions: a self-loop comes twice."""
    if direction == "both":
        return neighbors(nodes, edges, node, "outbound", kinds).unionByName(neighbors(nodes, edges, node, "inbound", kinds))
    here, there = ENDS[direction]
    own = edges.filter(F.col(here) == node)
    if kinds:
        own = own.filter(F.col("kind").isin(*kinds))
    own = own.select(F.col("id").alias("edge_id"), "from_id", "to_id", F.col("kind").alias("edge_kind"), F.col(there).alias("other"))
    named = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("kind").alias("node_kind"), F.col("file_path").alias("node_file"))
    return own.join(named, own.other == named.node_id, "left").drop("other").withColumn("direction", F.lit(direction))


def edge_counts(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out of the ends of architecture edges: one pass over the edges, partial sums before the shuffle."""
    arch = edges.filter(X.is_architecture())
    ends = arch.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out of all nodes over architecture edges."""
    counted = edge_counts(edges)
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def inspect_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).withColumn("centrality", F.col("fan_in") * 2 + F.col("fan_out"))


def walk(edges: DataFrame, start: DataFrame, depth: int, direction: str = "outbound", architecture: bool = True) -> DataFrame:
    """node, path_length, via (sorted distinct kinds) of all that ``start`` (one column, id) reaches. Ends that are no node are walked through."""
    here, there = ENDS[direction]
    arch = edges.filter(X.is_architecture()) if architecture else edges
    hops = arch.select(F.col(here).alias("here"), F.col(there).alias("there"), "kind").distinct().persist()
    try:
        begin = cut(start.select(F.col("id").alias("node")).distinct())
        frontier, visited, levels = begin, begin, []
        for level in range(1, max(depth, 1) + 1):
            reached = hops.join(frontier, hops.here == frontier.node).groupBy(F.col("there").alias("node")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
            # a start that has an edge to itself is reached at length one
            old = visited if level > 1 else visited.join(hops.filter("here = there").select(F.col("here").alias("node")), "node", "left_anti")
            new = cut(reached.join(old, "node", "left_anti").select("node", F.lit(level).alias("path_length"), F.array_join("kinds", ", ").alias("via")))
            if new.isEmpty():
                break
            levels.append(new)
            frontier = new.select("node").join(begin, "node", "left_anti") if level == 1 else new.select("node")
            visited = visited.unionByName(new.select("node"))
        if not levels:
            return begin.limit(0).select("node", F.lit(0).alias("path_length"), F.lit("").alias("via"))
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        return out
    finally:
        hops.unpersist()


def reachable(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 2, direction: str = "outbound", architecture: bool = True) -> DataFrame:
    """Nodes reached with path_length and via_edge_kind; what is no node is left out of the result only."""
    start = edges.sparkSession.createDataFrame([(node,)], "id string")
    found = walk(edges, start, depth, direction, architecture)
    return nodes.join(found, nodes.id == found.node).drop("node").withColumnRenamed("via", "via_edge_kind")


def dependencies(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 2) -> DataFrame:
    return reachable(nodes, edges, node, depth, "outbound")


def callers(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 2) -> DataFrame:
    return reachable(nodes, edges, node, depth, "inbound")


def impact(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 10) -> DataFrame:
    """Everything that depends on a node, itself left out, nearest first."""
    found = reachable(nodes, edges, node, depth, "inbound").filter(F.col("id") != node)
    return found.orderBy("path_length", "via_edge_kind", "id")


def affected_files(found: DataFrame) -> DataFrame:
    return found.filter(F.col("file_path").isNotNull()).select("file_path").distinct()


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, most: int = 8) -> DataFrame:
    """step, id of one shortest outbound path over listed architecture edges through real nodes; empty if there is none.

    Of paths of one length the one whose nodes have the smallest ids from the target back is given.
    """
    spark = edges.sparkSession
    schema = "step int, id string"
    if source == target:
        return spark.createDataFrame([(0, source)], schema)
    hops = edges.filter(X.listed_architecture()).select("from_id", "to_id").distinct()
    hops = hops.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").persist()
    try:
        frontier = spark.createDataFrame([(source,)], "node string")
        visited, parents, found = cut(frontier), [], False
        for _ in range(most):
            new = hops.join(frontier, hops.from_id == frontier.node).groupBy(F.col("to_id").alias("node")).agg(F.min("from_id").alias("parent"))
            new = cut(new.join(visited, "node", "left_anti"))
            parents.append(new)
            if not new.filter(F.col("node") == target).isEmpty():
                found = True
                break
            if new.isEmpty():
                break
            frontier = new.select("node")
            visited = visited.unionByName(frontier)
        if not found:
            return spark.createDataFrame([], schema)
        path = [target]  # one look-up a level, as long as the path
        for level in reversed(parents):
            path.append(level.filter(F.col("node") == path[-1]).first().parent)
        return spark.createDataFrame(list(enumerate(reversed(path))), schema)
    finally:
        hops.unpersist()


def neighborhood(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 2) -> DataFrame:
    """Edges (of all kinds) around a node for a diagram: distinct from_id, to_id, kind with both ends' names and kinds.

    An edge brings in those that leave its head and those that enter its tail. Heads must be nodes, tails may dangle.
    """
    spark = edges.sparkSession
    every = edges.select("from_id", "to_id", "kind").distinct().persist()
    try:
        seed = spark.createDataFrame([(node,)], "node string")
        heads = tails = seed
        seen, known_heads, known_tails = None, None, None
        for _ in range(max(depth, 1)):
            # `heads` are where new edges may start, `tails` where they may end: two equi-joins in place of one on either end
            new = every.join(heads, every.from_id == heads.node, "left_semi").unionByName(every.join(tails, every.to_id == tails.node, "left_semi")).distinct()
            if seen is not None:
                new = new.join(seen, ["from_id", "to_id", "kind"], "left_anti")
            new = cut(new)
            if new.isEmpty():
                break
            seen = new if seen is None else seen.unionByName(new)
            known_heads = heads if known_heads is None else known_heads.unionByName(heads)
            known_tails = tails if known_tails is None else known_tails.unionByName(tails)
            heads = new.select(F.col("to_id").alias("node")).distinct()
            tails = new.select(F.col("from_id").alias("node")).distinct()
        if seen is None:
            seen = cut(every.limit(0))
        a = nodes.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"), F.col("kind").alias("from_kind"))
        b = nodes.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("kind").alias("to_kind"))
        return seen.join(a, "from_id").join(b, "to_id", "left").select("from_id", "to_id", "kind", "from_name", "to_name", "from_kind", "to_kind")
    finally:
        every.unpersist()


def components(links: DataFrame, items: DataFrame, most: int = 60) -> DataFrame:
    """item, least (smallest item of its undirected component) for each of ``items`` (column item); links: a, b."""
    both = links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    try:
        label = cut(items.select("item", F.col("item").alias("least")).distinct())
        for _ in range(most):
            seen = both.join(label, both.b == label.item).groupBy("a").agg(F.min("least").alias("near"))
            lower = label.join(seen, label.item == seen.a, "left").select("item", "least", F.least("least", F.coalesce("near", "least")).alias("new"))
            # pointer jumping: follow the label's own label
            hop = lower.select(F.col("item").alias("new"), F.col("new").alias("far"))
            lower = cut(lower.join(hop, "new", "left").select("item", "least", F.least("new", F.coalesce("far", "new")).alias("new")))
            done = lower.filter("new <> least").isEmpty()
            label = lower.select("item", F.col("new").alias("least"))
            if done:
                return label
        raise RuntimeError("components did not settle")
    finally:
        both.unpersist()


def numbered(label: DataFrame) -> DataFrame:
    """Components numbered from 1 in the order of their smallest items: the numbers are counted over components, not items.

    Heads are sorted by range and counted within each range; a range's numbers begin after those of the ranges before it.
    """
    parts = max(1, int(label.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heads = cut(label.select("least").distinct().repartitionByRange(parts, "least").withColumn("range", F.spark_partition_id()))
    held = heads.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = held.withColumn("before", F.sum("n").over(W.orderBy("range")) - F.col("n"))  # one row a range
    nth = heads.withColumn("nth", F.row_number().over(W.partitionBy("range").orderBy("least")))
    heads = nth.join(F.broadcast(before), "range").select("least", (F.col("nth") + F.col("before")).alias("component"))
    return label.join(heads, "least")
