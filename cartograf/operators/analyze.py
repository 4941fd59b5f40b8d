"""Rankings, file topology, label votes, domain summaries, overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..sources.shared import cut
from .graph import components, edge_counts, numbered


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def nodes_by_language(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("count"))


def rank_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rankable nodes that have edges, with fan_in, fan_out, centrality (3 x in + out) and decision_score."""
    ranked = nodes.filter(~F.col("kind").isin(*S.NOT_RANKED)).join(edge_counts(edges), "id").withColumn("centrality", F.col("fan_in") * 3 + F.col("fan_out"))
    return ranked.withColumn("decision_score", X.decision_score())


# columns to rank by, the largest first but for names, which break ties
RANK_ORDER = ("-decision_score", "-fan_in", "-centrality", "name", "id")
FILE_ORDER = ("-file_score", "-fan_in", "-centrality", "path")


def top(ranked: DataFrame, order: tuple[str, ...], k: int) -> DataFrame:
    return ranked.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]).limit(k)


def workspace_top(ranked: DataFrame, path: str, order: tuple[str, ...], k: int) -> DataFrame:
    """Best k that aren't foreign code; of all, if there is nothing else. One pass: foreign code ranks last and goes if own code is there."""
    best = top(ranked.withColumn("__foreign", X.third_party(path).cast("int")), ("__foreign", *order), k)
    least = F.min("__foreign").over(W.partitionBy(F.lit(0)))  # over k rows
    return best.withColumn("__least", least).filter("__foreign = __least").drop("__foreign", "__least")


def recommendations(ranked: DataFrame, k: int = 5) -> DataFrame:
    return top(ranked.filter(X.recommendable()), RANK_ORDER, k)


def file_edges(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Architecture edges between tracked files: from_path, to_path, kind, n (edges), weight (of one edge of the kind).

    Edges of one file to one node are counted before the far end is looked up, by the partitioning that the look-up needs anyway.
    """
    path = nodes.select("id", "file_path")
    a, b = path.select(F.col("id").alias("from_id"), F.col("file_path").alias("a")), path.select(F.col("id").alias("to_id"), F.col("file_path").alias("to_path")).filter("to_path <> ''")
    tracked = files.select("path")
    arch = edges.filter(X.is_architecture()).select("from_id", "to_id", "kind", "source_file")
    near = arch.join(a, "from_id", "left").select(F.coalesce("a", "source_file").alias("from_path"), "to_id", "kind").filter("from_path <> ''")
    near = near.repartition("to_id").groupBy("to_id", "from_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    found = near.join(b, "to_id").groupBy("from_path", "to_path", "kind").agg(F.sum("n").alias("n"))
    found = found.join(tracked, found.from_path == tracked.path, "left_semi").join(tracked, found.to_path == tracked.path, "left_semi")
    return found.withColumn("weight", X.edge_weight())


def file_pairs(between: DataFrame) -> DataFrame:
    """from_path, to_path, n (edges), weight (their sum): no more rows than pairs of files that have edges."""
    return between.groupBy("from_path", "to_path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("weight"))


def file_fan(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, fan_in, fan_out, centrality; edges within a file count."""
    into = pairs.groupBy(F.col("to_path").alias("path")).agg(F.sum("n").alias("fan_in"))
    out = pairs.groupBy(F.col("from_path").alias("path")).agg(F.sum("n").alias("fan_out"))
    joined = files.select("path").join(into, "path", "left").join(out, "path", "left").na.fill(0, ["fan_in", "fan_out"])
    return joined.withColumn("centrality", F.col("fan_in") * 3 + F.col("fan_out"))


def weighted_neighbors(pairs: DataFrame) -> DataFrame:
    """path, neighbor, weight between different files: full weight forward, half backward; at least 1 in sum."""
    way = lambda path, neighbor, share: F.struct(F.col(path).alias("path"), F.col(neighbor).alias("neighbor"), (F.col("weight") * share).alias("w"))
    ways = pairs.filter("from_path <> to_path").select(F.inline(F.array(way("from_path", "to_path", 1.0), way("to_path", "from_path", 0.5))))
    return ways.groupBy("path", "neighbor").agg(F.sum("w").alias("weight")).filter("weight >= 1")


def own_labels(files: DataFrame, carry: bool = True) -> DataFrame:
    """Labels that a file votes with: its stored ones (``carry``), else those its path implies."""
    stored = (F.col("domain"), F.col("subsystem")) if carry else (F.lit(None).cast("string"),) * 2
    return files.select("path", F.coalesce(stored[0], X.domain_of("path")).alias("domain"), F.coalesce(stored[1], X.subsystem_of("path")).alias("subsystem"))


def label_vote(files: DataFrame, near: DataFrame, carry: bool = True) -> DataFrame:
    """path, domain, subsystem by one round of votes: own label 8, each neighbour's its weight; ties to the smaller label."""
    own = own_labels(files, carry)
    other = own.select(F.col("path").alias("neighbor"), "domain", "subsystem")
    votes = own.withColumn("weight", F.lit(8.0)).unionByName(near.join(other, "neighbor").select("path", "domain", "subsystem", "weight"))
    out = own.select("path")
    for label in ("domain", "subsystem"):
        summed = votes.groupBy("path", label).agg(F.sum("weight").alias("score"))
        best = W.partitionBy("path").orderBy(F.desc("score"), label)
        out = out.join(summed.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("path", label), "path")
    return out


def file_components(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """path, component (numbered in the order of smallest paths) of the undirected graph of files."""
    links = pairs.select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))
    return numbered(components(links, files.select(F.col("path").alias("item")))).select(F.col("item").alias("path"), "component")


def file_topology(nodes: DataFrame, edges: DataFrame, files: DataFrame, carry: bool = True) -> DataFrame:
    """path, fan_in, fan_out, centrality, domain, subsystem, cluster_id of each file.

    What is as long as the nodes or edges is read once: the files' labels and the sums of file pairs are written to the shared folder.
    """
    files = cut(files.select("path", "domain", "subsystem"))
    pairs = cut(file_pairs(file_edges(nodes, edges, files)))
    cluster = F.concat(F.lit("cluster:"), F.col("component").cast("string"), F.lit(":"), X.cluster_of("domain", "subsystem"))
    voted = label_vote(files, weighted_neighbors(pairs), carry)
    return file_fan(files, pairs).join(voted, "path").join(file_components(files, pairs), "path").select("path", "fan_in", "fan_out", "centrality", "domain", "subsystem", cluster.alias("cluster_id"))


def rank_files(topology: DataFrame) -> DataFrame:
    return topology.withColumn("file_score", X.file_decision_score())


def domain_summary(topology: DataFrame, files: DataFrame) -> DataFrame:
    """domain, file_count, node_count, hub_count (files that have edges)."""
    counted = topology.join(files.select("path", "symbol_count"), "path", "left")
    return counted.groupBy("domain").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(F.coalesce("symbol_count", F.lit(0))).cast("long").alias("node_count"), F.count_if(F.col("centrality") > 0).alias("hub_count")
    )


def file_counts(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, symbol_count, edge_count from the nodes and edges of a patch."""
    symbols = nodes.filter(X.present("file_path")).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    links = edges.filter(X.present("source_file")).groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("edge_count"))
    return files.select("path").join(symbols, "path", "left").join(links, "path", "left").na.fill(0, ["symbol_count", "edge_count"])


def overview(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Tables of the overview report, from one ranking and one topology."""
    ranked = rank_nodes(nodes, edges).persist()
    try:
        central, advised = cut(workspace_top(ranked, "file_path", RANK_ORDER, 10)), cut(recommendations(ranked))
    finally:
        ranked.unpersist()
    topology = cut(file_topology(nodes, edges, files))
    return {
        "kinds": nodes_by_kind(nodes).orderBy(F.desc("count"), "kind"),
        "languages": nodes_by_language(nodes).orderBy(F.desc("count"), "language"),
        "central_nodes": central,
        "critical_files": workspace_top(rank_files(topology), "path", FILE_ORDER, 5),
        "recommendations": advised,
        "domains": domain_summary(topology, files).orderBy(F.desc("hub_count"), F.desc("node_count"), "domain"),
    }
