"""Patches: enrichment, upsert by key with the last row winning, deletion by file, labels after analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X
from ..sources.derived import Graph
from ..sources.shared import cut
from .analyze import file_topology, rank_nodes
from .resolve import resolve_edges


def enrich_nodes(nodes: DataFrame) -> DataFrame:
    has = X.present("file_path")
    domain = F.coalesce("domain", F.when(has, X.domain_of("file_path")))
    subsystem = F.coalesce("subsystem", F.when(has, X.subsystem_of("file_path")))
    cluster = F.coalesce("cluster_id", F.when(X.present(domain) & X.present(subsystem), X.cluster_of(domain, subsystem)))
    return nodes.withColumns({"domain": domain, "subsystem": subsystem, "cluster_id": cluster})


def enrich_files(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    symbols = nodes.filter(X.present("file_path")).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"))
    links = edges.filter(X.present("source_file")).groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("links"))
    out = files.join(symbols, "path", "left").join(links, "path", "left")
    zero = F.lit(0)
    filled = {
        "symbol_count": F.coalesce("symbol_count", "symbols", zero).cast("int"), "edge_count": F.coalesce("edge_count", "links", zero).cast("int"),
        "domain": F.coalesce("domain", X.domain_of("path")), "subsystem": F.coalesce("subsystem", X.subsystem_of("path")),
    }
    return S.conform(out.withColumns(filled), S.FILES)


def check_ends(edges: DataFrame) -> DataFrame:
    """Fails where an edge lacks an end."""
    bad = ~(X.present("from_id") & X.present("to_id"))
    return edges.withColumn("from_id", F.when(bad, F.raise_error(F.concat(F.lit("edge without both ends: "), F.coalesce("id", F.lit("?")))).cast("string")).otherwise(F.col("from_id")))


def check_metadata(nodes: DataFrame) -> DataFrame:
    """Fails where a node's metadata has an entry of a wrong type."""
    problem = X.metadata_problem("kind", "metadata_json")
    return nodes.withColumn("metadata_json", F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(" in "), F.col("id"))).cast("string")).otherwise(F.col("metadata_json")))


def last_wins(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the one with the largest ``order`` (dropped from the result), or any if there is none."""
    if order is None:
        return df.dropDuplicates([key])
    best = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__nth", F.row_number().over(best)).filter("__nth = 1").drop("__nth", order)


def upsert(base: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Base rows whose key isn't new, and the new ones: an anti-join, no rewrite row by row."""
    new = last_wins(new, key, order)
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Without the files of ``paths`` (path), their nodes, and the edges found in them."""
    gone = paths.select("path").distinct()
    return Graph(
        graph.nodes.join(gone, graph.nodes.file_path == gone.path, "left_anti"),
        graph.edges.join(gone, graph.edges.source_file == gone.path, "left_anti"),
        graph.files.join(gone, "path", "left_anti"),
    )


def apply_patch(graph: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame, deleted: DataFrame | None = None, order: str | None = None) -> Graph:
    """The graph after a patch: rows of patched and deleted files go, the patch's come, enriched and resolved.

    Rows of nodes and edges may carry a column ``order`` that says which of several with one id is last; of a file's rows the
    one that was indexed last counts.
    """
    nodes = S.conform(last_wins(nodes, "id", order), S.NODES)
    edges = S.conform(last_wins(edges, "id", order), S.EDGES)
    nodes = cut(enrich_nodes(check_metadata(nodes)))
    edges = cut(S.conform(resolve_edges(cut(check_ends(edges)), nodes, graph.nodes), S.EDGES))
    newest = S.conform(files, S.FILES).withColumn("order", F.struct("last_indexed_at", "mtime", "hash"))
    files = cut(enrich_files(S.conform(last_wins(newest, "path", "order"), S.FILES), nodes, edges))
    touched = files.select("path")
    if deleted is not None:
        touched = touched.unionByName(deleted.select("path"))
    kept = delete_files(graph, touched)
    return Graph(upsert(kept.nodes, nodes, "id"), upsert(kept.edges, edges, "id"), upsert(kept.files, files, "path"))


def settled(graph: Graph) -> Graph:
    """The graph written to the shared folder, so that what reads it often doesn't patch it again each time."""
    return Graph(cut(graph.nodes), cut(graph.edges), cut(graph.files))


def relabel(graph: Graph, carry: bool = True) -> Graph:
    """Labels and centralities after analysis, by joins: of nodes by their file and id, of files by path. Nodes without edges get 0."""
    topology = cut(file_topology(graph.nodes, graph.edges, graph.files, carry))
    by_file = topology.select(F.col("path").alias("file_path"), F.col("domain").alias("d"), F.col("subsystem").alias("s"), F.col("cluster_id").alias("c"))
    scores = cut(rank_nodes(graph.nodes, graph.edges).select("id", F.col("centrality").cast("double").alias("score")))
    nodes = graph.nodes.join(by_file, "file_path", "left").join(scores, "id", "left")
    nodes = nodes.withColumns({"domain": F.coalesce("d", "domain"), "subsystem": F.coalesce("s", "subsystem"), "cluster_id": F.coalesce("c", "cluster_id"), "centrality_score": F.coalesce("score", F.lit(0.0))})
    by_path = topology.select("path", F.col("domain").alias("d"), F.col("subsystem").alias("s"), F.col("centrality").cast("double").alias("score"))
    files = graph.files.join(by_path, "path", "left")
    domain = F.coalesce("d", "domain", F.lit("workspace"))
    files = files.withColumns({
        "subsystem": F.coalesce("s", "subsystem", domain), "domain": domain, "centrality_score": F.coalesce("score", "centrality_score", F.lit(0.0)),
        "symbol_count": F.coalesce("symbol_count", F.lit(0)), "edge_count": F.coalesce("edge_count", F.lit(0)),
    })
    return Graph(S.conform(nodes, S.NODES), graph.edges, S.conform(files, S.FILES))
