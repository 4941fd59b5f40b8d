"""A code graph over the star tables, for queries and tests: nodes, edges, files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import scalars as X


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}

    def node(table, kind, language, key, name, qualified, path, summary=None):
        columns = {
            "id": F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")), "kind": F.lit(kind), "name": name, "language": F.lit(language), "qualified_name": qualified,
            "file_path": path, "summary": F.lit(None).cast("string") if summary is None else summary,
        }
        return t[table].select(*[c.alias(n) for n, c in columns.items()])

    text = lambda c: F.col(c).cast("string")
    order = F.concat(F.lit("order_"), text("o_orderkey"))
    part_dir = F.when(F.col("p_type") == "ECONOMY", "vendor").otherwise("tools")
    parts = [
        node("region", "namespace", "typescript", "r_regionkey", F.col("r_name"), F.col("r_name"), F.lit("/ws/src/graph/regions.ts")),
        node("nation", "module", "typescript", "n_nationkey", F.col("n_name"), F.col("n_name"), F.concat(F.lit("/ws/src/graph/nation_"), text("n_nationkey"), F.lit(".ts"))),
        node("supplier", "service", "python", "s_suppkey", F.col("s_name"), F.col("s_name"), F.concat(F.lit("/ws/src/runtime/supplier_"), text("s_nationkey"), F.lit(".py"))),
        node("customer", "class", "typescript", "c_custkey", F.col("c_name"), F.col("c_name"), F.concat(F.lit("/ws/src/ui/customer_"), text("c_nationkey"), F.lit(".ts"))),
        node("part", "function", "rust", "p_partkey", F.col("p_name"), F.concat("p_brand", F.lit("::"), "p_name"), F.concat(F.lit("/ws/src/"), part_dir, F.lit("/brand_"), F.expr("substr(p_brand, 7)"), F.lit(".rs")), F.col("p_type")),
        node("orders", "method", "cpp", "o_orderkey", order, F.lit(None).cast("string"), F.concat(F.lit("/ws/src/core/prio_"), F.expr("substr(o_orderpriority, 1, 1)"), F.lit(".cpp"))),
    ]
    nodes = parts[0]
    for more in parts[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.withColumns({"domain": X.domain_of("file_path"), "subsystem": X.subsystem_of("file_path")})
    nodes = S.conform(nodes.withColumn("cluster_id", X.cluster_of("domain", "subsystem")), S.NODES)

    def edge(df, kind, a, b):
        ref = lambda p, c: F.lit(c) if p is None else F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
        return df.select(ref(*a).alias("from_id"), ref(*b).alias("to_id"), F.lit(kind).alias("kind"))

    lines = t["lineitem"]
    least = t["supplier"].groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    links = [
        edge(t["nation"], "contains", ("namespace", "n_regionkey"), ("module", "n_nationkey")),
        edge(t["supplier"], "defines", ("module", "s_nationkey"), ("service", "s_suppkey")),
        edge(t["supplier"], "imports", ("service", "s_suppkey"), ("module", "s_nationkey")),
        edge(least, "publishes", ("module", "s_nationkey"), ("service", "s_suppkey")),
        edge(t["customer"], "imports", ("class", "c_custkey"), ("module", "c_nationkey")),
        edge(t["orders"], "depends_on", ("method", "o_orderkey"), ("class", "o_custkey")),
        edge(lines.select("l_orderkey", "l_partkey").distinct(), "references", ("method", "l_orderkey"), ("function", "l_partkey")),
        edge(lines.select("l_partkey", "l_suppkey").distinct(), "calls", ("function", "l_partkey"), ("service", "l_suppkey")),
        edge(t["nation"], "imports", ("module", "n_nationkey"), ("external", "n_name")),  # ends that are no node
    ]
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    edges = edges.withColumns({"id": F.concat_ws(":", "kind", "from_id", "to_id"), "confidence": F.lit(1.0)})
    held = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbol_count"), F.min("language").alias("language"))
    files = held.withColumns({"domain": X.domain_of("path"), "subsystem": X.subsystem_of("path")})
    return Graph(nodes, S.conform(edges, S.EDGES), S.conform(files, S.FILES))
