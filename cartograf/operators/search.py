"""Symbol search and the choice of a primary definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    low = X.fold(F.lit(name))
    return nodes.filter((X.fold("name") == low) | (X.fold("qualified_name") == low))


def nodes_of_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path)


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 10, file: str | None = None) -> DataFrame:
    """Exact, then prefix, then fuzzy matches: one scan gives each node its tier, best of each definition kept.

    Tiers rank before the limit (ties inside one by id), so a full tier isn't cut arbitrarily.
    """
    query = query.strip()
    low = F.lit(query.lower())
    name, full = X.fold("name"), X.fold(F.coalesce("qualified_name", F.lit("")))
    if kind:
        nodes = nodes.filter(F.col("kind") == kind)
    if file:
        nodes = nodes.filter(X.fold("file_path").contains(X.fold(F.lit(file))))
    asked = X.fold(F.lit(query))
    exact = (name == asked) | (X.fold("qualified_name") == asked)
    prefix = name.startswith(low) | X.fold("qualified_name").startswith(low)
    fuzzy = name.contains(low) | full.contains(low)
    tier = F.when(exact, "exact").when(prefix, "prefix").when(fuzzy, "fuzzy")
    score = F.when(F.col("match_type") == "exact", F.when(F.lower("qualified_name") == low, 110).otherwise(100)).when(F.col("match_type") == "prefix", 80).otherwise(60)
    found = nodes.withColumn("match_type", tier).filter(F.col("match_type").isNotNull()).withColumn("score", score)
    order = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "prefix", 1).otherwise(2)
    found = found.select("id", "name", "kind", F.when(X.present("qualified_name"), F.col("qualified_name")).alias("qualified_name"), "file_path", "language", "score", "match_type", order.alias("tier"))
    found = found.orderBy("tier", "id").limit(limit)
    same = W.partitionBy("kind", F.coalesce("qualified_name", "name"), F.coalesce("file_path", F.lit(""))).orderBy(F.desc("score"), "id")
    best = found.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth", "tier")
    return best.orderBy(F.desc("score"), F.desc(F.coalesce(F.length("qualified_name"), F.lit(0))), F.coalesce("file_path", F.lit("")), "id")


def symbol_score() -> F.Column:
    return F.coalesce("centrality_score", F.lit(0.0)) + X.bonus(X.present("domain"), 2) + X.bonus(X.present("subsystem"), 1) + X.bonus(X.present("summary"), 1) + X.bonus(X.present("qualified_name"), 0.5) + X.bonus(F.col("kind").isin("function", "method"), 1)


def search_symbols(nodes: DataFrame, query: str, limit: int = 10, filtered: bool = True) -> DataFrame:
    """Symbols by kind, place of the match, score; ``filtered`` leaves out what doesn't match anywhere."""
    low = F.lit(query.lower())
    within = {c: F.instr(X.fold(F.coalesce(c, F.lit(""))), query.lower()) > 0 for c in ("name", "qualified_name", "summary", "domain", "subsystem")}
    if filtered:
        hit = F.lit(False)
        for c in within.values():
            hit = hit | c
        nodes = nodes.filter(hit)
    kind_rank = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "method", 1).when(F.col("kind") == "class", 2).otherwise(3)
    match_rank = (
        F.when(X.fold("qualified_name") == low, 0).when(X.fold("name") == low, 1).when(within["summary"], 2).when(within["domain"], 3).when(within["subsystem"], 4).otherwise(5)
    )
    ranked = nodes.select("*", kind_rank.alias("kind_rank"), match_rank.alias("match_rank"), symbol_score().alias("symbol_score"))
    return ranked.orderBy("kind_rank", "match_rank", F.desc("symbol_score"), F.desc(F.coalesce("centrality_score", F.lit(0.0))), "id").limit(limit)


def candidate_metrics(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, child_count (what it defines), degree (edges at it, a self-loop once) of each of ``ids``."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"), ((F.col("kind") == "defines").cast("int")).alias("d"), "from_id")
    counted = ends.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.sum(F.when(F.col("from_id") == F.col("id"), F.col("d")).otherwise(0)).alias("child_count"), F.count(F.lit(1)).alias("degree"))
    return ids.select("id").join(counted, "id", "left").na.fill(0, ["child_count", "degree"])


def best_match(found: DataFrame, edges: DataFrame) -> DataFrame:
    """At most one row of a search result: the clear primary definition among exact matches, or all if none is exact."""
    top_tier = found.filter("match_type = 'exact'")
    candidates = found if top_tier.isEmpty() else top_tier
    scored = candidates.join(candidate_metrics(candidates, edges), "id")
    order = W.orderBy(F.desc("child_count"), F.desc("degree"), F.desc("score"), F.coalesce("file_path", F.lit("")), "id")  # a search result is at most its limit long
    ranked = scored.select("*", F.row_number().over(order).alias("nth"), F.lead("child_count").over(order).alias("next_children"), F.lead("degree").over(order).alias("next_degree"))
    clear = F.col("next_children").isNull() | (F.col("child_count") > F.col("next_children")) | ((F.col("child_count") == F.col("next_children")) & (F.col("degree") >= F.col("next_degree") + 2))
    return ranked.filter((F.col("nth") == 1) & clear).drop("nth", "next_children", "next_degree")
