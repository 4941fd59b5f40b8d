"""Resolution of textual edge ends to node ids, as joins over distinct (kind, file, text) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.shared import cut


def _names(nodes: DataFrame, exact: bool) -> DataFrame:
    """Every text by which a node may be meant, as one equi-join key: name, qualified name and its tails, path, file name.

    A name that ends in ``::c`` or ``.c`` is keyed by all such tails, so that a suffix match needs no scan.
    """
    fit = (lambda c: c) if exact else X.fold
    q = F.col("qualified_name")
    at = F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1)))
    tails = F.transform(
        F.filter(at, lambda i: (F.substr(q, i, F.lit(2)) == "::") | (F.substr(q, i, F.lit(1)) == ".")),
        lambda i: F.when(F.substr(q, i, F.lit(1)) == ".", F.substr(q, i + 1)).otherwise(F.substr(q, i + 2)),
    )
    own = F.array(fit(F.col("name")), fit(q))
    tails = F.when(q.isNotNull(), tails if exact else F.transform(tails, X.fold)).otherwise(F.array().cast("array<string>"))
    base = X.basename("file_path")
    keys = F.concat(
        F.transform(F.concat(own, tails), lambda s: F.concat(F.lit("n:"), s)),
        F.array(F.concat(F.lit("p:"), "file_path"), F.concat(F.lit("b:"), base if exact else X.fold(base))),
    )
    return nodes.select("id", "name", "kind", "qualified_name", "file_path", "centrality_score", F.explode(F.array_distinct(F.filter(keys, lambda s: s.isNotNull()))).alias("key"))


def _asked(raws: DataFrame, exact: bool) -> DataFrame:
    """Keys to look for: each candidate as a name, a path and a file name. The stored graph needs a directory before the file name."""
    fit = (lambda c: c) if exact else X.fold
    as_base = lambda c: F.concat(F.lit("b:"), c if exact else X.fold(X.basename(c)))
    keys = F.flatten(F.transform("candidates", lambda c: F.array(F.concat(F.lit("n:"), fit(c)), F.concat(F.lit("p:"), c), as_base(c))))
    return raws.select("kind", "source_file", "raw", F.explode(F.array_distinct(keys)).alias("key"))


def _score(edge_kind, source_file) -> F.Column:
    path = F.col("node_path")
    here = X.dirname(source_file)
    placed = source_file.isNotNull() & (source_file != "") & X.present(path)
    depends = edge_kind.isin("imports", "depends_on")
    score = X.bonus(F.col("node_name") == X.basename("node_name"), 1) + X.bonus(placed & (here == X.dirname(path)), 4) + X.bonus(placed & path.startswith(here), 2)
    score += F.when(depends, X.bonus(F.col("node_kind") == "file", 6) + X.bonus(F.coalesce(path.rlike(r"\.(h|hpp|hh|hxx|cpp|cc|cxx)\z"), F.lit(False)), 2)).otherwise(X.bonus(F.col("node_kind") != "file", 5))
    score += X.bonus(X.present("node_qualified") & ~F.col("node_qualified").contains("::"), 1)
    return score + F.coalesce("centrality_score", F.lit(0.0)) / 1000


def resolve_names(raws: DataFrame, local: DataFrame, stored: DataFrame) -> DataFrame:
    """kind, source_file, raw and resolved (node id, or null) of distinct raws (same three columns).

    The patch's own nodes come first, the stored ones only if none of them matches. Among all candidates
    the single best-scored one is taken; a tie at the top leaves the text unresolved.
    """
    raws = raws.select("kind", "source_file", F.col("raw"), X.symbol_candidates(F.trim("raw")).alias("candidates")).filter(F.size("candidates") > 0)
    keys = ["kind", "source_file", "raw"]
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))

    def best(asked, nodes, exact):
        met = _asked(asked, exact).join(_names(nodes, exact).select(F.col("id"), F.col("name").alias("node_name"), F.col("kind").alias("node_kind"), F.col("qualified_name").alias("node_qualified"), F.col("file_path").alias("node_path"), "centrality_score", "key"), "key")
        met = met.dropDuplicates([*keys, "id"]).withColumn("score", _score(F.col("kind"), F.col("source_file")))
        ranked = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
        two = met.withColumns({"nth": F.row_number().over(ranked), "next": F.lead("score").over(ranked)}).filter("nth = 1")
        return two.select(*keys, F.when(F.col("next").isNull() | (F.col("score") > F.col("next")), F.col("id")).alias("resolved"))

    mine = best(raws, local, True)
    rest = raws.alias("r").join(mine.alias("m"), same("r", "m"), "left_anti")
    return mine.unionByName(best(rest, stored, False))


def resolve_files(raws: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """raw, resolved of distinct raws that mean a file: by ``file:`` id, by unique path, by unique file name where the text has a directory."""
    plain = raws.select("raw", F.when(F.col("raw").startswith("file:"), F.expr("substring(raw, 6)")).otherwise(F.col("raw")).alias("path"))
    plain = plain.withColumns({"as_id": F.concat(F.lit("file:"), "path"), "base": X.basename("path")})
    files = stored.filter("kind = 'file' and file_path is not null").select("id", "file_path")
    only = lambda key: files.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    ids = known.select(F.col("id").alias("by_id")).distinct()
    paths = only(F.col("file_path").alias("path")).withColumnRenamed("id", "by_path")
    bases = only(X.fold(X.basename("file_path")).alias("low")).withColumnRenamed("id", "by_base")
    out = plain.join(ids, plain.as_id == ids.by_id, "left").join(paths, "path", "left").withColumn("low", X.fold("base")).join(bases, "low", "left")
    by_base = F.when((F.col("base") != "") & (F.col("base") != F.col("path")), F.col("by_base"))
    return out.select("raw", F.coalesce("by_id", "by_path", by_base).alias("resolved")).filter(F.col("resolved").isNotNull())


def resolve_edges(edges: DataFrame, local: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges with both ends resolved as far as possible, and source spans filled in from the start node."""
    known = local.select("id").unionByName(stored.select("id")).distinct()
    ends = edges.select("kind", "source_file", F.explode(F.array("from_id", "to_id")).alias("raw")).distinct()
    # written once: each is read for both ends, and plans must not grow from patch to patch
    open_ends = cut(ends.join(known, ends.raw == known.id, "left_anti"))
    files = cut(resolve_files(open_ends.select("raw").distinct(), known, stored))
    names = cut(resolve_names(open_ends.join(files.select("raw"), "raw", "left_anti"), local, stored).filter(F.col("resolved").isNotNull()))
    for end in ("from_id", "to_id"):
        f = files.select(F.col("raw").alias("f_raw"), F.col("resolved").alias("f"))
        n = names.select(F.col("kind").alias("n_kind"), F.col("source_file").alias("n_file"), F.col("raw").alias("n_raw"), F.col("resolved").alias("n"))
        edges = edges.join(f, edges[end] == f.f_raw, "left")
        edges = edges.join(n, (edges[end] == n.n_raw) & (edges.kind == n.n_kind) & edges.source_file.eqNullSafe(n.n_file), "left")
        edges = edges.withColumn(end, F.coalesce("f", "n", end)).drop("f_raw", "f", "n_kind", "n_file", "n_raw", "n")
    spans = local.select("id", "file_path", "start_line", "end_line").unionByName(stored.join(local.select("id"), "id", "left_anti").select("id", "file_path", "start_line", "end_line"))
    spans = spans.select(F.col("id").alias("s_id"), F.col("file_path").alias("s_file"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end")).dropDuplicates(["s_id"])
    edges = edges.join(spans, edges.from_id == spans.s_id, "left")
    filled = {"source_file": F.coalesce("source_file", "s_file"), "source_start_line": F.coalesce("source_start_line", "s_start"), "source_end_line": F.coalesce("source_end_line", "s_end")}
    return edges.withColumns(filled).drop("s_id", "s_file", "s_start", "s_end")
