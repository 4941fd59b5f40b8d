"""One query for each operator over the graph derived from the star tables, and over text and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..extract import registry
from ..functions import scalars as X
from ..operators import analyze, graph, patch, resolve, search
from ..sources import store, workspace
from ..sources.derived import Graph, derived_graph
from ..sources.shared import cut, shared_dir
from ..streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def on_graph(f: Callable[[Graph], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(derived_graph(spark, sf_dir))
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NODE = ["id", "kind", "name", "file_path"]
HUB, SERVICE, FUNCTION = "module:0", "service:3", "function:7"


@on_graph
def nodes_by_kind(g):
    return analyze.nodes_by_kind(g.nodes)


@on_graph
def nodes_by_language(g):
    return analyze.nodes_by_language(g.nodes)


@on_graph
def architecture_edges_by_kind(g):
    return g.edges.filter(X.is_architecture()).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


@on_graph
def listed_architecture_edges(g):
    return g.edges.filter(X.listed_architecture()).select("id", "kind")


@on_graph
def edges_in_kind_list(g):
    return g.edges.filter(F.col("kind").isin("calls", "imports")).select("id", "from_id", "to_id", "kind")


@on_graph
def fan_in_out(g):
    return graph.degrees(g.nodes, g.edges)


@on_graph
def inspect_centrality(g):
    return graph.inspect_centrality(g.nodes, g.edges).select("id", "centrality")


RANKED = ["id", "name", "kind", "file_path", "fan_in", "fan_out", "centrality", "decision_score"]


@on_graph
def rank_nodes(g):
    return analyze.rank_nodes(g.nodes, g.edges).select(*RANKED)


@on_graph
def rank_nodes_top10(g):
    return analyze.top(analyze.rank_nodes(g.nodes, g.edges), analyze.RANK_ORDER, 10).select(*RANKED)


@on_graph
def central_nodes_top10(g):
    return analyze.workspace_top(analyze.rank_nodes(g.nodes, g.edges), "file_path", analyze.RANK_ORDER, 10).select(*RANKED)


@on_graph
def recommendations_top5(g):
    return analyze.recommendations(analyze.rank_nodes(g.nodes, g.edges)).select(*RANKED)


@on_graph
def third_party_flag(g):
    return g.nodes.select("id", X.third_party("file_path").alias("third_party"), X.recommendable().alias("recommendable"))


NEIGHBOR = ["edge_id", "from_id", "to_id", "edge_kind", "node_id", "node_name", "node_kind", "node_file", "direction"]


@on_graph
def neighbors_outbound(g):
    return graph.neighbors(g.nodes, g.edges, HUB, "outbound").select(*NEIGHBOR)


@on_graph
def neighbors_inbound(g):
    return graph.neighbors(g.nodes, g.edges, SERVICE, "inbound", ["calls", "publishes", "defines"]).select(*NEIGHBOR)


@on_graph
def neighbors_both(g):
    return graph.neighbors(g.nodes, g.edges, HUB, "both").select(*NEIGHBOR)


@on_graph
def file_edges(g):
    return analyze.file_edges(g.nodes, g.edges, g.files).select("from_path", "to_path", "kind", F.col("n").alias("edges"), (F.col("n") * F.col("weight")).alias("weight"))


def _pairs(g):
    return analyze.file_pairs(analyze.file_edges(g.nodes, g.edges, g.files))


@on_graph
def file_fan(g):
    return analyze.file_fan(g.files, _pairs(g))


@on_graph
def weighted_file_neighbors(g):
    return analyze.weighted_neighbors(_pairs(g))


@on_graph
def file_label_vote(g):
    return analyze.label_vote(g.files, cut(analyze.weighted_neighbors(_pairs(g))))


@on_graph
def file_components(g):
    return analyze.file_components(g.files, cut(_pairs(g))).withColumn("component", F.col("component").cast("long"))


@on_graph
def file_topology(g):
    return analyze.file_topology(g.nodes, g.edges, g.files)


@on_graph
def rank_files_top5(g):
    ranked = analyze.rank_files(analyze.file_topology(g.nodes, g.edges, g.files))
    return analyze.workspace_top(ranked, "path", analyze.FILE_ORDER, 5).select("path", "fan_in", "fan_out", "centrality", "domain", "file_score")


@on_graph
def domain_summary(g):
    return analyze.domain_summary(analyze.file_topology(g.nodes, g.edges, g.files), g.files)


@on_graph
def file_symbol_counts(g):
    spans = g.nodes.select(F.col("id").alias("from_id"), "file_path")
    edges = g.edges.drop("source_file").join(spans, "from_id", "left").withColumnRenamed("file_path", "source_file")
    return analyze.file_counts(g.files, g.nodes, edges)


@on_graph
def infer_domain_subsystem(g):
    paths = g.files.select("path").unionByName(g.files.select(F.regexp_replace("path", "/(graph|runtime|ui|core|tools)/", "/pkg/").alias("path"))).unionByName(g.files.select(F.regexp_replace("path", "/src/", "/lib/").alias("path"))).distinct()
    domain, subsystem = X.domain_of("path"), X.subsystem_of("path")
    return paths.select("path", domain.alias("domain"), X.domain_of("path", parity=False).alias("domain_intent"), subsystem.alias("subsystem"), X.cluster_of(domain, subsystem).alias("cluster_id"))


@query
def detect_language(spark, sf_dir):
    ends = [".TS", ".mjs", ".rs", ".py", ".hpp", ".c++", ".c", ".txt", ""]
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/w.d/p"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("page_id") % len(ends) + 1).cast("int"))).alias("path"))
    return pages.select("page_id", "path", X.language_of("path").alias("language"), X.is_header("path").alias("header"), X.basename("path").alias("base"), X.dirname("path").alias("folder"))


@on_graph
def find_node_by_name(g):
    return search.find_by_name(g.nodes, "sUPPLIER#000000003").unionByName(search.find_by_name(g.nodes, "small widget")).select(*NODE)


@on_graph
def file_nodes(g):
    return search.nodes_of_file(g.nodes, "/ws/src/graph/regions.ts").select(*NODE)


FOUND = ["id", "name", "kind", "qualified_name", "file_path", "score", "match_type"]


@on_graph
def search_tiered(g):
    return search.search(g.nodes, " Small Widget ", limit=60).select(*FOUND)


@on_graph
def search_tiered_filtered(g):
    return search.search(g.nodes, "order_1", kind="method", limit=25, file="PRIO_1").select(*FOUND)


SYMBOL = [*NODE, "kind_rank", "match_rank", "symbol_score"]


@on_graph
def search_symbols_filtered(g):
    return search.search_symbols(g.nodes, "ECONOMY", 40).select(*SYMBOL)


@on_graph
def search_symbols_ranked(g):
    return search.search_symbols(g.nodes, "graph", 40, filtered=False).select(*SYMBOL)


@on_graph
def candidate_metrics(g):
    return search.candidate_metrics(g.nodes.filter(F.col("kind").isin("module", "namespace", "service")), g.edges)


@on_graph
def best_match(g):
    found = search.search(g.nodes.filter(F.col("kind").isin("module", "service")), "n_1", limit=10).unionByName(search.search(g.nodes, "Supplier#000000001", limit=10))
    return search.best_match(found.drop("language"), g.edges).select("id", "name", "child_count", "degree")


@on_graph
def candidate_metrics_all(g):
    """Metrics of all nodes as candidates."""
    return search.candidate_metrics(g.nodes, g.edges)


@on_graph
def best_match_all(g):
    """The clear primary definition among matches of all kinds."""
    found = search.search(g.nodes, "n_1", limit=10).unionByName(search.search(g.nodes, "Supplier#000000001", limit=10))
    return search.best_match(found.drop("language"), g.edges).select("id", "name", "child_count", "degree")


REACHED = ["id", "name", "kind", "path_length", "via_edge_kind"]


@on_graph
def reachable_outbound(g):
    return graph.reachable(g.nodes, g.edges, FUNCTION, 4, "outbound").select(*REACHED)


@on_graph
def reachable_inbound(g):
    return graph.reachable(g.nodes, g.edges, HUB, 3, "inbound", architecture=False).select(*REACHED)


@on_graph
def dependencies_depth2(g):
    return graph.dependencies(g.nodes, g.edges, "method:1").select(*REACHED)


@on_graph
def callers_depth2(g):
    return graph.callers(g.nodes, g.edges, SERVICE).select(*REACHED)


@on_graph
def impact_depth10(g):
    return graph.impact(g.nodes, g.edges, HUB).select(*REACHED)


@on_graph
def affected_files(g):
    return graph.affected_files(graph.impact(g.nodes, g.edges, SERVICE))


@on_graph
def shortest_path(g):
    return graph.shortest_path(g.nodes, g.edges, "method:1", "module:3")


@on_graph
def mermaid_edges(g):
    return graph.neighborhood(g.nodes, g.edges, "namespace:0", 3)


@on_graph
def edge_semantics(g):
    return g.edges.select("kind").distinct().unionByName(g.edges.select(F.concat(F.lit("x_"), "kind").alias("kind")).distinct()).select("kind", X.direction().alias("direction"), X.edge_weight().alias("weight"), X.listed_architecture().alias("listed"))


@on_graph
def node_scores(g):
    scored = g.nodes.withColumn("centrality", F.lit(5))
    return scored.select("id", X.decision_score().alias("decision_score"), search.symbol_score().alias("symbol_score"), X.diagram_id("id").alias("diagram_id"), X.capitalize("kind").alias("capital"))


@query
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), X.line_count("text").alias("lines"))


@query
def type_references(spark, sf_dir):
    found = F.array_sort(X.type_references("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("names"), F.sha2(F.array_join(found, ","), 256).alias("digest"))


@query
def semantic_verbs(spark, sf_dir):
    words = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.element_at(F.array(*[F.lit(w) for w in ("Loader", ".get", "SaveAll", "", "dispatchSend", "forward", "Offset")]), (F.col("event_id") % 7 + 1).cast("int"))).alias("callee"))
    return words.select("event_id", "callee", F.explode(X.semantic_verbs("callee")).alias("verb"))


def _raw_targets(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 10
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    shapes = [("", ""), ("this.", "()"), (" await new ", "(x, y) "), ("self->", "->run()"), ("crate::", "::{A, B}"), ("super::", ".get"), ("&", "/x.h"), ("::", "::T"), ("'", "'"), ("new this.", ".read()")]
    raw = F.lit(None).cast("string")
    for j, (a, b) in enumerate(shapes):
        raw = F.when(k == j, F.concat(F.lit(a), name, F.lit(b))).otherwise(raw)
    return part.select("p_partkey", raw.alias("raw"))


@query
def normalize_target(spark, sf_dir):
    return _raw_targets(spark, sf_dir).select("p_partkey", "raw", X.normalize_target("raw").alias("target"))


@query
def symbol_candidates(spark, sf_dir):
    return _raw_targets(spark, sf_dir).select("p_partkey", F.posexplode(X.symbol_candidates("raw")).alias("nth", "candidate"))


def _patch(g):
    """A patch that renames every third service, adds nodes to a file and drops another."""
    services = g.nodes.filter("kind = 'service'")
    number = F.split("id", ":")[1].cast("long")
    renamed = services.filter(number % 3 == 0)
    again = renamed.withColumns({"name": F.concat(F.lit("New "), "name"), "seq": F.lit(2)})
    return renamed.withColumn("seq", F.lit(1)).unionByName(again).drop("domain", "subsystem", "cluster_id")


@on_graph
def patch_upsert(g):
    new = S.conform(patch.last_wins(_patch(g), "id", "seq"), S.NODES)
    return patch.upsert(g.nodes, patch.enrich_nodes(new), "id").select(*NODE, "domain", "subsystem", "cluster_id")


@on_graph
def patch_delete(g):
    left = patch.delete_files(g, g.files.filter(F.col("path").contains("/ui/")).select("path"))
    return left.nodes.select("id").unionByName(left.files.select(F.col("path").alias("id")))


@on_graph
def patch_apply(g):
    """A whole patch: files indexed anew with renamed services and two edges each, one end as text; one file deleted."""
    services = _patch(g)
    links = services.select(F.col("id").alias("from_id"), F.regexp_extract("file_path", r"supplier_(\d+)", 1).alias("nation"), "seq")
    module = g.nodes.filter("kind = 'module'").select(F.substring_index("id", ":", -1).alias("nation"), F.lower("name").alias("text"))
    links = links.join(module, "nation")
    edges = links.select("from_id", F.col("text").alias("to_id"), F.lit("imports").alias("kind"), "seq").unionByName(links.select("from_id", F.lit("nobody:knows").alias("to_id"), F.lit("calls").alias("kind"), "seq"))
    order = F.col("seq").alias("order")
    edges = edges.select("*", F.concat_ws("|", "kind", "from_id", "to_id").alias("id")).withColumn("order", order).drop("seq")
    nodes = services.withColumn("order", order).drop("seq")
    files = g.files.filter(F.col("path").contains("/supplier_")).select("path", F.lit("h").alias("hash"), F.lit(1).cast("long").alias("last_indexed_at"), "language")
    files = files.unionByName(files.withColumns({"hash": F.lit("older"), "last_indexed_at": F.lit(0).cast("long")}))
    gone = g.files.filter("path = '/ws/src/graph/regions.ts'").select("path")
    after = patch.apply_patch(g, files, _with_order(nodes, S.NODES), _with_order(edges, S.EDGES), gone, "order")
    row = lambda df, part, *columns: df.select(F.lit(part).alias("part"), *[F.col(c).cast("string").alias(n) for n, c in zip(("id", "a", "b", "c"), columns, strict=True)])
    return row(after.nodes, "node", "id", "name", "cluster_id", "file_path").unionByName(row(after.edges, "edge", "id", "from_id", "to_id", "source_file")).unionByName(row(after.files, "file", "path", "hash", "symbol_count", "edge_count"))


def _with_order(df, schema):
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "order")


@query
def metadata_types(spark, sf_dir):
    """Whether metadata made up from the ids has the types that its kind of node demands."""
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod("doc_id", F.lit(len(words))) + 1).cast("int"))
    text = F.concat(F.lit('{"'), pick("async", "exported", "abstract", "qos", "retain"), F.lit('":'), pick("true", "1", '"x"', "null"), F.lit("}"))
    kind = pick("function", "method", "class", "topic", "module", "type", "topic")
    return table(spark, sf_dir, "documents").select("doc_id", X.metadata_problem(kind, text).isNull().alias("fits"))


@on_graph
def node_enrich(g):
    return patch.enrich_nodes(g.nodes.withColumns({c: F.lit(None).cast("string") for c in ("domain", "subsystem", "cluster_id")})).select("id", "domain", "subsystem", "cluster_id")


@on_graph
def relabelled_nodes(g):
    return patch.relabel(g).nodes.select("id", "domain", "subsystem", "cluster_id", "centrality_score")


@on_graph
def resolve_endpoints(g):
    """Textual ends, some of several meanings, of all nodes against a patch and the whole graph: names, tails, paths, file names."""
    local = S.conform(patch.last_wins(_patch(g), "id", "seq"), S.NODES)
    kind, tail = F.col("kind"), F.element_at(F.split("qualified_name", "::"), -1)
    text = F.when(kind == "service", F.upper("name")).when(kind == "function", tail).when(kind == "class", F.concat(F.lit("new "), "name", F.lit("()"))).when(kind == "method", F.col("name")).otherwise(F.col("file_path"))
    asked = g.nodes.unionByName(local).select(kind, F.explode(F.array(text, "name", "file_path")).alias("raw"))
    raws = asked.select(F.when(kind.isin("function", "method"), "calls").otherwise("imports").alias("kind"), F.lit("/ws/src/runtime/main.py").alias("source_file"), "raw").distinct()
    return resolve.resolve_names(raws, local, g.nodes).select("kind", "raw", "resolved")


@query
def hash_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    stored = docs.filter("doc_id % 5 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("hash"))
    return workspace.hash_diff(docs.select(path, F.sha2("text", 256).alias("hash")), stored)


@query
def dirty_set(spark, sf_dir):
    return changes.dirty_set(changes.tool_events(table(spark, sf_dir, "events")), "/ws")


@query
def update_targets(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    none = g.files.select("path").limit(0)
    dirty = changes.dirty_set(changes.tool_events(table(spark, sf_dir, "events")), "/ws")
    return workspace.update_targets(none, dirty, g.files.select("path"))


@query
def deleted_files(spark, sf_dir):
    g = derived_graph(spark, sf_dir)
    return workspace.deleted_files(changes.dirty_set(changes.tool_events(table(spark, sf_dir, "events")), "/ws").unionByName(g.files.select("path")), g.files.filter("language <> 'rust'"))


@query
def graph_revision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"))
    return store.revision_of(docs, "/ws", None, 1_700_000_000_000)


@query
def timestamps_and_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    total = events.agg(F.max("event_id").alias("top"))
    return events.crossJoin(F.broadcast(total)).select("event_id", X.iso_timestamp("ms").alias("iso"), X.is_stale("ms", 1_704_200_000_000).alias("stale"), X.progress("event_id", "top").alias("progress"))  # one row


@on_graph
def overview_tables(g):
    """All tables of the overview report in one: section, key, value."""
    tables = analyze.overview(g.nodes, g.edges, g.files)
    keys = {"kinds": ("kind", "count"), "languages": ("language", "count"), "central_nodes": ("id", "centrality"), "critical_files": ("path", "centrality"), "recommendations": ("id", "centrality"), "domains": ("domain", "file_count")}
    out = None
    for section, (k, v) in keys.items():
        rows = tables[section].select(F.lit(section).alias("section"), F.col(k).alias("key"), F.col(v).cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def dirty_stream_available_now(spark, sf_dir):
    """The dirty set by a stream over the event table, run until nothing is left to read."""
    import uuid

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    changes.run_available(changes.dirty_stream(changes.tool_events(stream), "/ws"), f"{base}/out", f"{base}/state")
    return spark.read.schema("path string").parquet(f"{base}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


SOURCES = {
    "python": ("from pathlib import Path as P\n\nclass Reader{0}(Base):\n    def load{0}(self, name: Model):\n        return P(name).read_text()\n\ndef handle_{0}(x):\n    store.save(x)\n", ".py"),
    "typescript": ("import {{ readFile as rf }} from './fs';\nexport class Svc{0} extends Base {{\n  name: string = '';\n  run{0}(x: number) {{ return rf(x); }}\n  get size() {{ return 1; }}\n}}\nexport function go{0}() {{ helper(); bus.publish('t'); }}\nclass Hidden {{}}\n", ".ts"),
    "rust": ("use std::fs::read_to_string as read_file;\npub struct Item{0} {{ n: u32 }}\ntrait Draw {{ fn draw(&self); }}\nimpl Draw for Item{0} {{\n    fn draw(&self) {{ read_file(\"x\"); }}\n}}\n", ".rs"),
    "c": ("#include \"shape.h\"\ntypedef struct Shape Shape;\nstruct Point{0} {{ int x; }};\nint area{0}(Shape *s) {{ return load_size(s); }}\n", ".c"),
    "cpp": ("#include <vector>\nclass Fwd;\nclass Win{0} : public Base {{\n  void show() {{ bus->connect(this); }}\n  Model *model;\n}};\nvoid run{0}(Config c) {{ start(c); }}\n", ".cpp"),
}


def _extracted(spark, sf_dir, language):
    """Symbols and edges of one generated source file for each document."""
    text, ext = SOURCES[language]
    number = F.pmod(F.col("doc_id"), F.lit(50)).cast("string")
    before, *rest = text.split("{0}")
    clean = lambda s: F.lit(s.replace("{{", "{").replace("}}", "}"))
    content = F.concat(clean(before), *[c for piece in rest for c in (number, clean(piece))])
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/ws/src/gen/f"), F.col("doc_id").cast("string"), F.lit(ext)).alias("path"), F.lit(language).alias("language"), content.alias("content"))
    nodes, edges = registry.extract(files)
    return nodes.select(F.lit("node").alias("row"), "kind", F.col("qualified_name").alias("name")).unionByName(edges.select(F.lit("edge").alias("row"), "kind", F.col("to_id").alias("name"))).groupBy("row", "kind").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("name").alias("names"))


for _language in SOURCES:
    QUERIES[f"extract_{_language}"] = lambda spark, sf_dir, language=_language: _extracted(spark, sf_dir, language)
