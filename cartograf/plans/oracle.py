"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from .. import schemas as S

_DOMAINS = ", ".join(f"'{d}'" for d in S.DOMAINS)
_THIRD = "|".join(S.THIRD_PARTY)


def parts(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def known(p: str) -> str:
    return f"list_filter({parts(p)}, lambda s: s IN ({_DOMAINS}))[-1]"


def domain(p: str) -> str:
    return f"coalesce({known(p)}, CASE WHEN list_position({parts(p)}, 'src') > 1 THEN ({parts(p)})[list_position({parts(p)}, 'src') - 1] END, 'workspace')"


def domain_intent(p: str) -> str:
    back = f"list_position(list_reverse({parts(p)}), 'src')"
    return f"coalesce({known(p)}, CASE WHEN {back} > 1 THEN list_reverse({parts(p)})[{back} - 1] END, 'workspace')"


def subsystem(p: str) -> str:
    back = f"coalesce(list_position(list_reverse({parts(p)}), 'src'), 0)"
    start = f"CASE WHEN {back} > 0 THEN len({parts(p)}) - {back} + 1 ELSE greatest(len({parts(p)}) - 2, 1) END"
    return f"array_to_string(({parts(p)})[({start}):({start}) + 2], '/')"


def third(p: str) -> str:
    return f"coalesce(regexp_matches(lower(replace({p}, '\\', '/')), '/({_THIRD})/'), false)"


GRAPH = f"""
nodes0 AS (
  SELECT 'namespace:' || r_regionkey AS id, 'namespace' AS kind, r_name AS name, 'typescript' AS language, r_name AS qualified_name, '/ws/src/graph/regions.ts' AS file_path, NULL AS summary FROM region
  UNION ALL SELECT 'module:' || n_nationkey, 'module', n_name, 'typescript', n_name, '/ws/src/graph/nation_' || n_nationkey || '.ts', NULL FROM nation
  UNION ALL SELECT 'service:' || s_suppkey, 'service', s_name, 'python', s_name, '/ws/src/runtime/supplier_' || s_nationkey || '.py', NULL FROM supplier
  UNION ALL SELECT 'class:' || c_custkey, 'class', c_name, 'typescript', c_name, '/ws/src/ui/customer_' || c_nationkey || '.ts', NULL FROM customer
  UNION ALL SELECT 'function:' || p_partkey, 'function', p_name, 'rust', p_brand || '::' || p_name,
    '/ws/src/' || CASE WHEN p_type = 'ECONOMY' THEN 'vendor' ELSE 'tools' END || '/brand_' || substr(p_brand, 7) || '.rs', p_type FROM part
  UNION ALL SELECT 'method:' || o_orderkey, 'method', 'order_' || o_orderkey, 'cpp', NULL, '/ws/src/core/prio_' || substr(o_orderpriority, 1, 1) || '.cpp', NULL FROM orders
),
paths AS (SELECT path, {domain("path")} AS domain, {subsystem("path")} AS subsystem FROM (SELECT DISTINCT file_path AS path FROM nodes0)),
nodes AS (SELECT n.*, p.domain, p.subsystem, p.domain || ':' || p.subsystem AS cluster_id FROM nodes0 n JOIN paths p ON n.file_path = p.path),
edges0 AS (
  SELECT 'contains' AS kind, 'namespace:' || n_regionkey AS from_id, 'module:' || n_nationkey AS to_id FROM nation
  UNION ALL SELECT 'defines', 'module:' || s_nationkey, 'service:' || s_suppkey FROM supplier
  UNION ALL SELECT 'imports', 'service:' || s_suppkey, 'module:' || s_nationkey FROM supplier
  UNION ALL SELECT 'publishes', 'module:' || s_nationkey, 'service:' || min(s_suppkey) FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT 'imports', 'class:' || c_custkey, 'module:' || c_nationkey FROM customer
  UNION ALL SELECT 'depends_on', 'method:' || o_orderkey, 'class:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'references', 'method:' || l_orderkey, 'function:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'calls', 'function:' || l_partkey, 'service:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'imports', 'module:' || n_nationkey, 'external:' || n_name FROM nation
),
edges AS (SELECT kind || ':' || from_id || ':' || to_id AS id, * FROM edges0),
arch AS (SELECT * FROM edges WHERE kind NOT IN ('contains', 'defines')),
files AS (SELECT p.path, p.domain, p.subsystem, n.symbol_count FROM paths p JOIN (SELECT file_path, count(*) AS symbol_count FROM nodes0 GROUP BY 1) n ON n.file_path = p.path),
fan AS (
  SELECT n.id, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out FROM nodes n
  LEFT JOIN (SELECT to_id, count(*) c FROM arch GROUP BY 1) i ON i.to_id = n.id LEFT JOIN (SELECT from_id, count(*) c FROM arch GROUP BY 1) o ON o.from_id = n.id
),
ranked AS (
  SELECT n.*, fan_in, fan_out, fan_in * 3 + fan_out AS centrality,
    (fan_in * 3 + fan_out)::DOUBLE + CASE WHEN coalesce(domain, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(subsystem, '') <> '' THEN 1 ELSE 0 END
    + CASE WHEN coalesce(summary, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(qualified_name, '') <> '' THEN 0.5 ELSE 0 END
    - CASE WHEN {third("file_path")} THEN 100 ELSE 0 END AS decision_score
  FROM nodes n JOIN fan USING (id) WHERE fan_in * 3 + fan_out > 0
),
weights AS (SELECT * FROM (VALUES ('calls', 3.0::DOUBLE), ('depends_on', 3.0), ('implements', 3.0), ('extends', 3.0), ('imports', 2.0), ('references', 2.0),
  ('reads', 1.5), ('writes', 1.5), ('publishes', 1.5), ('subscribes', 1.5), ('routes_to', 1.5), ('handles', 1.5)) w(kind, weight)),
between AS (
  SELECT a.file_path AS from_path, b.file_path AS to_path, e.kind, coalesce(w.weight, 1.0) AS weight
  FROM arch e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id LEFT JOIN weights w ON w.kind = e.kind
),
file_fan AS (
  SELECT f.path, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, coalesce(i.c, 0) * 3 + coalesce(o.c, 0) AS centrality FROM files f
  LEFT JOIN (SELECT to_path, count(*) c FROM between GROUP BY 1) i ON i.to_path = f.path LEFT JOIN (SELECT from_path, count(*) c FROM between GROUP BY 1) o ON o.from_path = f.path
),
near AS (
  SELECT path, neighbor, sum(w) AS weight FROM (
    SELECT from_path AS path, to_path AS neighbor, weight AS w FROM between WHERE from_path <> to_path
    UNION ALL SELECT to_path, from_path, weight * 0.5 FROM between WHERE from_path <> to_path
  ) GROUP BY 1, 2 HAVING sum(w) >= 1
),
voted AS (
  SELECT d.path, d.domain, s.subsystem FROM (
    SELECT path, domain, row_number() OVER (PARTITION BY path ORDER BY sum(weight) DESC, domain) AS nth FROM (
      SELECT path, domain, 8.0::DOUBLE AS weight FROM files UNION ALL SELECT near.path, f.domain, near.weight FROM near JOIN files f ON f.path = near.neighbor
    ) GROUP BY path, domain
  ) d JOIN (
    SELECT path, subsystem, row_number() OVER (PARTITION BY path ORDER BY sum(weight) DESC, subsystem) AS nth FROM (
      SELECT path, subsystem, 8.0::DOUBLE AS weight FROM files UNION ALL SELECT near.path, f.subsystem, near.weight FROM near JOIN files f ON f.path = near.neighbor
    ) GROUP BY path, subsystem
  ) s ON s.path = d.path AND s.nth = 1 WHERE d.nth = 1
),
links AS (SELECT DISTINCT from_path AS a, to_path AS b FROM between WHERE from_path <> to_path UNION SELECT DISTINCT to_path, from_path FROM between WHERE from_path <> to_path),
closure AS (SELECT path AS a, path AS b FROM files UNION SELECT c.a, l.b FROM closure c JOIN links l ON l.a = c.b),
parted AS (SELECT a AS path, dense_rank() OVER (ORDER BY least) AS component FROM (SELECT a, min(b) AS least FROM closure GROUP BY a)),
topology AS (
  SELECT path, fan_in, fan_out, centrality, v.domain, v.subsystem, 'cluster:' || component || ':' || v.domain || ':' || v.subsystem AS cluster_id
  FROM file_fan JOIN voted v USING (path) JOIN parted USING (path)
)
"""


def on_graph(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH}{', ' + more if more else ''} {select}"


def reach(start: str, depth: int, outbound: bool, edges: str = "arch") -> str:
    """CTE ``found``: node, path_length, via."""
    here, there = ("from_id", "to_id") if outbound else ("to_id", "from_id")
    return f"""
walk(node, depth) AS (
  SELECT {there}, 1 FROM {edges} WHERE {here} = '{start}' UNION SELECT e.{there}, w.depth + 1 FROM walk w JOIN {edges} e ON e.{here} = w.node WHERE w.depth < {depth}
),
best AS (SELECT node, min(depth) AS path_length FROM walk WHERE node <> '{start}' OR depth = 1 GROUP BY node),
levels AS (SELECT node, path_length FROM best WHERE node <> '{start}' UNION ALL SELECT '{start}', 0),
found AS (
  SELECT b.node, b.path_length, string_agg(DISTINCT e.kind, ', ' ORDER BY e.kind) AS via
  FROM best b JOIN {edges} e ON e.{there} = b.node JOIN levels l ON l.node = e.{here} AND l.path_length = b.path_length - 1 GROUP BY 1, 2
)"""


REACHED = "SELECT n.id, n.name, n.kind, f.path_length::INT AS path_length, f.via AS via_edge_kind FROM found f JOIN nodes n ON n.id = f.node"
RANKED = "id, name, kind, file_path, fan_in, fan_out, centrality, decision_score"
RANK_ORDER = "decision_score DESC, fan_in DESC, centrality DESC, name, id"
FILE_SCORE = f"centrality::DOUBLE + CASE WHEN coalesce(domain, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(subsystem, '') <> '' THEN 1 ELSE 0 END - CASE WHEN {third('path')} THEN 100 ELSE 0 END"
NEIGHBOR = "e.id AS edge_id, e.from_id, e.to_id, e.kind AS edge_kind, n.id AS node_id, n.name AS node_name, n.kind AS node_kind, n.file_path AS node_file"
RECOMMENDABLE = f"""(kind IN ({", ".join(f"'{k}'" for k in S.RECOMMENDABLE)}) AND coalesce(file_path, '') <> '' AND NOT regexp_matches(file_path, '(?i)test|spec') AND NOT {third("file_path")} AND lower(name) NOT IN ('new', 'main', 'default', 'helper'))"""
SYMBOL_SCORE = "0.0::DOUBLE + CASE WHEN coalesce(domain, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(subsystem, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(summary, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(qualified_name, '') <> '' THEN 0.5 ELSE 0 END + CASE WHEN kind IN ('function', 'method') THEN 1 ELSE 0 END"
NODE = "id, kind, name, file_path"


def symbols(q: str, filtered: bool) -> str:
    within = lambda c: f"contains(lower(coalesce({c}, '')), lower('{q}'))"
    where = "WHERE " + " OR ".join(within(c) for c in ("name", "qualified_name", "summary", "domain", "subsystem")) if filtered else ""
    return f"""SELECT {NODE},
  CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 ELSE 3 END::INT AS kind_rank,
  CASE WHEN lower(qualified_name) = lower('{q}') THEN 0 WHEN lower(name) = lower('{q}') THEN 1 WHEN {within("summary")} THEN 2 WHEN {within("domain")} THEN 3 WHEN {within("subsystem")} THEN 4 ELSE 5 END::INT AS match_rank,
  {SYMBOL_SCORE} AS symbol_score
FROM nodes {where} ORDER BY kind_rank, match_rank, symbol_score DESC, id LIMIT 40"""


def searched(q: str, limit: int, where: str = "true") -> str:
    return f"""SELECT id, name, kind, qualified_name, file_path, score, match_type FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, coalesce(qualified_name, name), coalesce(file_path, '') ORDER BY score DESC, id) AS nth FROM (
    SELECT *, CASE tier WHEN 0 THEN CASE WHEN lower(qualified_name) = '{q}' THEN 110 ELSE 100 END WHEN 1 THEN 80 ELSE 60 END::INT AS score, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'fuzzy' END AS match_type FROM (
      SELECT *, CASE WHEN lower(name) = '{q}' OR lower(qualified_name) = '{q}' THEN 0 WHEN starts_with(lower(name), '{q}') OR starts_with(lower(qualified_name), '{q}') THEN 1
        WHEN contains(lower(name), '{q}') OR contains(lower(coalesce(qualified_name, '')), '{q}') THEN 2 END AS tier FROM nodes WHERE {where}
    ) WHERE tier IS NOT NULL ORDER BY tier, id LIMIT {limit}
  )
) WHERE nth = 1"""


_DIRECTIONS = ", ".join(f"('{k}', '{v}')" for k, v in S.DIRECTIONS.items())
_LANGUAGES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items())
_EXT = "lower(CASE WHEN contains(path, '.') THEN '.' ELSE '' END || string_split(path, '.')[-1])"
_PAGES = """(SELECT page_id, '/w.d/p' || page_id || (['.TS', '.mjs', '.rs', '.py', '.hpp', '.c++', '.c', '.txt', ''])[page_id % 9 + 1] AS path FROM pages)"""
_TARGETS = """(SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN n WHEN 1 THEN 'this.' || n || '()' WHEN 2 THEN ' await new ' || n || '(x, y) ' WHEN 3 THEN 'self->' || n || '->run()'
  WHEN 4 THEN 'crate::' || n || '::{A, B}' WHEN 5 THEN 'super::' || n || '.get' WHEN 6 THEN '&' || n || '/x.h' WHEN 7 THEN '::' || n || '::T' WHEN 8 THEN '''' || n || ''''
  ELSE 'new this.' || n || '.read()' END AS raw FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part))"""


def _normalized(c: str) -> str:
    out = f"trim({c})"
    for pattern, by, flags in (
        ("^[\"''`]", "", ""), ("[\"''`]$", "", ""), ("^await\\s+", "", ""), ("^new\\s+", "", ""), ("^this\\.", "", ""), ("^this->", "", ""), ("^self\\.", "", ""), ("^self->", "", ""),
        ("^crate::", "", ""), ("^super::", "", ""), ("^&", "", ""), ("^::", "", ""), ("\\(\\)", "", "g"), ("->", ".", "g"), ("::\\{.*\\}$", "", ""), ("\\(.*\\)$", "", ""),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{by}', '{flags}')"
    return f"trim({out})"


_TOOLS = """(SELECT CASE event_type WHEN 'purchase' THEN 'write_file' WHEN 'signup' THEN 'create_file' ELSE 'read_' || event_type END AS tool,
  'src/u' || user_id % 97 || (['.ts', '.py', '.rs', '.md', '.cpp'])[user_id % 5 + 1] AS path FROM events)"""
_DIRTY = f"SELECT DISTINCT '/ws/' || path AS path FROM {_TOOLS} WHERE regexp_matches(tool, 'write|edit|create|save|patch|replace|rename|move|delete|remove') AND NOT ends_with(path, '.md')"
_CALLEES = "(SELECT event_id, event_type || (['Loader', '.get', 'SaveAll', '', 'dispatchSend', 'forward', 'Offset'])[event_id % 7 + 1] AS callee FROM events)"
_VERBS = "(VALUES ('reads', 'read|get|load|fetch'), ('writes', 'write|save|set|store|append|update'), ('publishes', 'publish|emit|dispatch|send'), ('subscribes', 'subscribe|listen|consume|observe'), ('routes_to', 'route|forward|redirect')) v(verb, words)"
_METRICS = """metrics AS (SELECT n.id, coalesce(sum(CASE WHEN e.from_id = n.id AND e.kind = 'defines' THEN 1 ELSE 0 END), 0)::BIGINT AS child_count, count(e.id) AS degree
  FROM nodes n LEFT JOIN edges e ON e.from_id = n.id OR e.to_id = n.id WHERE n.kind IN ('module', 'namespace', 'service') GROUP BY n.id)"""

_ALL_METRICS = """metrics AS (SELECT n.id, coalesce(c.child_count, 0)::BIGINT AS child_count, coalesce(c.degree, 0) AS degree FROM nodes n LEFT JOIN (
  SELECT id, sum(defined)::BIGINT AS child_count, count(*) AS degree FROM (
    SELECT from_id AS id, CASE kind WHEN 'defines' THEN 1 ELSE 0 END AS defined FROM edges UNION ALL SELECT to_id, 0 FROM edges WHERE to_id <> from_id
  ) GROUP BY id) c USING (id))"""
_BEST = "SELECT id, name, child_count, degree FROM ranked2 WHERE nth = 1 AND (c2 IS NULL OR child_count > c2 OR (child_count = c2 AND degree >= d2 + 2))"

ORACLE: dict[str, str] = {
    "nodes_by_kind": on_graph("SELECT kind, count(*) AS count FROM nodes GROUP BY kind"),
    "nodes_by_language": on_graph("SELECT language, count(*) AS count FROM nodes WHERE language IS NOT NULL GROUP BY language"),
    "architecture_edges_by_kind": on_graph("SELECT kind, count(*) AS count FROM arch GROUP BY kind"),
    "listed_architecture_edges": on_graph(f"SELECT id, kind FROM edges WHERE kind IN ({', '.join(repr(k) for k in S.ARCHITECTURE)})"),
    "edges_in_kind_list": on_graph("SELECT id, from_id, to_id, kind FROM edges WHERE kind IN ('calls', 'imports')"),
    "fan_in_out": on_graph("SELECT * FROM fan"),
    "inspect_centrality": on_graph("SELECT id, fan_in * 2 + fan_out AS centrality FROM fan"),
    "rank_nodes": on_graph(f"SELECT {RANKED} FROM ranked"),
    "rank_nodes_top10": on_graph(f"SELECT {RANKED} FROM ranked ORDER BY {RANK_ORDER} LIMIT 10"),
    "central_nodes_top10": on_graph(f"SELECT {RANKED} FROM ranked WHERE NOT {third('file_path')} ORDER BY {RANK_ORDER} LIMIT 10"),
    "recommendations_top5": on_graph(f"SELECT {RANKED} FROM ranked WHERE {RECOMMENDABLE} ORDER BY {RANK_ORDER} LIMIT 5"),
    "third_party_flag": on_graph(f"SELECT id, {third('file_path')} AS third_party, {RECOMMENDABLE} AS recommendable FROM nodes"),
    "neighbors_outbound": on_graph(f"SELECT {NEIGHBOR}, 'outbound' AS direction FROM edges e LEFT JOIN nodes n ON n.id = e.to_id WHERE e.from_id = 'module:0'"),
    "neighbors_inbound": on_graph(f"SELECT {NEIGHBOR}, 'inbound' AS direction FROM edges e LEFT JOIN nodes n ON n.id = e.from_id WHERE e.to_id = 'service:3' AND e.kind IN ('calls', 'publishes', 'defines')"),
    "neighbors_both": on_graph(f"SELECT {NEIGHBOR}, 'outbound' AS direction FROM edges e LEFT JOIN nodes n ON n.id = e.to_id WHERE e.from_id = 'module:0' UNION ALL SELECT {NEIGHBOR}, 'inbound' FROM edges e LEFT JOIN nodes n ON n.id = e.from_id WHERE e.to_id = 'module:0'"),
    "file_edges": on_graph("SELECT from_path, to_path, kind, count(*) AS edges, sum(weight) AS weight FROM between GROUP BY 1, 2, 3"),
    "file_fan": on_graph("SELECT * FROM file_fan"),
    "weighted_file_neighbors": on_graph("SELECT * FROM near"),
    "file_label_vote": on_graph("SELECT * FROM voted"),
    "file_components": on_graph("SELECT path, component FROM parted"),
    "file_topology": on_graph("SELECT * FROM topology"),
    "rank_files_top5": on_graph(f"SELECT path, fan_in, fan_out, centrality, domain, {FILE_SCORE} AS file_score FROM topology WHERE NOT {third('path')} ORDER BY file_score DESC, fan_in DESC, centrality DESC, path LIMIT 5"),
    "domain_summary": on_graph("SELECT t.domain, count(*) AS file_count, sum(f.symbol_count)::BIGINT AS node_count, count(*) FILTER (centrality > 0) AS hub_count FROM topology t JOIN files f USING (path) GROUP BY t.domain"),
    "file_symbol_counts": on_graph("SELECT f.path, f.symbol_count::INT AS symbol_count, coalesce(e.c, 0)::INT AS edge_count FROM files f LEFT JOIN (SELECT n.file_path, count(*) c FROM edges e JOIN nodes n ON n.id = e.from_id GROUP BY 1) e ON e.file_path = f.path"),
    "infer_domain_subsystem": on_graph(
        f"SELECT path, {domain('path')} AS domain, {domain_intent('path')} AS domain_intent, {subsystem('path')} AS subsystem, {domain('path')} || ':' || {subsystem('path')} AS cluster_id FROM (SELECT path FROM files UNION SELECT regexp_replace(path, '/(graph|runtime|ui|core|tools)/', '/pkg/', 'g') FROM files UNION SELECT replace(path, '/src/', '/lib/') FROM files)"
    ),
    "detect_language": f"SELECT page_id, path, CASE {_EXT} {_LANGUAGES} END AS language, {_EXT} IN ('.h', '.hpp', '.hh', '.hxx') AS header, string_split(path, '/')[-1] AS base, '/w.d' AS folder FROM {_PAGES}",
    "find_node_by_name": on_graph(f"SELECT {NODE} FROM nodes WHERE lower(name) = 'supplier#000000003' OR lower(qualified_name) = 'supplier#000000003' UNION ALL SELECT {NODE} FROM nodes WHERE lower(name) = 'small widget' OR lower(qualified_name) = 'small widget'"),
    "file_nodes": on_graph(f"SELECT {NODE} FROM nodes WHERE file_path = '/ws/src/graph/regions.ts'"),
    "search_tiered": on_graph(searched("small widget", 60)),
    "search_tiered_filtered": on_graph(searched("order_1", 25, "kind = 'method' AND contains(lower(file_path), 'prio_1')")),
    "search_symbols_filtered": on_graph(symbols("ECONOMY", True)),
    "search_symbols_ranked": on_graph(symbols("graph", False)),
    "candidate_metrics": on_graph("SELECT * FROM metrics", _METRICS),
    "best_match": on_graph(
        f"SELECT id, name, child_count, degree FROM ranked2 WHERE nth = 1 AND (c2 IS NULL OR child_count > c2 OR (child_count = c2 AND degree >= d2 + 2))",
        f"""{_METRICS}, matches AS ({searched("n_1", 10, "kind IN ('module', 'service')")} UNION ALL {searched("supplier#000000001", 10)}),
        chosen AS (SELECT * FROM matches WHERE match_type = 'exact' OR NOT EXISTS (SELECT 1 FROM matches WHERE match_type = 'exact')),
        ranked2 AS (SELECT c.*, m.child_count, m.degree, row_number() OVER w AS nth, lead(m.child_count) OVER w AS c2, lead(m.degree) OVER w AS d2 FROM chosen c JOIN metrics m USING (id)
          WINDOW w AS (ORDER BY m.child_count DESC, m.degree DESC, c.score DESC, c.file_path, c.id))""",
    ),
    "candidate_metrics_all": on_graph("SELECT * FROM metrics", _ALL_METRICS),
    "best_match_all": on_graph(
        _BEST,
        f"""{_ALL_METRICS}, matches AS ({searched("n_1", 10)} UNION ALL {searched("supplier#000000001", 10)}),
        chosen AS (SELECT * FROM matches WHERE match_type = 'exact' OR NOT EXISTS (SELECT 1 FROM matches WHERE match_type = 'exact')),
        ranked2 AS (SELECT c.*, m.child_count, m.degree, row_number() OVER w AS nth, lead(m.child_count) OVER w AS c2, lead(m.degree) OVER w AS d2 FROM chosen c JOIN metrics m USING (id)
          WINDOW w AS (ORDER BY m.child_count DESC, m.degree DESC, c.score DESC, c.file_path, c.id))""",
    ),
    "reachable_outbound": on_graph(REACHED, reach("function:7", 4, True)),
    "reachable_inbound": on_graph(REACHED, reach("module:0", 3, False, "edges")),
    "dependencies_depth2": on_graph(REACHED, reach("method:1", 2, True)),
    "callers_depth2": on_graph(REACHED, reach("service:3", 2, False)),
    "impact_depth10": on_graph(REACHED + " WHERE n.id <> 'module:0'", reach("module:0", 10, False)),
    "affected_files": on_graph("SELECT DISTINCT n.file_path FROM found f JOIN nodes n ON n.id = f.node WHERE n.id <> 'service:3'", reach("service:3", 10, False)),
    "shortest_path": on_graph(
        "SELECT step, id FROM path",
        """hops AS (SELECT DISTINCT from_id, to_id FROM arch WHERE to_id IN (SELECT id FROM nodes)),
        steps(node, depth) AS (SELECT 'method:1', 0 UNION SELECT h.to_id, s.depth + 1 FROM steps s JOIN hops h ON h.from_id = s.node WHERE s.depth < 8),
        dist AS (SELECT node, min(depth) AS d FROM steps GROUP BY node),
        path(step, id) AS (SELECT d::INT, node FROM dist WHERE node = 'module:3' UNION ALL
          SELECT p.step - 1, (SELECT min(h.from_id) FROM hops h JOIN dist x ON x.node = h.from_id AND x.d = p.step - 1 WHERE h.to_id = p.id) FROM path p WHERE p.step > 0)""",
    ),
    "mermaid_edges": on_graph(
        "SELECT DISTINCT r.from_id, r.to_id, r.kind, a.name AS from_name, b.name AS to_name, a.kind AS from_kind, b.kind AS to_kind FROM around r JOIN nodes a ON a.id = r.from_id LEFT JOIN nodes b ON b.id = r.to_id",
        """around(from_id, to_id, kind, depth) AS (
          SELECT from_id, to_id, kind, 1 FROM edges WHERE from_id = 'namespace:0' OR to_id = 'namespace:0'
          UNION (SELECT e.from_id, e.to_id, e.kind, r.depth + 1 FROM around r JOIN edges e ON e.from_id = r.to_id WHERE r.depth < 3
          UNION SELECT e.from_id, e.to_id, e.kind, r.depth + 1 FROM around r JOIN edges e ON e.to_id = r.from_id WHERE r.depth < 3))""",
    ),
    "edge_semantics": on_graph(
        f"SELECT k.kind, coalesce(d.text, 'source -> target') AS direction, coalesce(w.weight, 1.0) AS weight, k.kind IN ({', '.join(repr(k) for k in S.ARCHITECTURE)}) AS listed FROM kinds k LEFT JOIN weights w USING (kind) LEFT JOIN (VALUES {_DIRECTIONS}) d(kind, text) USING (kind)",
        "kinds AS (SELECT DISTINCT kind FROM edges UNION SELECT DISTINCT 'x_' || kind FROM edges)",
    ),
    "node_scores": on_graph(
        f"""SELECT id, 5.0::DOUBLE + CASE WHEN coalesce(domain, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(subsystem, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(summary, '') <> '' THEN 1 ELSE 0 END
        + CASE WHEN coalesce(qualified_name, '') <> '' THEN 0.5 ELSE 0 END - CASE WHEN {third("file_path")} THEN 100 ELSE 0 END AS decision_score, {SYMBOL_SCORE} AS symbol_score,
        regexp_replace(id, '[^a-zA-Z0-9]', '_', 'g') AS diagram_id, upper(kind[1]) || kind[2:] AS capital FROM nodes"""
    ),
    "content_hash": "SELECT doc_id, sha256(text) AS hash, len(string_split(text, chr(10)))::INT AS lines FROM documents",
    "type_references": r"""SELECT doc_id, len(l)::INT AS names, sha256(array_to_string(l, ',')) AS digest FROM (
      SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_]*\b')), lambda s: s NOT IN ('None', 'True', 'False', 'Optional', 'List', 'Dict', 'Set', 'Tuple'))) AS l FROM documents)""",
    "semantic_verbs": f"SELECT event_id, callee, verb FROM {_CALLEES} JOIN {_VERBS} ON regexp_matches(lower(callee), words)",
    "normalize_target": f"SELECT p_partkey, raw, {_normalized('raw')} AS target FROM {_TARGETS}",
    "symbol_candidates": f"""SELECT p_partkey, (unnest(range(len(c))))::INT AS nth, unnest(c) AS candidate FROM (SELECT p_partkey, list_filter([n,
      CASE WHEN contains(n, '.') THEN string_split(n, '.')[-1] END, CASE WHEN contains(n, '::') THEN string_split(n, '::')[-1] END, CASE WHEN contains(n, '/') THEN string_split(n, '/')[-1] END],
      lambda s: s IS NOT NULL AND s <> '') AS c FROM (SELECT p_partkey, {_normalized('raw')} AS n FROM {_TARGETS}))""",
    "patch_upsert": on_graph(
        f"SELECT id, kind, CASE WHEN kind = 'service' AND split_part(id, ':', 2)::BIGINT % 3 = 0 THEN 'New ' || name ELSE name END AS name, file_path, domain, subsystem, cluster_id FROM nodes"
    ),
    "patch_delete": on_graph("SELECT id FROM nodes WHERE NOT contains(file_path, '/ui/') UNION ALL SELECT path FROM files WHERE NOT contains(path, '/ui/')"),
    "patch_apply": on_graph(
        """SELECT 'node' AS part, id, CASE WHEN kind = 'service' THEN 'New ' || name ELSE name END AS a, cluster_id AS b, file_path AS c FROM nodes
        WHERE CASE WHEN kind = 'service' THEN split_part(id, ':', 2)::BIGINT % 3 = 0 ELSE kind <> 'namespace' END
        UNION ALL SELECT 'edge', id, from_id, to_id, NULL FROM edges
        UNION ALL SELECT 'edge', 'imports|service:' || s_suppkey || '|' || lower(n_name), 'service:' || s_suppkey, 'module:' || n_nationkey, '/ws/src/runtime/supplier_' || n_nationkey || '.py' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'edge', 'calls|service:' || s_suppkey || '|nobody:knows', 'service:' || s_suppkey, 'nobody:knows', '/ws/src/runtime/supplier_' || s_nationkey || '.py' FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'file', path, NULL, symbol_count::VARCHAR, NULL FROM files WHERE NOT contains(path, '/supplier_') AND path <> '/ws/src/graph/regions.ts'
        UNION ALL SELECT 'file', '/ws/src/runtime/supplier_' || s_nationkey || '.py', 'h', count(*) FILTER (s_suppkey % 3 = 0)::VARCHAR, (2 * count(*) FILTER (s_suppkey % 3 = 0))::VARCHAR FROM supplier GROUP BY s_nationkey"""
    ),
    "metadata_types": """SELECT doc_id, CASE
        WHEN doc_id % 5 < 2 AND doc_id % 7 < 2 OR doc_id % 5 = 2 AND doc_id % 7 = 2 OR doc_id % 5 = 4 AND doc_id % 7 IN (3, 6) THEN doc_id % 4 = 0
        WHEN doc_id % 5 = 3 AND doc_id % 7 IN (3, 6) THEN doc_id % 4 = 1 ELSE true END AS fits FROM documents""",
    "node_enrich": on_graph("SELECT id, domain, subsystem, cluster_id FROM nodes"),
    "relabelled_nodes": on_graph("SELECT n.id, t.domain, t.subsystem, t.cluster_id, coalesce(r.centrality, 0)::DOUBLE AS centrality_score FROM nodes n JOIN topology t ON t.path = n.file_path LEFT JOIN ranked r ON r.id = n.id"),
    "hash_diff": """SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'changed' END AS status FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
    "dirty_set": _DIRTY,
    "update_targets": f"SELECT path, 'dirty' AS source FROM ({_DIRTY})",
    "deleted_files": on_graph(f"SELECT path FROM ({_DIRTY} UNION SELECT path FROM files) WHERE path NOT IN (SELECT file_path FROM nodes WHERE language <> 'rust')"),
    "graph_revision": """SELECT key, value FROM (SELECT sha256('/ws') AS w, sha256(sha256('/ws') || ':no-git:1700000000000:' || string_agg(sha256(text), ',' ORDER BY sha256(text))) AS r FROM documents)
      CROSS JOIN LATERAL (VALUES ('graphRevision', r), ('indexedCommit', ''), ('workspaceId', w), ('indexedAt', '1700000000000')) v(key, value)""",
    "timestamps_and_progress": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, 1704200000000 - epoch_us(ts) // 1000 > 60000 AS stale, CASE WHEN top = 0 THEN 0 ELSE floor(event_id::DOUBLE / top * 100 + 0.5) END::INT AS progress FROM events, (SELECT max(event_id) AS top FROM events)",
    "overview_tables": on_graph(
        f"""SELECT 'kinds' AS section, kind AS key, count(*) AS value FROM nodes GROUP BY kind UNION ALL SELECT 'languages', language, count(*) FROM nodes GROUP BY language
        UNION ALL (SELECT 'central_nodes', id, centrality FROM ranked WHERE NOT {third("file_path")} ORDER BY {RANK_ORDER} LIMIT 10)
        UNION ALL (SELECT 'critical_files', path, centrality FROM topology WHERE NOT {third("path")} ORDER BY {FILE_SCORE} DESC, fan_in DESC, centrality DESC, path LIMIT 5)
        UNION ALL (SELECT 'recommendations', id, centrality FROM ranked WHERE {RECOMMENDABLE} ORDER BY {RANK_ORDER} LIMIT 5)
        UNION ALL SELECT 'domains', domain, count(*) FROM topology GROUP BY domain"""
    ),
    "dirty_stream_available_now": _DIRTY,
}

# What one generated file of each language holds, read off the extractors and looked through: row, kind, name; {n} is the number of
# the file's variant, {f} its path. It pins results and shows that no file's rows are lost or doubled.
EXTENSIONS = {"python": ".py", "typescript": ".ts", "rust": ".rs", "c": ".c", "cpp": ".cpp"}
EXTRACTED = {
    "python": """
      node class Reader{n}
      node file
      node function handle_{n}
      node method Reader{n}.load{n}
      edge calls P
      edge calls P(name).read_text
      edge calls store.save
      edge contains class:{f}:Reader{n}
      edge contains function:{f}:handle_{n}
      edge contains method:{f}:Reader{n}.load{n}
      edge defines method:{f}:Reader{n}.load{n}
      edge depends_on Base
      edge depends_on Model
      edge depends_on Model
      edge depends_on P
      edge depends_on P
      edge depends_on Reader{n}
      edge depends_on pathlib::Path
      edge depends_on pathlib::Path
      edge extends Base
      edge handles {n}
      edge imports pathlib
      edge reads P(name).read_text
      edge references Base
      edge references Model
      edge references Model
      edge references P
      edge references P
      edge references P(name).read_text
      edge references Reader{n}
      edge references store.save
      edge writes x
    """,
    "typescript": """
      node class Svc{n}
      node file
      node function go{n}
      node getter Svc{n}.getSize
      node method Svc{n}.run{n}
      node property Svc{n}.name
      edge calls helper
      edge calls rf
      edge contains class:{f}:Svc{n}
      edge contains function:{f}:go{n}
      edge contains getter:{f}:Svc{n}.getSize
      edge contains method:{f}:Svc{n}.run{n}
      edge contains property:{f}:Svc{n}.name
      edge defines getter:{f}:Svc{n}.getSize
      edge defines method:{f}:Svc{n}.run{n}
      edge defines property:{f}:Svc{n}.name
      edge depends_on ./fs
      edge depends_on ./fs::readFile
      edge depends_on ./fs::readFile
      edge extends Base
      edge imports ./fs
      edge publishes t
    """,
    "rust": """
      node file
      node function Item{n}::draw
      node struct Item{n}
      node trait Draw
      edge calls read_file
      edge contains function:{f}:Item{n}::draw
      edge contains struct:{f}:Item{n}
      edge contains trait:{f}:Draw
      edge defines function:{f}:Item{n}::draw
      edge depends_on Draw
      edge depends_on Draw
      edge depends_on Item{n}
      edge depends_on Item{n}
      edge depends_on std::fs::read_to_string
      edge depends_on std::fs::read_to_string
      edge implements Draw
      edge imports std::fs
      edge reads std::fs::read_to_string
      edge references Draw
      edge references Draw
      edge references Item{n}
      edge references Item{n}
    """,
    "c": """
      node file
      node function area{n}
      node struct Point{n}
      node struct Shape
      node type Shape
      edge calls load_size
      edge contains function:{f}:area{n}
      edge contains struct:{f}:Point{n}
      edge contains struct:{f}:Shape
      edge contains type:{f}:Shape
      edge depends_on Point{n}
      edge depends_on Shape
      edge depends_on Shape
      edge depends_on Shape
      edge depends_on shape.h
      edge imports shape.h
      edge reads load_size
      edge references Point{n}
      edge references Shape
      edge references Shape
      edge references Shape
    """,
    "cpp": """
      node class Win{n}
      node file
      node function Win{n}::show
      node function run{n}
      edge calls bus.connect
      edge calls start
      edge contains class:{f}:Win{n}
      edge contains function:{f}:Win{n}::show
      edge contains function:{f}:run{n}
      edge defines function:{f}:Win{n}::show
      edge depends_on Base
      edge depends_on Base
      edge depends_on Config
      edge depends_on Model
      edge depends_on Win{n}
      edge depends_on vector
      edge extends Base
      edge imports vector
      edge references Base
      edge references Config
      edge references Model
      edge references Win{n}
    """,
}


def extracted(language: str) -> str:
    """Rows and distinct names by row and kind, if every document's file holds the table's rows."""
    lines = [line.split() for line in EXTRACTED[language].strip().splitlines()]
    rows = ", ".join(f"('{row}', '{kind}', {repr(name[0]) if name else 'NULL'})" for row, kind, *name in lines)
    path = f"'/ws/src/gen/f' || doc_id || '{EXTENSIONS[language]}'"
    return f"""SELECT "row", kind, count(*) AS count, count(DISTINCT replace(replace(name, '{{f}}', {path}), '{{n}}', (doc_id % 50)::VARCHAR)) AS names
FROM documents, (VALUES {rows}) v("row", kind, name) GROUP BY "row", kind"""


ORACLE |= {f"extract_{language}": extracted(language) for language in EXTRACTED}
