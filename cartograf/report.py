"""Text and diagram renderers. They collect what they print: a search's limit, a neighbourhood, top-k tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import analyze, graph, search
from .sources.derived import Graph

ADVICE = {
    "inspect": ("start with the direct callers; they are the highest-leverage impact surface.", "inspect the direct callers first; they show the highest-leverage impact surface.", "moderate confidence from graph connectivity; verify with source context when relationships are sparse or ambiguous."),
    "impact": ("review the nearest transitive dependents and their owning files before changing the target.", "review the nearest transitive dependents and their owning files before changing the target.", "moderate confidence from reachable dependents; deeper analysis may reveal indirect runtime effects."),
    "overview": ("inspect the listed hubs and critical files first; they are the highest-value entry points for analysis.", "inspect the listed hubs and critical files first; they are the highest-value entry points for analysis.", "moderate confidence from structural metrics; validate domain assumptions with targeted symbol inspection."),
}


def _advice(of: str) -> list[str]:
    first, then, sure = ADVICE[of]
    return ["", f"Priority: high — {first}", f"Recommendation / Next Step: {then}", f"Confidence / Uncertainty: {sure}", ""]


def _inferred(query: str, row) -> str:
    return f"Inferred primary definition for '{query}': {row.kind} {row.qualified_name or row.name} in {row.file_path}"


def context(g: Graph, row, depth: int = 2) -> str:
    degree = graph.inspect_centrality(g.nodes.filter(F.col("id") == row.id), g.edges).first()
    lines = [f"Symbol: {row.name} [{row.kind}]"] + ([f"Qualified: {row.qualified_name}"] if row.qualified_name else []) + [f"Location: {row.file_path}", ""]
    lines += [f"Fan-in: {degree.fan_in}", f"Fan-out: {degree.fan_out}", f"Centrality: {degree.centrality}", ""]
    for title, walk in (("Dependencies (what it uses):", graph.dependencies), ("\nCallers (what uses it):", graph.callers)):
        found = walk(g.nodes, g.edges, row.id, depth).orderBy("path_length", "name", "id").collect()
        lines.append(title)
        lines += [f"- {r.name} [{r.kind}] via {r.via_edge_kind} (distance {r.path_length})" + (f" ({r.file_path})" if r.file_path else "") for r in found] or [f"- None found at depth {depth}"]
    return "\n".join(lines + _advice("inspect"))


def mermaid(g: Graph, node: str, name: str, depth: int = 2) -> str:
    edges = graph.neighborhood(g.nodes, g.edges, node, depth)
    rows = edges.select("*", X.diagram_id("from_id").alias("a"), X.diagram_id("to_id").alias("b")).orderBy(~X.listed_architecture(), "from_id", "to_id", "kind").collect()
    if not rows:
        return f"%% Symbol '{name}' found but has no relationships."
    label = lambda name, kind, ident: f'"{name} [{kind}]"' if name else f'"{ident} [unresolved]"'
    return "graph TD\n" + "".join(f"  {r.a}({label(r.from_name, r.from_kind, r.from_id)}) -->|{r.kind}| {r.b}({label(r.to_name, r.to_kind, r.to_id)})\n" for r in rows)


def _exact(rows: list) -> list:
    return [r for r in rows if r.match_type == "exact"]


def inspect(g: Graph, query: str, kind: str | None = None, file: str | None = None, depth: int = 2, form: str = "text", limit: int = 10) -> str | list:
    """Context or diagram of a symbol; of several matches the clear primary one; else the list of matches."""
    found = search.search(g.nodes, query, kind, limit, file)
    rows = found.collect()
    if not rows:
        return f"No symbols found matching: {query}"
    show = (lambda r: context(g, r, depth)) if form == "text" else (lambda r: mermaid(g, r.id, r.name, depth))
    single = _exact(rows)[0] if len(_exact(rows)) == 1 else rows[0] if len(rows) == 1 else None
    if single and (form != "text" or len(rows) == 1):
        return show(single)
    best = search.best_match(found, g.edges).first()
    return rows if best is None else f"{_inferred(query, best)}\n\n{show(best)}"


def impact(g: Graph, target: str) -> str:
    found = search.search(g.nodes, target)
    rows = found.collect()
    if not rows:
        return f"No symbols found matching: {target}"
    best = _exact(rows)[0] if len(_exact(rows)) == 1 else rows[0] if len(rows) == 1 else search.best_match(found, g.edges).first()
    if best is None:
        lines = [f"- {r.name} [{r.kind}] ({r.match_type})" + (f" in {r.file_path}" if r.file_path else "") for r in rows[:5]]
        return "\n".join([f"Ambiguous target: {target}", "Provide 'kind' or 'file' to disambiguate. Top matches:", *lines])
    callers = graph.impact(g.nodes, g.edges, best.id).persist()
    lines = [_inferred(target, best), ""] if len(rows) > 1 else []
    lines += [f"Impact Analysis for: {best.name}", f"Kind: {best.kind}", f"Location: {best.file_path or 'unknown'}", "", "Transitive Dependents:"]
    lines += [f"- {r.name} [{r.kind}] via {r.via_edge_kind} (distance {r.path_length})" + (f" in {r.file_path}" if r.file_path else "") for r in callers.collect()]
    lines += ["", "Affected Files:"] + ([f"- {r.file_path}" for r in graph.affected_files(callers).orderBy("file_path").collect()] or ["- None"])
    callers.unpersist()
    return "\n".join(lines + _advice("impact"))


def overview(g: Graph, revision: dict | None = None) -> str:
    tables: dict[str, DataFrame] = analyze.overview(g.nodes, g.edges, g.files)
    rows = {k: df.collect() for k, df in tables.items()}
    out = ["## Architecture Overview", "", "| Kind | Count |", "| :--- | :--- |", *[f"| {r.kind} | {r['count']} |" for r in rows["kinds"]], ""]
    if rows["languages"]:
        out += ["**Languages**: " + ", ".join(f"{r.language} ({r['count']})" for r in rows["languages"]), ""]
    if revision:
        out += [f"**Graph Revision**: {revision['graphRevision']}", f"**Indexed Commit**: {revision.get('indexedCommit') or 'none'}", f"**Workspace ID**: {revision['workspaceId']}", ""]
    if rows["domains"]:
        out += ["### Architecture Domains", *[f"- **{r.domain}**: {r.file_count} files, {r.node_count} symbols, {r.hub_count} hubs" for r in rows["domains"]], ""]
    if rows["critical_files"]:
        out += ["### Architecture-Critical Files"]
        out += [f"- `{r.path}` [fan-in={r.fan_in}, fan-out={r.fan_out}, centrality={r.centrality}] ({r.domain or 'workspace'} / {r.subsystem or 'workspace'})" for r in rows["critical_files"]] + [""]
    out += ["### Core Runtime Hubs", *[f"- **{r.name}** ({r.kind}) in `{r.file_path or 'unknown'}`: fan-in={r.fan_in}, fan-out={r.fan_out}, centrality={r.centrality}" for r in rows["central_nodes"]]]
    if rows["recommendations"]:
        out += ["", "### Recommended Next Inspections", *[f"- Inspect `{r.name}` ({r.kind}) in `{r.file_path or 'unknown'}`" for r in rows["recommendations"]]]
    return "\n".join(out + _advice("overview"))
