"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator or group."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions import text as texts
from loomgraph.operators import correlate, explain, extract, focus, forest, graph, report, resolve, rollup, scan, traverse, views
from loomgraph.plans import adapters as A
from loomgraph.plans.workspaces import QUERIES as WORKSPACES
from loomgraph.session import configure, materialize, shared_folder
from loomgraph.sources import otlp, tables

# Tables several queries start from are written once per session and data folder, the way
# a deployment would keep them as tables.
_KEPT: dict[tuple, object] = {}


def kept(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]):
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        configure(spark)
        _KEPT[key] = build()
    return _KEPT[key]


def _spread(df: DataFrame) -> DataFrame:
    """Written in at least one file per core: row-local text work follows the file layout,
    and the test tables come as single small files."""
    return materialize(df.repartition(df.sparkSession.sparkContext.defaultParallelism))


def _spans(spark, sf_dir) -> DataFrame:
    return kept("spans", spark, sf_dir, lambda: A.event_spans(spark, sf_dir))


def _forest(spark, sf_dir) -> forest.Forest:
    return kept("forest", spark, sf_dir, lambda: forest.build_forest(_spans(spark, sf_dir)))


def _numbered(spark, sf_dir) -> DataFrame:
    return kept("numbered", spark, sf_dir, lambda: forest.number_spans(_forest(spark, sf_dir)))


def _links(spark, sf_dir) -> DataFrame:
    return kept("links", spark, sf_dir, lambda: materialize(A.part_links(spark, sf_dir)))


def _facts(spark, sf_dir) -> DataFrame:
    return kept("facts", spark, sf_dir, lambda: materialize(A.resolved_part_facts(spark, sf_dir)))


def _open_graph(spark, sf_dir) -> graph.Graph:
    """Nothing folded: every file is a node."""
    def build():
        made = graph.build_graph(A.part_records(spark, sf_dir), _facts(spark, sf_dir), max_nodes=1 << 40)
        return made._replace(nodes=materialize(made.nodes))
    return kept("open", spark, sf_dir, build)


def _small_graph(spark, sf_dir) -> graph.Graph:
    """The default node budget."""
    def build():
        made = graph.build_graph(A.part_records(spark, sf_dir), _facts(spark, sf_dir))
        return made._replace(nodes=materialize(made.nodes))
    return kept("small", spark, sf_dir, build)


def _part_nodes(spark, sf_dir) -> DataFrame:
    """Parts as nodes with the fan counts of the unfolded links; ids as in part_links."""
    ident = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    records = rollup.with_roles(A.part_records(spark, sf_dir)).withColumn("id", ident)
    return (
        records.join(graph.degrees(_links(spark, sf_dir)), ["repo_id", "id"], "left")
        .na.fill(0, ["in", "out"])
        .withColumn("kind", F.lit("file"))
        .withColumn("label", F.col("name"))
    )


# --- files -------------------------------------------------------------------------


def scan_records(spark, sf_dir):
    return scan.scan(A.document_files(spark, sf_dir)).select("path", "dir", "name", "ext", "area", "lines", "bytes", "mode")


def excerpt_first_lines(spark, sf_dir):
    return scan.scan(A.document_files(spark, sf_dir)).select("path", F.array_join("excerpt", "\n").alias("excerpt"))


def symbol_outline(spark, sf_dir):
    text = F.expr(
        r"""CASE p_partkey % 5
            WHEN 0 THEN '// head\nexport async function f' || p_partkey || '() {}\n  export const c = 1\nexport const c = 2\n'
            WHEN 1 THEN 'import os\n\nclass K' || p_partkey || ':\n    async def run(self): pass\n'
            WHEN 2 THEN 'func (r *T) Get' || p_partkey || '() {}\nfunc hidden() {}\n'
            WHEN 3 THEN 'pub struct S' || p_partkey || ';\npub async fn go() {}\nCREATE TABLE IF NOT EXISTS app.t' || p_partkey || ' (id int)\n'
            ELSE 'export { a' || p_partkey || ', b as c, d as default }\nnothing here\n' END"""
    )
    parts = A.table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.array_join(texts.outline(texts.lines_of(text)), ",").alias("symbols"))


def statement_text(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", texts.normalize_statement(F.col("text")).alias("statement")
    )


def summary_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", texts.clean_summary(F.col("text")).alias("summary"))


def report_cells(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", texts.report_cell(F.col("html")).alias("cell"))


def classify_roles(spark, sf_dir):
    return rollup.with_roles(A.part_records(spark, sf_dir)).select("path", "role", "contributes")


def modal_role_by_directory(spark, sf_dir):
    from loomgraph.operators.classify import modal_role

    return modal_role(rollup.with_roles(A.part_records(spark, sf_dir)), ["dir"])


def node_heights(spark, sf_dir):
    rows = A.part_records(spark, sf_dir).withColumn("kind", F.lit("file"))
    return rows.select("path", report.node_height().alias("height"))


# --- roll-up and graph ----------------------------------------------------------------


def rollup_plan(spark, sf_dir):
    return _small_graph(spark, sf_dir).plan.select("area", "depth", "dense", F.round("share", 9).alias("share"), "files")


def rolled_up_nodes(spark, sf_dir):
    nodes = _small_graph(spark, sf_dir).nodes
    return nodes.select("id", "label", "kind", "area", "role", "lines", "bytes", "items", "in", "out")


def rolled_up_links(spark, sf_dir):
    links = _small_graph(spark, sf_dir).links
    return links.select("type", "from", "to", "observations", "confidence")


def graph_nodes(spark, sf_dir):
    return _open_graph(spark, sf_dir).nodes.select("id", "label", "kind", "area", "role", "lines", "items", "in", "out")


def containment_edges(spark, sf_dir):
    links = _open_graph(spark, sf_dir).links
    return links.filter("type = 'containment'").select("from", "to")


def area_counts(spark, sf_dir):
    return _open_graph(spark, sf_dir).areas.select(F.col("id").alias("area"), "count")


def repository_stats(spark, sf_dir):
    return _open_graph(spark, sf_dir).stats.select("nodes", "source_files", "lines", "links", "packages")


def coverage_counters(spark, sf_dir):
    return _small_graph(spark, sf_dir).coverage.drop("repo_id")


def _directory_facts(spark, sf_dir) -> DataFrame:
    facts = _facts(spark, sf_dir).filter("res_kind = 'internal'")
    return facts.withColumn("type", F.lit("import")).withColumn("from", paths.dir_of(F.col("path"))).withColumn(
        "to", paths.dir_of(F.col("res_value"))
    )


def edge_aggregate(spark, sf_dir):
    return graph.aggregate_edges(_directory_facts(spark, sf_dir)).select("from", "to", "observations", "confidence")


def edge_samples(spark, sf_dir):
    return graph.edge_samples(_directory_facts(spark, sf_dir)).select("from", "to", F.array_join("samples", "; ").alias("samples"))


def edge_evidence(spark, sf_dir):
    place = F.transform("evidence", lambda e: F.concat_ws(":", e["path"], e["start_line"], e["end_line"], e["specifier"]))
    return graph.edge_evidence(_directory_facts(spark, sf_dir)).select("from", "to", F.array_join(place, "; ").alias("evidence"))


def externals_topk(spark, sf_dir):
    return graph.top_externals(graph.external_hits(_facts(spark, sf_dir))).select("name", "hits", "rank")


def fan_in_out(spark, sf_dir):
    return graph.degrees(_links(spark, sf_dir)).select("id", F.col("in").alias("fan_in"), F.col("out").alias("fan_out"))


def dependency_hubs(spark, sf_dir):
    return graph.hubs(_part_nodes(spark, sf_dir)).select("rank", "path", F.col("in").alias("fan_in"), F.col("out").alias("fan_out"))


def page_reference_graph(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "spec")
    )
    first = pages.groupBy("page_id", "spec").agg(F.min("pos").alias("pos"))
    return first.groupBy("spec").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.sum("pos").alias("positions")
    )


# --- resolution -------------------------------------------------------------------------


def _resolved_code(spark, sf_dir) -> DataFrame:
    def build():
        files = _spread(A.code_files(spark, sf_dir))
        sources = scan.keep_sources(files)
        return materialize(resolve.resolve_imports(extract.extract_imports(sources, scanned=True), sources, files))
    return kept("resolved", spark, sf_dir, build)


def resolve_generated_code(spark, sf_dir):
    return _resolved_code(spark, sf_dir).select("path", "spec", "statement", "start_line", "end_line", "res_kind", "res_value")


def resolution_by_language(spark, sf_dir):
    return graph.kinds_by_language(_resolved_code(spark, sf_dir)).drop("repo_id")


def resolution_ratio(spark, sf_dir):
    return graph.resolution_ratio(_resolved_code(spark, sf_dir)).drop("repo_id")


# --- traversal and focus -------------------------------------------------------------------


def _hub_ids(spark, sf_dir) -> DataFrame:
    return graph.hubs(_part_nodes(spark, sf_dir)).select("repo_id", "id", "rank")


def cone_dependencies(spark, sf_dir):
    roots = _hub_ids(spark, sf_dir).select("repo_id", F.col("id").alias("root"))
    return traverse.cone(_links(spark, sf_dir), roots).select("root", "id")


def cone_links(spark, sf_dir):
    """Links crossed from the first three hubs on, dangling ones left out; a root that is no node adds nothing."""
    hubs = _hub_ids(spark, sf_dir)
    nodes = _part_nodes(spark, sf_dir).filter("lines >= 100").select("repo_id", "id")
    roots = hubs.filter("rank <= 3").select("repo_id", F.col("id").alias("root"))
    missing = hubs.filter("rank = 1").select("repo_id", F.concat("id", F.lit("x")).alias("root"))
    reached = traverse.cone(_links(spark, sf_dir), roots.unionByName(missing), nodes=nodes)
    return traverse.cone_links(_links(spark, sf_dir), reached, nodes=nodes).select("root", "type", "from", "to")


def cone_dependents(spark, sf_dir):
    roots = _hub_ids(spark, sf_dir).select("repo_id", F.col("id").alias("root"))
    return traverse.cone(_links(spark, sf_dir), roots, "dependents").select("root", "id")


def shortest_path(spark, sf_dir):
    ids = _hub_ids(spark, sf_dir)
    pairs = ids.select("repo_id", F.col("id").alias("source"), (F.col("rank") + 1).alias("rank")).join(
        ids.select("repo_id", F.col("id").alias("target"), "rank"), ["repo_id", "rank"]
    )
    found = traverse.shortest_paths(_links(spark, sf_dir), pairs)
    return found.select("source", "target", F.array_join("path", ">").alias("path"))


def shortest_path_links(spark, sf_dir):
    ids = _hub_ids(spark, sf_dir)
    pairs = ids.select("repo_id", F.col("id").alias("source"), (F.col("rank") + 1).alias("rank")).join(
        ids.select("repo_id", F.col("id").alias("target"), "rank"), ["repo_id", "rank"]
    )
    links = _links(spark, sf_dir)
    found = traverse.path_links(links, traverse.shortest_paths(links, pairs))
    return found.select("source", "target", "position", "type", "from", "to")


def induced_subgraph(spark, sf_dir):
    chosen = _part_nodes(spark, sf_dir).filter("lines >= 400").select("repo_id", "id")
    return traverse.induced(_links(spark, sf_dir), chosen).select("from", "to")


def neighbour_context(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    rows = focus.neighbour_context(made.nodes, made.links)
    return rows.select("id", F.array_join("imports", ";").alias("imports"), F.array_join("imported_by", ";").alias("imported_by"))


def node_inspection(spark, sf_dir):
    return focus.inspect_nodes(_open_graph(spark, sf_dir).links).select("id", "outgoing", "incoming", "packet")


SEARCHES = ["small", "b7", "widget_1", "lib", "schema", "ring", ".tsx"]


def search_ranked(spark, sf_dir):
    return focus.search(_part_nodes(spark, sf_dir), SEARCHES).select("query", "rank", "score", "path", "matches")


def tour_chapters(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    return focus.tour(made.nodes, made.links, made.areas)[0].select("chapter", "nodes", "links")


# --- explanations and report -----------------------------------------------------------------


def node_explanations(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    nodes, _ = explain.explain(explain.explain_requests(made.nodes, made.links))
    return nodes.select("id", "summary")


def link_sentences(spark, sf_dir):
    made = _small_graph(spark, sf_dir)
    return explain.describe_links(made.links, made.nodes).select("type", "from", "to", "sentence")


def selection_texts(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    chosen = made.nodes.filter("kind <> 'dir'").withColumn(
        "set_id", F.when(F.col("kind") == "external", F.lit("dependencies")).otherwise(F.concat("area", F.lit(" "), "role"))
    )
    return explain.describe_sets(chosen, made.links).select("set_id", "text")


def ask_lines(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    questions = A.part_records(spark, sf_dir).select("repo_id", "path", F.element_at("symbols", 1).alias("fn"))
    return explain.ask_payload(made.nodes, made.links, questions).select("path", "fn", explain.ask_line().alias("line"))


def report_metrics(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    return report.metrics(made.stats, made.coverage).select("position", "metric", "value")


def report_links(spark, sf_dir):
    made = _small_graph(spark, sf_dir)
    return report.link_table(made.links, made.nodes).drop("repo_id")


def report_nodes(spark, sf_dir):
    return report.node_table(_open_graph(spark, sf_dir).nodes).drop("repo_id")


def node_contributions(spark, sf_dir):
    return _open_graph(spark, sf_dir).nodes.select("id", report.contribution().alias("contribution"))


def link_chips(spark, sf_dir):
    links = _small_graph(spark, sf_dir).links
    return links.groupBy("type", report.evidence_chip().alias("chip")).agg(F.count("*").alias("links"))


def scope_note(spark, sf_dir):
    made = _small_graph(spark, sf_dir)
    names = made.stats.select("repo_id", F.lit("demo").alias("name"))
    omitted = made.stats.select("repo_id", F.lit(1).alias("npm"), (F.col("packages") % 3).cast("int").alias("cargo"))
    return report.scope_notes(made, names, omitted).select("note")


def saved_graph_nodes(spark, sf_dir):
    """The graph saved to the shared folder and loaded again."""
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    tables.save_graph(_open_graph(spark, sf_dir), folder)
    return tables.load_graph(spark, folder).nodes.select("id", "label", "kind", "area", "role", "lines", "items", "in", "out")


def neighbour_lists(spark, sf_dir):
    return focus.shown_neighbours(_open_graph(spark, sf_dir).links, k=5).select("id", "side", "rank", "type", "other", "more")


def _part_texts(spark, sf_dir) -> DataFrame:
    """A text per part's file, some longer than a digest shows."""
    said = F.expr("repeat(p_name || ' ', p_size * 10)")
    return A.table(spark, sf_dir, "part").select(F.lit(A.REPO).alias("repo_id"), A.part_path().alias("path"), said.alias("text"))


def ask_payloads(spark, sf_dir):
    made = _open_graph(spark, sf_dir)
    questions = A.part_records(spark, sf_dir).select("repo_id", "path", F.element_at("symbols", 1).alias("fn"))
    rows = explain.ask_payload(made.nodes, made.links, questions, _part_texts(spark, sf_dir))
    return rows.select("path", "fn", F.array_join("samples", "; ").alias("samples"), F.sha2("source", 256).alias("source_sha256"))


def explanation_cache(spark, sf_dir):
    """Summaries from a cache (packages of even length), from an explainer (other packages, cleaned) and the offline ones."""
    made = _open_graph(spark, sf_dir)
    requests = materialize(explain.explain_requests(made.nodes, made.links, wanted=F.col("kind") != "file"))
    even = F.length("path") % 2 == 0
    cache = requests.filter((F.col("kind") == "external") & even).select(
        explain.cache_key("told", "v1").alias("cache_key"), F.concat(F.lit("Cached "), "path").alias("summary")
    )

    def teller(asked: DataFrame) -> DataFrame:
        said = F.concat(F.lit("```\n Supplied   for\n"), "path", F.lit("\n```"))
        return asked.filter("kind = 'external'").select("repo_id", "id", said.alias("summary"))

    told, fresh = explain.explain(requests, teller, "told", "v1", materialize(cache))
    known = requests.withColumn("cache_key", explain.cache_key("told", "v1")).join(fresh.select("cache_key"), "cache_key", "left_semi")
    return told.join(known.select("repo_id", "id", F.lit(True).alias("fresh")), ["repo_id", "id"], "left").select(
        "id", "summary", F.coalesce("fresh", F.lit(False)).alias("fresh")
    )


# --- traces ------------------------------------------------------------------------------------


def span_relations(spark, sf_dir):
    rows = _forest(spark, sf_dir).spans
    return rows.select("trace_id", "span_id", "relation", "derived_parent", F.col("depth").cast("bigint").alias("depth"))


def cycle_breaks(spark, sf_dir):
    return _forest(spark, sf_dir).spans.filter("relation = 'cycle-broken'").select("trace_id", "span_id")


def relation_lists(spark, sf_dir):
    return forest.relation_lists(_forest(spark, sf_dir).spans)


def trace_bounds(spark, sf_dir):
    return forest.trace_bounds(_spans(spark, sf_dir))


def hot_paths(spark, sf_dir):
    rows = forest.hot_paths(_forest(spark, sf_dir))
    return rows.select("trace_id", F.col("total_ns").cast("bigint").alias("total_ns"), F.array_join("path", ">").alias("path"))


def error_paths(spark, sf_dir):
    rows = forest.error_paths(_forest(spark, sf_dir))
    return rows.select("trace_id", "rank", "span_id", F.array_join("path", ">").alias("path"))


def error_ranks(spark, sf_dir):
    return forest.error_ranks(_forest(spark, sf_dir))


def call_tree(spark, sf_dir):
    rows = forest.call_tree(_forest(spark, sf_dir), numbered=_numbered(spark, sf_dir))
    return rows.select("trace_id", "forest", F.col("position").cast("bigint").alias("position"), "span_id", F.col("depth").cast("bigint").alias("depth"))


def subtree_sizes(spark, sf_dir):
    return _numbered(spark, sf_dir).select("trace_id", "span_id", "size")


def span_descendants(spark, sf_dir):
    """Everything below every root, in breadth-first order."""
    tops = _forest(spark, sf_dir).spans.filter("relation = 'root'")
    rows = forest.descendants(_numbered(spark, sf_dir), tops)
    order = Window.partitionBy("trace_id", "span_id").orderBy("depth", "position")
    return rows.select("trace_id", "span_id", "descendant", "depth", F.row_number().over(order).cast("bigint").alias("nth"))


def span_ancestors(spark, sf_dir):
    """What is above every failed span, the top span first."""
    tree = _forest(spark, sf_dir)
    return forest.ancestors(tree, tree.spans.filter("status_code = 2"))


def _display(spark, sf_dir) -> DataFrame:
    return views.display_rows(_spans(spark, sf_dir), F.col("service"))


def trace_summary(spark, sf_dir):
    return views.trace_summary(_display(spark, sf_dir))


def visible_spans(spark, sf_dir):
    rows = views.visible_spans(_display(spark, sf_dir), service="error", min_duration="50000000")
    return rows.select("trace_id", "span_id", "service", "status", "duration_label")


def service_lanes(spark, sf_dir):
    return views.service_lanes(_display(spark, sf_dir))


def span_ratios(spark, sf_dir):
    rows = views.time_ratios(_spans(spark, sf_dir), forest.trace_bounds(_spans(spark, sf_dir)))
    return rows.select("trace_id", "span_id", "start_offset", "start_ratio", "end_ratio")


def timeline_ticks(spark, sf_dir):
    rows = views.ticks(forest.trace_bounds(_spans(spark, sf_dir)))
    return rows.select("trace_id", F.col("offset_ns").cast("bigint").alias("offset_ns"), "label")


def first_visible_spans(spark, sf_dir):
    tree = _forest(spark, sf_dir)
    shown = views.visible_spans(_display(spark, sf_dir), min_duration="50000000")
    return views.first_visible(forest.hot_paths(tree), forest.error_paths(tree), shown)


def tree_visibility(spark, sf_dir):
    shown = views.visible_spans(_display(spark, sf_dir), errors_only=True)
    rows = views.mark_visible(forest.call_tree(_forest(spark, sf_dir), numbered=_numbered(spark, sf_dir)), shown)
    return rows.groupBy("trace_id").agg(F.count_if("visible").alias("shown"), F.count_if(~F.col("visible")).alias("hidden"))


def source_correlation(spark, sf_dir):
    nodes = A.part_records(spark, sf_dir).select("path", F.col("path").alias("id"), F.lit("file").alias("kind"))
    spans = A.recorded_sources(spark, sf_dir)
    rows = correlate.correlate(spans, nodes, source_root="/srv/app")
    return rows.select("event_id", "recorded_path", "function_name", "line_number", F.col("source.node_id").alias("node_id"))


def source_warnings(spark, sf_dir):
    nodes = A.part_records(spark, sf_dir).select("path", F.col("path").alias("id"), F.lit("file").alias("kind"))
    rows = correlate.correlate(A.recorded_sources(spark, sf_dir), nodes, source_root="/srv/app")
    made = correlate.correlation_report(rows)
    return made.select("unmatched_source_spans", F.array_join("deprecated_attributes", ",").alias("deprecated_attributes"))


def _otlp(spark, sf_dir) -> otlp.TraceImport:
    def build():
        made = otlp.import_traces(_spread(A.event_documents(spark, sf_dir)))
        return made._replace(spans=materialize(made.spans))
    return kept("otlp", spark, sf_dir, build)


def otlp_spans(spark, sf_dir):
    rows = _otlp(spark, sf_dir).spans
    attributes = F.array_join(F.transform("attributes", lambda a: F.concat(a["key"], F.lit("="), otlp.value_text(a["value"]))), ";")
    return rows.select(
        "trace_id", "span_id", "parent_span_id", "name", "kind", F.col("start_ns").cast("bigint").alias("start_ns"),
        F.col("duration_ns").cast("bigint").alias("duration_ns"), "sampled", "status_code", attributes.alias("attributes"),
        views.service_name().alias("service"), F.size("events").cast("bigint").alias("events"),
    )


def otlp_nested_values(spark, sf_dir):
    """Values nested up to eight levels, as JSON and as text; secrets are gone at every level."""
    made = otlp.import_traces(_spread(A.nested_documents(spark, sf_dir)))
    value = F.col("attribute.value")
    return made.spans.select("span_id", F.explode("attributes").alias("attribute")).select(
        "span_id", F.col("attribute.key").alias("key"), F.to_json(value).alias("value"), otlp.value_text(value).alias("text")
    )


def _linked(spark, sf_dir) -> otlp.TraceImport:
    def build():
        made = otlp.import_traces(_spread(A.linked_documents(spark, sf_dir)))
        return made._replace(spans=materialize(made.spans))
    return kept("linked", spark, sf_dir, build)


def _told(attributes) -> Column:
    return F.array_join(F.transform(attributes, lambda a: F.concat(a["key"], F.lit("="), otlp.value_text(a["value"]))), ";")


def span_event_rows(spark, sf_dir):
    rows = otlp.span_events(_linked(spark, sf_dir).spans)
    return rows.select(
        "trace_id", "span_id", "position", F.col("time_ns").cast("bigint").alias("time_ns"), "name",
        _told("attributes").alias("attributes"), F.col("dropped_attributes").cast("bigint").alias("dropped_attributes"),
    )


def span_link_rows(spark, sf_dir):
    """Span links with what they lead to: a span of the import, and one that passes the filter."""
    spans = _linked(spark, sf_dir).spans
    rows = views.link_targets(otlp.span_links(spans), spans, spans.filter("status_code = 2"))
    return rows.select(
        "trace_id", "span_id", "position", "linked_trace_id", "linked_span_id", "trace_state", "flags", _told("attributes").alias("attributes"),
        "local_target", "selectable",
    )


def otlp_limited(spark, sf_dir):
    """Rejects of an import with limits on events, links and traces."""
    limits = {"maxEventsPerSpan": 2, "maxLinksPerSpan": 1, "maxValueBytes": 12}
    made = otlp.import_traces(_spread(A.linked_documents(spark, sf_dir)), limits=limits)
    return made.rejects.groupBy("code").agg(F.count("*").alias("spans"))


def trace_sizes(spark, sf_dir):
    rows = _spans(spark, sf_dir).select("trace_id", "span_id", "name", "status_code", "start_ns")
    sizes = report.serialized_size(rows, "trace_id")
    over = report.over_limit(sizes, 6000).select("trace_id", F.lit(True).alias("over"))
    return sizes.join(over, "trace_id", "left").select("trace_id", "bytes", F.coalesce("over", F.lit(False)).alias("over"))


def otlp_file_spans(spark, sf_dir):
    """The same documents written to text files and read back by byte ranges."""
    folder = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    _spread(A.event_documents(spark, sf_dir)).select("text").write.text(folder)
    texts = otlp.read_otlp_texts(spark, folder, split_bytes=1 << 18, names=r"/part-[^/]*\.txt$")
    rows = otlp.import_traces(texts).spans
    return rows.select("trace_id", "span_id", "name", F.col("start_ns").cast("bigint").alias("start_ns"), views.service_name().alias("service"))


def otlp_rejects(spark, sf_dir):
    return _otlp(spark, sf_dir).rejects.groupBy("code").agg(F.count("*").alias("spans"))


def otlp_report(spark, sf_dir):
    made = _otlp(spark, sf_dir).report
    return made.select(*[F.col(c).cast("bigint").alias(c) for c in made.columns])


def otlp_unknown_fields(spark, sf_dir):
    return _otlp(spark, sf_dir).unknown_fields


def otlp_notices(spark, sf_dir):
    rows = report.completeness(_otlp(spark, sf_dir).report)
    return rows.select("notice", F.col("value").cast("bigint").alias("value"))


QUERIES = {
    **WORKSPACES,
    **{f.__name__: f
    for f in (
        scan_records, excerpt_first_lines, symbol_outline, statement_text, summary_text, report_cells, classify_roles,
        modal_role_by_directory, node_heights, rollup_plan, rolled_up_nodes, rolled_up_links, graph_nodes,
        containment_edges, area_counts, repository_stats, coverage_counters, edge_aggregate, edge_samples,
        edge_evidence, externals_topk, fan_in_out, dependency_hubs, page_reference_graph, resolve_generated_code,
        resolution_by_language, resolution_ratio, cone_dependencies, cone_dependents, cone_links, shortest_path, shortest_path_links,
        induced_subgraph, neighbour_context, node_inspection, search_ranked, tour_chapters, node_explanations,
        link_sentences, selection_texts, ask_lines, ask_payloads, explanation_cache, neighbour_lists, report_metrics, report_links, report_nodes, node_contributions,
        link_chips, scope_note, saved_graph_nodes, span_relations, cycle_breaks,
        relation_lists, trace_bounds, hot_paths, error_paths, error_ranks, call_tree, subtree_sizes, span_ancestors, span_descendants, trace_summary, visible_spans,
        service_lanes, span_ratios, timeline_ticks, first_visible_spans, tree_visibility, source_correlation,
        source_warnings, otlp_spans, otlp_file_spans, otlp_limited, otlp_nested_values, span_event_rows, span_link_rows, trace_sizes, otlp_rejects, otlp_report, otlp_unknown_fields, otlp_notices,
    )},
}
