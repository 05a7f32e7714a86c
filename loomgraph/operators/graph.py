"""Nodes, links and their counters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.ranking import first_per_group
from loomgraph.functions.vocabulary import MAX_EXTERNALS, MAX_NODES, ROLLUP_DEPTH
from loomgraph.operators.classify import group_role
from loomgraph.operators.rollup import assign_groups, group_path, plan_areas, visible_id, with_roles
from loomgraph.session import SORTING, materialize, settings

SAMPLES = 6
EVIDENCE = 12
# Facts of an edge that travel before it is known whether more are needed.
REACH = 64
EDGE = ["repo_id", "type", "from", "to"]
LINK = EDGE + ["observations", "confidence", "samples", "evidence", "first_fact"]


class Graph(NamedTuple):
    nodes: DataFrame
    links: DataFrame
    areas: DataFrame
    stats: DataFrame
    coverage: DataFrame
    plan: DataFrame


# --- links ------------------------------------------------------------------------


def fact_order() -> Column:
    """Position of a fact: files by path, then line, then specifier."""
    return F.struct("path", "start_line", "end_line", "spec")


def aggregate_edges(facts: DataFrame) -> DataFrame:
    """(edge, observations, confidence): self edges vanish, one row per (type, from, to)."""
    exact = F.bool_and(F.col("confidence") == "exact")
    return (
        facts.filter(F.col("from") != F.col("to"))
        .groupBy(*EDGE)
        .agg(
            F.count("*").alias("observations"),
            F.when(exact, "exact").otherwise("heuristic").alias("confidence"),
            F.min(fact_order()).alias("first_fact"),
        )
    )


def edge_samples(facts: DataFrame, k: int = SAMPLES) -> DataFrame:
    """First k distinct statements per edge, in fact order."""
    distinct = (
        facts.filter(F.col("from") != F.col("to"))
        .groupBy(*EDGE, "statement")
        .agg(F.min(fact_order()).alias("_order"))
    )
    kept = first_per_group(distinct, EDGE, [F.col("_order")], k, "_n")
    ordered = F.array_sort(F.collect_list(F.struct("_n", "statement")))
    return kept.groupBy(*EDGE).agg(F.transform(ordered, lambda s: s["statement"]).alias("samples"))


def edge_evidence(facts: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """First k distinct source locations per edge, in fact order."""
    location = ["path", "start_line", "end_line", "spec"]
    distinct = (
        facts.filter(F.col("from") != F.col("to"))
        .groupBy(*EDGE, *location)
        .agg(F.min(F.struct("statement", "extractor", "confidence")).alias("_rest"))
    )
    kept = first_per_group(distinct, EDGE, [F.col(c) for c in location], k, "_n")
    item = F.struct(
        F.col("_n"),
        F.struct(
            "path", "start_line", "end_line", F.col("spec").alias("specifier"), F.col("_rest.statement"),
            F.col("_rest.extractor"), F.col("_rest.confidence"),
        ).alias("e"),
    )
    return kept.groupBy(*EDGE).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda i: i["e"]).alias("evidence")
    )


def links_of(facts: DataFrame, reach: int = REACH) -> DataFrame:
    """Links with bounded samples and evidence; `facts` carry type, from, to. Written once.

    One shuffle takes the first `reach` facts of every edge, cut on the map side. Most edges have fewer, and are done.
    Of the others all facts are counted, and only what the lists still lack is looked for, behind what they hold.
    """
    flows = facts.filter((F.col("from") != F.col("to")) & F.col("repo_id").isNotNull() & F.col("type").isNotNull())
    told = ["path", "start_line", "end_line", "spec", "statement", "extractor", "confidence"]
    # texts of few lengths come first in a row, so that rows are alike and pack well
    slim = flows.select("repo_id", "type", "extractor", "confidence", "start_line", "end_line", "from", "path", "to", "spec", "statement")
    first = first_per_group(slim, EDGE, [F.col(c) for c in told], reach, "_n")
    listed = (
        first.groupBy(*EDGE)
        .agg(
            F.count("*").alias("observations"), F.bool_and(F.col("confidence") == "exact").alias("exact"),
            F.array_sort(F.collect_list(F.struct("_n", *told))).alias("_facts"),
        )
        .select(
            *EDGE, "observations", _confidence(F.col("exact")).alias("confidence"),
            F.slice(F.array_distinct(F.transform("_facts", lambda f: f["statement"])), 1, SAMPLES).alias("samples"),
            _first_places(F.col("_facts")).alias("evidence"),
            _place(F.get("_facts", F.lit(0))).alias("first_fact"),
        )
    )
    with settings(facts.sparkSession, SORTING):
        heads = materialize(listed)
    crowded = F.col("observations") >= reach
    # written, so that its own size tells whether the facts must be shuffled to meet it
    cut = materialize(heads.filter(crowded).select(*EDGE, "samples", "evidence", "first_fact"))
    every = materialize(
        flows.join(cut.select(*EDGE), EDGE, "left_semi").groupBy(*EDGE)
        .agg(F.count("*").alias("observations"), F.bool_and(F.col("confidence") == "exact").alias("exact"))
        .select(*EDGE, "observations", _confidence(F.col("exact")).alias("confidence"))
    )
    few = cut.filter(F.size("samples") < SAMPLES).select(*EDGE, F.col("samples").alias("_samples"))
    unsaid = ~F.exists("_samples", lambda said: said.eqNullSafe(F.col("statement")))
    more_samples = edge_samples(flows.join(few, EDGE).filter(unsaid)).withColumnRenamed("samples", "_samples")
    short = cut.filter(F.size("evidence") < EVIDENCE).select(*EDGE, F.element_at("evidence", -1).alias("_last"))
    last = F.struct("_last.path", "_last.start_line", "_last.end_line", F.col("_last.specifier").alias("spec"))
    more_evidence = edge_evidence(flows.join(short, EDGE).filter(fact_order() > last)).withColumnRenamed("evidence", "_evidence")
    filled = materialize(
        cut.join(every, EDGE).join(more_samples, EDGE, "left").join(more_evidence, EDGE, "left")
        .withColumn("samples", F.slice(F.concat("samples", F.coalesce("_samples", F.array().cast("array<string>"))), 1, SAMPLES))
        .withColumn("evidence", F.slice(F.coalesce(F.concat("evidence", "_evidence"), F.col("evidence")), 1, EVIDENCE))
        .select(*LINK)
    )
    return heads.filter(~crowded).select(*LINK).unionByName(filled)


def _confidence(exact: Column) -> Column:
    return F.when(exact, "exact").otherwise("heuristic")


def _place(fact: Column) -> Column:
    return F.struct(*[fact[c].alias(c) for c in ("path", "start_line", "end_line", "spec")])


def _first_places(facts: Column, k: int = EVIDENCE) -> Column:
    """The first fact of each of the first k places of a sorted list."""
    fresh = F.filter(facts, lambda f, i: (i == 0) | ~_place(f).eqNullSafe(_place(F.get(facts, i - 1))))
    return F.transform(
        F.slice(fresh, 1, k),
        lambda f: F.struct(
            f["path"].alias("path"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"),
            f["spec"].alias("specifier"), f["statement"].alias("statement"), f["extractor"].alias("extractor"),
            f["confidence"].alias("confidence"),
        ),
    )


def degrees(links: DataFrame) -> DataFrame:
    """(repo_id, id, in, out): links, not facts; containment excluded."""
    ends = links.filter(F.col("type") != "containment").select(
        "repo_id",
        F.explode(
            F.array(
                F.struct(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    )
    return ends.groupBy("repo_id", "e.id").agg(F.sum("e.i").alias("in"), F.sum("e.o").alias("out"))


def containment(nodes: DataFrame) -> DataFrame:
    """(repo_id, from, to): the nearest visible ancestor directory holds each local node."""
    local = nodes.filter(F.col("kind") != "external").select("repo_id", "id", "path")
    folders = nodes.filter(F.col("kind") == "dir").select("repo_id", F.col("path").alias("up"), F.col("id").alias("from"))
    above = local.select("repo_id", F.col("id").alias("to"), F.posexplode(paths.ancestors(F.col("path"))).alias("far", "up"))
    return above.join(folders, ["repo_id", "up"]).groupBy("repo_id", "to").agg(F.min_by("from", "far").alias("from")).select(
        "repo_id", "from", "to"
    )


# --- externals ----------------------------------------------------------------------


def external_hits(resolved: DataFrame) -> DataFrame:
    """(repo_id, name, hits): facts per package."""
    return (
        resolved.filter(F.col("res_kind") == "external")
        .groupBy("repo_id", F.col("res_value").alias("name"))
        .agg(F.count("*").alias("hits"))
    )


def top_externals(hits: DataFrame, cap: int = MAX_EXTERNALS) -> DataFrame:
    return first_per_group(hits, ["repo_id"], [F.desc("hits"), F.col("name")], cap, "rank")


# --- nodes ------------------------------------------------------------------------------


def _blocks(parts: DataFrame, key: str) -> DataFrame:
    """Directory nodes from per-role partial sums."""
    roles = parts.groupBy("repo_id", key, "role").agg(
        F.sum("files").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")
    )
    best = F.min(F.struct((-F.col("files")).alias("rank"), F.col("role").alias("role")))
    return roles.groupBy("repo_id", F.col(key).alias("path")).agg(
        F.sum("files").alias("items"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), best.alias("_best")
    ).withColumn("role", group_role(F.col("_best.role"))).drop("_best")


def directory_nodes(grouped: DataFrame) -> DataFrame:
    """Fold targets, plus one block for every area."""
    parts = grouped.groupBy("repo_id", "area", "grp", "role").agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")
    )
    groups = _blocks(parts.filter(F.col("grp").isNotNull()), "grp")
    slabs = _blocks(parts, "area").join(groups.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    return groups.unionByName(slabs)


NODE = [
    "repo_id", "id", "label", "path", "kind", "area", "role", "contributes", "lines", "bytes",
    "excerpt", "symbols", "items",
]


def _file_nodes(grouped: DataFrame) -> DataFrame:
    return grouped.filter(F.col("grp").isNull()).select(
        "repo_id", F.col("path").alias("id"), F.col("name").alias("label"), "path", F.lit("file").alias("kind"), "area",
        "role", F.array("contributes").alias("contributes"), "lines", "bytes", "excerpt", "symbols",
        F.lit(None).cast("bigint").alias("items"),
    )


def _directory_rows(blocks: DataFrame) -> DataFrame:
    label = F.concat(F.col("items").cast("string"), F.lit(" files / "), F.col("lines").cast("string"), F.lit(" lines"))
    return blocks.select(
        "repo_id", F.concat(F.lit("dir:"), "path").alias("id"), paths.name_of(F.col("path")).alias("label"), "path",
        F.lit("dir").alias("kind"), F.substring_index("path", "/", 1).alias("area"), "role",
        F.array("role").alias("contributes"), "lines", "bytes",
        F.array(F.concat(F.lit("Area: "), "path"), label).alias("excerpt"),
        F.lit(None).cast("array<string>").alias("symbols"), "items",
    )


def _external_nodes(shown: DataFrame) -> DataFrame:
    return shown.select(
        "repo_id", F.concat(F.lit("ext:"), "name").alias("id"), F.col("name").alias("label"), F.col("name").alias("path"),
        F.lit("external").alias("kind"), F.lit("dependencies").alias("area"), F.lit("external dependency").alias("role"),
        F.array(F.lit("third-party code")).alias("contributes"), F.lit(0).cast("bigint").alias("lines"),
        F.lit(0).cast("bigint").alias("bytes"), F.array(F.concat(F.lit("Package: "), "name")).alias("excerpt"),
        F.lit(None).cast("array<string>").alias("symbols"), F.lit(None).cast("bigint").alias("items"),
    )


# --- the whole graph -----------------------------------------------------------------------


def visible_facts(resolved: DataFrame, plan: DataFrame, shown: DataFrame) -> DataFrame:
    """Facts with both ends mapped to visible nodes.

    A fact's group follows from its path and its area's decision, so both ends are looked
    up in the per-area plan instead of joining the file table twice.
    """
    spots = plan.select("repo_id", F.col("area").alias("_area"), "depth", "dense")

    def seen(facts: DataFrame, column: str, name: str) -> DataFrame:
        path = F.col(column)
        depth = F.size(F.split(path, "/")) - 1
        grp = group_path(path, depth, F.col("_area"), F.col("dense"), F.col("depth"))
        return (
            facts.withColumn("_area", paths.area_of(path))
            .join(spots, ["repo_id", "_area"])
            .withColumn(name, visible_id(path, grp))
            .drop("_area", "depth", "dense")
        )

    placed = seen(resolved.filter(F.col("res_kind").isin("internal", "external")), "path", "from")
    internal = seen(placed.filter(F.col("res_kind") == "internal"), "res_value", "to").withColumn("type", F.lit("import"))
    external = (
        placed.filter(F.col("res_kind") == "external")
        .join(shown.select("repo_id", F.col("name").alias("res_value")), ["repo_id", "res_value"], "left_semi")
        .withColumn("to", F.concat(F.lit("ext:"), "res_value"))
        .withColumn("type", F.lit("external"))
    )
    return internal.unionByName(external)


def coverage_counters(records: DataFrame, resolved: DataFrame) -> DataFrame:
    mode = lambda name: F.count_if(F.col("mode") == name)
    kind = lambda name: F.count_if(F.col("res_kind") == name)
    by_file = records.groupBy("repo_id").agg(
        mode("exact").alias("exact_files"), mode("heuristic").alias("heuristic_files"),
        mode("unsupported").alias("unsupported_files"), mode("failed").alias("failed_files"),
    )
    by_fact = resolved.groupBy("repo_id").agg(
        F.count("*").alias("import_facts"), kind("internal").alias("internal_facts"),
        kind("external").alias("external_facts"), kind("system").alias("system_facts"),
        kind("unresolved").alias("unresolved_facts"), kind("ignored").alias("ignored_facts"),
    )
    return by_file.join(by_fact, "repo_id", "left").na.fill(0)


def build_graph(
    records: DataFrame,
    resolved: DataFrame,
    max_nodes: int = MAX_NODES,
    rollup_depth: int = ROLLUP_DEPTH,
    dense_areas: Sequence[str] = (),
) -> Graph:
    """The visible graph of every repository at once.

    `resolved` is read several times; materialize it first when it comes from extraction.
    Tables that several outputs start from (roles, plan, nodes, mapped facts, links) are
    written once, so each output stays a short plan.
    """
    limit = max_nodes if max_nodes >= 1 else MAX_NODES
    files = materialize(with_roles(records))
    hits = materialize(external_hits(resolved))
    packages = hits.groupBy("repo_id").agg(F.count("*").alias("packages"))
    plan = materialize(plan_areas(files, packages, max_nodes, rollup_depth, dense_areas))
    grouped = assign_groups(files, plan)

    local = materialize(_file_nodes(grouped).unionByName(_directory_rows(directory_nodes(grouped))))
    local_count = local.groupBy("repo_id").agg(F.count("*").alias("local"))
    shown = materialize(
        top_externals(hits).join(local_count, "repo_id")
        .filter(F.col("rank") <= F.greatest(F.lit(limit) - F.col("local"), F.lit(0)))
        .drop("local")
    )
    base = local.unionByName(_external_nodes(shown))

    flows = links_of(visible_facts(resolved, plan, shown))
    held = materialize(containment(local)).select(
        "repo_id", F.lit("containment").alias("type"), "from", "to", F.lit(0).cast("bigint").alias("observations"),
        F.lit("exact").alias("confidence"), F.array().cast("array<string>").alias("samples"),
        F.lit(None).cast(flows.schema["evidence"].dataType).alias("evidence"),
        F.lit(None).cast(flows.schema["first_fact"].dataType).alias("first_fact"),
    )
    links = flows.unionByName(held)

    children = held.groupBy("repo_id", F.col("from").alias("id")).agg(F.count("*").alias("children"))
    nodes = (
        base.join(children, ["repo_id", "id"], "left")
        .join(degrees(flows), ["repo_id", "id"], "left")
        .select(
            *[c for c in NODE if c != "items"],
            F.when(F.col("kind") == "dir", F.coalesce("children", "items")).alias("items"),
            F.coalesce("in", F.lit(0)).alias("in"),
            F.coalesce("out", F.lit(0)).alias("out"),
        )
    )
    areas = base.groupBy("repo_id", F.col("area").alias("id")).agg(F.count("*").alias("count"))
    stats = (
        base.groupBy("repo_id").agg(F.count("*").alias("nodes"))
        .join(records.groupBy("repo_id").agg(F.count("*").alias("source_files"), F.sum("lines").alias("lines")), "repo_id")
        .join(flows.groupBy("repo_id").agg(F.count("*").alias("links")), "repo_id", "left")
        .join(packages, "repo_id", "left")
        .na.fill(0, ["links", "packages"])
    )
    rolled = grouped.groupBy("repo_id").agg(F.count("grp").alias("rolled_up_files"))
    shown_count = shown.groupBy("repo_id").agg(F.count("*").alias("_shown"))
    coverage = (
        coverage_counters(records, resolved).join(rolled, "repo_id", "left")
        .join(packages, "repo_id", "left").join(shown_count, "repo_id", "left")
        .na.fill(0)
        .withColumn("hidden_externals", F.col("packages") - F.col("_shown"))
        .drop("packages", "_shown")
    )
    return Graph(nodes, links, areas, stats, coverage, plan)


def resolution_ratio(resolved: DataFrame) -> DataFrame:
    """Share of repository-shaped facts that found their file; NULL when there are none."""
    internal = F.count_if(F.col("res_kind") == "internal")
    missed = F.count_if(F.col("res_kind") == "unresolved")
    return resolved.groupBy("repo_id").agg(
        internal.alias("internal"), missed.alias("unresolved"), F.try_divide(internal, internal + missed).alias("ratio")
    )


KINDS = ["internal", "external", "system", "unresolved", "ignored"]


def kinds_by_language(resolved: DataFrame) -> DataFrame:
    """Fact kinds per repository and file extension."""
    language = paths.extension_of(F.col("path"))
    return resolved.groupBy("repo_id", language.alias("language")).agg(
        *[F.count_if(F.col("res_kind") == kind).alias(kind) for kind in KINDS]
    )


def first_unresolved(resolved: DataFrame, k: int = 10) -> DataFrame:
    missed = resolved.filter(F.col("res_kind") == "unresolved")
    return first_per_group(missed, ["repo_id"], [F.col("path"), F.col("start_line"), F.col("spec")], k, "rank")


def hubs(nodes: DataFrame, k: int = 8) -> DataFrame:
    """Local nodes with the most links."""
    local = nodes.filter(F.col("kind") != "external").withColumn("degree", F.col("in") + F.col("out"))
    return first_per_group(local, ["repo_id"], [F.desc("degree"), F.col("path"), F.col("id")], k, "rank")
