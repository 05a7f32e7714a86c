"""Report tables and completeness notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import human_list
from loomgraph.operators.graph import Graph

METRICS = [
    ("Nodes", "nodes"), ("Source files", "source_files"), ("Lines", "lines"), ("Links", "links"), ("Packages", "packages"),
    ("Exact files", "exact_files"), ("Heuristic files", "heuristic_files"), ("Unsupported files", "unsupported_files"),
    ("Failed files", "failed_files"), ("Import facts", "import_facts"), ("Internal facts", "internal_facts"),
    ("External facts", "external_facts"), ("System facts", "system_facts"), ("Unresolved facts", "unresolved_facts"),
    ("Ignored facts", "ignored_facts"), ("Rolled-up files", "rolled_up_files"), ("Hidden externals", "hidden_externals"),
]


def metrics(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo_id, position, metric, value)."""
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("bigint").alias("value"))
          for i, (label, c) in enumerate(METRICS)]
    )
    return stats.join(coverage, "repo_id").select("repo_id", F.explode(rows).alias("m")).select("repo_id", "m.*")


def area_table(areas: DataFrame) -> DataFrame:
    return areas.orderBy("repo_id", F.col("id") == "dependencies", "id")


def node_table(nodes: DataFrame) -> DataFrame:
    return nodes.select("repo_id", "path", "id", "kind", "role", "area", "lines", "in", "out", "items").orderBy("repo_id", "path", "id")


def evidence_text(evidence: Column) -> Column:
    places = F.transform(
        F.array_sort(
            F.transform(evidence, lambda e: F.struct(e["path"], e["start_line"], e["end_line"], e["specifier"], e["extractor"]))
        ),
        lambda e: F.concat(e["path"], F.lit(":"), e["start_line"], F.lit("-"), e["end_line"]),
    )
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "none").otherwise(F.array_join(places, ", "))


def link_table(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dependency links with display paths, ordered by their printed fields."""
    end = lambda column, name: nodes.select("repo_id", F.col("id").alias(column), F.col("path").alias(name))
    shown = (
        links.filter(F.col("type") != "containment")
        .join(end("from", "_from"), ["repo_id", "from"], "left").join(end("to", "_to"), ["repo_id", "to"], "left")
        .select(
            "repo_id", F.coalesce("_from", "from").alias("from"), F.coalesce("_to", "to").alias("to"), "type",
            F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
            F.coalesce(F.col("observations").cast("string"), F.lit("unknown")).alias("observations"),
            evidence_text(F.col("evidence")).alias("evidence"),
        )
    )
    return shown.orderBy("repo_id", "from", "to", "type", "confidence", "observations", "evidence")


def scope_notes(graph: Graph, names: DataFrame, omitted: DataFrame | None = None) -> DataFrame:
    """(repo_id, note): what the visible slice leaves out."""
    dense = graph.plan.filter("dense")
    # only the first four areas are named, the rest is a number
    from loomgraph.functions.ranking import first_per_group

    listed = first_per_group(dense, ["repo_id"], [F.col("area")], 4, "_n").groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "area"))), lambda s: s["area"]).alias("shown")
    )
    totals = dense.groupBy("repo_id").agg(F.count("*").alias("rolled"))
    shown_packages = graph.nodes.filter(F.col("kind") == "external").groupBy("repo_id").agg(F.count("*").alias("shown_packages"))
    rows = (
        names.join(listed, "repo_id", "left").join(totals, "repo_id", "left")
        .join(shown_packages, "repo_id", "left").join(graph.stats.select("repo_id", "packages"), "repo_id", "left")
    )
    if omitted is not None:
        rows = rows.join(omitted, "repo_id", "left")
    else:
        rows = rows.withColumn("npm", F.lit(0)).withColumn("cargo", F.lit(0))
    rows = rows.na.fill(0)
    tail = F.when(F.col("rolled") > 4, F.array(F.concat((F.col("rolled") - 4).cast("string"), F.lit(" more")))).otherwise(
        F.array().cast("array<string>")
    )
    areas = F.when(
        F.col("rolled") > 0,
        F.concat(
            F.lit(" "), human_list(F.concat("shown", tail)), F.when(F.col("rolled") == 1, " is").otherwise(" are"),
            F.lit(" rolled into single blocks."),
        ),
    ).otherwise(F.lit(""))
    packages = F.when(
        F.col("packages") > F.col("shown_packages"),
        F.concat(F.lit(" "), F.col("shown_packages").cast("string"), F.lit(" of "), F.col("packages").cast("string"), F.lit(" packages shown.")),
    ).otherwise(F.lit(""))
    phrase = lambda n, one: F.when(
        F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(" " + one), F.when(F.col(n) == 1, "").otherwise("s"))
    )
    missing = F.concat_ws(" and ", phrase("npm", "workspace package"), phrase("cargo", "cargo crate"))
    left_out = F.when(missing != "", F.concat(F.lit(" "), missing, F.lit(" omitted."))).otherwise(F.lit(""))
    return rows.select(
        "repo_id",
        F.concat(
            F.lit("This is a focused source slice of "), "name", F.lit(", not the whole checkout. node_modules, build outputs, lockfiles, .env files, and nested worktrees are excluded."),
            areas, packages, left_out, F.lit(" Dots are import packets."),
        ).alias("note"),
    )


def contribution() -> Column:
    return (
        F.when(F.col("kind") == "external", F.concat(F.col("in").cast("string"), F.lit(" references in this slice")))
        .when(F.col("kind") == "dir", F.concat(F.coalesce("items", F.lit(0)).cast("string"), F.lit(" items / "), F.format_number("lines", 0), F.lit(" lines")))
        .otherwise(F.concat(F.format_number("lines", 0), F.lit(" lines / "), F.format_number("bytes", 0), F.lit(" bytes")))
    )


def evidence_chip() -> Column:
    return F.when(F.col("confidence") == "heuristic", "Heuristic").when(F.col("confidence") == "exact", "Exact").otherwise("Unknown")


def node_height() -> Column:
    scaled = F.round(F.least(F.lit(0.1) + F.log10(F.lit(1) + F.col("lines")) * 0.3, F.lit(1.4)), 3)
    return F.when(F.col("kind") == "external", F.lit(0.12)).otherwise(scaled)


NOTICES = [
    ("sampling", "sampled_spans"), ("sampling-unsampled", "unsampled_spans"), ("dropped-attributes", "dropped_attributes"),
    ("dropped-events", "dropped_events"), ("dropped-links", "dropped_links"), ("unknown-fields", "unknown_field_count"),
    ("duplicates", "duplicate_spans"), ("redactions", "redacted_attributes"), ("unmatched", "unmatched_source_spans"),
    ("orphans", "orphans"), ("cycles", "cycle_breaks"),
]


def completeness(report: DataFrame) -> DataFrame:
    """(position, notice, value): one row per non-zero counter the report carries."""
    present = [(i, n, c) for i, (n, c) in enumerate(NOTICES) if c in report.columns]
    rows = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(n).alias("notice"), F.col(c).cast("decimal(38,0)").alias("value")) for i, n, c in present]
    )
    return report.select(F.explode(rows).alias("n")).select("n.*").filter(F.col("value") > 0)


def serialized_size(rows: DataFrame, group: str) -> DataFrame:
    """Bytes of the rows as JSON text, per group."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    return rows.groupBy(group).agg(F.sum(size.cast("bigint")).alias("bytes"))


def over_limit(sizes: DataFrame, limit: int) -> DataFrame:
    return sizes.filter(F.col("bytes") > limit)
