"""Spans to source files by exact path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import normalize_recorded
from loomgraph.functions.vocabulary import SOURCE_ATTRIBUTES
from loomgraph.operators.views import service_name

_ABSOLUTE = ["posix-absolute", "drive-absolute", "unc"]


def _attribute(name: str) -> Column:
    return F.get(F.filter("attributes", lambda a: a["key"] == name), F.lit(0))


def _preferred(field: str) -> tuple[Column, Column]:
    """(value, used_deprecated): a present stable key blocks the deprecated one, even when unusable."""
    stable, old = (_attribute(name) for name in SOURCE_ATTRIBUTES[field])
    if field == "line":
        number = lambda a: a["scalar"].try_cast("decimal(38,0)")
        usable = lambda a: F.when((a["type"] == "int") & (number(a) > 0) & (number(a) <= 2**53 - 1), a["scalar"])
    else:
        usable = lambda a: F.when(a["type"] == "string", a["scalar"])
    value = F.when(stable.isNotNull(), usable(stable)).otherwise(usable(old))
    return value, stable.isNull() & usable(old).isNotNull()


def source_fields(spans: DataFrame) -> DataFrame:
    """Add recorded_path, function_name, line_number and which deprecated keys were used."""
    names = {"path": "recorded_path", "function": "function_name", "line": "line_number"}
    for field, column in names.items():
        value, old = _preferred(field)
        spans = spans.withColumn(column, value).withColumn(f"deprecated_{field}", F.coalesce(old, F.lit(False)))
    return spans


def repository_path(recorded: Column, source_root: str | None) -> Column:
    """Repository-relative path of a recorded path; NULL when it cannot be one."""
    path = normalize_recorded(recorded)
    relative = F.when(
        (path["flavor"] == "relative") & ~path["escaped"] & (F.size(path["segments"]) > 0),
        F.array_join(path["segments"], "/"),
    )
    if source_root is None:
        return relative
    root = normalize_recorded(F.lit(source_root))
    depth = F.size(root["segments"])
    raw = path["raw"]
    inside = (
        path["flavor"].isin(_ABSOLUTE) & ~path["escaped"] & ~root["escaped"]
        & (path["flavor"] == root["flavor"]) & (path["prefix"] == root["prefix"])
        & (F.size(path["segments"]) >= depth) & (F.slice(path["segments"], F.lit(1), depth) == root["segments"])
        & (F.size(raw) >= depth) & (F.slice(raw, F.lit(1), depth) == root["segments"])
    )
    # the remainder must not climb above the root on its way
    rest = F.slice(raw, depth + 1, F.greatest(F.size(raw) - depth, F.lit(0)))
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped"))

    def step(state: Column, part: Column) -> Column:
        stack = state["stack"]
        climbs = (part == "..") & (F.size(stack) == 0)
        return F.struct(
            F.when(part != "..", F.array_append(stack, part))
            .when(F.size(stack) == 0, stack)
            .otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))
            .alias("stack"),
            (state["escaped"] | climbs).alias("escaped"),
        )

    walked = F.aggregate(rest, zero, step)
    joined = F.when(~walked["escaped"] & (F.size(walked["stack"]) > 0), F.array_join(walked["stack"], "/"))
    return F.coalesce(relative, F.when(inside, joined))


def with_repository(spans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Add repo_id by repositories(service, repo_id); spans of other services have none."""
    known = repositories.select(F.col("service").alias("_service"), "repo_id")
    return spans.withColumn("_service", service_name()).join(known, "_service", "left").drop("_service")


def correlate(spans: DataFrame, nodes: DataFrame, source_root: str | None = None) -> DataFrame:
    """Add `source`: the one visible file node at the recorded path, if there is exactly one.

    Spans with a `repo_id` (see `with_repository`) look in that repository only; without the column all nodes are one
    repository.
    """
    keys = ["repo_id", "_path"] if "repo_id" in spans.columns else ["_path"]
    files = (
        nodes.filter(F.col("kind") == "file").withColumnRenamed("path", "_path").groupBy(*keys)
        .agg(F.count("*").alias("owners"), F.min("id").alias("node_id"))
        .filter(F.col("owners") == 1).select(*keys, "node_id")
    )
    placed = source_fields(spans).withColumn("_path", repository_path(F.col("recorded_path"), source_root))
    match = F.struct(
        "node_id", F.col("_path").alias("path"), "recorded_path", "function_name", "line_number",
        F.lit("exact-file").alias("kind"),
    )
    return placed.join(files, keys, "left").withColumn("source", F.when(F.col("node_id").isNotNull(), match)).drop("_path", "node_id")


def correlation_report(correlated: DataFrame) -> DataFrame:
    """Unmatched recorded sources, and the deprecated attributes seen, in fixed order."""
    used = [
        F.when(F.bool_or(f"deprecated_{field}"), F.lit(names[1])) for field, names in SOURCE_ATTRIBUTES.items()
    ]
    return correlated.agg(
        F.count_if(F.col("recorded_path").isNotNull() & F.col("source").isNull()).alias("unmatched_source_spans"),
        F.filter(F.array(*used), lambda name: name.isNotNull()).alias("deprecated_attributes"),
    )
