"""Which files stay visible and which fold into a directory block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.vocabulary import DENSE_ROLES, DENSE_SHARE, MAX_EXTERNALS, MAX_NODES, ROLLUP_DEPTH
from loomgraph.operators.classify import role_of
from loomgraph.session import materialize


def with_roles(records: DataFrame) -> DataFrame:
    """Add role, contributes and dir_depth to file records."""
    role = role_of(F.col("path"), F.array_join("excerpt", "\n"))
    return (
        records.withColumn("_role", role)
        .withColumn("role", F.col("_role.label"))
        .withColumn("contributes", F.col("_role.contributes"))
        .withColumn("dir_depth", F.size(F.split("path", "/")) - 1)
        .drop("_role")
    )


def dense_shares(files: DataFrame) -> DataFrame:
    """(repo_id, area, share, files): the part of each area that is reference material."""
    return files.groupBy("repo_id", "area").agg(
        F.avg(F.col("role").isin(DENSE_ROLES).cast("double")).alias("share"), F.count("*").alias("files")
    )


def group_path(path: Column, dir_depth: Column, area: Column, dense: Column, depth: Column) -> Column:
    """Directory a file folds into, NULL when it stays visible."""
    return F.when(dense, F.when(dir_depth > 0, area)).when(
        dir_depth > depth, F.array_join(F.slice(F.split(path, "/"), F.lit(1), depth), "/")
    )


def _visible_by_depth(files: DataFrame, rollup_depth: int) -> DataFrame:
    """(repo_id, depth, visible) for every roll-up depth, in one pass over the directories."""
    # Loose files are rows, groups are distinct prefixes: shrink to directories first.
    folders = files.groupBy("repo_id", "area", "dense", "dir_depth", F.col("dir")).agg(F.count("*").alias("n"))
    per_depth = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(rollup_depth)))).withColumn(
        "grp", group_path(F.concat("dir", F.lit("/x")), F.col("dir_depth"), F.col("area"), F.col("dense"), F.col("depth"))
    )
    blocks = per_depth.groupBy("repo_id", "depth", "grp").agg(F.sum("n").alias("n"))
    count = F.sum(F.when(F.col("grp").isNull(), F.col("n")).otherwise(F.lit(1)))
    return blocks.groupBy("repo_id", "depth").agg(count.alias("visible"))


def plan_areas(
    files: DataFrame,
    externals: DataFrame,
    max_nodes: int = MAX_NODES,
    rollup_depth: int = ROLLUP_DEPTH,
    dense_areas: Sequence[str] = (),
) -> DataFrame:
    """(repo_id, area, depth, dense, share, files): the roll-up decision per area.

    `files` carries roles; `externals(repo_id, packages)` the distinct package count.
    Depth shrinks first; then whole areas fold in a fixed order until the graph fits.
    """
    limit = max_nodes if max_nodes >= 1 else MAX_NODES
    shares = dense_shares(files)
    forced = F.col("area").isin(list(dense_areas)) if dense_areas else F.lit(False)
    areas = materialize(shares.withColumn("dense", (F.col("share") >= DENSE_SHARE) | forced))
    tagged = files.select("repo_id", "area", "dir", "dir_depth").join(
        areas.select("repo_id", "area", "dense"), ["repo_id", "area"]
    )
    reserved = (
        areas.groupBy("repo_id").agg(F.count("*").alias("areas"))
        .join(externals, "repo_id", "left")
        .select("repo_id", "areas", (F.col("areas") + F.least(F.coalesce("packages", F.lit(0)), F.lit(MAX_EXTERNALS))).alias("reserved"))
    )
    total = F.col("visible") + F.col("reserved")
    chosen = materialize(
        _visible_by_depth(tagged, rollup_depth).join(reserved, "repo_id")
        .groupBy("repo_id", "areas", "reserved")
        .agg(
            F.max(F.when(total <= limit, F.col("depth"))).alias("fit"),
            F.min_by("visible", "depth").alias("visible_at_one"),
        )
    )

    # What folding an area saves once the depth is one.
    at_one = tagged.groupBy("repo_id", "area").agg(
        F.count_if(F.col("dir_depth") <= 1).alias("loose"),
        F.count_if(F.col("dir_depth") == 1).alias("loose_below"),
        F.max((F.col("dir_depth") > 1).cast("int")).alias("deep"),
    )
    below = F.col("loose_below") + F.col("deep")
    planned = (
        areas.join(at_one, ["repo_id", "area"])
        .join(chosen, "repo_id")
        .withColumn("eligible", F.col("fit").isNull() & ~F.col("dense") & (F.col("loose") > 1))
        .withColumn("saves", F.when(F.col("eligible") & (below > 0), below - 1).otherwise(F.lit(0)))
    )
    # More areas than the budget can never fit: all eligible areas fold, no order needed.
    # Otherwise a repository has at most `limit` areas, so the ordered sum is small.
    hopeless = F.col("reserved") > limit
    order = Window.partitionBy("repo_id").orderBy(
        F.desc("eligible"), F.desc(F.round("share", 9)), F.desc("loose"), "area"
    )
    ordered = (
        planned.filter(~hopeless & F.col("eligible"))
        .withColumn("saved_before", F.coalesce(F.sum("saves").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(
            "repo_id", "area",
            (F.col("visible_at_one") - F.col("saved_before") + F.col("reserved") > limit).alias("folds"),
        )
    )
    folded = F.col("eligible") & (hopeless | F.coalesce("folds", F.lit(False)))
    return planned.join(ordered, ["repo_id", "area"], "left").select(
        "repo_id", "area",
        F.coalesce("fit", F.lit(1)).alias("depth"),
        (F.col("dense") | folded).alias("dense"),
        "share", "files",
    )


def assign_groups(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Add `grp` (NULL for visible files) and `node_id`."""
    grouped = files.join(plan.select("repo_id", "area", "depth", "dense"), ["repo_id", "area"]).withColumn(
        "grp", group_path(F.col("path"), F.col("dir_depth"), F.col("area"), F.col("dense"), F.col("depth"))
    )
    return grouped.withColumn("node_id", visible_id(F.col("path"), F.col("grp"))).drop("depth", "dense")


def visible_id(path: Column, grp: Column) -> Column:
    return F.coalesce(F.concat(F.lit("dir:"), grp), path)
