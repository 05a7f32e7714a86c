"""Path arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("root")).otherwise(F.substring_index(path, "/", 1))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension_of(path: Column) -> Column:
    """Lower-cased extension of the file name; empty when it has none."""
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]*)$", 1))


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\.?/", ""), r"\\", "/")


def trim_slashes(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def walk_segments(start: Column, parts: Column) -> Column:
    """Apply `..` and plain segments to a stack: STRUCT<stack, escaped>."""
    zero = F.struct(start.cast("array<string>").alias("stack"), F.lit(False).alias("escaped"))

    def step(state: Column, part: Column) -> Column:
        stack = state["stack"]
        return (
            F.when(state["escaped"], state)
            .when(
                part == "..",
                F.when(F.size(stack) == 0, F.struct(stack.alias("stack"), F.lit(True).alias("escaped"))).otherwise(
                    F.struct(
                        F.slice(stack, F.lit(1), F.size(stack) - 1).alias("stack"), F.lit(False).alias("escaped")
                    )
                ),
            )
            .otherwise(F.struct(F.array_append(stack, part).alias("stack"), F.lit(False).alias("escaped")))
        )

    return F.aggregate(parts, zero, step)


def join_path(directory: Column, relative: Column) -> Column:
    """Directory plus relative path; NULL when `..` would leave the root."""
    start = F.filter(F.split(directory, "/"), lambda s: s != "")
    parts = F.filter(F.split(relative, "/"), lambda s: (s != "") & (s != "."))
    # Most relative specifiers hold no `..` past their head; those need no stack.
    plain = F.concat_ws("/", start, parts)
    state = walk_segments(start, parts)
    walked = F.when(~state["escaped"], F.array_join(state["stack"], "/"))
    return F.when(F.array_contains(parts, ".."), walked).otherwise(plain)


def ancestors(path: Column) -> Column:
    """Proper ancestor directories, nearest first (never the empty root)."""
    segments = F.split(path, "/")
    depth = F.size(segments) - 1
    return F.when(
        depth >= 1,
        F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def classify_flavor(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^(\\\\|//)"), "unc")
        .when(value.rlike(r"^[A-Za-z]:[\\/]"), "drive-absolute")
        .when(value.rlike(r"^[A-Za-z]:"), "drive-relative")
        .when(value.startswith("/"), "posix-absolute")
        .when(value.startswith("\\"), "rooted")
        .otherwise("relative")
    )


def normalize_recorded(value: Column) -> Column:
    """STRUCT<flavor, prefix, segments, raw, escaped> of a recorded path."""
    flavor = classify_flavor(value)
    slashed = F.regexp_replace(value, r"\\", "/")
    kept = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    drive = F.regexp_extract(slashed, "^([A-Za-z]:)/", 1)
    prefix = (
        F.when((flavor == "unc") & (F.size(kept) >= 2), F.concat(F.lit("//"), F.get(kept, F.lit(0)), F.lit("/"), F.get(kept, F.lit(1))))
        .when(flavor == "unc", F.lit(""))
        .when(drive != "", drive)
        .when(flavor == "posix-absolute", F.lit("/"))
        .otherwise(F.lit(""))
    )
    size = F.size(kept)
    raw = (
        F.when(flavor == "unc", F.slice(kept, F.lit(3), F.greatest(size - 2, F.lit(0))))
        .when(drive != "", F.slice(kept, F.lit(2), F.greatest(size - 1, F.lit(0))))
        .otherwise(kept)
    )
    # Unlike a join, a leading `..` marks the path as escaped but the walk goes on.
    zero = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped"))

    def step(state: Column, part: Column) -> Column:
        stack = state["stack"]
        empty = F.size(stack) == 0
        return F.struct(
            F.when(part != "..", F.array_append(stack, part))
            .when(empty, stack)
            .otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))
            .alias("stack"),
            (state["escaped"] | ((part == "..") & empty)).alias("escaped"),
        )

    state = F.aggregate(raw, zero, step)
    return F.struct(
        flavor.alias("flavor"),
        prefix.alias("prefix"),
        state["stack"].alias("segments"),
        raw.alias("raw"),
        state["escaped"].alias("escaped"),
    )
