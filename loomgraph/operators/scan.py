"""From raw files to file records: filters, path parts, measures, excerpt and symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths, text as texts
from loomgraph.functions.vocabulary import (
    IGNORED_DIRS,
    IGNORED_FILES,
    NESTED_CHECKOUT,
    SOURCE_EXTENSIONS,
)


def is_source(path: Column) -> Column:
    """The last dot of the whole path decides, so `a.b/c` has no source extension."""
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(SOURCE_EXTENSIONS)


def is_ignored(path: Column, exclude: Sequence[str] = ()) -> Column:
    segments = F.split(path, "/")
    file_name = paths.name_of(path)
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    ignored = (
        path.rlike(NESTED_CHECKOUT)
        | file_name.isin(IGNORED_FILES)
        | file_name.startswith(".env")
        | F.arrays_overlap(folders, F.array(*[F.lit(name) for name in IGNORED_DIRS]))
        | ~is_source(path)
    )
    for prefix in exclude:
        bare = prefix.rstrip("/")
        ignored = ignored | (path == bare) | path.startswith(bare + "/")
    return ignored


def keep_sources(files: DataFrame, exclude: Sequence[str] = (), max_chars: int | None = None) -> DataFrame:
    """Readable source files only; path filters run before any text is touched.

    `max_chars`, if given, leaves out longer files; `oversized` counts them.
    """
    path = F.col("path")
    return (
        files.withColumn("path", paths.clean_path(path))
        .filter((path != "") & ~is_ignored(path, exclude))
        .filter((F.lit(True) if max_chars is None else F.length("text") <= max_chars) & ~texts.is_binary(F.col("text")))
    )


def oversized(files: DataFrame, max_chars: int) -> DataFrame:
    """(repo_id, oversized): how many files `keep_sources(..., max_chars)` leaves out for their length."""
    return files.groupBy("repo_id").agg(F.count_if(F.length("text") > max_chars).alias("oversized"))


def scan(files: DataFrame, exclude: Sequence[str] = (), max_chars: int | None = None) -> DataFrame:
    """File records of `files(repo_id, path, text)`; the text itself is dropped here."""
    path, text, lines = F.col("path"), F.col("text"), F.col("_lines")
    return keep_sources(files, exclude, max_chars).withColumn("_lines", texts.lines_of(text)).select(
        "repo_id",
        "path",
        paths.dir_of(path).alias("dir"),
        paths.name_of(path).alias("name"),
        paths.extension_of(path).alias("ext"),
        paths.area_of(path).alias("area"),
        texts.line_count(text).alias("lines"),
        F.length(text).cast("bigint").alias("bytes"),
        texts.excerpt(lines).alias("excerpt"),
        texts.outline(lines).alias("symbols"),
        extraction_mode(path).alias("mode"),
        extractor_name(path).alias("extractor"),
        F.array().cast("array<string>").alias("diagnostics"),
    )


def _language(path: Column) -> Column:
    from loomgraph.functions.vocabulary import COMPONENT_EXTENSIONS, PYTHON_EXTENSIONS, SCRIPT_EXTENSIONS

    ext = F.lower(F.substring_index(path, ".", -1))
    return (
        F.when(ext.isin(SCRIPT_EXTENSIONS + COMPONENT_EXTENSIONS), "typescript")
        .when(ext.isin(PYTHON_EXTENSIONS), "python")
        .when(ext == "go", "go")
        .when(ext == "rs", "rust")
    )


def extractor_name(path: Column) -> Column:
    return F.concat(_language(path), F.lit("-line-scanner"))


def extraction_mode(path: Column) -> Column:
    return F.when(_language(path).isNull(), "unsupported").otherwise("heuristic")
