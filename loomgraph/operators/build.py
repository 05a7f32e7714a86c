"""From files to graphs in one call, with every option passed to the step it is for."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from loomgraph.functions.vocabulary import MAX_NODES, ROLLUP_DEPTH
from loomgraph.operators.extract import extract_imports
from loomgraph.operators.graph import Graph, build_graph
from loomgraph.operators.report import scope_notes
from loomgraph.operators.resolve import resolve_imports
from loomgraph.operators.scan import keep_sources, scan
from loomgraph.session import materialize
from loomgraph.sources.manifests import repo_names


class Built(NamedTuple):
    graph: Graph
    facts: DataFrame
    notes: DataFrame  # (repo_id, note)


def build(
    files: DataFrame, exclude: Sequence[str] = (), max_chars: int | None = None, max_nodes: int = MAX_NODES,
    rollup_depth: int = ROLLUP_DEPTH, dense_areas: Sequence[str] = (), names: DataFrame | None = None, omitted: DataFrame | None = None,
) -> Built:
    """The graphs of all repositories in files(repo_id, path, text).

    Paths below `exclude` and files over `max_chars` are left out; `names(repo_id, name)` are those of the manifests unless
    given; `omitted(repo_id, npm, cargo)` are manifests a reader left out, for the notes.
    """
    sources = materialize(keep_sources(files, exclude, max_chars))
    records = materialize(scan(files, exclude, max_chars))
    facts = materialize(resolve_imports(extract_imports(sources, scanned=True), sources, files))
    graph = build_graph(records, facts, max_nodes, rollup_depth, dense_areas)
    return Built(graph, facts, scope_notes(graph, repo_names(files) if names is None else names, omitted))
