"""Span forests: relations, cycle breaks, depths, hot paths, error paths, call trees.

Walking to the root is done by pointer doubling: every round joins each unfinished span
with the span its pointer reaches, so a 20,000-deep chain needs 15 rounds, not 20,000.

Trees are numbered by an Euler tour ranked the same way: a span's position in pre-order and
the size of its subtree make an interval that holds the positions of its descendants, so
orders and subtrees need no path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions.ranking import ranked
from loomgraph.session import materialize

KEY = ["trace_id", "span_id"]
SPAN_ORDER = ["start_ns", "end_ns", "span_id"]
# Positions that share a cell when intervals are joined with positions.
CELL = 64


class Forest(NamedTuple):
    """`spans` adds relation, derived_parent, depth, top_span_id and path_ns to the input.

    `levels[k]` maps a span to its 2^k-th ancestor.
    """

    spans: DataFrame
    levels: list[DataFrame]


class _Doubled(NamedTuple):
    state: DataFrame
    levels: list[DataFrame]
    circling: DataFrame | None


def _initial(links: DataFrame) -> DataFrame:
    """State of links(trace_id, span_id, parent, own_ns); a NULL parent ends the walk."""
    return links.select(
        *KEY, "parent", "own_ns",
        F.col("parent").alias("jump"),
        F.lit(1).cast("bigint").alias("steps"),
        F.col("own_ns").cast("decimal(38,0)").alias("total"),
        F.when(F.col("parent").isNull(), F.col("span_id")).alias("top"),
        F.col("parent").alias("far"),
    )


def _advance(open_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Let every pointer jump over the pointer it reaches."""
    a, b = open_rows.alias("a"), state.alias("b")
    return a.join(
        b, (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.jump") == F.col("b.span_id"))
    ).select(
        "a.trace_id", "a.span_id", "a.parent", "a.own_ns", "b.jump",
        (F.col("a.steps") + F.col("b.steps")).alias("steps"),
        (F.col("a.total") + F.col("b.total")).cast("decimal(38,0)").alias("total"),
        "b.top",
        F.greatest("a.far", "b.far").alias("far"),
    )


def _observed(state: DataFrame, pointer: str = "jump") -> tuple[DataFrame, int]:
    """Materialize and count open walks in the same job."""
    seen = Observation()
    is_open = F.count_if(F.col(pointer).isNotNull()).alias("open")
    written = materialize(state.observe(seen, is_open))
    return written, seen.get["open"]


def _parted(written: DataFrame, ended: DataFrame | None, pointer: str = "jump") -> tuple[DataFrame, DataFrame]:
    """Open walks, and all ended ones: a walk that has ended stays where the round that ended it was written."""
    over = written.filter(F.col(pointer).isNull())
    return written.filter(F.col(pointer).isNotNull()), over if ended is None else ended.unionByName(over)


def _double(links: DataFrame) -> _Doubled:
    """Double until every walk ends, or until the rest can only be going round in circles."""
    open_rows, ended = _parted(_initial(links), None)
    open_count = None
    levels: list[DataFrame] = []
    reach = 1
    while True:
        levels.append(open_rows.select(*KEY, "jump"))
        written, remaining = _observed(_advance(open_rows, open_rows.unionByName(ended)))
        open_rows, ended = _parted(written, ended)
        state = open_rows.unionByName(ended)
        reach *= 2
        if remaining == 0:
            return _Doubled(state, levels, None)
        # While a finite walk is open, some span at the next power-of-two depth ends its
        # walk in every round. No progress means that only cycles are left.
        if remaining == open_count:
            break
        open_count = remaining
    circling = open_rows
    largest = circling.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    while reach < 2 * largest:
        circling = materialize(_advance(circling, circling))
        reach *= 2
    return _Doubled(state, levels, circling)


def with_parent_flag(spans: DataFrame) -> DataFrame:
    """Add `parent_exists`: the recorded parent is a span of the same trace."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_found"))
    return (
        spans.join(ids, ["trace_id", "parent_span_id"], "left")
        .withColumn("parent_exists", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def build_forest(spans: DataFrame) -> Forest:
    """Relate every span to its trace; (trace_id, span_id) is unique in `spans`."""
    flagged = materialize(with_parent_flag(spans))
    links = flagged.select(
        *KEY, F.when(F.col("parent_exists"), F.col("parent_span_id")).alias("parent"),
        F.greatest(F.col("end_ns") - F.col("start_ns"), F.lit(0)).alias("own_ns"),
    )
    first = _double(links)
    state, levels = first.state, first.levels
    cut = F.lit(False)
    if first.circling is not None:
        # What is left lies in components that hold a cycle. A span that is the greatest
        # among its own ancestors is the one at which its cycle is cut.
        circling = first.circling
        is_cut = F.col("far") == F.col("span_id")
        relinked = circling.select(*KEY, F.when(~is_cut, F.col("parent")).alias("parent"), "own_ns")
        second = _double(relinked)
        cuts = materialize(circling.filter(is_cut).select(*KEY, F.lit(True).alias("_cut")))
        ids = circling.select(*KEY)
        settled = [level.join(ids, KEY, "left_anti") for level in levels]
        levels = []
        for k in range(max(len(settled), len(second.levels))):
            parts = [group[k] for group in (settled, second.levels) if k < len(group)]
            levels.append(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        state = state.filter(F.col("jump").isNull()).unionByName(second.state)
        state = state.join(cuts, KEY, "left")
        cut = F.coalesce("_cut", F.lit(False))
    derived = state.select(
        *KEY,
        F.col("parent").alias("derived_parent"), F.col("steps").alias("depth"),
        F.col("top").alias("top_span_id"), F.col("total").alias("path_ns"), cut.alias("_is_cut"),
    )
    relation = (
        F.when(F.col("parent_span_id").isNull(), "root")
        .when(F.col("_is_cut"), "cycle-broken")
        .when(~F.col("parent_exists"), "orphan")
        .otherwise("child")
    )
    related = (
        flagged.join(derived, KEY)
        .withColumn("relation", relation)
        .withColumn("derived_parent", F.when(F.col("relation") == "child", F.col("derived_parent")))
        .drop("_is_cut", "parent_exists")
    )
    spans = materialize(related)
    deepest = spans.agg(F.max("depth")).first()[0] or 1
    return Forest(spans, levels[: (deepest - 1).bit_length()])


def ancestor_rows(forest: Forest, targets: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor, up) for every target, itself included with up = 0.

    Offsets are built bit by bit, so each ancestor appears exactly once.
    """
    rows = targets.select(*KEY, F.col("span_id").alias("ancestor"), F.lit(0).cast("bigint").alias("up"))
    for k, level in enumerate(forest.levels):
        hop = level.select("trace_id", F.col("span_id").alias("ancestor"), "jump")
        stay = F.struct("ancestor", "up")
        move = F.struct(F.col("jump").alias("ancestor"), (F.col("up") + (1 << k)).alias("up"))
        both = F.when(F.col("jump").isNull(), F.array(stay)).otherwise(F.array(stay, move))
        rows = rows.join(hop, ["trace_id", "ancestor"], "left").select(*KEY, F.explode(both).alias("r")).select(*KEY, "r.*")
    return rows


def root_paths(forest: Forest, targets: DataFrame) -> DataFrame:
    """(trace_id, span_id, path): ids from the top span down to the target (as long as the trace is deep)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("pos"), F.col("ancestor").alias("id"))))
    return ancestor_rows(forest, targets).groupBy(*KEY).agg(F.transform(ordered, lambda s: s["id"]).alias("path"))


def leaves(spans: DataFrame) -> DataFrame:
    parents = spans.filter(F.col("derived_parent").isNotNull()).select(
        "trace_id", F.col("derived_parent").alias("span_id")
    )
    return spans.join(parents, KEY, "left_anti")


def hot_paths(forest: Forest) -> DataFrame:
    """(trace_id, total_ns, path): the root-to-leaf path with the greatest duration sum.

    Only true roots count. Ties: earlier root start, then the smaller id path.
    """
    spans = forest.spans
    roots = spans.filter(F.col("relation") == "root").select(
        "trace_id", F.col("span_id").alias("top_span_id"), F.col("start_ns").alias("root_start")
    )
    ends = leaves(spans).select(*KEY, "top_span_id", "path_ns").join(roots, ["trace_id", "top_span_id"])
    best = ends.groupBy("trace_id").agg(
        F.min(F.struct((-F.col("path_ns")).alias("neg"), F.col("root_start"))).alias("best")
    )
    tied = ends.join(best, "trace_id").filter(
        (-F.col("path_ns") == F.col("best.neg")) & (F.col("root_start") == F.col("best.root_start"))
    )
    paths = root_paths(forest, tied).groupBy("trace_id").agg(F.min("path").alias("path"))
    return best.select("trace_id", (-F.col("best.neg")).alias("total_ns")).join(paths, "trace_id")


def error_ranks(forest: Forest) -> DataFrame:
    """(trace_id, rank, span_id, depth): failed spans, earliest end first, then the deeper ancestry, then its ids.

    Ids of equally long ancestries compare as their spans do in a tour whose siblings go by id, so no path is built.
    """
    failed = forest.spans.filter(F.col("status_code") == 2).select(*KEY, "end_ns", "depth")
    by_id = tour(forest.spans.join(failed.select("trace_id").distinct(), "trace_id", "left_semi"), ["span_id"], [])
    placed = failed.join(by_id.select(*KEY, "position"), KEY)
    order = [F.col("end_ns"), F.desc("depth"), F.col("position")]
    return ranked(placed, ["trace_id"], order, "rank").select("trace_id", "rank", "span_id", "depth")


def error_paths(forest: Forest) -> DataFrame:
    """(trace_id, rank, span_id, path): the ancestry of every failed span, in the order of `error_ranks`.

    A path is as long as its span is deep; `error_ranks` with `ancestors` has the same as rows.
    """
    ranks = materialize(error_ranks(forest))
    return root_paths(forest, ranks).join(ranks, KEY).select("trace_id", "rank", "span_id", "path")


# --- tours and call trees -----------------------------------------------------------------


def tour(spans: DataFrame, order: list[str], kinds: list[str]) -> DataFrame:
    """(trace_id, *kinds, span_id, depth, position, size): an Euler tour of the trees of each (trace, kinds).

    `position` numbers the spans in pre-order from 1, siblings and tops by `order`; `size` is that of the subtree, so
    descendants are what stands at position + 1 to position + size - 1. The tour is a list of two entries per span, in
    and out; each round lets every entry's pointer jump over the pointer it reaches, so a list of n entries takes log n
    rounds, whatever the trees look like.
    """
    group = ["trace_id", *kinds]
    columns = list(dict.fromkeys([*group, "span_id", "depth", "derived_parent", *order]))
    named = spans.select(*columns).withColumn("_parent", F.coalesce("derived_parent", F.lit("")))
    placed = materialize(ranked(named, [*group, "_parent"], [F.col(c) for c in order], "_nth"))
    following = placed.select(*group, "_parent", (F.col("_nth") - 1).alias("_nth"), F.col("span_id").alias("_sibling"))
    first_child = placed.filter((F.col("_nth") == 1) & (F.col("_parent") != "")).select(
        "trace_id", F.col("_parent").alias("span_id"), F.col("span_id").alias("_child")
    )
    linked = placed.join(following, [*group, "_parent", "_nth"], "left").join(first_child, KEY, "left")
    entry = lambda out, after, after_out: F.struct(F.lit(out).alias("out"), after.alias("next"), after_out.alias("next_out"))
    child, sibling, parent = F.col("_child"), F.col("_sibling"), F.col("derived_parent")
    entries = F.array(
        entry(False, F.coalesce(child, F.col("span_id")), child.isNull()),
        entry(True, F.coalesce(sibling, parent), sibling.isNull()),
    )
    state = linked.select(*KEY, F.explode(entries).alias("e")).select(
        *KEY, "e.*", (~F.col("e.out")).cast("bigint").alias("ahead")
    )
    # `ahead` counts the ins from an entry up to the one it points to
    written, left = _observed(state, "next")
    moving, ended = _parted(written, None, "next")
    while left:
        reached = moving.unionByName(ended).select(
            "trace_id", F.col("span_id").alias("next"), F.col("out").alias("next_out"), F.col("next").alias("_next"),
            F.col("next_out").alias("_next_out"), F.col("ahead").alias("_ahead"),
        )
        written, left = _observed(moving.join(reached, ["trace_id", "next", "next_out"]).select(
            *KEY, "out", F.col("_next").alias("next"), F.col("_next_out").alias("next_out"),
            (F.col("ahead") + F.col("_ahead")).alias("ahead"),
        ), "next")
        moving, ended = _parted(written, ended, "next")
    state = moving.unionByName(ended)
    counts = state.groupBy(*KEY).agg(
        F.max(F.when(~F.col("out"), F.col("ahead"))).alias("_in"), F.max(F.when(F.col("out"), F.col("ahead"))).alias("_out")
    )
    sizes = placed.groupBy(*group).agg(F.count("*").alias("_all"))
    return placed.join(counts, KEY).join(sizes, group).select(
        *group, "span_id", "depth", (F.col("_all") - F.col("_in") + 1).alias("position"), (F.col("_in") - F.col("_out")).alias("size")
    )


def number_spans(forest: Forest, traces: DataFrame | None = None) -> DataFrame:
    """(trace_id, forest, span_id, depth, position, size): the call trees of each forest kind, see `tour`.

    `forest` is the relation of the top span: root, orphan or cycle-broken. Written once.
    """
    spans = forest.spans if traces is None else forest.spans.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")
    tops = forest.spans.filter(F.col("derived_parent").isNull()).select(
        "trace_id", F.col("span_id").alias("top_span_id"), F.col("relation").alias("forest")
    )
    return materialize(tour(spans.join(tops, ["trace_id", "top_span_id"]), SPAN_ORDER, ["forest"]))


_TREE = ["trace_id", "forest", "position", "span_id", "depth"]


def call_tree(forest: Forest, traces: DataFrame | None = None, numbered: DataFrame | None = None) -> DataFrame:
    """(trace_id, forest, position, span_id, depth): pre-order rows of each forest kind."""
    return (number_spans(forest, traces) if numbered is None else numbered).select(*_TREE)


def descendants(numbered: DataFrame, targets: DataFrame) -> DataFrame:
    """(trace_id, span_id, descendant, depth, position): everything below each target of `targets`, depth from 1.

    `numbered` is what `number_spans` gives. Breadth-first order is (depth, position). A target's interval is cut along
    cells of positions, so that the join is by equal cells and what it makes is what is asked for, but for the two cells
    at the interval's ends.
    """
    cell = lambda place: F.floor(place / CELL)
    last = F.col("position") + F.col("size") - 1
    asked = numbered.join(targets.select(*KEY).distinct(), KEY, "left_semi").filter(F.col("size") > 1).select(
        "trace_id", "forest", F.col("span_id"), F.col("depth").alias("_depth"), F.col("position").alias("_first"), last.alias("_last"),
        F.explode(F.sequence(cell(F.col("position") + 1), cell(last))).alias("_cell"),
    )
    placed = numbered.select(
        "trace_id", "forest", F.col("span_id").alias("descendant"), "depth", "position", cell(F.col("position")).alias("_cell")
    )
    inside = (F.col("position") > F.col("_first")) & (F.col("position") <= F.col("_last"))
    return asked.join(placed, ["trace_id", "forest", "_cell"]).filter(inside).select(
        *KEY, "descendant", (F.col("depth") - F.col("_depth")).alias("depth"), "position"
    )


def ancestors(forest: Forest, targets: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor, position): what is above each target, from the top span (position 1) down."""
    wanted = forest.spans.join(targets.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "depth")
    return ancestor_rows(forest, wanted).filter(F.col("up") > 0).join(wanted, KEY).select(
        *KEY, "ancestor", (F.col("depth") - F.col("up")).alias("position")
    )


# --- per-trace lists and summaries -------------------------------------------------------


def trace_bounds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("spans")
    )


def relation_lists(spans: DataFrame) -> DataFrame:
    """(trace_id, relation, position, span_id): root, orphan and cycle-break ids in span order."""
    tops = spans.filter(F.col("relation") != "child").select("trace_id", "relation", *SPAN_ORDER)
    return ranked(tops, ["trace_id", "relation"], [F.col(c) for c in SPAN_ORDER], "position").select(
        "trace_id", "relation", "position", "span_id"
    )
