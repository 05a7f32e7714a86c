"""Reachability and shortest paths over a link table, many questions per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.session import materialize


def flow_links(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Import and external links whose two ends exist."""
    flows = links.filter(F.col("type") != "containment").select("repo_id", "type", "from", "to")
    if nodes is None:
        return flows
    ids = nodes.select("repo_id", "id")
    return flows.join(ids.withColumnRenamed("id", "from"), ["repo_id", "from"], "left_semi").join(
        ids.withColumnRenamed("id", "to"), ["repo_id", "to"], "left_semi"
    )


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    written = materialize(df.observe(seen, F.count("*").alias("n")))
    return written, seen.get["n"]


WORD = 64


def cone(links: DataFrame, roots: DataFrame, direction: str = "dependencies", nodes: DataFrame | None = None) -> DataFrame:
    """(repo_id, root, id, distance): everything reachable from each root(repo_id, root).

    With `nodes`, roots that are no node have no cone and links with a missing end are not followed.

    All roots walk together. Roots are numbered and dealt into words of 64 bits; a row is a node with a word of the roots
    that newly reached it, so a node that thousands of roots reach is a few rows. Words are merged by `bit_or`. Only what
    is new in a round is joined again, so a node is expanded once per root and cycles end by themselves; pairs of a root
    and a node are made on output only.
    """
    near, far = ("from", "to") if direction == "dependencies" else ("to", "from")
    edges = flow_links(links, nodes).select("repo_id", F.col(near).alias("id"), F.col(far).alias("next")).distinct()
    edges = materialize(edges)
    if nodes is not None:
        roots = roots.join(nodes.select("repo_id", F.col("id").alias("root")), ["repo_id", "root"], "left_semi")
    numbered = materialize(roots.select("repo_id", "root").distinct().withColumn("_number", F.monotonically_increasing_id()))
    word, place = F.floor(F.col("_number") / WORD), (F.col("_number") % WORD).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    group = ["repo_id", "_word", "id"]
    start = numbered.select("repo_id", word.alias("_word"), F.col("root").alias("id"), bit.alias("bits"))
    rounds = [materialize(start.groupBy(*group).agg(F.bit_or("bits").alias("bits"), F.lit(0).alias("distance")))]
    step = 0
    while True:
        step += 1
        reached = rounds[-1].join(edges, ["repo_id", "id"]).select("repo_id", "_word", F.col("next").alias("id"), "bits")
        known = rounds[0]
        for part in rounds[1:]:
            known = known.unionByName(part)
        zero = F.lit(0).cast("bigint")
        both = reached.select(*group, "bits", zero.alias("had")).unionByName(known.select(*group, zero.alias("bits"), F.col("bits").alias("had")))
        merged = both.groupBy(*group).agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        new = merged.select(*group, F.col("bits").bitwiseAND(F.bitwise_not("had")).alias("bits")).filter(F.col("bits") != 0)
        fresh, found = _counted(new.withColumn("distance", F.lit(step)))
        if found == 0:
            break
        # keep the union short: older rounds fold into one table
        rounds = [materialize(known), fresh] if len(rounds) >= 16 else [*rounds, fresh]
    every = rounds[0]
    for part in rounds[1:]:
        every = every.unionByName(part)
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda at: F.call_function("getbit", F.col("bits"), at) == 1)
    pairs = every.select("repo_id", (F.col("_word") * WORD).alias("_first"), "id", "distance", F.explode(bits).alias("_bit"))
    return pairs.withColumn("_number", F.col("_first") + F.col("_bit")).join(numbered, ["repo_id", "_number"]).select(
        "repo_id", "root", "id", "distance"
    )


def cone_links(links: DataFrame, reached: DataFrame, direction: str = "dependencies", nodes: DataFrame | None = None) -> DataFrame:
    """Every link traversed while building a cone: all links that leave a reached node."""
    near = "from" if direction == "dependencies" else "to"
    return reached.select("repo_id", "root", F.col("id").alias(near)).join(
        flow_links(links, nodes), ["repo_id", near]
    ).select("repo_id", "root", "type", "from", "to")


def shortest_paths(links: DataFrame, pairs: DataFrame, sort_keys: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(repo_id, source, target, path) for each reachable pair of distinct nodes.

    Breadth-first with sorted neighbours finds the lexicographically smallest of the
    shortest paths, so each level keeps the smallest path per node. `sort_keys(repo_id, id,
    path)` gives the display path neighbours are sorted by; the id stands in without it. With
    `nodes`, both ends of a pair and of every link on the way must be nodes.
    """
    edges = flow_links(links, nodes).select("repo_id", F.col("from").alias("id"), F.col("to").alias("next")).distinct()
    if sort_keys is not None:
        names = sort_keys.select("repo_id", F.col("id").alias("next"), F.col("path").alias("key"))
        edges = edges.join(names, ["repo_id", "next"], "left")
    else:
        edges = edges.withColumn("key", F.col("next"))
    edges = materialize(edges.withColumn("key", F.coalesce("key", "next")))
    asked = materialize(pairs.filter(F.col("source") != F.col("target")).select("repo_id", "source", "target").distinct())
    hop = lambda key, node: F.struct(key.alias("key"), node.alias("id"))
    start = asked.select(
        "repo_id", "source", "target", F.col("source").alias("id"),
        F.array(hop(F.lit(""), F.col("source"))).alias("trail"),
    )
    pair = ["repo_id", "source", "target"]
    frontier = materialize(start)
    levels = [frontier.select(*pair, "id")]
    done = None
    while True:
        reached = (
            frontier.join(edges, ["repo_id", "id"])
            .select(*pair, F.col("next").alias("id"), F.array_append("trail", hop(F.col("key"), F.col("next"))).alias("trail"))
            .groupBy(*pair, "id").agg(F.min("trail").alias("trail"))
        )
        seen = levels[0]
        for part in levels[1:]:
            seen = seen.unionByName(part)
        level, found = _counted(reached.join(seen, [*pair, "id"], "left_anti"))
        arrived = level.filter(F.col("id") == F.col("target"))
        done = arrived if done is None else done.unionByName(arrived)
        if found == 0:
            break
        # pairs that arrived need no further level
        open_rows = level.join(arrived.select(*pair), pair, "left_anti")
        frontier = materialize(open_rows)
        # a level is written once; only a long list of levels is folded
        fresh = frontier.select(*pair, "id")
        levels = [materialize(seen), fresh] if len(levels) >= 16 else [*levels, fresh]
    return done.select(*pair, F.transform("trail", lambda h: h["id"]).alias("path"))


def path_links(links: DataFrame, found: DataFrame) -> DataFrame:
    """(repo_id, source, target, position, type, from, to): every link between neighbours of found(…, path)."""
    pair = ["repo_id", "source", "target"]
    steps = found.select(
        *pair, F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("from"), F.expr("slice(path, 2, size(path) - 1)").alias("to"))).alias("position", "step")
    )
    return (
        steps.select(*pair, (F.col("position") + 1).alias("position"), "step.from", "step.to")
        .join(flow_links(links), ["repo_id", "from", "to"])
        .select(*pair, "position", "type", "from", "to")
    )


def induced(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links with both ends in `chosen(repo_id, id)`."""
    return flow_links(links, chosen)
