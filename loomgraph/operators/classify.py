"""Roles of files and of groups of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vocabulary import CONTENT_HINTS, DEFAULT_ROLE, ROLE_RULES


def _first_match(path: Column, position: int, fallback: str) -> Column:
    chain = None
    for rule in ROLE_RULES:
        condition = path.rlike(rule[0])
        chain = F.when(condition, rule[position]) if chain is None else chain.when(condition, rule[position])
    return chain.otherwise(fallback)


def role_of(path: Column, head: Column | None = None) -> Column:
    """STRUCT<label, contributes>: the first path rule that matches, sharpened by the file head."""
    by_path = F.struct(
        _first_match(path, 1, DEFAULT_ROLE[0]).alias("label"),
        _first_match(path, 2, DEFAULT_ROLE[1]).alias("contributes"),
    )
    if head is None:
        return by_path
    firm = "|".join(f"(?:{rule[0]})" for rule in ROLE_RULES if rule[1] != "ui component")
    generic = ~path.rlike(firm)
    hinted = None
    for pattern, label, contributes in CONTENT_HINTS:
        verdict = F.struct(F.lit(label).alias("label"), F.lit(contributes).alias("contributes"))
        condition = head.rlike(pattern) & generic
        hinted = F.when(condition, verdict) if hinted is None else hinted.when(condition, verdict)
    return hinted.otherwise(by_path)


def group_role(role: Column) -> Column:
    return (
        F.when(role.isNull(), "group")
        .when(role.isin("screen / route", "api endpoint"), "route surface")
        .otherwise(role)
    )


def modal_role(members: DataFrame, group: Sequence[str], role: str = "role", weight: str | None = None) -> DataFrame:
    """Most frequent role per group; ties go to the smaller name."""
    size = F.sum(weight) if weight else F.count("*")
    counted = members.groupBy(*group, role).agg(size.alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(role).alias("role")))
    return counted.groupBy(*group).agg(best.alias("_best")).select(*group, group_role(F.col("_best.role")).alias("role"))
