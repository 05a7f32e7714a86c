"""Text measures and clean-ups as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.vocabulary import EXPORT_LIST, OUTLINE_PATTERNS


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(F.length(text) == 0, F.lit(0)).otherwise(newlines + 1 - F.endswith(text, F.lit("\n")).cast("int"))
    ).cast("bigint")


def is_binary(text: Column) -> Column:
    return F.contains(text, F.lit("\0"))


# JavaScript white space, which also covers a few non-ASCII blanks
BLANK = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANK}]+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def excerpt(lines: Column, limit: int = 10) -> Column:
    """First non-blank lines, tabs widened, right-trimmed, at most 96 characters each."""
    shown = F.slice(F.filter(lines, lambda line: line.rlike(f"[^{BLANK}]")), 1, limit)
    return F.transform(shown, lambda line: ellipsis(trim_end(F.replace(line, F.lit("\t"), F.lit("  "))), 96))


def normalize_statement(statement: Column) -> Column:
    flat = F.regexp_replace(F.trim(F.regexp_replace(statement, r"\s+", " ")), ";+$", "")
    return ellipsis(flat, 88)


def outline(lines: Column, limit: int | None = None) -> Column:
    """Declared names in first-seen order, all or the first `limit`; NULL when there are none."""
    exported = lambda line: F.transform(
        F.split(F.regexp_extract(line, EXPORT_LIST, 1), ","),
        lambda part: strip(F.element_at(F.split(strip(part), r"\s+as\s+"), -1)),
    )
    declared = lambda line: F.array(
        F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")) for pattern in OUTLINE_PATTERNS])
    )
    # A cheap test first: only lines that can declare something reach the pattern chain.
    candidates = F.filter(
        lines, lambda line: line.rlike(r"(?i)^\s*(export|async|def|class|func|pub|create)[\s*{]")
    )
    names = F.transform(
        candidates,
        lambda line: F.when(
            F.regexp_extract(line, EXPORT_LIST, 1) != "",
            F.filter(exported(line), lambda name: name != "default"),
        ).otherwise(declared(line)),
    )
    distinct = F.array_distinct(F.filter(F.flatten(names), lambda name: name.isNotNull() & (name != "")))
    return F.when(F.size(distinct) > 0, distinct if limit is None else F.slice(distinct, 1, limit))


# Characters of a text that a digest shows.
DIGEST = 4000


def digest_part(text: Column, limit: int = DIGEST) -> Column:
    """All of a text that its digest depends on: one character more than it shows tells that there are more."""
    return F.substring(text, 1, limit + 1)


def source_digest(text: Column, symbols: Column, limit: int = DIGEST) -> Column:
    head = F.concat(F.substring(text, 1, limit), F.lit("\n… (truncated)"))
    declares = F.concat(head, F.lit("\n\n/* also declares: "), F.array_join(symbols, ", "), F.lit(" */"))
    return F.when(F.length(text) <= limit, text).when(F.size(symbols) > 0, declares).otherwise(head)


def report_cell(value: Column) -> Column:
    """Escape a value for a table cell of the report."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    swaps = [("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"),
             ("[", "\\["), ("]", "\\]"), ("(", "\\("), (")", "\\)")]
    escaped = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), swaps, text)
    return F.trim(F.regexp_replace(escaped, "[\\r\\n\\t]+", " "))


def clean_summary(text: Column, limit: int = 700) -> Column:
    """Drop code fences, collapse blanks and cut at a sentence end, else at a space."""
    unfenced = F.regexp_replace(F.trim(text), r"^```[\s\S]*?\n|\n```\z", "")
    flat = F.trim(F.regexp_replace(unfenced, r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    mirrored = F.reverse(cut)
    # 0-based last index of a two-character mark, -1 when absent
    last = lambda mark: F.when(
        F.instr(mirrored, mark[::-1]) == 0, F.lit(-1)
    ).otherwise(F.length(cut) - F.instr(mirrored, mark[::-1]) - len(mark) + 1)
    stop = F.greatest(last(". "), last("! "), last("? "))
    space = last(" ")
    at_space = F.when(space < 0, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(
        F.substring(cut, F.lit(1), space)
    )
    return (
        F.when(F.length(flat) <= limit, flat)
        .when(stop > limit * 0.5, F.substring(cut, F.lit(1), stop + 1))
        .otherwise(F.concat(at_space, F.lit("…")))
    )


def plural(n: Column, noun: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" " + noun), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def human_list(items: Column) -> Column:
    size = F.size(items)
    return (
        F.when(size == 0, F.lit(""))
        .when(size == 1, F.get(items, F.lit(0)))
        .otherwise(
            F.concat(
                F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "),
                F.lit(" and "),
                F.get(items, size - 1),
            )
        )
    )
