"""License notices in texts: phrases at exact places and templates by an exact set-similarity join, in DataFrame functions only.

A text is read once: of its words only those that occur in some phrase or template are kept, with their places. All
later work is on that small written table.

Blocks are stretches of 2 * step words that begin at every multiple of `step`; `step` is the length of the longest
template, so each verbatim notice lies in a block. A block meets a template when it holds at least `percent` of the
template's distinct words. That join is exact: words are ordered by their number of occurrences in all documents, rare
ones first; if a block holds `need` words of a template, one of the template's first `size - need + 1` words is among
the block's first `len - need + 1` (prefix filter), the block has `need` words at least (length filter), and the places
of the shared word in both orders leave room for `need` (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that stand for a label wherever their words follow each other.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Notices as projects print them; their words are what is looked for.
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Licensed under the BSD License", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This work is licensed under the GNU Lesser General Public License", "lgpl"),
    ("This work is licensed under the GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution International License", "cc-by"),
    ("To the extent possible under law the author has waived all copyright and related rights", "cc0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("All rights reserved", "reserved"),
]

# Templates are handled in groups of at most so many distinct words: what a plan holds as literals stays bounded.
GROUP_WORDS = 2000


def _let(value: Column, body) -> Column:
    """`body` over a value computed once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def _spoken(text: str) -> list[str]:
    """The words of a template or phrase, as the column functions take them."""
    return re.findall(WORD, "".join(sign.lower() if "A" <= sign <= "Z" else sign for sign in text))


def known_words(docs: DataFrame, wanted: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, hits): of each text's words those in `wanted`, as (at, word) by place. Written once."""
    words = F.regexp_extract_all(folded(F.col(text_col)), F.lit(WORD), F.lit(0))
    hit = lambda word, at: F.when(word.isin(list(wanted)), F.struct(at.alias("at"), word.alias("word")))
    told = _let(words, lambda found: F.struct(
        F.size(found).cast("long").alias("n_words"),
        F.filter(F.transform(found, hit), lambda item: item.isNotNull()).alias("hits"),
    ))
    rows = docs.select(F.col(id_col).alias("doc_id"), told.alias("_told"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_told.n_words", "_told.hits"))


def phrase_places(hits: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """(at, label) of every place where the words of a phrase stand one after another."""
    def of(phrase: str, label: str) -> Column:
        first, *rest = _spoken(phrase)

        def stands(hit: Column, number: Column) -> Column:
            told = hit["word"] == first
            for step, word in enumerate(rest, 1):
                following = F.get(hits, number + step)
                told = told & (following["at"] == hit["at"] + step) & (following["word"] == word)
            return F.coalesce(told, F.lit(False))

        return F.transform(F.filter(hits, stands), lambda hit: F.struct(hit["at"].alias("at"), F.lit(label).alias("label")))

    return F.concat(*(of(phrase, label) for phrase, label in phrases))


def _groups(templates: Sequence[tuple[str, str]], limit: int) -> Iterator[list[tuple[str, set[str]]]]:
    group, held = [], set()
    for text, label in templates:
        words = set(_spoken(text))
        if not words:
            continue
        if group and len(held | words) > limit:
            yield group
            group, held = [], set()
        group.append((label, words))
        held |= words
    if group:
        yield group


def _need(size: int, percent: int) -> int:
    return max(1, -(-size * percent // 100))


def matching_blocks(read: DataFrame, group: Sequence[tuple[str, set[str]]], step: int, percent: int) -> DataFrame:
    """(row, block, label, share): every block of `read` (see `known_words`) that meets a template, once per template.

    Only blocks with a word of some template's prefix are looked at; the rest cannot meet any.
    """
    spark = read.sparkSession
    universe = sorted(set().union(*(words for _, words in group)))
    mine = F.filter("hits", lambda hit: hit["word"].isin(universe))
    # one row per known word; the order is total, so any order of equal counts does
    counted = read.select(F.explode(mine).alias("hit")).groupBy("hit.word").count().collect()
    counts = {row["word"]: row["count"] for row in counted}
    order = sorted(universe, key=lambda word: (counts.get(word, 0), word))
    rank = {word: place for place, word in enumerate(order)}
    entries, prefix = [], set()
    for number, (label, words) in enumerate(group):
        sorted_words = sorted(words, key=rank.__getitem__)
        need = _need(len(words), percent)
        for place, word in enumerate(sorted_words[: len(words) - need + 1]):
            entries.append((word, number, label, place, len(words), need, sorted_words))
            prefix.add(word)
    index = spark.createDataFrame(
        entries, "word string, template int, label string, place int, size int, need int, words array<string>"
    )
    starts = F.filter("hits", lambda hit: hit["word"].isin(sorted(prefix)))
    block_of = lambda hit: F.floor(hit["at"] / step).cast("int")
    blocks = F.array_distinct(F.flatten(F.transform(starts, lambda hit: F.array(block_of(hit), block_of(hit) - 1))))
    spread = read.select("row", "hits", F.explode(F.filter(blocks, lambda block: block >= 0)).alias("block"))
    inside = F.filter("hits", lambda hit: (hit["at"] >= F.col("block") * step) & (hit["at"] < (F.col("block") + 2) * step))
    # array_intersect keeps the order of its first side: the block's words in the global order
    held = F.array_intersect(F.array(*map(F.lit, order)), F.transform(inside, lambda hit: hit["word"]))
    sets = spread.select("row", "block", held.alias("held"))
    probes = sets.select("row", "block", "held", F.posexplode("held").alias("spot", "word"))
    length = F.size("held")
    room = F.least("place", "spot") + 1 + F.least(F.col("size") - F.col("place") - 1, length - F.col("spot") - 1)
    passed = probes.join(index, "word").filter(
        (length >= F.col("need")) & (F.col("spot") <= length - F.col("need")) & (room >= F.col("need"))
    )
    shared = F.array_intersect("held", "words")
    # the first shared word speaks for the pair, so that each pair is counted once
    counted_pairs = passed.withColumn("_shared", shared).filter(F.col("word") == F.get("_shared", F.lit(0)))
    met = counted_pairs.filter(F.size("_shared") >= F.col("need"))
    return met.select("row", "block", "label", (F.size("_shared") / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_words, places (at, label), blocks (first_word, label, share), score.

    `places` has every phrase place, by place; `blocks` every block that meets a template. The score is 1 where a phrase
    stands, else the greatest share of a template that a block meets, else 0. Null and empty texts have no words and score
    0; repeated rows and rows with equal or null ids are scanned each for itself; an empty table gives no rows; very long
    texts are read whole; other columns of the input are left behind, whatever their names. Ties do not arise.
    """
    spoken = [_spoken(text) for text, _ in [*phrases, *templates]]
    wanted = sorted(set().union(*spoken)) if spoken else []
    step = max([len(words) for words in spoken] or [1])
    read = known_words(docs, wanted, id_col, text_col)
    found = None
    for group in _groups(templates, GROUP_WORDS):
        met = matching_blocks(read, group, step, percent)
        found = met if found is None else found.unionByName(met)
    places = phrase_places(F.col("hits"), phrases) if phrases else F.array().cast("array<struct<at:int,label:string>>")
    base = read.select("row", "doc_id", "n_words", F.array_sort(places).alias("places"))
    if found is None:
        scanned = base.withColumn("blocks", F.lit(None).cast("array<struct<first_word:int,label:string,share:double>>"))
    else:
        # a document's matches are as many as its blocks; what is grouped is one text's own
        mine = F.struct((F.col("block") * step).alias("first_word"), "label", "share")
        grouped = found.groupBy("row").agg(F.array_sort(F.collect_set(mine)).alias("blocks"))
        scanned = base.join(grouped, "row", "left")
    blocks = F.coalesce("blocks", F.array().cast("array<struct<first_word:int,label:string,share:double>>"))
    best = F.coalesce(F.array_max(F.transform(blocks, lambda block: block["share"])), F.lit(0.0))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best)
    return scanned.select("doc_id", "n_words", "places", blocks.alias("blocks"), score.alias("score"))
