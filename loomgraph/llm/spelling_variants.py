"""Spelling variants: words one edit apart, by dynamic programming over sorted lists that reuses rows and skips ranges.

The vocabulary is sorted twice, as it is and by its reversed words. Two words one edit apart share their first or their
last half: pairs that share the first `min length // 2` code points are found in the list as it is, all others in the
reversed one, so each pair is found from one list only.

A word looks through the stretch of the list that shares its half. The matrix of edits between it and a listed word has a
band of three cells per row, since more than one edit does not count. Neighbours in the list share a prefix (their LCP),
so the rows of that prefix stand already; and once a row has no cell under two, no word with that prefix can be near:
the scan goes on at the next word whose LCP is shorter. All words of a task scan in step, one row each at a time, in numpy.

A list is cut into slices of some thousand neighbours; a word goes to the slices that its half can lie in and whose common
prefix is still within one edit of it. So a half shared by a third of the vocabulary is many tasks, not one.
Per word only sums and the best neighbour leave a slice; no pair does.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SHORT, by_place, column, equal_ranges, joined_text, longest_first, prepare
from loomgraph.session import materialize

SLICE_WORDS = 4096
# words that scan in step; bounds the memory of a task
STEP_WORDS = 4096
_LOWER = np.array([code + 32 if 65 <= code <= 90 else code for code in range(256)], np.uint8)
_LETTER = np.array([97 <= code <= 122 for code in range(256)], bool)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


# --- words and their numbers ---------------------------------------------------------


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of a-z and U+00C0 to U+00FF, which in UTF-8 are 0xC3 and the byte after it.

    `offsets` are where the joined texts begin and end; no run goes over them."""
    lead = raw == 0xC3
    member = _LETTER[raw] | lead
    member[1:] |= lead[:-1]
    begins, ends = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    begins[offsets] = ends[offsets] = True  # a text begins and ends
    begins[1:-1] |= ~member[:-1]
    ends[:-1] |= ~member
    begins[:-1] &= member
    begins[-1] = False
    ends[1:] &= member
    ends[0] = False
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _crcs(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """crc32 of what stands in each range, going on from the given sums."""
    made, sizes = states.copy(), ends - begins
    for at in np.flatnonzero(sizes > SHORT).tolist():
        made[at] = zlib.crc32(raw[begins[at]: ends[at]].tobytes(), int(states[at]))
    short = np.flatnonzero(sizes <= SHORT)
    order = short[longest_first(sizes[short])]
    crc = ~states[order]

    def step(live: int, signs: np.ndarray) -> None:
        mine = crc[:live]
        crc[:live] = _CRC[(mine ^ signs) & np.uint32(255)] ^ (mine >> np.uint32(8))

    by_place(raw, begins[order], sizes[order], step)
    made[order] = ~crc
    return made


def _grouped(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[int]]:
    """Distinct words among the ranges, and how often each occurs."""
    first, group = equal_ranges(raw, begins, ends - begins)
    whole = raw.tobytes()
    words = [whole[begin:end].decode() for begin, end in zip(begins[first].tolist(), ends[first].tolist())]
    return words, np.bincount(group, minlength=len(first)).tolist()


def _counted(raw: np.ndarray, offsets: np.ndarray, ids: list[int | None], thinned: int | None, min_length: int) -> tuple[list[str], list[int]]:
    """The words of some texts (joined, lower-cased) and how often each occurs; a word may come twice."""
    begins, ends = _runs(raw, offsets)
    points = np.concatenate([[0], np.cumsum(raw == 0xC3)])
    length = (ends - begins) - (points[ends] - points[begins])
    keep = length >= min_length  # a run that loses a code point does not grow
    begins, ends, length = begins[keep], ends[keep], length[keep]
    changed: dict[str, int] = {}
    if thinned and len(begins):
        owner = np.searchsorted(offsets, begins, "right") - 1
        starts = np.array([zlib.crc32(f"{'' if number is None else number}:".encode()) for number in ids], np.uint32)
        crc = _crcs(raw, begins, ends, starts[owner])
        hit = crc % np.uint32(thinned) == 0
        for begin, end, value, size in zip(begins[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), length[hit].tolist()):
            if size > min_length:
                word = raw[begin:end].tobytes().decode()
                gone = value % size
                word = word[:gone] + word[gone + 1:]
                changed[word] = changed.get(word, 0) + 1
        begins, ends = begins[~hit], ends[~hit]
    words, counts = _grouped(raw, begins, ends)
    return words + list(changed), counts + list(changed.values())


def count_words(docs: DataFrame, thinned: int | None = None, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of `min_length` code points at least
    that occur `min_count` times at least, over all whole texts. Written once.

    With `thinned`, a run loses the code point h % length where `thinned` divides h, the crc32 of `<id>:<run>`; a null
    id is empty there. Null and empty texts have no words, repeated rows count each, an empty table gives no words.
    Memory follows slices of about a megabyte, or one text if that is longer.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * (1 << 20) // max(1, batch.nbytes))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                raw, offsets = joined_text(part)
                words, counts = _counted(_LOWER[raw], offsets, column(part, "id").to_pylist(), thinned, min_length)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= min_count))


# --- the sorted list -----------------------------------------------------------------


def _half(length: int) -> int:
    """Code points that a word surely shares with any word one edit away, at its beginning or its end."""
    return max(0, length - 1) // 2


def _common(one: str, two: str) -> int:
    return len(os.path.commonprefix([one, two]))


def _within_one(prefix: str, word: str) -> bool:
    """Whether some word that begins with `prefix` can be within one edit of `word`: the banded rows of `prefix`."""
    row = [2, 0, 1]
    for depth, sign in enumerate(prefix):
        fresh = [2, 2, 2]
        for cell in range(3):
            at = depth + cell  # as many code points of `word`
            if at > len(word):
                continue
            best = row[cell] + (word[at - 1] != sign) if at else 2
            best = min(best, (row[cell + 1] if cell < 2 else 2) + 1, (fresh[cell - 1] if cell else 2) + 1)
            fresh[cell] = min(2, best)
        row = fresh
        if min(row) > 1:
            return False
    return True


class SortedList:
    """Sorted words with what a scan needs: code points, LCPs of neighbours, and where ranges of a prefix end."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(word) for word in words], np.int32)
        self.signs = _padded(words, int(self.lengths.max()) if words else 0)
        differs = self.signs[1:] != self.signs[:-1]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), self.signs.shape[1]) if len(words) > 1 else np.zeros(0, np.int64)
        self.lcp = np.concatenate([[0], np.minimum(shared, np.minimum(self.lengths[1:], self.lengths[:-1]))]).astype(np.int32)
        # over[d][i]: the first word after i that does not share d code points with it
        depth, size = self.signs.shape[1], len(words)
        self.over = np.full((depth + 1, size), size, np.int32)
        for d in range(1, depth + 1):
            starts = np.flatnonzero(np.concatenate([self.lcp < d, [True]]))
            self.over[d] = starts[np.searchsorted(starts, np.arange(size), "right")]

    def scan(self, queries: list[str], first: np.ndarray, last: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of every listed word one edit away from a query within [first, last), where all words share
        the query's first `shared` code points."""
        sizes = np.array([len(word) for word in queries], np.int32)
        depth = self.signs.shape[1]
        signs = _padded(queries, depth + 2, fill=-2)  # past its end a query matches nothing
        rows = np.empty((len(queries), depth + 1, 3), np.int8)
        rows[:] = [1, 0, 1]  # of an equal prefix
        rows[:, 0, 0] = 2
        live = np.flatnonzero(first < last)
        at, row_of = first.astype(np.int64).copy(), shared.astype(np.int64).copy()
        found_query, found_place = [], []
        limit = last.astype(np.int64)
        while len(live):
            i, d = at[live], row_of[live]
            done = d == self.lengths[i]
            ended = live[done]
            if len(ended):
                i_end, d_end = i[done], d[done]
                cell = sizes[ended] - d_end + 1
                inside = (cell >= 0) & (cell <= 2)
                one = np.zeros(len(ended), bool)
                one[inside] = rows[ended[inside], d_end[inside], cell[inside]] == 1
                found_query.append(ended[one])
                found_place.append(i_end[one])
                at[ended] = i_end + 1
            going = live[~done]
            if len(going):
                i_go, d_go = i[~done], d[~done]
                sign = self.signs[i_go, d_go]
                old = rows[going, d_go]
                new = np.full_like(old, 2)
                size = sizes[going]
                for cell in range(3):
                    of = d_go + cell  # code points of the query
                    best = old[:, cell] + (signs[going, np.maximum(of - 1, 0)] != sign)
                    best[of == 0] = 2
                    if cell < 2:
                        best = np.minimum(best, old[:, cell + 1] + 1)
                    if cell:
                        best = np.minimum(best, new[:, cell - 1] + 1)
                    new[:, cell] = np.where(of > size, 2, np.minimum(best, 2))
                rows[going, d_go + 1] = new
                dead = new.min(axis=1) > 1
                row_of[going] = d_go + 1
                skip = going[dead]
                at[skip] = self.over[d_go[dead] + 1, i_go[dead]]
            moved = np.concatenate([ended, going[dead]]) if len(going) else ended
            if len(moved):
                here = at[moved]
                inside = here < limit[moved]
                row_of[moved[inside]] = np.minimum(row_of[moved[inside]], self.lcp[here[inside]])
                live = live[at[live] < limit[live]]
        if not found_query:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_query), np.concatenate(found_place)


def _padded(words: list[str], width: int, fill: int = -1) -> np.ndarray:
    """Code points of the words, a row each, at least `width` wide."""
    width = max([width, *map(len, words)])
    signs = np.full((len(words), width), fill, np.int32)
    lengths = np.array([len(word) for word in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    signs[np.repeat(np.arange(len(words)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return signs


_TOP = "\U0010ffff"


class _Lists:
    """The list of a slice, as a sorted list for each class of lengths: short words together, longer ones by powers of two,
    so that memory follows the characters. A word stands in the lists of all lengths one edit away."""

    def __init__(self, words: list[str], counts: list[int]):
        members: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for kind in {self.kind(len(word) + more) for more in (-1, 0, 1)}:
                members.setdefault(kind, []).append(at)
        self.lists = {kind: (SortedList([words[at] for at in places]), [counts[at] for at in places]) for kind, places in members.items()}

    @staticmethod
    def kind(length: int) -> int:
        return max(6, length.bit_length())

    def near(self, asking: list[str], reverse: bool) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words found, greatest n of them, least such word) of those asking that have any."""
        parted: dict[int, list[str]] = {}
        for word in asking:
            parted.setdefault(self.kind(len(word)), []).append(word)
        for kind, queries in parted.items():
            if kind in self.lists:
                listed, counts = self.lists[kind]
                step = max(1, STEP_WORDS * 64 // (1 << kind))
                for begin in range(0, len(queries), step):
                    yield from _near(listed, counts, queries[begin: begin + step], reverse)


def _near(listed: SortedList, counts: list[int], queries: list[str], reverse: bool) -> Iterator[tuple[str, int, int, str]]:
    """In the list as it is a pair counts if it shares its first half, in the reversed list if it does not."""
    halves = [_half(len(word)) for word in queries]
    first = np.array([bisect.bisect_left(listed.words, word[:half]) for word, half in zip(queries, halves)], np.int64)
    last = np.array([bisect.bisect_left(listed.words, word[:half] + _TOP) for word, half in zip(queries, halves)], np.int64)
    best: dict[str, list] = {}
    for query, place in zip(*(part.tolist() for part in listed.scan(queries, first, last, np.array(halves)))):
        word, other = queries[query], listed.words[place]
        if reverse:
            word, other = word[::-1], other[::-1]
        half = min(len(word), len(other)) // 2
        if (word[:half] == other[:half]) != reverse:
            entry = best.setdefault(word, [0, 0, ""])
            if entry[0] == 0 or (-counts[place], other) < (-entry[1], entry[2]):
                entry[1:] = counts[place], other
            entry[0] += 1
    for word, (found, n, other) in best.items():
        yield word, found, n, other


class _Cut(NamedTuple):
    """Where slices of a sorted list begin and end; a few words per slice."""

    slices: list[int]
    firsts: list[str]
    lasts: list[str]

    def wanted(self, word: str) -> list[int]:
        """The slices in which a word one edit away, with the same first half, can lie."""
        half = word[: _half(len(word))]
        low, high = bisect.bisect_left(self.lasts, half), bisect.bisect_left(self.firsts, half + _TOP)
        return [
            self.slices[at] for at in range(low, high)
            if high - low == 1 or _within_one(self.firsts[at][: _common(self.firsts[at], self.lasts[at])], word)
        ]


def near_words(words: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): of each word of words(word, n) that has any, its near words' number, the greatest n
    among them and the least such word. Words are distinct and not null."""
    spark = prepare(words.sparkSession)
    total = words.count()
    parts = max(1, -(-total // slice_words))
    sides, cuts = [], []
    for reverse in (False, True):
        key = F.reverse("word") if reverse else F.col("word")
        listed = words.select(key.alias("word"), "n").repartitionByRange(parts, "word")
        sides.append(materialize(listed.withColumn("slice", F.spark_partition_id())))
        # two words per slice, so far under a megabyte for a million words
        ends = sides[-1].groupBy("slice").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()
        ends.sort(key=lambda row: row["first"])
        cuts.append(_Cut([row["slice"] for row in ends], [row["first"] for row in ends], [row["last"] for row in ends]))

    def dealt(reverse: bool) -> DataFrame:
        cut = cuts[reverse]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spelled = column(batch, "word").to_pylist()
                sent = [(part, word) for word in spelled for part in cut.wanted(word)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part for part, _ in sent], pa.int32()), pa.array([word for _, word in sent], pa.string())],
                    names=["slice", "word"],
                )

        listed = sides[reverse].select(F.lit(reverse).alias("reverse"), "slice", F.lit(False).alias("asks"), "word", "n")
        asked = sides[reverse].select("word").mapInArrow(deal, "slice int, word string").select(
            F.lit(reverse).alias("reverse"), "slice", F.lit(True).alias("asks"), "word", F.lit(None).cast("long").alias("n")
        )
        return listed.unionByName(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """List first, then what asks, slice by slice; a slice's list is bounded, what asks goes by in steps."""
        place, listed, counts, asking = None, [], [], []
        known = None

        def answer() -> pa.RecordBatch:
            nonlocal known
            known = known or _Lists(listed, counts)
            made = list(zip(*known.near(asking, place[0]))) or [()] * 4
            asking.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(made, kinds)], names=["word", "n_near", "best_n", "best"]
            )

        for batch in batches:
            rows = zip(*(column(batch, name).to_pylist() for name in ("reverse", "slice", "asks", "word", "n")))
            for reverse, part, asks, word, n in rows:
                if place != (reverse, part):
                    if asking:
                        yield answer()
                    place, listed, counts, known = (reverse, part), [], [], None
                if asks:
                    asking.append(word)
                    if len(asking) >= STEP_WORDS:
                        yield answer()
                else:
                    listed.append(word)
                    counts.append(n)
        if asking:
            yield answer()

    together = dealt(False).unionByName(dealt(True))
    found = together.repartition(2 * parts, "reverse", "slice").sortWithinPartitions("reverse", "slice", "asks", "word").mapInArrow(
        search, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best")
    )


def spelling_variants(words: DataFrame, ratio: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """words(word, n) with n_near, form, form_n and root.

    A word's form is its near word (one code point inserted, deleted or replaced) of the greatest n, ties to the least in
    code-point order, if that n is at least `ratio` (2 or more) times the word's own; `root` follows forms to the last,
    and is the word itself without one. Words are distinct; null words are left out; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more, else forms could go round in circles")
    known = materialize(words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    near = near_words(known, slice_words)
    joined = known.join(near, "word", "left")
    kept = F.col("best_n") >= ratio * F.col("n")
    told = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n"),
    ))
    # n grows `ratio`-fold with each step, so a chain has at most 63 of them: pointers double six times at most
    links = told.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), "_further"))
        links = moved.select("word", "root")
        if moved.filter(F.col("_further").isNotNull()).isEmpty():
            break
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
