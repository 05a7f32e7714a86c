"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts are lower-cased (A-Z) and reduced to words of digits, letters a-z and non-ASCII characters; words are numbers in the
automaton. A document word is hit if it lies in `size` consecutive words of an item, or in a whole item of fewer.

Of an item the automaton has the runs of g = (size + 1) / 2 words that begin at every g-th word: each run of `size` words
holds one of them whole, and an item has a node per word, not per word and window. A text is scanned once; where a run is
found, words are compared to both sides of it, along the item, and what is `size` words long or longer is hit. Word
numbers lead back to the positions in the original.

The automaton is broadcast. Its size is bounded first: benchmark rows are split into blocks of at most about `block_words`
words (a row longer than that is a block of its own), and there is one scan per block.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, column, text_bytes

_FOLD = bytes(
    code + 32 if 65 <= code <= 90 else code if 48 <= code <= 57 or 97 <= code <= 122 or code >= 128 else 32
    for code in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPAN = T.StructType([T.StructField("first_char", T.LongType()), T.StructField("end_char", T.LongType())])
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items_sha256", T.StringType()),
]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Items:
    """The automaton of some items, their words as numbers, and the ids each text of words goes by."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], size: int):
        self.size, self.step = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        texts: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            spelled = tuple(self.numbers.setdefault(word, len(self.numbers) + 1) for word in words(text))
            if spelled:
                # without an id an item hits, but has no name
                texts.setdefault(spelled, set()).update([] if item is None else [item])
        self.texts, self.ids = list(texts), [tuple(ids) for ids in texts.values()]
        # run of words -> whether it is all of an item, and where it begins in which items
        runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, spelled in enumerate(self.texts):
            if len(spelled) < size:
                runs.setdefault(spelled, []).append((number, -1))
                continue
            for at in range(0, len(spelled) - self.step + 1, self.step):
                runs.setdefault(spelled[at: at + self.step], []).append((number, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if runs else None
        for key, places in runs.items():
            self.automaton.add_word(key, (len(key), tuple(places)))
        if runs:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words, and the ids of the items they are of."""
        get = self.numbers.get
        said = tuple([get(word, 0) for word in words(text)])
        found, items = [], set()
        seen: dict[tuple[int, int], int] = {}  # how far a text has been compared with an item at an offset
        for end, (length, places) in self.automaton.iter(said) if self.automaton is not None and said else ():
            first, last = end - length + 1, end + 1
            for number, at in places:
                if at < 0:
                    found.append((first, last))
                    items.update(self.ids[number])
                elif seen.get((number, first - at), 0) < last:
                    begin, stop = self._compared(said, self.texts[number], first, at, length)
                    seen[number, first - at] = stop
                    if stop - begin >= self.size:
                        found.append((begin, stop))
                        items.update(self.ids[number])
        return _merge(found), items

    @staticmethod
    def _compared(said: tuple[int, ...], item: tuple[int, ...], first: int, at: int, length: int) -> tuple[int, int]:
        """The whole stretch of equal words around a run."""
        back = 0
        while back < first and back < at and said[first - back - 1] == item[at - back - 1]:
            back += 1
        on, room = length, min(len(said) - first, len(item) - at)
        while on < room and said[first + on] == item[at + on]:
            on += 1
        return first - back, first + on


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size, fetched one at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10ffff}]+")))).first()[0] or 0
    count = int(total // block_words) + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for number in range(count):
        yield [(row["item"], bytes(row["text"])) for row in rows.filter(block == number).select("item", F.col("text").cast("binary")).collect()]


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    places = [match.span() for match in _WORD.finditer(text)]
    found, chars, at = [], 0, 0
    for first, end in runs:
        begin, stop = places[first][0], places[end - 1][1]
        chars += len(text[at:begin].decode("utf-8", "replace"))
        length = len(text[begin:stop].decode("utf-8", "replace"))
        found.append({"first_char": chars, "end_char": chars + length})
        chars, at = chars + length, stop
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """`docs` with n_words, n_hit (words inside any occurrence of a window), items (ids, sorted as strings), spans (hit
    runs in characters of the original), items_sha256 and contaminated.

    A null or empty text has no words and no hits. Benchmark rows without text have no words; those without id hit, but
    are not among the items. An empty benchmark hits nothing. Equal windows of several items count for each. Repeated
    documents are judged one by one, texts of any length whole. An input column named like a result is replaced;
    `_runs<n>` and `_items<n>` are used in between.
    """
    spark = docs.sparkSession
    out = docs
    blocks = list(_one_by_one(spark, benchmark, item_col, item_text_col, size, block_words))
    runs_col, items_col = _state(len(blocks) - 1)
    for number, made in enumerate(blocks):
        fields = [T.StructField(name, kind) for name, kind in zip(_state(number), (T.BinaryType(), T.ArrayType(T.StringType())))]
        out = append(out, _pass(made, text_col, number), fields).drop(*_state(number - 1))

    def summarise(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = text_bytes(batch, text_col)
        states = [np.frombuffer(value, np.int64).reshape(-1, 2).tolist() for value in column(batch, runs_col).to_pylist()]
        items = column(batch, items_col).to_pylist()
        return [
            pa.array([len(words(text)) for text in texts], pa.int64()),
            pa.array([sum(end - first for first, end in runs) for runs in states], pa.int64()),
            pa.array(items, pa.list_(pa.string())),
            pa.array([_spans(text, runs) if runs else [] for text, runs in zip(texts, states)],
                     pa.list_(pa.struct([("first_char", pa.int64()), ("end_char", pa.int64())]))),
            pa.array([hashlib.sha256(",".join(found).encode()).hexdigest() for found in items], pa.string()),
        ]

    return append(out, summarise, FOUND).drop(runs_col, items_col).withColumn("contaminated", F.col("n_hit") > 0)


def _one_by_one(spark, benchmark, item_col, text_col, size, block_words):
    for rows in _blocks(benchmark, item_col, text_col, block_words):
        yield spark.sparkContext.broadcast(Items(rows, size))


def _state(number: int) -> tuple[str, str]:
    """Columns that hold what the scans up to a block have found."""
    return f"_runs{number}", f"_items{number}"


def _pass(made, text_col: str, number: int):
    again = number > 0

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        runs_out, items_out = [], []
        texts = text_bytes(batch, text_col)
        before = zip(*(column(batch, name).to_pylist() for name in _state(number - 1))) if again else ((b"", []) for _ in texts)
        for text, (old_runs, old_items) in zip(texts, before):
            runs, items = made.value.scan(text)
            if again:
                runs = _merge(runs + [tuple(pair) for pair in np.frombuffer(old_runs, np.int64).reshape(-1, 2).tolist()])
                items |= set(old_items)
            runs_out.append(np.array(runs, np.int64).tobytes())
            items_out.append(sorted(items))
        return [pa.array(runs_out, pa.binary()), pa.array(items_out, pa.list_(pa.string()))]

    return compute
