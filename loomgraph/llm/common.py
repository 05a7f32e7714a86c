"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import configure, share_code


def prepare(spark: SparkSession) -> SparkSession:
    """The session as the operators need it: workers import this package, and hold batches of a few megabytes."""
    return share_code(configure(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def append(df: DataFrame, compute: Callable[[pa.RecordBatch], Sequence[pa.Array]], fields: Sequence[T.StructField],
           slice_bytes: int | None = None) -> DataFrame:
    """Add columns computed batch by batch; all other columns pass through untouched.

    An input column named like a new one is replaced. With `slice_bytes`, a batch is worked through, and sent on, in
    slices of about that size.
    """
    prepare(df.sparkSession)
    names = {field.name.lower() for field in fields}
    kept = df.drop(*[column for column in df.columns if column.lower() in names])
    schema = T.StructType([*kept.schema.fields, *fields])
    width = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = whole.num_rows if slice_bytes is None else max(1, whole.num_rows * slice_bytes // max(1, whole.nbytes))
            for begin in range(0, whole.num_rows, max(1, step)):
                batch = whole.slice(begin, step)
                arrays = [*batch.columns[:width], *compute(batch)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8, null for null."""
    return column(batch, name).cast(pa.binary()).to_pylist()


def joined_text(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch in one byte array and the offsets of each text; null is empty."""
    array = column(batch, name)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset: array.offset + len(array) + 1]
    offsets = offsets.astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if array.null_count:
        # a null may own bytes of the buffer; the general path copies
        values = [value or b"" for value in array.cast(pa.binary()).to_pylist()]
        raw = np.frombuffer(b"".join(values), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(value) for value in values])]).astype(np.int64)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def put(table: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The table with values from `at` on; it doubles when they do not fit."""
    if at + len(values) > len(table):
        table = np.concatenate([table, np.zeros(max(len(table), at + len(values) - len(table)), table.dtype)])
    table[at: at + len(values)] = values
    return table


# ranges up to this length are worked through place by place, all together
SHORT = 255
_STIR = np.uint64(0x9E3779B97F4A7C15)


def by_place(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seen: Callable[[int, np.ndarray], None]) -> None:
    """Call seen(how many ranges are longer than `at`, their bytes at `at`) for every place; the longest ranges come first."""
    for at in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -at, "left"))
        seen(live, raw[begins[:live] + at])


def longest_first(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(SHORT - sizes.astype(np.uint8), kind="stable")


def equal_ranges(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first range of each group of equal byte ranges, and the group of every range.

    Short ranges are told apart by a 64-bit hash, and each is compared with the first of its group; long ones by their bytes.
    """
    group = np.zeros(len(begins), np.int64)
    firsts: list[np.ndarray] = []
    count = 0
    short = np.flatnonzero(sizes <= SHORT)
    if len(short):
        order = short[longest_first(sizes[short])]
        mine, lengths = begins[order], sizes[order]
        keys = lengths.astype(np.uint64)

        def stir(live: int, signs: np.ndarray) -> None:
            mixing = (keys[:live] ^ signs) * _STIR
            keys[:live] = mixing ^ (mixing >> np.uint64(29))

        with np.errstate(over="ignore"):
            by_place(raw, mine, lengths, stir)
        _, first, numbers = np.unique(keys, return_index=True, return_inverse=True)
        other, alike, place = mine[first][numbers], lengths[first][numbers] == lengths, 0

        def compare(live: int, signs: np.ndarray) -> None:
            nonlocal place
            alike[:live] &= raw[np.minimum(other[:live] + place, len(raw) - 1)] == signs
            place += 1

        by_place(raw, mine, lengths, compare)
        group[order] = numbers
        firsts.append(order[first])
        count = len(first)
        short = order[np.flatnonzero(~alike)]  # two contents with one hash
    rest = np.concatenate([short, np.flatnonzero(sizes > SHORT)])
    known: dict[bytes, int] = {}
    for at in rest.tolist():
        said = raw[begins[at]: begins[at] + sizes[at]].tobytes()
        if said not in known:
            known[said] = count + len(known)
            firsts.append(np.array([at]))
        group[at] = known[said]
    return np.concatenate(firsts) if firsts else np.zeros(0, np.int64), group
