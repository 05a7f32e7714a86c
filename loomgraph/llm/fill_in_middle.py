"""Fill-in-middle outputs assembled by a secondary sort, and texts restored from them by a second one.

A text is cut into units (lines) and, at two unit boundaries drawn from a keyed hash of its id, into prefix, middle and
suffix. Each part becomes pieces of whole units, a chunk of about 32 KB at most (a longer unit is cut itself), and each
piece knows its place in the output. `repartition` by row and `sortWithinPartitions` by (row, place) - the DataFrame form
of repartitionAndSortWithinPartitions - bring a row's pieces past a task one by one in output order, where they flow into
a running digest. No text is ever put together to be digested, so a text of any length needs the memory of one piece.

Restoring sees only what the output holds: the form and the stream of its bytes. Markers are looked for in that stream
(they may lie across pieces); what lies between them gets its place in the text, and a second sort within the same
partitions, without a second shuffle, brings the pieces into text order.

Each input row is a key of its own, so equal or null ids make no hot key. The row number comes from the partition and the
place in it: the input is to be a table read, or written first, so that a repeated task numbers its rows the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, joined_text, prepare

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 32 << 10
# bytes worked through, and sent on, at a time
SLICE = 1 << 20

# order of the parts in the output, and the place of each part in the text
_LAYOUT = {"psm": [(PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)], "spm": [(SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)]}
_TOLD = "n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"row long, place int, doc_id long, piece binary, {_TOLD}"
_FLOW = pa.schema([
    ("row", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("piece", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()),
    ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()),
])


def keyed(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * at, 8), 16, 10).cast("long") for at in range(4)]


def _cut(raw: np.ndarray, begin: int, end: int, units: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of [begin, end): whole units up to `chunk` bytes, or a stretch of one unit."""
    inside = units[np.searchsorted(units, begin, "right"): np.searchsorted(units, end, "right")]
    while begin < end:
        fit = np.searchsorted(inside, begin + chunk, "right")
        stop = int(inside[fit - 1]) if fit and inside[fit - 1] > begin else begin + chunk
        stop = min(stop, end)
        yield begin, stop
        begin = stop


def pieces(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """(row, place, doc_id, piece, n, form, prefix_chars, middle_chars): the output of every row, piece by piece.

    `rate` percent of the texts are changed, `spm_rate` percent of those in suffix-prefix-middle order. A null text is
    empty; empty texts and texts that hold a marker stay plain. What is told of a row stands at its first piece (place
    0), which every row has. An unchanged null id is null; other columns are left behind.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        *(part.alias(f"h{at}") for at, part in enumerate(keyed(F.col(id_col), seed), 1)), F.col(text_col).cast("string").alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what leaves is as large as what came
            step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
            for begin in range(0, batch.num_rows, step):
                yield _pieces_of(batch.slice(begin, step), rate, spm_rate, chunk)

    return rows.mapInArrow(cut, _PIECES)


def _pieces_of(batch: pa.RecordBatch, rate: int, spm_rate: int, chunk: int) -> pa.RecordBatch:
    raw, offsets = joined_text(batch)
    numbers, ids = column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist()
    draws = zip(*(column(batch, f"h{at}").to_pylist() for at in range(1, 5)))
    breaks = np.flatnonzero(raw == 10) + 1
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    whole = raw.tobytes()
    made: list[tuple] = []
    for at, (h1, h2, h3, h4) in enumerate(draws):
        first, last = int(offsets[at]), int(offsets[at + 1])
        units = breaks[np.searchsorted(breaks, first, "right"): np.searchsorted(breaks, last, "right")]
        if last > first and (not len(units) or units[-1] != last):
            units = np.append(units, last)
        n = len(units)
        plain = first == last or h3 % 100 >= rate or any(whole.find(marker, first, last) >= 0 for marker in (PREFIX, SUFFIX, MIDDLE))
        if plain:
            told, parts = (n, "plain", None, None), [(b"", first, last)]
        else:
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            edges = [first, int(units[low - 1]) if low else first, int(units[high - 1]) if high else first, last]
            chars = [int(leads[edges[part + 1]] - leads[edges[part]]) for part in (0, 1)]
            form = "spm" if h4 % 100 < spm_rate else "psm"
            told, parts = (n, form, *chars), [(marker, edges[part], edges[part + 1]) for marker, part in _LAYOUT[form]]
        place = 0
        for marker, begin, end in parts:
            ranges = list(_cut(raw, begin, end, units, chunk)) or [(begin, begin)]
            for number, (one, two) in enumerate(ranges):
                piece = marker + whole[one:two] if number == 0 else whole[one:two]
                made.append((numbers[at], place, ids[at], piece, *(told if place == 0 else (None,) * 4)))
                place += 1
    columns = list(zip(*made)) or [()] * 8
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["row", "place", "doc_id", "piece", "n", "form", "prefix_chars", "middle_chars"]
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)], names=names)


def assembled(made: DataFrame) -> DataFrame:
    """Pieces dealt by row and sorted by (row, place) within each partition: the secondary sort."""
    return made.repartition("row").sortWithinPartitions("row", "place")


class _Restorer:
    """Places of an output's bytes in the text, from the form and the bytes alone."""

    def __init__(self, form: str):
        self.expected = list(_LAYOUT.get(form, []))
        self.part, self.held = 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        if not self.expected:
            yield self.part, piece
            return
        data = self.held + piece
        while self.expected:
            marker, part = self.expected[0]
            at = data.find(marker)
            if at < 0:
                # a marker may begin in the last two bytes
                keep = max(0, len(data) - len(marker) + 1)
                self.held = data[keep:]
                if keep:
                    yield self.part, data[:keep]
                return
            if at:
                yield self.part, data[:at]
            data, self.part = data[at + len(marker):], part
            self.expected.pop(0)
        self.held = b""
        if data:
            yield self.part, data

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            yield self.part, self.held


def _flowing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to pieces of the text, and at the end of each row what is told of it with the output's digest."""
    made: list[tuple] = []
    size = 0
    state = None  # row, doc_id, told, digest, restorer, places handed out

    def put(part: int, data: bytes) -> None:
        nonlocal size
        made.append((state["row"], part, state["count"], data, None, None, None, None, None, None))
        state["count"] += 1
        size += len(data)

    def close() -> None:
        for part, data in state["restorer"].rest():
            put(part, data)
        made.append((state["row"], 3, state["count"], None, state["doc_id"], *state["told"], state["digest"].hexdigest()))

    def flush() -> pa.RecordBatch:
        nonlocal size
        columns = list(zip(*made)) or [()] * len(_FLOW)
        batch = pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, _FLOW)], schema=_FLOW)
        made.clear()
        size = 0
        return batch

    for batch in batches:
        columns = [column(batch, name) for name in ("row", "place", "doc_id", "piece", "n", "form", "prefix_chars", "middle_chars")]
        rows, places = columns[0].to_numpy(), columns[1].to_numpy()
        for at in range(batch.num_rows):
            if places[at] == 0:
                if state is not None:
                    close()
                told = tuple(values[at].as_py() for values in columns[4:])
                state = {
                    "row": int(rows[at]), "doc_id": columns[2][at].as_py(), "told": told, "digest": hashlib.sha256(),
                    "restorer": _Restorer(told[1]), "count": 0,
                }
            piece = columns[3][at].as_py()
            state["digest"].update(piece)
            for part, data in state["restorer"].feed(piece):
                put(part, data)
            if size >= SLICE:
                yield flush()
    if state is not None:
        close()
    yield flush()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text pieces in text order to one line per row, at the row that ends it."""
    digest = hashlib.sha256()
    for batch in batches:
        parts, data = column(batch, "part").to_numpy(), column(batch, "piece")
        ends = np.flatnonzero(parts == 3)
        restored, begin = [], 0
        for end in [*ends.tolist(), batch.num_rows]:
            for at in range(begin, end):
                digest.update(data[at].as_buffer())
            if end < batch.num_rows:
                restored.append(digest.hexdigest())
                digest = hashlib.sha256()
            begin = end + 1
        told = batch.take(pa.array(ends)).select(["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
        yield pa.RecordBatch.from_arrays([*told.columns, pa.array(restored, pa.string())], names=[*told.schema.names, "restored_sha256"])


def round_trip(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text",
               chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256 of every row.

    One shuffle carries the text. Repeated rows, equal and null ids are rows of their own; an empty table gives no rows.
    """
    flow = assembled(pieces(docs, seed, rate, spm_rate, id_col, text_col, chunk)).mapInArrow(
        _flowing, f"row long, part int, place long, piece binary, doc_id long, {_TOLD}, output_sha256 string"
    )
    # a sort within the partitions at hand: no exchange
    return flow.sortWithinPartitions("row", "part", "place").mapInArrow(
        _digested, f"doc_id long, {_TOLD}, output_sha256 string, restored_sha256 string"
    )


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text",
              chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the training text of every row, one row in memory at a time."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        told, held = None, []

        def whole() -> pa.RecordBatch:
            values = [*(pa.array([value], kind) for value, kind in zip(told, kinds)), pa.array([b"".join(held).decode()])]
            return pa.RecordBatch.from_arrays(values, names=[*names, "output"])

        for batch in batches:
            places, data = column(batch, "place").to_numpy(), column(batch, "piece")
            for at in range(batch.num_rows):
                if places[at] == 0:
                    if told is not None:
                        yield whole()
                    told, held = [column(batch, name)[at].as_py() for name in names], []
                held.append(data[at].as_py())
        if told is not None:
            yield whole()

    made = assembled(pieces(docs, seed, rate, spm_rate, id_col, text_col, chunk))
    return made.mapInArrow(join, f"doc_id long, {_TOLD}, output string")


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """`outputs` with `restored`: the text, from the output and its form alone (columns only, a row at a time)."""
    output = F.col(output_col)
    cut = {form: [marker.decode() for marker, _ in layout] for form, layout in _LAYOUT.items()}

    def parts(markers: list[str]) -> list[Column]:
        spots = [F.locate(marker, output) for marker in markers]
        ends = [*(spot - 1 for spot in spots[1:]), F.length(output)]
        return [F.substring(output, spot + 3, end - spot - 2) for spot, end in zip(spots, ends)]

    first, last, middle = parts(cut["psm"])
    after, before, between = parts(cut["spm"])
    restored = F.when(F.col(form_col) == "psm", F.concat(first, middle, last)).when(F.col(form_col) == "spm", F.concat(before, between, after))
    return outputs.withColumn("restored", restored.otherwise(output))
