"""Exact repeated-substring removal by a distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it starts elsewhere, too. Only sampled suffixes are sorted: each
window of `length` bytes has an anchor, the least rolling hash of its k-grams (the leftmost of equals), so equal
windows have anchors at the same place, and suffixes starting at anchors (with the few bytes before them) decide all
windows. Anchors whose k-gram occurs once are left out before anything is sorted.

Documents are packed into runs. A run sorts its suffixes, joins equal ones into one entry with a count, and sends them
front-coded (length shared with the entry before, and the rest), by hash of the k-gram. A receiver merges the sorted
runs with a loser tree that carries common-prefix lengths: entries are told apart by those alone, and bytes are only
compared beyond a prefix already known; the merge also yields the prefix lengths of neighbours. From these, and from
the order of the bytes before the anchors, it finds for each entry which offsets of a window around it occur twice.
Answers go back to the runs per entry. What travels for a string that is everywhere is one entry per run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, column, joined_text, mixed, prepare
from loomgraph.session import materialize

CHUNK = 1 << 19
INDEX_BITS = 20
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
NONE = 255


def gram_size(length: int) -> int:
    """k of the anchors; a window holds length - k + 1 grams and is told apart by at most length - k bytes before one."""
    return max(1, length // 2)


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, count - 1), base, np.uint64))])[:count]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of every anchor of the texts laid end to end. Texts under `length` bytes have none."""
    k = gram_size(length)
    width = length - k + 1
    places, hashes = [], []
    ups, downs = _powers(_BASE, CHUNK + length), _powers(_INVERSE, CHUNK + length)
    mask = np.uint64((1 << INDEX_BITS) - 1)
    starts, ends = offsets[:-1], offsets[1:]
    for begin in range(0, len(raw), CHUNK):
        piece = raw[begin: begin + CHUNK + length - 1]
        windows = len(piece) - length + 1
        if windows <= 0:
            break
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[piece] * ups[: len(piece)])])
            grams = mixed((sums[k:] - sums[:-k]) * downs[: len(piece) - k + 1])
        packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        least, span = packed, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: windows], least[width - span: width - span + windows])
        # windows that run over the end of a text are none
        near = slice(np.searchsorted(ends, begin, "right"), np.searchsorted(starts, begin + windows, "left"))
        edge = np.zeros(windows + 1, np.int32)
        first = np.clip(np.maximum(ends[near] - length + 1, starts[near]) - begin, 0, windows)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.clip(ends[near] - begin, 0, windows), -1)
        chosen = np.unique(least[:windows][np.cumsum(edge[:-1]) == 0] & mask).astype(np.int64)
        places.append(chosen + begin)
        hashes.append(grams[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([array.nbytes for array in arrays], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(sizes + b"".join(array.tobytes() for array in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, made = np.frombuffer(plain[: 8 * len(kinds)], "<u8"), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        made.append(np.frombuffer(plain[at: at + size], kind))
        at += size
    return made


def _open(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().combine_chunks()
    return table.to_batches()[0]


def _runs(batches: Iterator[pa.RecordBatch], text_col: str, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows packed, with all columns, into runs of about `run_bytes` of text; a longer text is a run of its own."""
    held, size = [], 0

    def packed():
        made = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_table(made)
        data = zstandard.ZstdCompressor(level=6, write_content_size=True).compress(sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([data], pa.binary())], names=["run", "data"])

    for batch in batches:
        offsets = joined_text(batch, text_col)[1]
        first = 0
        for at in range(batch.num_rows):
            size += int(offsets[at + 1] - offsets[at])
            if size >= run_bytes:
                held.append(batch.slice(first, at + 1 - first))
                yield packed()
                held, size, first = [], 0, at + 1
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield packed()


def _local_hashes(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per part the distinct gram hashes of a run, sorted; the lowest bit tells if one occurs twice in it."""
    values, counts = np.unique(hashes | np.uint64(1), return_counts=True)
    marked = (values ^ np.uint64(1)) | (counts > 1).astype(np.uint64)
    owner = _part_of(values, parts)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(parts + 1))
    for part in range(parts):
        if bounds[part] < bounds[part + 1]:
            yield part, marked[order[bounds[part]: bounds[part + 1]]]


def _send_hashes(text_col: str, length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(column(batch, "run").to_pylist(), column(batch, "data")):
                data = data.as_py()
                found = anchors(*joined_text(_open(data), text_col), length)[1]
                rows = [(part, name, marked.tobytes()) for part, marked in _local_hashes(found, parts)]
                yield _rows(rows)

    return run


def _rows(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[0] for row in rows], pa.int32()), pa.array([row[1] for row in rows], pa.string()), pa.array([row[2] for row in rows], pa.binary())],
        names=["part", "run", "blob"],
    )


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """Rows sorted by part, part by part: at most one row per run."""
    now, held = None, []
    for batch in batches:
        for part, name, blob in zip(column(batch, "part").to_pylist(), column(batch, "run").to_pylist(), column(batch, "blob").to_pylist()):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((name, blob))
    if held:
        yield now, held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the hashes a run sent occur twice anywhere."""
    for part, held in _by_part(batches):
        sent = [np.frombuffer(blob, np.uint64) for _, blob in held]
        every = np.concatenate(sent)
        values, back, counts = np.unique(every >> np.uint64(1), return_inverse=True, return_counts=True)
        twice = np.bincount(back, weights=(every & np.uint64(1)).astype(np.float64), minlength=len(values)) + (counts > 1) > 0
        flags = np.split(twice[back], np.cumsum([len(one) for one in sent])[:-1])
        yield _rows([(part, name, np.packbits(flag).tobytes()) for (name, _), flag in zip(held, flags)])


def contexts(raw: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes: up to `length` from the anchor on, then the length - k before it, nearest first; and how many of
    either the text has. What is missing is zero."""
    before = length - gram_size(length)
    owner = np.searchsorted(offsets, places, "right") - 1
    rights = np.minimum(length, offsets[owner + 1] - places)
    lefts = np.minimum(before, places - offsets[owner])
    padded = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(length, np.uint8)])
    right = padded[places[:, None] + before + np.arange(length)]
    right[np.arange(length) >= rights[:, None]] = 0
    left = padded[places[:, None] + before - 1 - np.arange(before)]
    left[np.arange(before) >= lefts[:, None]] = 0
    return np.hstack([right, left]), rights, lefts


def _common(rows: np.ndarray) -> np.ndarray:
    """Prefix length that each row shares with the one before; 0 for the first."""
    made = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        made[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return made


def front_coded(keys: np.ndarray, rights: np.ndarray, lefts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A sorted run of distinct entries: its blob, and the order and entry number of the members."""
    flat = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()
    order = np.lexsort((lefts, rights, flat))
    keys, rights, lefts = keys[order], rights[order], lefts[order]
    shared = _common(keys)
    new = np.ones(len(keys), bool)
    new[1:] = (shared[1:] < keys.shape[1]) | (rights[1:] != rights[:-1]) | (lefts[1:] != lefts[:-1])
    entry = np.cumsum(new) - 1
    keys, shared = keys[new], shared[new]
    rest = keys[np.arange(keys.shape[1]) >= shared[:, None]]
    counts = np.bincount(entry).astype("<u4")
    blob = _pack(shared.astype("<u2"), rights[new].astype("<u2"), lefts[new].astype("<u2"), counts, rest)
    return blob, order, entry


def _send_entries(text_col: str, length: int, parts: int):
    """Front-coded runs per part, and per run (part -1) where the members of every entry are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data, answers in _by_run(batches):
            raw, offsets = joined_text(_open(data), text_col)
            places, hashes = anchors(raw, offsets, length)
            keep, owner = np.zeros(len(places), bool), _part_of(hashes | np.uint64(1), parts)
            for part, marked in _local_hashes(hashes, parts):
                flags = np.unpackbits(np.frombuffer(answers[part], np.uint8), count=len(marked)).astype(bool)
                inside = np.flatnonzero(owner == part)
                keep[inside] = flags[np.searchsorted(marked >> np.uint64(1), hashes[inside] >> np.uint64(1))]
            places, owner = places[keep], owner[keep]
            rows, member_places, member_entries, sizes = [], [], [], []
            for part in np.unique(owner).tolist():
                mine = places[owner == part]
                blob, order, entry = front_coded(*contexts(raw, offsets, mine, length))
                rows.append((part, name, blob))
                member_places.append(mine[order])
                member_entries.append(entry)
                sizes += [part, len(mine)]
            gathered = [np.concatenate(found) if found else np.zeros(0, np.int64) for found in (member_places, member_entries)]
            rows.append((-1, name, _pack(np.array(sizes, "<i8"), gathered[0].astype("<u4"), gathered[1].astype("<u4"))))
            yield _rows(rows)

    return run


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, dict[int, bytes]]]:
    """Rows sorted by run, run by run: its packed documents (part null), and the blobs by part."""
    now, data, answers = None, None, {}
    for batch in batches:
        for name, part, blob in zip(column(batch, "run").to_pylist(), column(batch, "part").to_pylist(), column(batch, "blob")):
            blob = blob.as_py()
            if name != now:
                if now is not None:
                    yield now, data, answers
                now, data, answers = name, None, {}
            if part is None:
                data = blob
            else:
                answers[part] = blob
    if now is not None:
        yield now, data, answers


def _lce(one: bytes, two: bytes, known: int) -> int:
    """How far two keys of one length agree, given that they do up to `known`."""
    size = len(one)
    while known < size:
        a, b = one[known: known + 24], two[known: known + 24]
        if a != b:
            differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
            return known + len(a) - (differing.bit_length() + 7) // 8
        known += 24
    return size


def _entries(blob: bytes, width: int):
    """The entries of a run in order: (prefix shared with the one before, key)."""
    shared, _, _, _, rest = _unpack(blob, "<u2", "<u2", "<u2", "<u4", "u1")
    data, at, key = rest.tobytes(), 0, b""
    for known in shared.tolist():
        end = at + width - known
        key = key[:known] + data[at:end]
        at = end
        yield known, key


def merge_runs(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Merge sorted runs by a loser tree with prefix lengths.

    Each tree node holds a loser and the prefix it shares with the winner that beat it last. A new entry knows its
    prefix with the one just taken from its run, so the longer prefix wins a match outright; only on equal prefixes are
    bytes compared, from there on. Returns the run of each merged entry, its prefix shared with the one before, and keys.
    """
    count = len(blobs)
    leaves = 1
    while leaves < count:
        leaves *= 2
    streams = [_entries(blob, width) for blob in blobs]
    keys: list[bytes | None] = [None] * leaves
    known = [0] * leaves
    for run, stream in enumerate(streams):
        known[run], keys[run] = next(stream, (0, None))
    loser, prefix = [0] * leaves, [0] * leaves

    def match(a: int, ha: int, b: int, hb: int):
        """(winner, its prefix, loser, its prefix); prefixes are with the last key taken."""
        ka, kb = keys[a], keys[b]
        if kb is None:
            return a, ha, b, 0
        if ka is None:
            return b, hb, a, 0
        if ha > hb:
            return a, ha, b, hb
        if ha < hb:
            return b, hb, a, ha
        h = _lce(ka, kb, ha)
        if h == width or ka[h] < kb[h]:
            return a, ha, b, h
        return b, hb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= leaves:
            return node - leaves, 0
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        winner, hw, loser[node], prefix[node] = match(a, ha, b, hb)
        return winner, hw

    winner, shared = build(1)
    order, lcps, merged = [], [], []
    while keys[winner] is not None:
        order.append(winner)
        lcps.append(shared)
        merged.append(keys[winner])
        h, key = next(streams[winner], (0, None))
        run, keys[winner] = winner, key
        node = (run + leaves) >> 1
        while node:
            run, h, loser[node], prefix[node] = match(run, h, loser[node], prefix[node])
            node >>= 1
        winner, shared = run, h
    return np.array(order, np.int64), np.array(lcps, np.int64), merged


def repeated_offsets(keys: np.ndarray, lcps: np.ndarray, rights: np.ndarray, lefts: np.ndarray, counts: np.ndarray,
                     length: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted entries the least and the largest number of bytes before the anchor at which a window that occurs
    twice starts; NONE if none does. Entries share a window if they agree to both sides of the anchor far enough."""
    before = length - gram_size(length)
    left = np.ascontiguousarray(keys[:, length:])
    by_left = np.argsort(left.view(f"S{before}").ravel(), kind="stable")
    left_common = _common(left[by_left])
    low, high = np.full(len(keys), NONE), np.full(len(keys), NONE)
    left_id = np.zeros(len(keys), np.int64)
    for back in range(before + 1):
        right_id = np.cumsum(lcps < length - back)
        left_id[by_left] = np.cumsum(left_common < back)
        fits = np.flatnonzero((rights >= length - back) & (lefts >= back))
        if not len(fits):
            continue
        _, group = np.unique(right_id[fits] * (len(keys) + 1) + left_id[fits], return_inverse=True)
        twice = fits[np.bincount(group, weights=counts[fits])[group] > 1]
        low[twice] = np.minimum(low[twice], back)
        high[twice] = back
    return low, high


def _merge(length: int):
    width = length + length - gram_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _by_part(batches):
            blobs = [blob for _, blob in held]
            order, lcps, merged = merge_runs(blobs, width)
            keys = np.frombuffer(b"".join(merged), np.uint8).reshape(-1, width)
            heads = [_unpack(blob, "<u2", "<u2", "<u2", "<u4", "u1")[1:4] for blob in blobs]
            by_run = np.argsort(order, kind="stable")  # runs keep the order of their entries
            rights, lefts, counts = (np.empty(len(order), np.int64) for _ in range(3))
            for into, found in zip((rights, lefts, counts), zip(*heads)):
                into[by_run] = np.concatenate(found)
            low, high = repeated_offsets(keys, lcps, rights, lefts, counts, length)
            cuts = np.cumsum(np.bincount(order, minlength=len(held)))[:-1]
            answers = zip(np.split(low[by_run].astype("u1"), cuts), np.split(high[by_run].astype("u1"), cuts))
            yield _rows([(part, name, _pack(one, two)) for (name, _), (one, two) in zip(held, answers)])

    return run


def _spans(offsets: np.ndarray, answers: dict[int, bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal removed stretches of a run."""
    sizes, places, entries = _unpack(answers[-1], "<i8", "<u4", "<u4")
    firsts, ends, at = [], [], 0
    for part, size in sizes.reshape(-1, 2).tolist():
        low, high = _unpack(answers[part], "u1", "u1")
        place, entry = places[at: at + size].astype(np.int64), entries[at: at + size]
        at += size
        hit = low[entry] != NONE
        firsts.append(place[hit] - high[entry[hit]])
        ends.append(place[hit] + length - low[entry[hit]])
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    for first, end in zip(firsts, ends):
        np.add.at(edge, first, 1)
        np.add.at(edge, end, -1)
    inside = np.cumsum(edge[:-1]) > 0
    change = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    # stretches of neighbouring texts that touch are two
    cut = offsets[1:-1][inside[offsets[1:-1] - 1] & inside[np.minimum(offsets[1:-1], max(0, len(inside) - 1))] & (offsets[1:-1] > 0)] if len(inside) else offsets[:0]
    cut = np.unique(cut[(cut > 0) & (cut < len(inside))])
    return np.sort(np.concatenate([np.flatnonzero(change == 1), cut])), np.sort(np.concatenate([np.flatnonzero(change == -1), cut]))


SPAN = T.StructType([T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]


def _answer(text_col: str, names: list[str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, answers in _by_run(batches):
            batch = _open(data)
            offsets = joined_text(batch, text_col)[1]
            firsts, ends = _spans(offsets, answers, length)
            bounds = np.searchsorted(firsts, offsets)
            starts = np.repeat(offsets[:-1], np.diff(bounds))
            spans = pa.StructArray.from_arrays([pa.array(firsts - starts, pa.int64()), pa.array(ends - starts, pa.int64())], names=["first_byte", "end_byte"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets), pa.int64()), lists], names=names)

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, run_bytes: int = 4 << 20) -> DataFrame:
    """`docs` with n_bytes (UTF-8) and spans: the maximal stretches of bytes covered by strings of `length` bytes that
    also start elsewhere, in any document, the same included.

    Null texts are empty; texts under `length` bytes, and empty tables, have no spans. Repeated rows lose all they
    share, each of them. An input column named like a result is replaced; all others pass through unchanged.
    """
    if not 2 <= length <= 500:
        raise ValueError("length must lie in 2..500")
    spark = prepare(docs.sparkSession)
    names = {field.name for field in FIELDS}
    docs = docs.drop(*[name for name in docs.columns if name.lower() in names])
    schema = T.StructType([*docs.schema.fields, *FIELDS])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = "part int, run string, blob binary"

    runs = materialize(docs.mapInArrow(lambda batches: _runs(batches, text_col, run_bytes), "run string, data binary"))
    hashes = runs.mapInArrow(_send_hashes(text_col, length, parts), sent)
    answers = hashes.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated, sent)
    packed = runs.select(F.lit(None).cast("int").alias("part"), "run", F.col("data").alias("blob"))

    def per_run(blobs: DataFrame) -> DataFrame:
        return packed.unionByName(blobs).repartition("run").sortWithinPartitions("run")

    entries = materialize(per_run(answers).mapInArrow(_send_entries(text_col, length, parts), sent))
    suffixes = entries.filter(F.col("part") >= 0).repartition("part").sortWithinPartitions("part")
    found = suffixes.mapInArrow(_merge(length), sent)
    everything = per_run(found.unionByName(entries.filter(F.col("part") == -1)))
    return everything.mapInArrow(_answer(text_col, schema.fieldNames(), length), schema)


def remove_repeated(docs: DataFrame, text_col: str = "text", length: int = 200, chars_col: str = "n_chars") -> DataFrame:
    """`docs` without the repeated stretches of their texts, same columns; `chars_col`, where there is one, is set anew
    for texts that changed. A text that is cut away whole takes its row with it; texts empty or null before stay.
    """
    found = repeated_spans(docs, text_col, length)
    names = docs.columns
    text_type = T.StructField(text_col, T.StringType())

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        spans, texts = column(batch, "_spans").to_pylist(), column(batch, "_before").to_pylist()
        return [pa.array([cut_text(text, mine) if mine else text for text, mine in zip(texts, spans)], pa.string())]

    changed = found.withColumns({"_before": F.col(text_col), "_spans": F.col("spans")})
    made = append(changed, compute, [text_type]).filter((F.size("_spans") == 0) | (F.col(text_col) != ""))
    if chars_col in names:
        count = F.char_length(text_col).cast(docs.schema[chars_col].dataType)
        made = made.withColumn(chars_col, F.when(F.size("_spans") > 0, count).otherwise(F.col(chars_col)))
    return made.select(*names)


def cut(text: bytes, spans: list) -> bytes:
    """The bytes outside the spans."""
    kept, at = [], 0
    for span in spans:
        kept.append(text[at: span["first_byte"]])
        at = span["end_byte"]
    return b"".join([*kept, text[at:]])


def cut_text(text: str, spans: list) -> str:
    """Like `cut`, for text: a character goes only if all its bytes go."""
    data = text.encode()
    whole = []
    for span in spans:
        first, end = span["first_byte"], span["end_byte"]
        while first < end and data[first] & 0xC0 == 0x80:
            first += 1
        while end > first and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        whole.append({"first_byte": first, "end_byte": end})
    return cut(data, whole).decode()
