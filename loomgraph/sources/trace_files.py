"""A data source of trace exports: files cut into byte ranges, one row per JSON document.

A file is either one JSON value, however many lines it has, or a document per line. The planner lists every file, hidden
names too, and cuts files of lines into byte ranges; tasks read the lines that begin in their ranges. Which of the two a
file is, is decided on its bytes: a framer follows strings, escapes, nesting and which token may follow which, in numpy,
piece by piece. A second value, or bytes no JSON value can go on with, make it a file of lines; nearly always the second
line says so. Only a file that still is one open value after a whole range is one row, or lines, for one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "loomgraph_traces"
BLOCK = 1 << 20
BATCH = 8 << 20
# what opening one more file counts for when small files are put together
OPEN_COST = 64 << 10
# an Arrow string array holds less than 2 GB
LARGEST = 1 << 30

# --- framing -----------------------------------------------------------------------------

_OPEN_OBJECT, _CLOSE, _OPEN_LIST, _COLON, _COMMA, _STRING, _SCALAR = 1, 2, 3, 4, 5, 6, 7
_KIND = np.full(256, _SCALAR, np.uint8)
for _signs, _kind in (("{", _OPEN_OBJECT), ("}]", _CLOSE), ("[", _OPEN_LIST), (":", _COLON), (",", _COMMA), ('"', _STRING), (" \t\r\n", 0)):
    _KIND[[ord(_sign) for _sign in _signs]] = _kind
_VALUE = (_OPEN_OBJECT, _OPEN_LIST, _STRING, _SCALAR)
_FOLLOWS = np.zeros((8, 8), bool)
for _kind, _after in (
    (0, _VALUE), (_OPEN_OBJECT, (_CLOSE, _STRING)), (_OPEN_LIST, (_CLOSE, *_VALUE)), (_CLOSE, (_CLOSE, _COMMA)), (_COLON, _VALUE),
    (_COMMA, _VALUE), (_STRING, (_CLOSE, _COLON, _COMMA)), (_SCALAR, (_CLOSE, _COMMA, _SCALAR)),
):
    _FOLLOWS[_kind, list(_after)] = True


class Framer:
    """Whether the bytes fed so far can begin one JSON object or list (`open`), are one (`whole`), or cannot be (`broken`)."""

    def __init__(self) -> None:
        self.inside = self.escaped = self.broken = self.closed = False
        self.depth, self.last = 0, 0

    @property
    def whole(self) -> bool:
        return self.closed and not self.broken

    @property
    def open(self) -> bool:
        return not self.closed and not self.broken

    def feed(self, data: bytes) -> None:
        signs = np.frombuffer(data, np.uint8)
        if self.broken or not len(signs):
            return
        # how many backslashes stand right before each place, the one carried over included
        places = np.arange(len(signs))
        plain = signs != 92
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(plain, places, -1))])
        slashes = places - 1 - before[:-1] + (self.escaped & (before[:-1] < 0))
        quotes = (signs == 34) & (slashes % 2 == 0)
        trailing = len(signs) - 1 - before[-1] + (self.escaped and before[-1] < 0)
        self.escaped = bool(trailing % 2)
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        within = np.concatenate([[self.inside], after[:-1]])
        self.inside = bool(after[-1])
        if (within & (signs < 32)).any():
            self.broken = True  # a string does not run over a line
            return
        kinds = np.where(within, 0, _KIND[signs])
        found = np.flatnonzero(kinds)
        if not len(found):
            return
        kinds = kinds[found]
        if self.closed:
            self.broken = True  # something after the value
            return
        steps = np.where(np.isin(kinds, (_OPEN_OBJECT, _OPEN_LIST)), 1, np.where(kinds == _CLOSE, -1, 0))
        depths = self.depth + np.cumsum(steps)
        follows = _FOLLOWS[np.concatenate([[self.last], kinds[:-1]]), kinds]
        if self.last == 0 and kinds[0] not in (_OPEN_OBJECT, _OPEN_LIST):
            follows[0] = False
        ends = np.flatnonzero(depths <= 0)
        if len(ends):
            # the value ends here; nothing may come after it
            self.broken = bool(not follows[: ends[0] + 1].all() or ends[0] + 1 < len(kinds) or self.inside)
            self.closed = True
        elif not follows.all():
            self.broken = True
        self.depth, self.last = int(depths[-1]), int(kinds[-1])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the place in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _blocks(stream, limit: int | None = None) -> Iterator[bytes]:
    read = 0
    while limit is None or read < limit:
        data = stream.read(BLOCK)
        if not data:
            return
        read += len(data)
        yield data


def framed(stream, limit: int | None = None) -> Framer:
    """The framer after a stream, or after `limit` bytes of it, or as soon as it is broken."""
    framer, first = Framer(), True
    for data in _blocks(stream, limit):
        framer.feed(data.removeprefix(b"\xef\xbb\xbf") if first else data)
        first = False
        if framer.broken:
            break
    return framer


def lines(stream, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin in [begin, end); the last one is read to its end."""
    place, skipping = max(0, begin - 1), begin > 0
    stream.seek(place)
    held: list[bytes] = []
    for data in _blocks(stream):
        pieces = data.split(b"\n")
        last = pieces.pop()
        if pieces:
            pieces[0] = b"".join(held) + pieces[0]
            held = []
        for piece in pieces:
            if skipping:
                skipping = False
            elif end is not None and place >= end:
                return
            else:
                yield place, piece
            place += len(piece) + 1
        held.append(last)
        if end is not None and place + (sum(map(len, held)) if skipping else 0) >= end:
            return
    rest = b"".join(held)
    if rest and not skipping and (end is None or place < end):
        yield place, rest


def documents(path: str, begin: int, end: int | None, by_line: bool | None) -> Iterator[tuple[int, str | None]]:
    """(offset, text) of the documents of a byte range; `by_line` None: the file itself says. Too long a value has no text."""
    store, place = opened(path)
    with store.open_input_file(place) as stream:
        if by_line is None:
            by_line = not framed(stream).whole
        if not by_line:
            stream.seek(0)
            yield 0, None if stream.size() > LARGEST else stream.read().removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
            return
        for offset, line in lines(stream, begin, end):
            line = (line.removeprefix(b"\xef\xbb\xbf") if offset == 0 else line).removesuffix(b"\r")
            if line.strip():
                yield offset, None if len(line) > LARGEST else line.decode("utf-8", "replace")


# --- the data source ------------------------------------------------------------------------


class _Share(InputPartition):
    """Byte ranges for one task: (path, begin, end, by_line)."""

    def __init__(self, ranges: list[tuple[str, int, int | None, bool | None]]):
        self.ranges = ranges


class TraceSource(DataSource):
    """Options: path, a file or a folder, by path or URI; split_bytes, how much a task reads; names, a pattern of paths."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id string, line bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", 128 << 20)), self.options.get("names", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, names: str):
        self.path, self.split, self.names = path, max(1, split), names

    def _files(self) -> list[tuple[str, int]]:
        store, place = opened(self.path)
        found = store.get_file_info(place)
        infos = [found] if found.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
        # names keep the form of the option, so that tasks open them the same way
        head = self.path.rstrip("/")
        name = lambda info: self.path if found.is_file else head + info.path[len(place.rstrip("/")):]
        files = sorted((name(info), info.size) for info in infos if info.is_file and info.size)
        return [(path, size) for path, size in files if re.search(self.names, path)]

    def _ranges(self) -> Iterator[tuple[str, int, int | None, bool | None, int]]:
        for path, size in self._files():
            by_line = True if path.endswith(".jsonl") else None
            if by_line is None and size > self.split:
                store, place = opened(path)
                with store.open_input_file(place) as stream:
                    by_line = True if framed(stream, self.split).broken else None
            if by_line and size > self.split:
                for begin in range(0, size, self.split):
                    yield path, begin, min(begin + self.split, size), True, min(self.split, size - begin)
            else:
                yield path, 0, None, by_line, size

    def partitions(self) -> list[InputPartition]:
        shares, share, held = [], [], 0
        for *part, size in self._ranges():
            if share and held + size > self.split:
                shares.append(_Share(share))
                share, held = [], 0
            share.append(tuple(part))
            held += size + OPEN_COST
        return shares + [_Share(share)] * bool(share) or [_Share([])]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str | None]] = []
        size = 0
        for path, begin, end, by_line in partition.ranges:
            for offset, text in documents(path, begin, end, by_line):
                rows.append((path, offset, text))
                size += len(text or "")
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, str | None]]) -> pa.RecordBatch:
    columns = zip(("doc_id", "line", "text"), (pa.string(), pa.int64(), pa.string()), list(zip(*rows)) or [()] * 3)
    names, arrays = zip(*((name, pa.array(values, kind)) for name, kind, values in columns))
    return pa.RecordBatch.from_arrays(list(arrays), names=list(names))
