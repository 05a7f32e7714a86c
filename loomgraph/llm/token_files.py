"""Token ids in files: one zstandard frame per document under a shared dictionary.

A file holds, little-endian: the magic `LGTOK1\\0\\0`, the id width in bytes (u32), the SHA-256 of the dictionary; then
the frames in document order; then one index entry per document (offset u64, bytes u32, ids u32, id i64, has id u8);
then the index place (u64), the number of documents (u64) and the magic again. A reader fetches the tail and the index
and then only the frames it wants (`read_documents`). The dictionary lies beside the files, named by its hash.

Ids are serialized as u16 where the vocabulary allows it, else as u32, before compression.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm.common import column, equal_ranges, prepare, put, spread
from loomgraph.session import materialize, shared_folder

MAGIC = b"LGTOK1\0\0"
HEAD = "<8sI32s"
ENTRY = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("doc_id", "<i8"), ("has_id", "u1")])
TAIL = "<QQ8s"

# The split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Controls that regex libraries do not agree to call white space.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​﻿￾￿]")


# Classes of bytes where a text has only ASCII and letters of two bytes that begin with 0xC3.
_LETTER, _DIGIT, _SPACE, _OTHER, _ODD = range(5)


def _class_of(code: int) -> int:
    if 65 <= code <= 90 or 97 <= code <= 122 or code == 0xC3:
        return _LETTER
    if code in (9, 10, 11, 12, 13, 32):
        return _SPACE
    return _DIGIT if 48 <= code <= 57 else _ODD if 28 <= code <= 31 or code >= 0xC0 else _OTHER


_CLASS = np.array([_class_of(code) for code in range(256)], np.uint8)
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
_NO_LETTER = (0x97, 0xB7)  # the signs of multiplication and division


def plain_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts `token_starts` can cut: ASCII without separators that libraries do not agree on, and Latin letters."""
    odd = _CLASS[raw] == _ODD
    wide = raw >= 0x80
    after_lead = np.concatenate([[False], raw[:-1] == 0xC3])
    odd |= wide & (raw < 0xC0) & ~after_lead
    odd |= after_lead & np.isin(raw, _NO_LETTER)
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] == total[offsets[:-1]]


def token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin, as `SPLIT` cuts them.

    A pre-token is a run of letters, digits or other signs, with the space before it; the rest of a run of white space
    is one of its own, as is its last sign if that is no space. An apostrophe that stands alone after no space goes with
    the ending behind it.
    """
    kinds = _CLASS[raw]
    kinds[(raw >= 0x80) & (raw < 0xC0)] = _LETTER
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets] = True
    starts = begins.copy()
    starts[1:-1] |= kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    # white space before something else: its last sign is cut off, and goes with what follows if it is a space
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:-1]) if len(raw) > 1 else np.zeros(0, np.int64)
    starts[last] = True
    starts[last[raw[last] == 32] + 1] = False
    # endings: an apostrophe that begins a token, alone of its kind
    marks = np.flatnonzero((raw == 39) & starts[:-1])
    marks = marks[marks + 1 < len(raw)]
    marks = marks[~begins[marks + 1] & (kinds[marks + 1] == _LETTER)]
    for at in marks.tolist():
        for ending in _ENDINGS:
            end = at + 1 + len(ending)
            if raw[at + 1: end].tobytes() == ending and not begins[at + 2: end].any():
                starts[at + 1] = False
                if end < len(raw) and kinds[end] == _LETTER and not begins[end]:
                    starts[end] = True
                break
    return np.flatnonzero(starts[:-1])


class _Words:
    """The ids of each pre-token, from the tokenizer, kept while there is room."""

    def __init__(self, path: str, limit: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(SPLIT).findall
        self.limit = limit
        # in a byte-level vocabulary a token has as many characters as bytes
        size = self.tokenizer.get_vocab_size()
        self.sizes = np.array([len(self.tokenizer.id_to_token(number) or "") for number in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begins, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)
        self.used = 0

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        self.begins = put(self.begins, first, self.used + np.cumsum(lengths) - lengths)
        self.lengths = put(self.lengths, first, lengths)
        self.flat = put(self.flat, self.used, ids)
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + len(words))))

    def _learn(self, wanted: list[bytes]) -> None:
        """Encode pre-tokens not seen yet. Those of a space and letters go to the tokenizer in long strings, which it
        splits at the same places; where a word ends is told by the tokens' sizes, and checked."""
        spaced = {word for word in wanted if word[:1] == b" " and word[1:].decode().isalpha()}
        plain = list(spaced)
        pieces = [plain[at: at + 2000] for at in range(0, len(plain), 2000)]
        made = self.tokenizer.encode_batch_fast([b"".join(piece).decode() for piece in pieces], add_special_tokens=False)
        rest = [word for word in wanted if word not in spaced]
        for piece, encoding in zip(pieces, made):
            ids = np.array(encoding.ids, np.uint32)
            places = np.cumsum(self.sizes[ids])
            ends = np.cumsum([len(word) for word in piece])
            cuts = np.searchsorted(places, ends)
            if np.array_equal(places[np.minimum(cuts, len(places) - 1)], ends):
                self._keep(piece, ids, np.diff(np.concatenate([[0], cuts + 1])))
            else:
                rest += piece
        for begin in range(0, len(rest), 20_000):
            part = rest[begin: begin + 20_000]
            found = self.tokenizer.encode_batch_fast([word.decode() for word in part], add_special_tokens=False)
            lists = [encoding.ids for encoding in found]
            self._keep(part, np.array([number for ids in lists for number in ids], np.uint32), np.array(list(map(len, lists)), np.int64))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({word for word, number in zip(words, found) if number is None}))
            found = list(map(self.known.__getitem__, words))
        return np.array(found, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """All ids of each text. Plain texts are cut by their bytes and each distinct pre-token is looked up once;
        others by the pattern; those with a special token's string or doubtful white space are encoded in one piece."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and size < (1 << 20):
                size += len(texts[end])
                end += 1
            yield from self._encode_some(texts[begin:end])
            begin = end

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self._forget()
        made: list[np.ndarray | None] = [None] * len(texts)
        coded = [text.encode() for text in texts]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, coded)))]).astype(np.int64)
        fine = plain_texts(np.frombuffer(b"".join(coded), np.uint8), offsets)
        special = [any(token in text for token in self.added) for text in texts]
        chosen = [at for at in range(len(texts)) if fine[at] and coded[at] and not special[at]]
        if chosen:
            whole = b"".join(coded[at] for at in chosen)
            raw, bounds = np.frombuffer(whole, np.uint8), np.concatenate([[0], np.cumsum([len(coded[at]) for at in chosen])]).astype(np.int64)
            starts = token_starts(raw, bounds)
            sizes = np.diff(np.append(starts, len(raw)))
            first, group = equal_ranges(raw, starts, sizes)
            numbers = self._numbers([whole[one: one + n] for one, n in zip(starts[first].tolist(), sizes[first].tolist())])[group]
            lengths = self.lengths[numbers]
            ids = self.flat[spread(self.begins[numbers], lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, bounds)]
            for at, one, two in zip(chosen, ends[:-1].tolist(), ends[1:].tolist()):
                made[at] = ids[one:two]
        for at, text in enumerate(texts):
            if made[at] is None:
                if special[at] or _UNSURE.search(text):
                    made[at] = self.ids_of(text)
                else:
                    numbers = self._numbers([word.encode() for word in self.split(text)])
                    made[at] = self.flat[spread(self.begins[numbers], self.lengths[numbers])]
        return made


_ENCODERS: dict[tuple[str, int], _Words] = {}


def encoder(path: str, limit: int = 700_000) -> _Words:
    """One per worker process; `limit` bounds the pre-tokens kept."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = _Words(path, limit)
    return _ENCODERS[path, limit]


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any store pyarrow can open by URI; `file:/x`, as Hadoop writes it, is a local path."""
    local = re.match(r"file:(?://)?(/[^/].*)", folder)
    return (pyarrow.fs.LocalFileSystem(), local[1]) if local else pyarrow.fs.FileSystem.from_uri(folder)


class TokenFiles(NamedTuple):
    folder: str
    files: DataFrame  # path, n_docs, n_ids, start (ids in all files before it)
    dictionary: str  # its hash


def train_dictionary(docs: DataFrame, tokenizer: str, text_col: str, width: int, sample_docs: int, size: int) -> bytes:
    """A dictionary of at most `size` bytes, fitted on the ids of at most `sample_docs` different texts chosen by hash.

    One task encodes the sample; the driver gets the dictionary alone.
    """
    chosen = docs.select(F.col(text_col).alias("text")).filter(F.octet_length("text") > 0)
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    total = chosen.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    # twice as many as wanted by hash, then, without copies, the first of them
    share = int(min(1.0, 2 * sample_docs / max(1, total)) * (1 << 30))
    chosen = chosen.filter(hashed < share).distinct().orderBy(hashed, "text").limit(sample_docs)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, samples = encoder(tokenizer), []
        for batch in batches:
            for made in words.encode(column(batch, "text").to_pylist()):
                ids = made.astype(f"<u{width}").tobytes()
                samples += [ids[at: at + 65536] for at in range(0, len(ids), 65536)]
        made = b""
        if sum(map(len, samples)) >= 16 * size and len(samples) >= 50:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        elif samples:
            made = b"".join(samples)[-size:]  # too few for statistics: plain content serves as the dictionary
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    rows = chosen.repartition(1).mapInArrow(fit, "dictionary binary").collect()
    return bytes(rows[0]["dictionary"]) if rows else b""


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
                      text_col: str = "text", sample_docs: int = 2000, dictionary_size: int = 65536,
                      level: int = 3) -> TokenFiles:
    """Encode every text and write the ids in ascending id order, a file per range of ids.

    A null text is empty; `end_id`, if given, ends each document. Rows with equal or null ids (which come first) are
    ordered by text hash; equal rows are written as often as they occur. Other columns are ignored. An empty table
    gives no file. Each attempt of a task writes a file of its own; only files of committed tasks are listed.
    """
    spark = prepare(docs.sparkSession)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, text_col, width, sample_docs, dictionary_size)
    name = hashlib.sha256(dictionary).hexdigest()
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}.dictionary") as out:
        out.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)
    ending = np.array([] if end_id is None else [end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, index, place = None, None, [], struct.calcsize(HEAD)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                words = encoder(tokenizer)
                packer = zstandard.ZstdCompressor(level=level, dict_data=_shared(sent.value), write_content_size=True)
                place_in, root = filesystem(folder)
                path = f"{root}/{uuid.uuid4().hex}.tokens"
                out = place_in.open_output_stream(path)
                out.write(struct.pack(HEAD, MAGIC, width, bytes.fromhex(name)))
            texts = [text or "" for text in column(batch, "text").to_pylist()]
            for doc_id, found in zip(column(batch, "id").to_pylist(), words.encode(texts)):
                ids = np.concatenate([found, ending])
                frame = packer.compress(ids.astype(f"<u{width}").tobytes())
                out.write(frame)
                index.append((place, len(frame), len(ids), doc_id or 0, doc_id is not None))
                place += len(frame)
        if out is not None:
            entries = np.array(index, ENTRY)
            out.write(entries.tobytes())
            out.write(struct.pack(TAIL, place, len(entries), MAGIC))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path.rpartition("/")[2]]), pa.array([len(entries)], pa.int64()), pa.array([int(entries["ids"].sum())], pa.int64())],
                names=["path", "n_docs", "n_ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions(F.col("id"), F.xxhash64("text"), "text")
    written = materialize(
        placed.withColumn("part", F.spark_partition_id()).mapInArrow(_numbered(write), "path string, n_docs long, n_ids long, part int")
    )
    files, start = [], 0
    for row in written.orderBy("part").collect():  # one row per file
        files.append((row["path"], row["n_docs"], row["n_ids"], start))
        start += row["n_ids"]
    listed = spark.createDataFrame(files, "path string, n_docs long, n_ids long, start long")
    return TokenFiles(folder, listed, name)


def _numbered(write):
    """Add the number of the partition, which orders the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = []

        def noted():
            for batch in batches:
                if batch.num_rows and not part:
                    part.append(column(batch, "part")[0].as_py())
                yield batch

        for made in write(noted()):
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(part, pa.int32())], names=[*made.schema.names, "part"])

    return run


class Reader:
    """One file: its index, and any document without reading the others."""

    def __init__(self, folder: str, path: str):
        store, base = filesystem(folder)
        self.file = store.open_input_file(f"{base}/{path}")
        size = self.file.size()
        place, count, magic = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        head, self.width, name = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, place), ENTRY)
        with store.open_input_stream(f"{base}/{name.hex()}.dictionary") as stream:
            dictionary = stream.read()
        if hashlib.sha256(dictionary).digest() != name:
            raise ValueError(f"the dictionary of {path} has another hash")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_shared(dictionary))

    def document(self, number: int) -> np.ndarray:
        entry = self.index[number]
        frame = self.file.read_at(int(entry["bytes"]), int(entry["offset"]))
        return np.frombuffer(self.unpacker.decompress(frame), f"<u{self.width}").astype("<u4")


def read_token_files(made: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as u32)."""
    folder = made.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist()):
                reader = Reader(folder, path)
                index = reader.index
                sums = [zlib.crc32(reader.document(number).tobytes()) for number in range(len(index))]
                before = np.concatenate([[0], np.cumsum(index["ids"].astype(np.int64))[:-1]]) + start
                ids = pa.array(index["doc_id"].astype(np.int64), mask=index["has_id"] == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(before, pa.int64()), pa.array(index["ids"].astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    count = max(1, made.files.count())
    return made.files.repartition(count).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(made: TokenFiles, path: str, numbers: list[int]) -> list[np.ndarray]:
    """The ids of single documents of one file."""
    reader = Reader(made.folder, path)
    return [reader.document(number) for number in numbers]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
