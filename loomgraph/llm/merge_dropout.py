"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

Merges run by agenda: the candidate with the best score first, the leftmost among equals. Each candidate that comes up
is skipped at the dropout rate. Words (a run of spaces and what follows up to the next space) are merged on their own:
no piece continues past a space. Every occurrence of a word draws its own skips by the keyed hash of (seed, document,
word number, skip number), so any worker repeats them exactly.

Instead of a draw per candidate an occurrence draws how many candidates go by before its next skip (geometric, which is
the same law). What a word becomes depends on the places of its skips only, so it is kept in a tree per word: a node
stands for the skips so far, holds the ids if no other follows, and the number of candidates that come up until then.

Characters that the vocabulary lacks become byte pieces, as does a literal U+2581, which stands for a space inside
pieces; so decoding gives back every text. With dropout 0 the ids are those of the sentencepiece library for texts
without U+2581 that its normalizer leaves alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from loomgraph.llm.common import append, column, mixed, put, spread

_WORDS = re.compile(r" *[^ ]+| +")
_SPACE = "▁"
_LITERAL = "\0" + _SPACE  # no piece is spelled so
_MASK = (1 << 64) - 1
_PLACE, _PIECE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NEVER = np.iinfo(np.int64).max
CLOSED = 1 << 30
UNKNOWN = 1 << 30  # symbols from here on are characters without a piece


class Vocabulary:
    """Pieces, scores and bytes of a model file; the segmentations of words seen so far."""

    def __init__(self, path: str, room: int = 250_000):
        model = SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids, self.spelled = [0] * 256, []
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                self.byte_ids[int(piece[3:5], 16)] = number
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                self.spelled.append(b"")
            else:
                self.scores[piece] = (-model.get_score(number), number)
                self.spelled.append(piece.replace(_SPACE, " ").encode())
        if any(_SPACE in piece.lstrip(_SPACE) for piece in self.scores):
            raise ValueError("pieces of this model run on past a space")
        if not all(self.byte_ids):
            raise ValueError("this model has no byte pieces")
        self.piece_lengths = np.array(list(map(len, self.spelled)))
        self.piece_begins = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.room = room
        self._forget()
        self._tables()

    def _tables(self) -> None:
        """Symbols of single characters, and for every pair of pieces that merges its key and, in one number, the rank of
        its score and its piece. Pieces of equal score have equal ranks."""
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(UNKNOWN)
        for piece, (_, number) in self.scores.items():
            if len(piece) == 1 and piece != _SPACE:
                self.symbol[ord(piece)] = number
        self.symbol[ord(" ")] = self.scores[_SPACE][1]
        longer = [(cost, number) for piece, (cost, number) in self.scores.items() if len(piece) > 1]
        ranks = {cost: rank for rank, cost in enumerate(sorted({cost for cost, _ in longer}))}
        self.tied = len(ranks) < len(longer)
        self.piece_of_rank = np.zeros(len(ranks), np.int32)
        for cost, number in longer:
            self.piece_of_rank[ranks[cost]] = number
        pairs = {
            self.scores[piece[:at]][1] << 32 | self.scores[piece[at:]][1]: ranks[cost] << 20 | number
            for piece, (cost, number) in self.scores.items()
            for at in range(1, len(piece)) if piece[:at] in self.scores and piece[at:] in self.scores
        }
        # a hash table of pairs with linear probing, as many probes as its worst key needs
        self.shift = np.uint64(64 - 20)
        slots, self.probes = 1 << 20, 1
        self.pair_keys, self.pair_values = np.full(slots + 64, -1, np.int64), np.full(slots + 64, NEVER, np.int64)
        for key, value in pairs.items():
            slot = (key * int(_PLACE) & _MASK) >> int(self.shift)
            probes = 1
            while self.pair_keys[slot] >= 0:
                slot, probes = slot + 1, probes + 1
            self.pair_keys[slot], self.pair_values[slot] = key, value
            self.probes = max(self.probes, probes)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece of pairs of symbols, NEVER if they do not merge."""
        wanted = left.astype(np.int64) << 32 | right
        slot = (wanted.view(np.uint64) * _PLACE >> self.shift).astype(np.int64)
        keys = self.pair_keys[slot]
        found = np.where(keys == wanted, self.pair_values[slot], NEVER)
        late = np.nonzero((keys != wanted) & (keys >= 0))
        for step in range(1, self.probes):
            if not len(late[0]):
                break
            at = slot[late] + step
            keys = self.pair_keys[at]
            hit = keys == wanted[late]
            found[tuple(part[hit] for part in late)] = self.pair_values[at[hit]]
            more = ~hit & (keys >= 0)
            late = tuple(part[more] for part in late)
        return found

    def skip_all(self, words: list[str], sizes: np.ndarray, plans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`skip_at` for many words at once: (ids one after another, how many of each word, candidates).

        `plans` has a row of skips per word, -1 beyond the last. Each round takes every word's best candidate; a table
        has a row per place, so that every step runs along all words.
        """
        count, size = len(words), int(sizes.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.arange(size)[:, None] < sizes
        symbols = np.zeros((size, count), np.int32)
        symbols.T[inside.T] = self.symbol[codes]
        rounds = np.zeros(count, np.int64)
        rows = here = np.arange(count)
        # the rounds in which a word skips, and how many of them it has had
        planned = np.concatenate([plans, np.full((count, 1), -1, np.int64)], axis=1)
        had, upcoming, number = np.zeros(count, np.int64), planned[:, 0], 0
        lengths, passed = sizes.astype(np.int64), np.zeros(count, np.int64)
        # rank and place in one number, so that the least is the best and, among equals, the leftmost
        costs = np.full((size, count), CLOSED, np.int32)
        for at in range(size - 1):
            costs[at] = np.where(inside[at + 1], self._cost(symbols[at], symbols[at + 1], at), CLOSED)
        done_rows, done_symbols, done_lengths = [], [], []
        while len(rows):
            width = int(lengths.max())  # beyond it nothing is left
            chosen = costs[: max(1, width - 1)].min(axis=0)
            open_rows = chosen < CLOSED >> 1
            left_open = np.count_nonzero(open_rows)
            if left_open < 0.7 * len(rows) or left_open == 0:
                closed, kept = np.flatnonzero(~open_rows), np.flatnonzero(open_rows)
                done_rows.append(rows[closed])
                done_symbols.append(symbols.take(closed, axis=1))
                done_lengths.append(lengths[closed])
                rounds[rows[closed]] = passed[closed]
                rows, planned, had, upcoming, lengths, passed, chosen, open_rows = (
                    part[kept] for part in (rows, planned, had, upcoming, lengths, passed, chosen, open_rows)
                )
                symbols, costs = symbols[:width].take(kept, axis=1), costs[:width].take(kept, axis=1)
                here = np.arange(len(rows))
                if not len(rows):
                    break
            best = chosen & 63
            skipped = (upcoming == number) & open_rows
            number += 1
            passed += open_rows
            late = np.flatnonzero(skipped)
            if len(late):
                had[late] += 1
                upcoming[late] = planned[late, had[late]]
                costs[best[late], late] = CLOSED
            # what stands right of the merged pair moves up
            merges = open_rows & ~skipped
            go = np.flatnonzero(merges)
            spot = best[go]
            if self.tied:  # pieces of equal score are told apart by the pair
                pieces = self._look_up(symbols[spot, go], symbols[spot + 1, go]) & ((1 << 20) - 1)
            else:
                pieces = self.piece_of_rank[chosen[go] >> 6]
            merged = np.where(merges, best, size)
            for at in range(int(merged.min()) + 1, width):
                moves = merged < at
                last = at + 1 == len(symbols)
                np.copyto(symbols[at], 0 if last else symbols[at + 1], where=moves)
                np.copyto(costs[at], CLOSED if last else costs[at + 1] - 1, where=moves)
            lengths[go] -= 1
            across = len(rows)
            flat_symbols, flat_costs = symbols.reshape(-1), costs.reshape(-1)
            flat_symbols[spot * across + go] = pieces
            # both pairs that the new piece is in
            spots, lines = np.concatenate([spot - 1, spot]), np.concatenate([go, go])
            real = spots >= 0
            spots, lines = spots[real], lines[real]
            cells = spots * across + lines
            fine = spots + 1 < lengths[lines]
            flat_costs[cells[~fine]] = CLOSED
            cells = cells[fine]
            flat_costs[cells] = self._cost(flat_symbols[cells], flat_symbols[cells + across], spots[fine])
        width = max(len(part) for part in done_symbols)
        done_symbols = [np.pad(part, ((0, width - len(part)), (0, 0))) for part in done_symbols]
        order, lasts = np.concatenate(done_rows), np.concatenate(done_lengths)
        found = np.concatenate(done_symbols, axis=1)
        back = np.argsort(order)
        found, lasts = found[:, back], lasts[back]
        flat = found.T[np.arange(len(found)) < lasts[:, None]]
        unknown = flat >= UNKNOWN
        if unknown.any():  # characters without a piece become those of their bytes
            owners = np.repeat(np.arange(count), lasts)
            spelled = [self._bytes_of(symbol - UNKNOWN) if odd else [symbol] for symbol, odd in zip(flat.tolist(), unknown.tolist())]
            sizes = np.array(list(map(len, spelled)))
            flat = np.array([number for part in spelled for number in part], np.int32)
            lasts = np.bincount(owners, weights=sizes, minlength=count).astype(np.int64)
        return flat.astype(np.uint32), lasts, rounds

    def _cost(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        found = self._look_up(left, right)
        return np.where(found == NEVER, CLOSED, (found >> 20 << 6) + place).astype(np.int32)

    def _bytes_of(self, code: int) -> list[int]:
        return [self.byte_ids[byte] for byte in chr(code).encode("utf-8", "surrogatepass")]

    def _add(self, words: list[str], plans: np.ndarray, roots: np.ndarray | None, parents: np.ndarray) -> np.ndarray:
        """New nodes, a word and its skips each; those of words of similar lengths are merged together. A root is its own root."""
        sizes = np.array(list(map(len, words)))
        nodes = np.zeros(len(words), np.int64)
        classes = np.where(sizes <= 64, (sizes + 3) // 4, 17)
        for kind in np.unique(classes).tolist():
            every = np.flatnonzero(classes == kind)
            for begin in range(0, len(every), 5_000):
                rows = every[begin: begin + 5_000]
                mine = [words[at] for at in rows.tolist()]
                if kind > 16:
                    made = [self.skip_at(word, tuple(plan[plan >= 0].tolist())) for word, plan in zip(mine, plans[rows])]
                    flat = np.array([number for ids, _ in made for number in ids], np.uint32)
                    lengths, rounds = np.array([len(ids) for ids, _ in made]), np.array([number for _, number in made])
                else:
                    flat, lengths, rounds = self.skip_all(mine, sizes[rows], plans[rows])
                first = self.count
                self.count += len(rows)
                nodes[rows] = np.arange(first, self.count)
                skips = plans[rows, -1] if plans.shape[1] else np.full(len(rows), -1)
                begins = self.used + np.cumsum(lengths) - lengths
                for name, values in (
                    ("begins", begins), ("lengths", lengths), ("rounds", rounds), ("parents", parents[rows]), ("skips", skips),
                    ("roots_of", nodes[rows] if roots is None else roots[rows]),
                ):
                    setattr(self, name, put(getattr(self, name), first, values))
                self.flat = put(self.flat, self.used, flat)
                self.used += len(flat)
        return nodes

    def skip_at(self, word: str, skips: tuple[int, ...]) -> tuple[list[int], int]:
        """The ids of one word, and how many candidates come up; those numbered in `skips` are left out."""
        number, left_out = 0, set(skips)
        scores = self.scores
        symbols: list[str | None] = [_SPACE if sign == " " else _LITERAL if sign == _SPACE else sign for sign in word]
        count = len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        agenda = []
        for left in range(count - 1):
            made = symbols[left] + symbols[left + 1]
            if made in scores:
                agenda.append((scores[made][0], left, left + 1, made))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, made = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != made:
                continue
            number += 1
            if number - 1 in left_out:
                continue
            symbols[left], symbols[right] = made, None
            follower = after[right]
            after[left] = follower
            if follower < count:
                before[follower] = left
                joined = made + symbols[follower]
                if joined in scores:
                    heapq.heappush(agenda, (scores[joined][0], left, follower, joined))
            previous = before[left]
            if previous >= 0:
                joined = symbols[previous] + made
                if joined in scores:
                    heapq.heappush(agenda, (scores[joined][0], previous, left, joined))
        ids = []
        for symbol in symbols:
            if symbol is None:
                continue
            if symbol in scores:
                ids.append(scores[symbol][1])
            else:
                ids += [self.byte_ids[code] for code in symbol.removeprefix("\0" * (symbol == _LITERAL)).encode("utf-8", "surrogatepass")]
        return ids, number

    def encode(self, texts: list[str], seed: int, owners: list[str], dropout: float, at_a_time: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time (`at_a_time` characters or one text): how many ids each has, and all their ids. The keyed hash of (seed, owner, word number,
        skip number) draws every skip."""
        with np.errstate(divide="ignore"):
            rate = np.log1p(-np.float64(dropout))
        begin = 0
        while begin < len(texts):
            end, size, counts, keys = begin, 0, [], []
            found: list[str] = []
            while end < len(texts) and size < at_a_time:
                mine = _WORDS.findall(" " + texts[end]) if texts[end] else []
                start = np.array([zlib.crc32(owners[end].encode("utf-8", "surrogatepass")) | (seed & 0xFFFFFFFF) << 32], np.uint64)
                keys.append(mixed(mixed(start) + np.arange(len(mine), dtype=np.uint64) * _PLACE))
                counts.append(len(mine))
                found += mine
                size += len(texts[end])
                end += 1
            if self.count > self.room:
                self._forget()
            nodes = self._roots(found)
            if dropout:
                self._walk(nodes, np.concatenate(keys), rate)
            lengths = self.lengths[nodes]
            ids = self.flat[spread(self.begins[nodes], lengths)]
            sums = np.concatenate([[0], np.cumsum(lengths)])
            ends = np.cumsum(counts)
            yield np.diff(sums[np.concatenate([[0], ends])]), ids
            begin = end

    def _forget(self) -> None:
        """Empty the trees."""
        self.known: dict[str, int] = {}
        self.words: dict[int, str] = {}
        self.children: dict[int, int] = {}
        self.count = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        # of each node: where its ids are, how many candidates come up, what it is reached from and by which skip
        self.begins, self.lengths, self.rounds, self.parents, self.skips, self.roots_of = (np.zeros(1 << 16, np.int64) for _ in range(6))

    def _roots(self, found: list[str]) -> np.ndarray:
        nodes = list(map(self.known.get, found))
        if None in nodes:
            new = list({word for word, node in zip(found, nodes) if node is None})
            made = self._add(new, np.zeros((len(new), 0), np.int64), None, np.full(len(new), -1)).tolist()
            self.known.update(zip(new, made))
            self.words.update(zip(made, new))
            nodes = list(map(self.known.__getitem__, found))
        return np.array(nodes, np.int64)

    def _walk(self, nodes: np.ndarray, keys: np.ndarray, rate: np.float64) -> None:
        """Move every occurrence from the root of its word to the node of its skips."""
        here, step = np.arange(len(nodes)), 0
        at, passed = nodes, np.zeros(len(nodes), np.int64)
        while len(here):
            step += 1
            drawn = mixed(keys[here] + np.uint64(step * int(_PIECE) & _MASK))
            gaps = np.log(((drawn >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / rate
            skip = passed + np.minimum(gaps, 1 << 40).astype(np.int64)
            more = skip < self.rounds[at]
            here, at, skip = here[more], at[more], skip[more]
            wanted, back = np.unique(at << 32 | skip, return_inverse=True)
            found = np.array([self.children.get(key, -1) for key in wanted.tolist()], np.int64)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                parents, skips = wanted[missing] >> 32, wanted[missing] & 0xFFFFFFFF
                plans = np.zeros((len(missing), step), np.int64)
                plans[:, -1], above = skips, parents
                for place in range(step - 2, -1, -1):
                    plans[:, place], above = self.skips[above], self.parents[above]
                roots = self.roots_of[parents]
                found[missing] = self._add([self.words[root] for root in roots.tolist()], plans, roots, parents)
                self.children.update(zip(wanted[missing].tolist(), found[missing].tolist()))
            at, passed = found[back], skip + 1
            nodes[here] = at

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids spell, and how many each id has."""
        lengths = self.piece_lengths[ids]
        return self.piece_bytes[spread(self.piece_begins[ids], lengths)], lengths

    def texts_of(self, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        """The texts of runs of ids, without the space that encoding puts in front."""
        raw, lengths = self.decode(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        whole, begin = raw.tobytes(), 0
        for end in ends.tolist():
            yield whole[begin + 1: end]
            begin = end


_VOCABULARIES: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, seed: int = 0, dropout: float = 0.0, room: int = 250_000) -> Vocabulary:
    """One per worker process, model, seed and rate; `room` bounds the segmented words kept."""
    key = (path, seed, dropout, room)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(path, room)
    return _VOCABULARIES[key]


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    """A list of ids per text."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def _owned(batch: pa.RecordBatch, id_col: str, text_col: str) -> tuple[list[str], list[str]]:
    """Texts, and what keys their draws."""
    texts = [text or "" for text in column(batch, text_col).to_pylist()]
    return texts, [text if owner is None else owner for owner, text in zip(column(batch, id_col).cast(pa.string()).to_pylist(), texts)]


def encode(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1, id_col: str = "doc_id",
           text_col: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with `out`, the ids of the whole text.

    Null and empty texts have none. The id (or, where it is null, the text) keys the draws, so repeated rows are
    segmented alike. An input column named like `out` is replaced; all others pass through.
    """
    if not 0 <= dropout <= 1:
        raise ValueError("dropout is a share")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        words, (texts, owners) = vocabulary(model, seed, dropout), _owned(batch, id_col, text_col)
        counts, ids = zip(*words.encode(texts, seed, owners, dropout))
        return [_lists(np.concatenate(counts), np.concatenate(ids))]

    return append(docs, compute, [T.StructField(out, T.ArrayType(T.IntegerType(), True))], slice_bytes=1 << 20)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with `out`, the text of its ids; null for null ids."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        every = column(batch, ids_col).to_pylist()
        counts = np.array([len(ids or ()) for ids in every], np.int64)
        flat = np.array([number for ids in every for number in ids or ()], np.int64)
        made = vocabulary(model).texts_of(counts, flat)
        return [pa.array([None if ids is None else text.decode("utf-8", "replace") for ids, text in zip(every, made)], pa.string())]

    return append(encoded, compute, [T.StructField(out, T.StringType())])


def round_trip(docs: DataFrame, model: str, seed: int = 0, dropout: float = 0.1, id_col: str = "doc_id",
               text_col: str = "text", keep_ids: bool = False, room: int = 250_000, slice_bytes: int = 1 << 20) -> DataFrame:
    """`docs` with n_tokens, ids_crc32 (of the ids as little-endian u32), decoded_sha256 (of the decoded text) and
    lossless: whether decoding the ids gives back the text (null counts as empty); with `keep_ids` also ids.

    One pass encodes and decodes, so a task has one Python worker and one table of pieces. A worker's memory follows
    `slice_bytes` and `room`; they change the cost only.
    """
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType()),
        *[T.StructField("ids", T.ArrayType(T.IntegerType(), True))] * keep_ids,
    ]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        words = vocabulary(model, seed, dropout, room)
        texts, owners = _owned(batch, id_col, text_col)
        rows, kept, at = [], [], 0
        for counts, ids in words.encode(texts, seed, owners, dropout, slice_bytes):
            begin, data = 0, ids.astype("<u4").tobytes()
            for count, decoded in zip(counts.tolist(), words.texts_of(counts, ids)):
                sums = zlib.crc32(data[begin: begin + 4 * count])
                rows.append((count, sums, hashlib.sha256(decoded).hexdigest(), decoded == texts[at].encode()))
                begin, at = begin + 4 * count, at + 1
            kept += [ids] * keep_ids
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        made = [pa.array([row[at] for row in rows], kind) for at, kind in enumerate(kinds)]
        return made + [_lists(np.array([row[0] for row in rows], np.int64), np.concatenate(kept))] * keep_ids if keep_ids else made

    return append(docs, compute, fields, slice_bytes=slice_bytes)
