"""Toxicity of deobfuscated text.

A noisy channel writes letters as look-alikes, repeats them or spaces them out. Suspicious stretches become character
lattices; Viterbi decoding under a character 4-gram model counted over all documents restores them. Words of the text
and of its restored stretches are then scored: a word, or the first letters of a word, counts by how surely labelled
documents that have it are toxic.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, joined_text, mixed, prepare

SLICE = 1 << 20
SPACE, WIDE, DIGIT, OTHER, SYMBOLS = 0, 27, 28, 29, 32


def _class_of(code: int) -> int:
    if code in b" \t\n\r\x0b\x0c":
        return SPACE
    if 65 <= code <= 90 or 97 <= code <= 122:
        return (code | 32) - 96
    return WIDE if code >= 128 else DIGIT if 48 <= code <= 57 else OTHER


CLASS = np.array([_class_of(code) for code in range(256)], np.uint8)
LOWER = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))

# Look-alikes the channel writes for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
# Doubled signs the channel writes for one letter.
DOUBLED = {"0": "u"}
# Costs in nats.
COST_LOOKALIKE, COST_LITERAL, COST_DROP_REPEAT, COST_DROP_GAP, COST_KEEP_GAP, COST_DROP_SIGN = 0.5, 3.0, 0.2, 0.1, 4.0, 4.0
# A doubled letter or sign is often meant; a mark at the edge of a token often is no letter.
COST_DROP_DOUBLE, COST_EDGE_MARK = 2.5, 0.5

_SIGNS = "".join(LOOKALIKES)
LOOKS = np.zeros(256, bool)
LOOKS[[code for sign in _SIGNS for code in sign.encode()]] = True
_LEET = re.compile(rf"(?<![a-z{_SIGNS}])(?:[a-z]++[{_SIGNS}]|[{_SIGNS}]++[a-z])[a-z{_SIGNS}]*+")
_REPEAT = re.compile(r"(?<![a-z])(?=[a-z]*?([a-z])\1)[a-z]++")
_LETTERS = re.compile(r"[a-z]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[a-z0-9@$!|+][ .\-_*]{1,3}){3,}[a-z0-9@$!|+](?![^\W_])")


class CharModel:
    """Log probabilities of a symbol after three others, interpolated down to single symbols."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        grams = np.zeros(SYMBOLS**4)
        grams[codes] = counts
        table = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in (1, 2, 3, 4):
            seen = grams.reshape(-1, SYMBOLS**order).sum(axis=0).reshape(-1, SYMBOLS)
            lower = np.tile(table.reshape(-1, SYMBOLS), (len(seen) // max(1, table.size // SYMBOLS), 1))
            table = (seen + 5 * lower) / (seen.sum(axis=1, keepdims=True) + 5)
        self.log = np.log(table).astype(np.float32).ravel()

    def cost(self, state: int, symbol: int) -> float:
        return -float(self.log[state * SYMBOLS + symbol])


def count_grams(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The character model of all texts. Its table has 32^4 cells whatever the corpus; counts add up in partitions first."""

    def count(batches):
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            raw, offsets = joined_text(batch, text_col)
            ends = offsets[1:-1]
            for begin in range(0, len(raw), SLICE):
                piece = CLASS[raw[begin: begin + SLICE + 3]].astype(np.int64)
                if len(piece) < 4:
                    continue
                keys = ((piece[:-3] * SYMBOLS + piece[1:-2]) * SYMBOLS + piece[2:-1]) * SYMBOLS + piece[3:]
                fine = np.ones(len(keys), bool)
                for back in (1, 2, 3):  # a gram does not run on into the next text
                    at = ends - back - begin
                    fine[at[(at >= 0) & (at < len(keys))]] = False
                total += np.bincount(keys[fine], minlength=SYMBOLS**4)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])

    prepare(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return CharModel(counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))


@lru_cache(maxsize=64)
def _inner(segment: str) -> tuple[int, int]:
    """Where the signs before the first letter end and where those after the last one begin."""
    return len(segment) - len(segment.lstrip(_SIGNS)), len(segment.rstrip(_SIGNS))


def _options(segment: str, at: int, spaced: bool) -> list[tuple[str, float]]:
    """What the channel may have been given at a place of the lattice, and at what cost."""
    sign = segment[at]
    if spaced and sign in " .-_*":
        return [("", COST_DROP_GAP), (" ", COST_KEEP_GAP)]
    dropped = []
    if at > 0 and segment[at - 1] == sign:
        longer = at > 1 and segment[at - 2] == sign or segment[at + 1: at + 2] == sign
        dropped = [("", COST_DROP_REPEAT if longer else COST_DROP_DOUBLE)]
    if sign.isalpha():
        return [(sign, 0.0), *dropped]
    found = [(letter, COST_LOOKALIKE) for letter in LOOKALIKES.get(sign, "")]
    if segment[at + 1: at + 2] == sign and segment[max(0, at - 1): at] != sign:
        found += [(letter, COST_LOOKALIKE) for letter in DOUBLED.get(sign, "")]  # its second sign is dropped
    first, last = _inner(segment)
    edge = sign in "!|+($@€" and not first <= at < last
    return [*found, *dropped, (sign, COST_EDGE_MARK if edge else COST_LITERAL), ("", COST_DROP_SIGN)]


def _symbol(text: str) -> int:
    return int(CLASS[ord(text)]) if ord(text) < 128 else WIDE


def decode(segment: str, model: CharModel, spaced: bool = False) -> str:
    """The cheapest reading of a segment. States are the last three symbols, so paths that share them compete."""
    # a path is linked backwards: (what came before, what is said last)
    paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for at in range(len(segment)):
        new: dict[int, tuple[float, tuple | None]] = {}
        options = _options(segment, at, spaced)
        for state, (cost, path) in paths.items():
            for said, price in options:
                if said:
                    symbol = _symbol(said)
                    total, after = cost + price + model.cost(state, symbol), (state * SYMBOLS + symbol) % SYMBOLS**3
                else:
                    total, after = cost + price, state
                if after not in new or total < new[after][0]:
                    new[after] = (total, (path, said) if said else path)
        paths = new
    path = min((cost + model.cost(state, SPACE), state) for state, (cost, _) in paths.items())[1]
    path, made = paths[path][1], []
    while path:
        path, said = path
        made.append(said)
    return "".join(reversed(made))


def restorations(text: str, model: CharModel, known: dict[tuple[str, bool], str], room: int = 200_000) -> list[tuple[int, int, str]]:
    """(first, end, restored) of every suspicious stretch of a lower-cased text whose best reading differs."""
    found = []
    for pattern, spaced in ((_LEET, False), (_REPEAT, False), (_SPACED, True)):
        for match in pattern.finditer(text):
            key = (match[0], spaced)
            if key not in known:
                if len(known) >= room:
                    known.clear()
                # long stretches, too, are decoded whole: the cost is linear
                said = decode(match[0], model, spaced)
                # a reading of the same words says nothing new
                known[key] = match[0] if _LETTERS.findall(said) == _LETTERS.findall(match[0]) else said
            if known[key] != match[0]:
                found.append((match.start(), match.end(), known[key]))
    return found


def restored_text(text: str, model: CharModel) -> str:
    """The text, lower-cased (A-Z), with its suspicious stretches restored; of overlapping ones the first counts."""
    lowered = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    made, at = [], 0
    for first, end, said in sorted(restorations(lowered, model, {})):
        if first >= at:
            made += [lowered[at:first], said]
            at = end
    return "".join([*made, lowered[at:]])


def word_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every word and its first 4 and first 5 bytes, the places of their words, and the words' hashes in order. Words are runs of letters and non-ASCII bytes."""
    kinds = CLASS[raw]
    inside = (kinds >= 1) & (kinds <= WIDE)
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    lower = np.frombuffer(LOWER, np.uint8)[raw].astype(np.uint64)
    hashes, places = [], []
    key = np.full(len(starts), 14695981039346656037, np.uint64)
    active = np.arange(len(starts))
    step = 0
    with np.errstate(over="ignore"):
        while len(active):
            key[active] = (key[active] ^ lower[starts[active] + step]) * np.uint64(1099511628211)
            step += 1
            if step in (4, 5):
                longer = active[lengths[active] > step]
                hashes.append(mixed(key[longer] + np.uint64(step)))
                places.append(starts[longer])
            active = active[lengths[active] > step]
        hashes.append(mixed(key))
    places.append(starts)
    return np.concatenate(hashes), np.concatenate(places), hashes[-1]


class Evidence(NamedTuple):
    hashes: np.ndarray  # sorted
    surety: np.ndarray  # share of toxic documents among those with the feature, smoothed
    rest: float  # score of a text without evidence


def _document_features(raw, offsets, model, known):
    """Yield (document, feature hash) pairs, some documents at a time: of the texts and of what their stretches restore to."""
    for begin, end in _groups(offsets):
        part = raw[offsets[begin]: offsets[end]]
        bounds = offsets[begin: end + 1] - offsets[begin]
        hashes, places, _ = word_features(part)
        numbers = np.searchsorted(bounds, places, "right") - 1
        data, owners, texts = part.tobytes().translate(LOWER), [], []
        for number in np.flatnonzero(_suspicious(part, bounds)).tolist():
            text = data[bounds[number]: bounds[number + 1]].decode("utf-8", "replace")
            said = " ".join(restored for _, _, restored in restorations(text, model, known))
            if said:
                owners.append(number)
                texts.append(said.encode())
        if texts:
            starts = np.concatenate([[0], np.cumsum([len(text) + 1 for text in texts])])
            more, places, _ = word_features(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
            hashes = np.concatenate([hashes, more])
            numbers = np.concatenate([numbers, np.array(owners)[np.searchsorted(starts, places, "right") - 1]])
        yield numbers + begin, hashes


def _copy_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the least hash of three words in a row, or of its words if it has fewer."""
    keys = np.zeros(len(offsets) - 1, np.int64)
    with np.errstate(over="ignore"):
        for number, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            words = word_features(raw[begin:end])[2]
            if len(words) >= 3:
                keys[number] = mixed(words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(7)).min().astype(np.int64)
            elif len(words):
                keys[number] = mixed(words.sum(keepdims=True))[0].astype(np.int64)
    return keys


def _groups(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes; a longer text is a range of its own."""
    made, begin = [], 0
    for number in range(1, len(offsets)):
        if offsets[number] - offsets[begin] >= SLICE or number == len(offsets) - 1:
            made.append((begin, number))
            begin = number
    return made


def _suspicious(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that may hold a stretch to restore: a cheap test before the patterns."""
    kinds = CLASS[raw]
    letter = (kinds >= 1) & (kinds <= 26)
    sign, look = (kinds >= DIGIT), LOOKS[raw]
    lower = np.frombuffer(LOWER, np.uint8)[raw]
    flag = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 1:
        flag[1:-1] = (letter[1:] & letter[:-1] & (lower[1:] == lower[:-1])) | (letter[1:] & look[:-1]) | (look[1:] & letter[:-1])
        alone = (letter | sign) & ~np.concatenate([[False], letter[:-1]]) & ~np.concatenate([letter[1:], [False]])
        for gap in (2, 3, 4):
            flag[gap:-1] |= alone[gap:] & alone[:-gap]
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] > total[offsets[:-1]]


def gather_evidence(labelled: DataFrame, model, text_col: str = "text", toxic_col: str = "toxic", sample_docs: int = 30_000,
                    min_odds: float = 2.0, min_surety: float = 0.9) -> Evidence:
    """Features of labelled documents and how surely they mark toxic ones.

    About `sample_docs` labelled rows, chosen by text hash, are used. A feature stays if at least `min_surety` of
    the documents that have it are toxic and the log odds ratio of its counts, less two standard errors, is at least
    `min_odds`. Rows without label teach nothing.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(toxic_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull())
    sizes = rows.agg(F.count("*").alias("all"), F.sum("toxic").alias("toxic")).first()
    if not sizes["all"] or not sizes["toxic"] or sizes["toxic"] == sizes["all"]:
        return Evidence(np.zeros(0, np.uint64), np.zeros(0), float(bool(sizes["toxic"])) * 0.5)
    share = min(1.0, sample_docs / sizes["all"])
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # copies teach once: rows that share their least three-word hash and their label are one
    key = T.StructField("copy_key", T.LongType())
    chosen = append(chosen, lambda batch: [pa.array(_copy_keys(*joined_text(batch)))], [key])
    chosen = chosen.groupBy("copy_key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")

    def rows_of(values, bad, good, total):
        return pa.RecordBatch.from_arrays(
            [pa.array(values), pa.array(bad, pa.int64()), pa.array(good, pa.int64()), pa.array([total] * len(values))],
            names=["feature", "bad", "good", "total"],
        )

    def count(batches):
        for batch in batches:
            raw, offsets = joined_text(batch)
            labels = np.array(batch.column(1).to_pylist(), bool)
            yield rows_of(np.zeros(1, np.int64), [int(labels.sum())], [int((~labels).sum())], True)
            for owners, hashes in _document_features(raw, offsets, model.value, _known(model.value)):
                order = np.lexsort((hashes, owners))
                owners, hashes = owners[order], hashes[order]
                first = np.ones(len(owners), bool)
                first[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
                values, back = np.unique(hashes[first], return_inverse=True)
                bad = np.bincount(back, weights=labels[owners[first]], minlength=len(values)).astype(np.int64)
                yield rows_of(values.view(np.int64), bad, np.bincount(back, minlength=len(values)) - bad, False)

    counts = chosen.mapInArrow(count, "feature long, bad long, good long, total boolean").groupBy("total", "feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    # the sample's own size comes with the counts; only features of three toxic documents or more travel to the driver
    found = counts.filter(F.col("total") | ((F.col("bad") >= 3) & (F.col("bad") > F.col("good")))).toPandas()
    sums = found[found["total"]]
    n_bad, n_good = int(sums["bad"].sum()), int(sums["good"].sum())
    found = found[~found["total"]]
    bad, good = found["bad"].to_numpy(np.float64), found["good"].to_numpy(np.float64)
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    surety = (bad + 0.5) / (bad + good + 1)
    keep = (odds - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)) >= min_odds) & (surety >= min_surety)
    hashes = found["feature"].to_numpy(np.int64).view(np.uint64)[keep]
    order = np.argsort(hashes)
    return Evidence(hashes[order], surety[keep][order], 0.02)


def score_texts(docs: DataFrame, model: CharModel, evidence: Evidence, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with score (0 to 1), predicted and n_evidence (features that mark toxic texts, as often as they occur).

    The score rises with the surest feature and with further ones. Null and empty texts have no evidence and the
    lowest score. Repeated rows score alike; columns named like a result are replaced.
    """
    context = prepare(docs.sparkSession).sparkContext
    sent_model, sent = context.broadcast(model), context.broadcast(evidence)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_evidence", T.LongType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, offsets = joined_text(batch, text_col)
        marks = sent.value
        best, hits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        if len(marks.hashes) and len(raw):
            for owners, hashes in _document_features(raw, offsets, sent_model.value, _known(sent_model.value)):
                at = np.minimum(np.searchsorted(marks.hashes, hashes), len(marks.hashes) - 1)
                found = marks.hashes[at] == hashes
                np.maximum.at(best, owners[found], marks.surety[at[found]])
                np.add.at(hits, owners[found], 1)
        score = np.where(hits > 0, 1 - (1 - best) / np.sqrt(np.maximum(hits, 1)), marks.rest)
        return [pa.array(np.clip(score, 0, 1)), pa.array(hits)]

    return append(docs, compute, fields).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _known(model: CharModel) -> dict:
    """Restored stretches, kept per worker with their model."""
    if not hasattr(model, "known"):
        model.known = {}
    return model.known


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", toxic_col: str = "toxic", **limits) -> tuple[CharModel, Evidence]:
    """The character model of all documents and the evidence of the labelled ones."""
    model = count_grams(docs, text_col)
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    return model, gather_evidence(labelled, sent, text_col, toxic_col, **limits)
