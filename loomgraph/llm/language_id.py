"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features are relative frequencies of hashed byte n-grams (1 to 4) of the whole lower-cased (A-Z) text. One linear SVM
per family separates it from the others; within the chosen family one SVM per pair of languages votes. All are trained
here on a bounded sample (`per_language` documents, no two alike), by dual coordinate descent; the bound is for the
classifiers only, every document is scored over its whole text.

Languages that no listed family has are put together by how near the averages of their samples are, a few to a family, so
that pairs grow with the languages and not with their square. Classifiers are applied a few at a time.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import append, joined_text, prepare

# Language families.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}
ORDERS = (1, 2, 3, 4)
BITS = 12
# languages of a family made from the data, and classifiers applied at a time
GROUP, BLOCK = 8, 8
WIDTH = 1 << BITS
SLICE = 1 << 20
_LOWER = np.array([code + 32 if 65 <= code <= 90 else code for code in range(256)], np.uint8)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_WIDE = re.compile(rb"[\x80-\xff]")
UNKNOWN = "und"


def families_of(languages: list[str], centres: np.ndarray) -> list[list[int]]:
    """The languages' numbers by family: listed families, then groups of at most GROUP others, the nearest centres together."""
    listed: dict[str, list[int]] = {}
    others = []
    for number, language in enumerate(languages):
        family = _FAMILY_OF.get(language.lower().split("-")[0])
        (others if family is None else listed.setdefault(family, [])).append(number)
    made = list(listed.values())
    while others:
        far = ((centres[others] - centres[others[0]]) ** 2).sum(axis=1)
        made.append([others[at] for at in np.argsort(far, kind="stable")[:GROUP].tolist()])
        others = [number for number in others if number not in made[-1]]
    return made


def gram_slices(raw: np.ndarray, offsets: np.ndarray):
    """Yield (order, first position, bucket of the n-gram at each position) over slices of bounded length.

    Positions whose n-gram would cross the end of its text have the bucket WIDTH.
    """
    ends = offsets[1:]
    for begin in range(0, len(raw), SLICE):
        stop = min(len(raw), begin + SLICE)
        piece = _LOWER[raw[begin: stop + max(ORDERS) - 1]].astype(np.uint32)
        size = stop - begin
        near = ends[np.searchsorted(ends, begin, "right"): np.searchsorted(ends, stop + max(ORDERS), "right")]
        for order in ORDERS:
            key = np.full(size, order, np.uint32)
            for step in range(order):
                part = piece[step: step + size]
                key[: len(part)] = (key[: len(part)] + part) * np.uint32(2654435761)
                key ^= key >> np.uint32(15)
            bucket = (key * np.uint32(2246822519) >> np.uint32(32 - BITS)).astype(np.int64)
            for back in range(1, order):
                at = near - back - begin
                bucket[at[(at >= 0) & (at < size)]] = WIDTH
            yield order, begin, bucket


def _owners(offsets: np.ndarray, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have positions in [begin, begin + size): where each starts in it, and its number."""
    inner = offsets[np.searchsorted(offsets, begin, "right"): np.searchsorted(offsets, begin + size, "left")]
    starts = np.unique(np.concatenate([[begin], inner]))
    return starts - begin, np.searchsorted(offsets, starts, "right") - 1


def frequencies(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: relative n-gram frequencies, order by order. For the bounded training sample."""
    rows = np.zeros((len(offsets) - 1, len(ORDERS) * WIDTH), np.float32)
    for order, begin, bucket in gram_slices(raw, offsets):
        starts, owners = _owners(offsets, begin, len(bucket))
        for first, last, owner in zip(starts, [*starts[1:], len(bucket)], owners):
            found = np.bincount(bucket[first:last], minlength=WIDTH + 1)[:WIDTH]
            rows[owner, (order - 1) * WIDTH: order * WIDTH] += found
    return rows / np.maximum(_grams(offsets).repeat(WIDTH, axis=1), 1).astype(np.float32)


def _grams(offsets: np.ndarray) -> np.ndarray:
    """Per text and order: how many n-grams it has."""
    lengths = np.diff(offsets)
    return np.stack([np.maximum(lengths - order + 1, 0) for order in ORDERS], axis=1)


def margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One row per text, one column per classifier. weights: (orders, WIDTH + 1, classifiers), last bucket zero."""
    sums = np.zeros((len(offsets) - 1, len(ORDERS), weights.shape[2]))
    for order, begin, bucket in gram_slices(raw, offsets):
        starts, owners = _owners(offsets, begin, len(bucket))
        for first in range(0, weights.shape[2], BLOCK):
            part = weights[order - 1][:, first: first + BLOCK][bucket]
            sums[owners, order - 1, first: first + BLOCK] += np.add.reduceat(part, starts, axis=0)
    return (sums / np.maximum(_grams(offsets), 1)[:, :, None]).sum(axis=1) + bias


def train_svm(rows: np.ndarray, chosen: np.ndarray, signs: np.ndarray, cost: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss over the chosen rows, by dual coordinate descent."""
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    extra = 1.0 / (2 * cost / (2 * share))
    norms = np.einsum("ij,ij->i", rows, rows)[chosen] + 1 + extra
    alpha, weights, bias = np.zeros(len(chosen)), np.zeros(rows.shape[1], np.float32), 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for at in order.permutation(len(chosen)):
            row = rows[chosen[at]]
            # einsum: no thread pool wakes up for these short products
            slope = signs[at] * (float(np.einsum("i,i->", row, weights)) + bias) - 1 + alpha[at] * extra[at]
            new = max(0.0, alpha[at] - slope / norms[at])
            if new != alpha[at]:
                weights += np.float32((new - alpha[at]) * signs[at]) * row
                bias += (new - alpha[at]) * signs[at]
                largest = max(largest, abs(new - alpha[at]))
                alpha[at] = new
        if largest < 1e-4:
            break
    return weights, bias


class Model:
    """Languages, families, a classifier per family, and within each family one per pair of its languages."""

    def __init__(self, languages: list[str], rows: np.ndarray, labels: np.ndarray):
        self.languages = languages
        centres = np.stack([rows[labels == number].mean(axis=0) for number in range(len(languages))])
        self.families = families_of(languages, np.sqrt(centres))
        owner = np.zeros(len(languages), np.int64)
        for number, members in enumerate(self.families):
            owner[members] = number
        # rare n-grams count more; one length for the average row
        scale = (1 / np.sqrt(rows.mean(axis=0) + 1e-4)).astype(np.float32)
        rows *= scale  # in place: the sample is held once
        scale /= max(np.sqrt(np.einsum("ij,ij->i", rows, rows)).mean(), 1e-9)
        rows /= max(np.sqrt(np.einsum("ij,ij->i", rows, rows)).mean(), 1e-9)

        def fitted(tasks) -> tuple[np.ndarray, np.ndarray]:
            weights, bias = np.zeros((len(ORDERS), WIDTH + 1, len(tasks)), np.float32), np.zeros(len(tasks))
            for at, (chosen, signs) in enumerate(tasks):
                found, bias[at] = train_svm(rows, chosen, signs)
                weights[:, :WIDTH, at] = (found * scale).reshape(len(ORDERS), WIDTH)
            return weights, bias

        every = np.arange(len(rows))
        heads = [(every, np.where(owner[labels] == number, 1.0, -1.0)) for number in range(len(self.families))]
        self.heads = fitted(heads) if len(self.families) > 1 else None
        self.pairs: list[list[tuple[int, int]]] = []
        self.votes: list[tuple[np.ndarray, np.ndarray] | None] = []
        for members in self.families:
            pairs = list(itertools.combinations(members, 2))
            tasks = [np.flatnonzero((labels == one) | (labels == two)) for one, two in pairs]
            self.pairs.append(pairs)
            self.votes.append(fitted([(rows_of, np.where(labels[rows_of] == one, 1.0, -1.0)) for rows_of, (one, _) in zip(tasks, pairs)]) if pairs else None)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text and how sure the least sure decision was. Of equal votes the first language wins."""
        count = len(offsets) - 1
        family, score = np.zeros(count, np.int64), np.ones(count)
        if self.heads is not None:
            found = margins(raw, offsets, *self.heads)
            family = found.argmax(axis=1)
            score = _sure(found[np.arange(count), family])
        chosen = np.array([members[0] for members in self.families])[family]
        for number, members in enumerate(self.families):
            texts = np.flatnonzero(family == number)
            if self.votes[number] is None or not len(texts):
                continue
            parts = [raw[offsets[at]: offsets[at + 1]] for at in texts.tolist()]
            ends = np.concatenate([[0], np.cumsum([len(part) for part in parts])]).astype(np.int64)
            found = margins(np.concatenate(parts), ends, *self.votes[number])
            votes = np.zeros((len(texts), len(self.languages)))
            for at, (one, two) in enumerate(self.pairs[number]):
                # a vote each, the margin decides ties
                votes[:, one] += (found[:, at] > 0) + 1e-3 * np.tanh(found[:, at])
                votes[:, two] += (found[:, at] <= 0) - 1e-3 * np.tanh(found[:, at])
            best = np.array(members)[votes[:, members].argmax(axis=1)]
            for at, (one, two) in enumerate(self.pairs[number]):
                sure = np.where(best == one, _sure(found[:, at]), np.where(best == two, 1 - _sure(found[:, at]), 1.0))
                score[texts] = np.minimum(score[texts], sure)
            chosen[texts] = best
        return [self.languages[number] for number in chosen.tolist()], score


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * margin))


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = raw.tobytes()
    found = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        plain = _ASCII_LETTER.search(data, begin, end) is not None
        found.append(plain or (
            _WIDE.search(data, begin, end) is not None and any(map(str.isalpha, data[begin:end].decode("utf-8", "replace")))
        ))
    return np.array(found, bool)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 200) -> Model | None:
    """Fit on at most `per_language` documents of each language, chosen by text hash; None without labelled text.

    Rows without text, letters or language teach nothing; equal texts of a language teach once. Texts of any length are
    measured whole. The driver gets one vector per chosen document.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & (F.octet_length("text") > 0)
    )
    hashed = F.xxhash64("text")
    counts = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).collect()}
    if not counts:
        return None
    # twice as many as wanted by hash, then, without copies, the first by rank
    share = F.lit(0.0)
    for language, n in sorted(counts.items()):
        share = F.when(F.col("lang") == language, F.lit(min(1.0, 2 * per_language / max(1, n)))).otherwise(share)
    drawn = rows.filter(F.pmod(hashed, F.lit(1 << 30)) < share * (1 << 30)).distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 30)), "text")
    chosen = drawn.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= per_language).select("text", "lang")
    vector = T.StructField("vector", T.BinaryType())

    def measure(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, offsets = joined_text(batch)
        keep = has_letter(raw, offsets)
        vectors = frequencies(raw, offsets)
        return [pa.array([row.tobytes() if fine else None for row, fine in zip(vectors, keep)], pa.binary())]

    sample = append(chosen, measure, [vector], slice_bytes=256 << 10).filter(F.col("vector").isNotNull()).select("lang", "vector").collect()
    if not sample:
        return None
    languages = sorted({row["lang"] for row in sample})
    labels = np.array([languages.index(row["lang"]) for row in sample])
    vectors = np.empty((len(sample), len(ORDERS) * WIDTH), np.float32)
    for at in range(len(sample)):
        vectors[at], sample[at] = np.frombuffer(sample[at]["vector"], np.float32), None
    return Model(languages, vectors, labels)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1, how sure the least sure decision was).

    Null texts and texts without a letter are `und` with score 0, as is all without a model. Repeated rows are told alike,
    an empty table gives none, and of languages with equal votes the first in order is taken. An input column named
    lang_pred or score is replaced; all others pass through.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, offsets = joined_text(batch, text_col)
        known = has_letter(raw, offsets)
        if sent.value is None or not known.any():
            return [pa.array([UNKNOWN] * batch.num_rows, pa.string()), pa.array(np.zeros(batch.num_rows))]
        names, score = sent.value.predict(raw, offsets)
        return [
            pa.array([name if fine else UNKNOWN for name, fine in zip(names, known)], pa.string()),
            pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
        ]

    return append(docs, compute, fields, slice_bytes=2 << 20)
