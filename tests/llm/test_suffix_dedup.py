import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm.suffix_dedup import cut, merge_runs, front_coded, remove_repeated, repeated_spans


def _brute(texts, length):
    data = [(text or "").encode() for text in texts]
    seen = Counter(text[at: at + length] for text in data for at in range(len(text) - length + 1))
    out = []
    for text in data:
        inside = [False] * len(text)
        for at in range(len(text) - length + 1):
            if seen[text[at: at + length]] > 1:
                inside[at: at + length] = [True] * length
        out.append(bytes(code for code, gone in zip(text, inside) if not gone))
    return out


def _kept(made):
    return {r.doc_id: cut((r.text or "").encode(), r.spans) for r in made.collect()}


@pytest.mark.parametrize("length", [7, 40])
def test_against_brute_force(spark, length):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    shared = "".join(rng.choice("abcdefgh") for _ in range(length + 3))
    texts += [shared + "tail", "head" + shared, "x" + shared[: length - 1] + "y", "aaaa" * 60, "abab" * 50, None, "", shared * 2, texts[3], texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _kept(repeated_spans(docs, length=length, run_bytes=2000)) == dict(enumerate(_brute(texts, length)))


def test_loser_tree_gives_order_and_prefixes():
    rng = np.random.default_rng(3)
    runs = [rng.integers(97, 99, (size, 12)).astype(np.uint8) for size in (50, 1, 33, 0, 70)]
    blobs = [front_coded(rows, np.full(len(rows), 8), np.full(len(rows), 4))[0] for rows in runs if len(rows)]
    order, lcps, keys = merge_runs(blobs, 12)
    assert keys == sorted(keys) and len(order) == len(keys)
    for at in range(1, len(keys)):
        common = next((i for i in range(12) if keys[at][i] != keys[at - 1][i]), 12)
        assert lcps[at] == common


def test_odd_input(odd_docs, no_docs):
    made = repeated_spans(odd_docs.withColumnRenamed("source", "spans"), length=20)
    assert made.count() == odd_docs.count()
    assert {r.n_bytes for r in made.collect() if r.text is None} == {0}
    assert repeated_spans(no_docs).count() == 0


def test_removal_keeps_characters_whole_and_columns(spark):
    shared = "é" * 30
    rows = [(1, "a" + shared + "b", 32), (2, shared, 30), (3, "c" + shared, 31), (4, "", 0), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    made = {r.doc_id: (r.text, r.n_chars) for r in remove_repeated(docs, length=20).collect()}
    assert made == {1: ("ab", 2), 3: ("c", 1), 4: ("", 0), 5: (None, None)}
