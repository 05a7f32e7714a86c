import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import partenum
from loomgraph.llm.partenum import Bands, jaccard_components, keep_one, signatures


def _sets(texts, n):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[at: at + n]) for at in range(max(1, len(words) - n + 1))} if words else set())
    return out


def _brute(ids, texts, n, percent):
    sets, root = _sets(texts, n), list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = root[a], root[b]
                root = [new if label == old else label for label in root]
    return {ids[at]: (len(sets[at]), min(ids[other] for other in range(len(ids)) if root[other] == root[at])) for at in range(len(ids))}


def _edited(text, changes, rng):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(spark, sentences):
    rng = random.Random(2)
    texts = sentences(30, 60) + sentences(10, 9, seed=4)
    for at in range(30):
        texts += [_edited(texts[at], changes, rng) for changes in (1, 2, 3)]
    hub = sentences(1, 120, seed=9)[0]
    texts += [_edited(hub, rng.randint(1, 4), rng) for _ in range(60)]
    texts += [hub.upper(), hub.replace(" ", "\n"), None, "", " ", "a b", "A  b", "a", texts[0], " ".join(texts[1].split()[:-4])]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=n, percent=percent).collect()}
        assert found == _brute(ids, texts, n, percent)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_groups_of_many_blocks(spark, sentences, monkeypatch, block):
    """Small blocks, near copies that link in chains only, and strays that share passages with them."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    rng = random.Random(7)
    base, other = sentences(1, 60, seed=31)[0].split(), sentences(1, 200, seed=32)[0].split()
    texts = []
    for at in range(40):  # a window that moves on: neighbours link, the ends do not
        texts.append(" ".join((base + other)[at: at + 60]))
    texts += [_edited(" ".join(base), rng.randint(1, 3), rng) for _ in range(25)]
    texts += [" ".join(base[:30] + rng.sample(other, 40)) for _ in range(15)] + sentences(5, 20, seed=33)
    ids = list(range(len(texts)))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=4, percent=80).collect()}
    assert found == _brute(ids, texts, 4, 80)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    bands = Bands(85)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        far = int(rng.integers(0, 15 * 2 * len(one) // 185 + 1))
        two = np.unique(np.concatenate([one[far // 2:], rng.integers(0, 2**63, far - far // 2).astype(np.uint64)]))
        both = len(np.intersect1d(one, two))
        if 100 * both >= 85 * (len(one) + len(two) - both):
            frequent = rng.random() < 0.5
            marks = [rng.random(len(elements)) < 0.3 if False else np.isin(elements, one[: len(one) // 2]) & frequent for elements in (one, two)]
            assert np.intersect1d(signatures(one, marks[0], bands), signatures(two, marks[1], bands)).size


def test_short_text_in_copies_and_with_rare_words(spark, sentences):
    texts = []
    for number, sentence in enumerate(sentences(6, 60, seed=8)):
        for size in (12, 13, 15, 17, 28):
            text = " ".join(sentence.split()[:size])
            texts += [text] * 100
            texts += [f"{text} " + " ".join(f"r{number}x{at}" for at in range(rare)) for rare in (2, 4)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    first = {}
    alone = [at for at, text in enumerate(texts) if first.setdefault(text, at) == at]
    for n, percent in ((4, 85), (5, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=n, percent=percent).collect()}
        brute = _brute(alone, [texts[at] for at in alone], n, percent)
        assert found == {at: brute[first[text]] for at, text in enumerate(texts)}


def test_sure_signatures_of_the_worst_placing():
    # each group keeps 3, 1 or 0 signatures with 0, 1 or 2 differing elements in different partitions
    for percent in (80, 85):
        bands = Bands(percent)
        for size in range(1, 400):
            band, far = bands.of(size), bands.distance(size)
            left = [3] * bands.groups(band)
            for at in range(far):
                left[at % len(left)] -= 2 if at < len(left) else 1
            assert bands.sure(band, size) <= max(0, sum(left))


def test_odd_input(odd_docs, no_docs):
    made = jaccard_components(odd_docs.withColumn("component_id", F.lit("x")))
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in made.collect()]
    assert len(rows) == odd_docs.count()
    assert sorted(rows, key=str).count((5, 3, 5)) == 2 and (None, 3, 5) in rows and (1, 0, 1) in rows
    assert jaccard_components(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("text like 'one two%'").count() == 1
    assert kept.count() == odd_docs.count() - 2 and keep_one(no_docs).count() == 0
