import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import spelling_variants as sv


def _near(one, two):
    if len(one) == len(two):
        return sum(a != b for a, b in zip(one, two)) == 1
    if len(one) > len(two):
        one, two = two, one
    return len(two) == len(one) + 1 and any(two[:at] + two[at + 1:] == one for at in range(len(two)))


def _plainly(words, ratio):
    told = {}
    for word, n in words.items():
        near = [other for other in words if _near(word, other)]
        best = min(near, key=lambda other: (-words[other], other), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        told[word] = (form, len(near))
    made = {}
    for word, n in words.items():
        root = word
        while told[root][0] is not None:
            root = told[root][0]
        form, near = told[word]
        made[word] = (word, form, root, n, near, words.get(form))
    return made


def _vocabulary(seed, letters, low, high, count):
    rng = random.Random(seed)
    made = {}
    for _ in range(count):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        made[word] = rng.choice([5, 6, 30, 200, 5000])
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word) + 1)
            made[rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]])] = 5
    made.pop("", None)
    return made


@pytest.mark.parametrize("words, slice_words", [
    (_vocabulary(1, "ab", 6, 9, 120), 20), (_vocabulary(2, "abcé", 6, 8, 250), 4096), (_vocabulary(3, "abcdefgh", 3, 12, 300), 25),
    ({"hotpre" + word: n for word, n in _vocabulary(4, "abc", 4, 6, 200).items()}, 15),
    (_vocabulary(5, "ab", 1, 4, 40), 8), (_vocabulary(6, "xyz", 60, 70, 60), 30),
    ({"q" * length: 5 + length for length in [*range(6, 20), *range(61, 68), 127, 128, 129, 300]}, 7),
])
def test_against_brute_force(spark, words, slice_words):
    rows = spark.createDataFrame(list(words.items()), "word string, n int")
    made = {row.word: tuple(row) for row in sv.spelling_variants(rows, ratio=5, slice_words=slice_words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert made == _plainly(words, 5)


def test_scan_skips_ranges():
    words = sorted({"aaaaaa" + str(at) for at in range(300)} | {"bbbbbb" + str(at) for at in range(300)} | {"aaaaab"})
    listed = sv.SortedList(words)
    looked = []
    real = listed.signs

    class Seen:
        shape = real.shape

        def __getitem__(self, key):
            looked.append(len(key[0]))
            return real[key]

    listed.signs = Seen()
    import numpy as np
    found = listed.scan(["aaaaab"], np.array([0]), np.array([len(words)]), np.array([0]))
    near = {words[at] for at in found[1].tolist()}
    assert near == {word for word in words if _near(word, "aaaaab")}
    # the six hundred words share two beginnings; ranges beyond one edit are passed over
    assert sum(looked) < 400


def test_words_and_counts(spark, odd_docs, no_docs):
    rng = random.Random(6)
    parts = ["Straßen", "naïveté", "COLOUR", "colour", "abcdefg", "x×÷y÷z×w", "short", "ÀÉÎÕÜß", "日本abcdefgh日", "under_score1234567word", "Łabcdefgh"]
    rows = [(at if at % 7 else None, rng.choice([" ", "", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for at in range(400)]
    rows += [(None, None), (3, ""), (4, "abcdef"), (5, "ghijkl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit("mine"))
    for thinned in (None, 3):
        wanted = {}
        for doc_id, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(chr(ord(sign) + 32) if "A" <= sign <= "Z" else sign for sign in run)
                mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if thinned and mark % thinned == 0:
                    run = run[: mark % len(run)] + run[mark % len(run) + 1:]
                wanted[run] = wanted.get(run, 0) + 1
        wanted = {word: n for word, n in wanted.items() if len(word) >= 6 and n >= 2}
        made = sv.count_words(docs, thinned=thinned, min_length=6, min_count=2)
        assert {row.word: row.n for row in made.collect()} == wanted
    assert sv.spelling_variants(sv.count_words(no_docs)).count() == 0
    assert sv.spelling_variants(sv.count_words(odd_docs, min_length=1, min_count=1), slice_words=3).count() > 5
    with pytest.raises(ValueError):
        sv.spelling_variants(sv.count_words(no_docs), ratio=1)
