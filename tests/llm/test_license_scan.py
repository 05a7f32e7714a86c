import random
import re

from pyspark.sql import functions as F

from loomgraph.llm import license_scan as ls


def _words(text):
    return re.findall(ls.WORD, re.sub("[A-Z]", lambda sign: sign[0].lower(), text or ""))


def _plainly(text, phrases, templates, percent):
    words = _words(text)
    step = max(len(_words(said)) for said, _ in [*phrases, *templates])
    places = sorted(
        (at, label) for phrase, label in phrases for wanted in [_words(phrase)] for at in range(len(words)) if words[at: at + len(wanted)] == wanted
    )
    blocks, best = set(), 0.0
    for begin in range(0, len(words), step):
        inside = set(words[begin: begin + 2 * step])
        for said, label in templates:
            mine = set(_words(said))
            if 100 * len(mine & inside) >= percent * len(mine):
                share = len(mine & inside) / len(mine)
                blocks.add((begin, label, share))
                best = max(best, share)
    return len(words), places, sorted(blocks), 1.0 if places else best


def _check(docs, phrases, templates, percent):
    rows = docs.collect()
    made = ls.scan_licenses(docs, phrases=phrases, templates=templates, percent=percent).collect()
    spoken = lambda row: (row.n_words, [tuple(at) for at in row.places], [tuple(at) for at in row.blocks], row.score)
    told = sorted((str(row.doc_id), *spoken(row)) for row in made)
    assert told == sorted((str(row.doc_id), *_plainly(row.text, phrases, templates, percent)) for row in rows)


def test_against_brute_force(spark):
    rng = random.Random(2)
    common, rare = ["the", "of", "is", "to"], ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = []
    for _ in range(150):
        texts.append(" ".join(rng.choice(common * 3 + rare) for _ in range(rng.randint(0, 80))))
    templates = [(" ".join(rng.sample(common + rare, rng.randint(1, 8))), f"t{at % 5}") for at in range(12)] + [("the the the", "same")]
    phrases = [("the of", "p1"), ("is is", "p2"), ("alpha", "p3")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (50, 80, 100):
        _check(docs, phrases, templates, percent)


def test_groups_of_templates_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. Released under the MIT License"), (2, "ALL RIGHTS reserved")], "doc_id long, text string")
    whole = sorted(map(tuple, ls.scan_licenses(docs).collect()))
    monkeypatch.setattr(ls, "GROUP_WORDS", 5)
    assert sorted(map(tuple, ls.scan_licenses(docs).collect())) == whole
    assert {block["label"] for _, _, _, blocks, _ in whole for block in blocks} >= {"cc-by-nc", "mit", "reserved"}


def test_notices_in_long_and_odd_texts(spark, odd_docs, no_docs):
    filler = "word " * 30_000
    rows = [(20, filler + "Released\nunder the -- MIT License! " + filler), (21, "cc by cc by"), (None, "General  Public\tLicense"), (None, "General  Public\tLicense")]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("row", F.lit("mine")).withColumn("hits", F.lit(1)).withColumn("label", F.lit(2)).withColumn("word", F.lit(3))
    _check(docs, ls.PHRASES, ls.TEMPLATES, 80)
    assert ls.scan_licenses(no_docs).count() == 0
    assert ls.scan_licenses(odd_docs, templates=[]).filter("score > 0").count() == 0


def test_no_python_worker(spark, odd_docs):
    plan = ls.scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
