import hashlib
import random
import re

from pyspark.sql import functions as F

from loomgraph.llm.decontamination import Items, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _brute(docs, items, size):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda text: WORD.findall((text or "").translate(fold))
    windows = []
    for item, text in items:
        found = words(text)
        windows += [(str(item), found[at: at + size]) for at in range(max(1, len(found) - size + 1)) if found]
    out = []
    for doc, text in docs:
        found, hit, owners = words(text), set(), set()
        for item, window in windows:
            for at in range(len(found) - len(window) + 1):
                if found[at: at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    owners |= {item} - {"None"}
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), sorted(owners), digest, bool(hit)))
    return sorted(out, key=str)


def _rows(made):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.items_sha256, r.contaminated) for r in made.collect()), key=str)


def test_against_brute_force(spark, sentences):
    texts = sentences(40, 30)
    docs = [(at, text) for at, text in enumerate(texts)]
    docs += [(90, "Start, " + texts[0].upper() + " end"), (91, "x" + texts[1]), (92, texts[2].replace(" ", "--")), (93, "tiny Item! tiny item"), (94, None), (95, "")]
    items = [(1, texts[0]), (10, texts[2]), (2, "tiny item"), (3, ""), (4, None), (None, texts[5]), (5, texts[0]), (6, "Straße " + texts[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _rows(decontaminate(frame, bench)) == _brute(docs, items, 10)
    # the same over several blocks of the benchmark
    assert _rows(decontaminate(frame, bench, block_words=30)) == _brute(docs, items, 10)


def test_runs_of_few_words(spark):
    """Many overlaps: two words in every order, sizes odd and even, items inside items."""
    rng = random.Random(4)
    text = lambda least, most: " ".join(rng.choice("ab") for _ in range(rng.randint(least, most)))
    docs = [(at, text(0, 60)) for at in range(60)]
    items = [(at if at % 9 else None, text(0, 25)) for at in range(25)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1, 4, 7, 10):
        assert _rows(decontaminate(frame, bench, size=size)) == _brute(docs, items, size)


def test_automaton_follows_the_text(sentences):
    texts = [text.encode() for text in sentences(300, 100, seed=9)]
    made = Items([(str(at), text) for at, text in enumerate(texts)], 10)
    # a node per word, not per word and window
    assert made.automaton.get_stats()["nodes_count"] <= sum(len(text.split()) for text in texts) + 1
    assert made.automaton.get_stats()["total_size"] <= 20 * sum(map(len, texts))


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünï — a  B,c d; Ende")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    row = decontaminate(docs, bench).first()
    (span,) = row.spans
    assert row.text[span.first_char: span.end_char] == "a  B,c d"


def test_odd_input(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    made = decontaminate(odd_docs.withColumn("n_hit", F.lit("mine")), bench)
    assert made.count() == odd_docs.count() and made.filter("contaminated").count() == 3
    assert decontaminate(no_docs, bench).count() == 0
    assert decontaminate(odd_docs, bench.limit(0)).filter("contaminated").count() == 0
