import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_in_middle as fim


def _plainly(doc_id, text, seed, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * at: 8 * at + 8], 16) for at in range(4))
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, middle, last = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(first), len(middle), f"<S>{last}<P>{first}<M>{middle}"
    return n, "psm", len(first), len(middle), f"<P>{first}<S>{last}<M>{middle}"


def _texts():
    rng = random.Random(4)
    signs = ["a", "é", "日", "\n", "\n", "<", "P", "S", "M", ">", " ", "\r", "😀"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return made + ["<P", "a\n<S", ">\n<M\n<", "x<P>y", "\n\n\n", "no line end", "\n".join(["long line " * 400] * 30)]


@pytest.mark.parametrize("chunk", [3, 64, fim.CHUNK])
def test_outputs_and_restored_texts(spark, chunk):
    rows = list(enumerate(_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {doc_id: _plainly(doc_id, text, 3, 80, 40) for doc_id, text in rows}
    made = {row.doc_id: row for row in fim.round_trip(docs, seed=3, rate=80, spm_rate=40, chunk=chunk).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert len(made) == len(rows)
    for doc_id, text in rows:
        n, form, before, between, output = wanted[doc_id]
        row = made[doc_id]
        assert (row.n, row.form, row.prefix_chars, row.middle_chars) == (n, form, before, between)
        assert row.output_sha256 == sha(output) and row.restored_sha256 == sha(text)
    whole = fim.restore(fim.transform(docs, seed=3, rate=80, spm_rate=40, chunk=chunk)).collect()
    assert {row.doc_id: row.output for row in whole} == {doc_id: told[4] for doc_id, told in wanted.items()}
    assert {row.doc_id: row.restored for row in whole} == dict(rows)
    assert {form for _, form, *_ in wanted.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, no_docs):
    clashing = odd_docs.withColumn("row", F.lit("mine")).withColumn("piece", F.lit(1)).withColumn("form", F.lit(2))
    made = fim.round_trip(clashing).collect()
    told = sorted((row.doc_id is None, row.doc_id or 0, row.n, row.output_sha256) for row in made)
    wanted = [(row.doc_id, _plainly(row.doc_id, row.text, 7, 100, 50)) for row in odd_docs.collect()]
    assert told == sorted((at is None, at or 0, told[0], hashlib.sha256(told[4].encode()).hexdigest()) for at, told in wanted)
    assert fim.round_trip(no_docs).count() == 0 and fim.transform(no_docs).count() == 0


def test_one_shuffle(spark, odd_docs):
    plan = fim.round_trip(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan
