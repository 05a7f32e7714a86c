import corpus_pipeline
from loomgraph.session import materialize


def test_stages_keep_columns_and_take_effect(spark, sentences, tmp_path):
    texts = sentences(30, 60, seed=21)
    passage = " ".join(sentences(1, 60, seed=22)[0].split())
    rows = [(at, text, "en", "s", len(text)) for at, text in enumerate(texts)]
    rows += [
        (100, texts[0], "en", "s", None), (101, texts[0] + " more", "en", "s", None), (102, "!!! 123", "en", "s", None), (103, None, None, None, None),
        (104, texts[1][:150] + " " + passage, "de", "s", None), (105, passage + " " + texts[2][150:], "de", "s", None), (106, sentences(1, 30, seed=23)[0], "en", "s", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"file:{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"file:{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, f"file:{tmp_path}"))
        if name != "tokens":
            assert made.columns == docs.columns
        seen[name], docs = {row.doc_id for row in made.collect()}, made
    assert {102, 103} & seen["language"] == set() and len(seen["language"]) == len(rows) - 2
    assert {100, 101} & seen["near copies"] == set() and 0 in seen["near copies"]
    assert seen["repeated passages"] == seen["near copies"]
    assert seen["benchmark"] == seen["repeated passages"] - {106}
    assert docs.filter("not lossless").count() == 0
    assert corpus_pipeline.run(spark, f"file:{tmp_path}").count() == docs.count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_acts_on_its_prediction(spark, sentences):
    english = [" ".join(["the", "thing", "which", "with", "and"][(at * 7 + step) % 5] for step in range(30)) for at in range(40)]
    german = [" ".join(["der", "und", "nicht", "über", "schlecht"][(at * 3 + step * 2) % 5] for step in range(30)) for at in range(40)]
    rows = [(at, text, "en", "s", 1) for at, text in enumerate(english)] + [(100 + at, text, "de", "s", 1) for at, text in enumerate(german)]
    rows += [(200, english[0] + " which", None, "s", 1), (201, german[0] + " und", None, "s", 1), (202, "12 34", None, "s", 1)]
    made = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    told = {row.doc_id: row.lang for row in made}
    assert told.pop(200) == "en" and told.pop(201) == "de" and 202 not in told
    assert told == {row[0]: row[2] for row in rows[:80]}
    # no language is known: clean documents stay
    nothing = spark.createDataFrame([(row[0], row[1], None, "s", 1) for row in rows], COLUMNS)
    assert corpus_pipeline.language_stage(spark, nothing, "").count() == 82


def test_stages_on_odd_input(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(None, "one two three"), (1, None)], "item_id long, text string").write.parquet(f"file:{tmp_path}/benchmark.parquet")
    clashing = odd_docs.withColumn("score", odd_docs.lang).withColumn("_row", odd_docs.doc_id).withColumn("spans", odd_docs.source)
    for docs in (no_docs, odd_docs, clashing):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = materialize(stage(spark, before, f"file:{tmp_path}"))
            if name != "tokens":
                assert docs.columns == before.columns
            if name == "language":
                assert docs.filter("text is null or not text rlike '\\\\p{L}'").count() == 0
            if "_row" in docs.columns:
                assert docs.filter("not (_row <=> doc_id and spans <=> source)").count() == 0
            if name == "near copies":
                assert docs.filter("text = 'one two three four five six'").count() == min(1, before.filter("text = 'one two three four five six'").count())
        assert docs.filter("not lossless").count() == 0
