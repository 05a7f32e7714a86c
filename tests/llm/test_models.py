import random

from pyspark.sql import functions as F

from loomgraph.llm import language_id, toxicity


def _speech(language, size, rng):
    words = {
        "en": ["the", "thing", "which", "with", "and", "shall", "there"], "de": ["der", "und", "schlecht", "nicht", "über", "für", "gemacht"],
        "fr": ["le", "être", "avec", "qui", "mais", "très", "oiseau"], "es": ["el", "niño", "que", "pero", "ción", "más", "llave"],
    }[language]
    return " ".join(rng.choice(words) for _ in range(size))


def test_languages_and_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(at, _speech(lang, rng.randint(4, 60), rng), lang) for at in range(400) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id % 4 < 3"))
    assert sorted(map(sorted, ([model.languages[i] for i in family] for family in model.families))) == [["de", "en"], ["es", "fr"]]
    made = language_id.identify(docs.filter("doc_id % 4 = 3"), model)
    assert made.filter("lang = lang_pred").count() >= 0.97 * made.count()
    assert made.filter("score < 0 or score > 1").count() == 0


def test_unknown_and_odd_input(spark, odd_docs, no_docs):
    model = language_id.train(spark.createDataFrame([("hello there", "en"), ("guten tag", "de"), (None, "fr"), ("123", "es"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = language_id.identify(odd_docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert (row.lang_pred == "und") == (not any(map(str.isalpha, row.text or "")))
    assert language_id.train(no_docs) is None
    assert {row.lang_pred for row in language_id.identify(odd_docs, None).collect()} == {"und"}
    one = language_id.train(spark.createDataFrame([("only this", "en")], "text string, lang string"))
    assert language_id.identify(odd_docs.filter("doc_id = 8"), one).first().lang_pred == "en"
    assert language_id.identify(no_docs, model).count() == 0


def test_long_texts_are_scored_whole(spark):
    model = language_id.train(spark.createDataFrame([("the thing which", "en"), ("der schlecht nicht", "de")] * 3, "text string, lang string"))
    text = "the thing which " * 2 + "der schlecht nicht " * 120_000
    assert language_id.identify(spark.createDataFrame([(text,)], "text string"), model).first().lang_pred == "de"


def _corpus(spark):
    rng = random.Random(8)
    plain = ["where", "there", "stone", "tiger", "paper", "silver", "morning", "idle", "stupor", "moral", "letter", "orange", "ladder"]
    plain += ["".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for at in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 40))]
        toxic = at % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((at, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_restored_words_count(spark, odd_docs, no_docs):
    docs = _corpus(spark)
    model, evidence = toxicity.fit(docs, docs.filter("doc_id % 4 <> 2"))
    made = toxicity.score_texts(docs.filter("doc_id % 4 = 2"), model, evidence)
    assert made.filter("predicted <> toxic").count() <= 3
    hidden = ["what an 1d10t there", "so st00pid paper", "a m0r0n morning", "idiooooot letter", "the s t u p i d tiger", "i.d.i.o.t orange", "IDIOT ladder"]
    clean = ["meet at 10 there", "letter 4 you", "silver 1999 paper", "a b c morning", "zzz", ""]
    rows = [(at, text) for at, text in enumerate(hidden + clean)] + [(99, None)]
    scored = toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model, evidence).orderBy("doc_id").collect()
    assert [row.predicted for row in scored] == [1] * len(hidden) + [0] * (len(clean) + 1)
    assert toxicity.restored_text("an 1d10t and st00pid m0r0n", model) == "an idiot and stupid moron"
    assert toxicity.score_texts(odd_docs.withColumn("score", F.lit(1)), model, evidence).count() == odd_docs.count()
    assert toxicity.score_texts(no_docs, model, evidence).count() == 0


def test_forms_that_open_a_lattice(spark):
    rng = random.Random(9)
    plain = ["where", "there", "stone", "tiger", "letter", "class", "enter", "garden", "is", "at", "all", "you"]
    plain += ["".join(rng.choice("aeiou") + rng.choice("lnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["loser", "idiot", "ass", "asshole", "trash", "scum"]
    rows = []
    for at in range(900):
        words = [rng.choice(plain) for _ in range(30)]
        if at % 3 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((" ".join(words), int(at % 3 == 0)))
    docs = spark.createDataFrame(rows, "text string, toxic int")
    model, evidence = toxicity.fit(docs, docs)
    hidden = ["l053r", "l0$3r", "1053r", "idi07", "idio7", "a55", "a$$", "4$$h0le", "[1d10t]", "*tr4sh*", "-1d10t", "you,1d10t", "1d10t!", "scuum", "iiddiioott"]
    clean = ["en!!", "a$$$", "all letter class", "tiger!", "(there", "stone(", "10 $5 100!", "garden 1999"]
    scored = toxicity.score_texts(spark.createDataFrame([(text,) for text in hidden + clean], "text string"), model, evidence).collect()
    marks = {row.text: row.predicted for row in scored}
    assert [text for text in hidden if not marks[text]] == [] and [text for text in clean if marks[text]] == []
    for text in ("en!!", "all letter class", "tiger!", "(there", "stone(", "10 $5 100!"):
        assert toxicity.restored_text(text, model) == text
    long = "q5" * 100_000  # no quadratic work in a long token
    assert set(toxicity.decode(long, model)) <= set("qs5")


def test_without_labels(spark, odd_docs, no_docs):
    unlabelled = odd_docs.select("text", F.lit(None).cast("int").alias("toxic"))
    model, evidence = toxicity.fit(odd_docs, unlabelled)
    assert toxicity.score_texts(odd_docs, model, evidence).filter("predicted = 1").count() == 0
    model, evidence = toxicity.fit(no_docs, unlabelled.limit(0))
    assert len(evidence.hashes) == 0


def test_viterbi_finds_the_cheapest_reading(spark):
    docs = _corpus(spark)
    model = toxicity.count_grams(docs)

    def every(segment, at=0):
        if at == len(segment):
            yield "", 0.0
            return
        for said, price in toxicity._options(segment, at, False):
            for rest, cost in every(segment, at + 1):
                yield said + rest, price + cost

    def cost(text, price):
        state = 0
        for sign in text:
            price += model.cost(state, toxicity._symbol(sign))
            state = (state * toxicity.SYMBOLS + toxicity._symbol(sign)) % toxicity.SYMBOLS**3
        return price + model.cost(state, toxicity.SPACE)

    for segment in ("1d10t", "st00p1d", "p4p3rr", "mmm0ral", "s!lver5"):
        best = min(cost(text, price) for text, price in every(segment))
        said = toxicity.decode(segment, model)
        assert min(cost(text, price) for text, price in every(segment) if text == said) <= best + 1e-6


def test_copies_teach_once(spark):
    rng = random.Random(11)
    rows = [(_speech("en", 30, rng), "en")] * 3000 + [(_speech(lang, 30, rng), lang) for _ in range(300) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    seen = []
    plain = language_id.Model

    def noted(languages, vectors, labels):
        seen.append([int((labels == at).sum()) for at in range(len(languages))])
        return plain(languages, vectors, labels)

    language_id.Model = noted
    try:
        language_id.train(docs, per_language=100)
    finally:
        language_id.Model = plain
    assert len(seen[0]) == 2 and all(60 <= n <= 100 for n in seen[0])


def test_many_unlisted_languages(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"x{at:02d}" for at in range(20)]
    words = {name: ["".join(rng.choice(letters[at:] + letters[:at]) for _ in range(rng.randint(3, 6))) for _ in range(12)] for at, name in enumerate(names)}
    rows = [(at, " ".join(rng.choice(words[name]) for _ in range(40)), name) for at in range(600) for name in [names[at % 20]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id < 400"), per_language=30)
    assert max(map(len, model.families)) <= language_id.GROUP and sorted(at for family in model.families for at in family) == list(range(20))
    made = language_id.identify(docs.filter("doc_id >= 400"), model)
    assert made.filter("lang = lang_pred").count() >= 0.95 * made.count()
    assert made.filter("score < 0 or score > 1").count() == 0
