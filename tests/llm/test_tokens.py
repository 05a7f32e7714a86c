import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomgraph.llm import merge_dropout, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, it's 12 o'clock", "a\n\n b  c ", "x\x1cy\x85z", "<|endoftext|> mid <|endoftext|>", "straße Ñandú 日本 ½² ǅ", "", " ",
    "tab\there\r\n", "emoji 👩‍👩‍👧 ok", "'s't 'RE", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
]


def _fuzz(count, seed):
    rng = random.Random(seed)
    signs = "ab cdE  \n\t'’,.!?0129éñüß日 \u3000\u2028½👍"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(count)]


def _encoded(words, *asked):
    """The ids of each text, as bytes."""
    made = []
    for counts, ids in words.encode(*asked):
        made += [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])]
    return made


def _decoded(words, ids):
    return next(words.texts_of(np.array([len(ids) // 4]), np.frombuffer(ids, "<u4"))).decode()


def test_ids_are_the_tokenizers_own():
    library = Tokenizer.from_file(BYTES)
    texts = TEXTS + _fuzz(400, 1)
    texts += ["it's we're I'll I'LL ''s !'s x's 's 'server  's\n't\t'd 9've a'b", "a  b \n c\t\td \n\n", "  lead", "trail  ", "é'll ×÷ à1b2", "x" * 700 + " " + "9" * 300 + "x" * 700]
    rng = random.Random(8)
    texts += ["".join(rng.choice(["'", "s", "t", "ll", " ", "  ", "\n", "\t", "é", "Z", "7", ".", "re", "m"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ours = [ids.tolist() for ids in token_files.encoder(BYTES).encode(texts)]
    assert ours == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_files_round_trip(spark, odd_docs, no_docs, tmp_path):
    library = Tokenizer.from_file(BYTES)
    made = token_files.write_token_files(odd_docs.withColumn("id", F.lit(1)), f"file:{tmp_path}/t", BYTES, end_id=2, dictionary_size=4096)
    rows = token_files.read_token_files(made).orderBy("start").collect()
    ids = [row.doc_id for row in rows]
    assert len(rows) == odd_docs.count() and ids == sorted(ids, key=lambda value: (value is not None, value or 0))
    assert [row.start for row in rows] == np.concatenate([[0], np.cumsum([row.n_tokens for row in rows])[:-1]]).tolist()
    expected = []
    for row in odd_docs.collect():
        found = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        expected.append((row.doc_id, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    assert sorted(((row.doc_id, row.n_tokens, row.ids_crc32) for row in rows), key=str) == sorted(expected, key=str)
    first = made.files.orderBy("start").first()
    assert token_files.read_documents(made, first.path, [0])[0][-1] == 2
    empty = token_files.write_token_files(no_docs, f"file:{tmp_path}/e", BYTES)
    assert token_files.read_token_files(empty).count() == 0


def test_without_dropout_like_the_library():
    words, library = merge_dropout.Vocabulary(PIECES), SentencePieceProcessor(model_file=PIECES)
    texts = TEXTS + _fuzz(300, 2)
    ours = [np.frombuffer(ids, "<u4").tolist() for ids in _encoded(words, texts, 0, [""] * len(texts), 0.0)]
    assert ours == library.encode(texts)


def test_dropout_is_keyed_and_lossless():
    texts = TEXTS + ["x▁y ▁", "the quick brown fox jumps over the lazy dog " * 5] + _fuzz(300, 3)
    owners = [str(at) for at in range(len(texts))]
    run = lambda seed, rate=0.2: _encoded(merge_dropout.Vocabulary(PIECES), texts, seed, owners, rate)
    words, one = merge_dropout.Vocabulary(PIECES), run(1)
    assert one == run(1) and one != run(2)
    for ids, text in zip(one + run(3, 1.0), texts * 2):
        assert _decoded(words, ids) == text
    # frequent words vary within a text
    long = _encoded(words, ["banana internationalization " * 50], 5, ["1"], 0.3)[0]
    assert len(np.frombuffer(long, "<u4")) not in {50 * n for n in range(2, 40)}


def test_each_occurrence_draws_its_own_skips():
    words, text = merge_dropout.Vocabulary(PIECES), "internationalization " * 20_000
    ids = _encoded(words, [text], 5, ["1"], 0.1)[0]
    assert (words.roots_of[: words.count] == words.known[" internationalization"]).sum() > 40
    # as often whole as under independent skips
    whole, rng = words.skip_at(" internationalization", ())[0], random.Random(6)
    drawn = [words.skip_at(" internationalization", [at for at in range(80) if rng.random() < 0.1])[0] == whole for _ in range(20_000)]
    assert abs(ids.count(np.array(whole, "<u4").tobytes()) - sum(drawn)) < 0.02 * 20_000
    assert _encoded(merge_dropout.Vocabulary(PIECES), ["a", text], 5, ["0", "1"], 0.1)[1] == ids


def test_vector_and_single_merging_agree():
    words = merge_dropout.Vocabulary(PIECES)
    _encoded(words, _fuzz(200, 4) + ["some ordinary words of several lengths, repeated", "and others besides"] * 5, 9, ["k"] * 210, 0.3)
    assert words.count > 1000
    for node in range(words.count):
        skips, at = [], node
        while words.parents[at] >= 0:
            skips.append(int(words.skips[at]))
            at = int(words.parents[at])
        ids, rounds = words.skip_at(words.words[at], tuple(skips))
        begin = words.begins[node]
        assert words.flat[begin: begin + words.lengths[node]].tolist() == ids and words.rounds[node] == rounds


def test_pieces_of_equal_score():
    plain, tied = merge_dropout.Vocabulary(PIECES), merge_dropout.Vocabulary(PIECES)
    tied.tied = True  # the other way to tell a merged piece
    texts = _fuzz(100, 5) + ["several ordinary words"] * 3
    assert _encoded(plain, texts, 1, ["k"] * 103, 0.2) == _encoded(tied, texts, 1, ["k"] * 103, 0.2)


def test_round_trip_of_odd_input(odd_docs, no_docs):
    made = merge_dropout.round_trip(odd_docs.withColumn("n_tokens", F.lit("x")), PIECES, seed=3, keep_ids=True)
    rows = made.collect()
    assert len(rows) == odd_docs.count() and all(row.lossless for row in rows)
    for row in rows:
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes()) and len(row.ids) == row.n_tokens
    encoded = merge_dropout.encode(odd_docs, PIECES, seed=3)
    assert merge_dropout.decode(encoded, PIECES).filter("decoded <> coalesce(text, '')").count() == 0
    assert merge_dropout.round_trip(no_docs, PIECES).count() == 0
