"""A cleaning pipeline over `documents`: language, near copies, repeated passages, benchmark leaks, token ids.

Each stage works on all that its predecessor kept and, but for the last, returns the columns it was given.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import held_out, table
from loomgraph.llm.decontamination import decontaminate
from loomgraph.llm.language_id import UNKNOWN, identify, train
from loomgraph.llm.merge_dropout import round_trip
from loomgraph.llm.partenum import keep_one
from loomgraph.llm.suffix_dedup import remove_repeated
from loomgraph.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def keeping_columns(stage: Stage) -> Stage:
    """A stage whose other columns go by names of their own meanwhile, so that none clashes with what it adds."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apart = docs.toDF(*[name if name in _OWN else f"extra_{at}" for at, name in enumerate(docs.columns)])
        return stage(spark, apart, sf_dir).toDF(*docs.columns)

    return run


# Below this score no family claims a text: the best one's margin is under -1.4.
LEAST_SURE = 0.05


@keeping_columns
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language nothing tells go: null texts, texts without a letter, and those of a score under LEAST_SURE.

    Where `lang` is null it becomes the predicted language. Without a document to learn from no text is rejected but those
    without letters, and `lang` stays as it was. Rows with null or equal ids and repeated rows are judged each for itself;
    an empty table stays empty.
    """
    model = train(docs.filter(~held_out()).select("text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SURE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@keeping_columns
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more stays: the one of the
    least doc_id (null ids last; of equal ids the least text, of equal rows one). Documents without words are linked with
    nothing and stay; an empty table stays empty."""
    return keep_one(docs, n=5, percent=80)


@keeping_columns
def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere are cut out of every text that has them (a
    character goes if all its bytes go), and n_chars follows. Documents of which nothing is left go. Ids do not matter:
    repeated rows are texts of their own, and what they repeat goes from each."""
    return remove_repeated(docs, length=200)


@keeping_columns
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item (or a whole shorter item) go. Each row is judged for itself,
    whatever its id; null texts have no words and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids with merge-dropout: doc_id, lang, source, n_tokens, ids, ids_crc32, decoded_sha256, lossless.

    Null and empty texts have no ids. Draws are keyed by doc_id, by the text where it is null, so repeated rows come out alike."""
    made = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=7, keep_ids=True, room=60_000)
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "lossless")


STAGES = [
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("repeated passages", repeated_passage_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

# SQL can express neither the trained language model nor merge-dropout.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
