"""The registered queries of this package: thin digests over the operators, on whole tables."""

from __future__ import annotations

import hashlib
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import (
    decontamination, fill_in_middle, language_id, license_scan, merge_dropout, partenum, sharding, spelling_variants, suffix_dedup,
    token_files, toxicity, url_rules, winnowing,
)
from loomgraph.llm.common import append, column, held_out, table, text_bytes
from loomgraph.session import shared_folder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model, evidence = toxicity.fit(docs, docs.join(labels, "doc_id").select("text", "toxic"))
    return toxicity.score_texts(docs, model, evidence).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "n_evidence"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batch: pa.RecordBatch) -> list[pa.Array]:
        spans = column(batch, "spans").to_pylist()
        kept = [hashlib.sha256(suffix_dedup.cut(text or b"", mine)).hexdigest() for text, mine in zip(text_bytes(batch), spans)]
        removed = [sum(span["end_byte"] - span["first_byte"] for span in mine) for mine in spans]
        return [pa.array(removed, pa.int64()), pa.array([len(mine) for mine in spans], pa.int64()), pa.array(kept, pa.string())]

    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return append(found, digest, fields).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_files.write_token_files(
        table(spark, sf_dir, "documents"), token_files.new_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return token_files.read_token_files(made)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.printed(F.col("prints")).alias("fingerprint"),
        winnowing.printed(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(
        table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out()).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merge_dropout.round_trip(
        table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), seed=7, room=800_000, slice_bytes=4 << 20
    )
    return made.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.round_trip(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.count_words(table(spark, sf_dir, "documents"), thinned=199, min_length=6, min_count=5)
    return spelling_variants.spelling_variants(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda place: place["at"])
    base = F.transform("places", lambda place: place["label"])
    every = F.concat(base, F.transform("blocks", lambda block: block["label"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"), "score",
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_url_rules": op5_url_rules,
    "op6_winnowing": op6_winnowing,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_language_id": op8_language_id,
    "op9_partenum": op9_partenum,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}
