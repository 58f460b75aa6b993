"""Registered queries of the subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontam, embed_dedup, hard_negatives, jaccard, langid, licenses, lines, packing, pii, quality, spelling, substring, warc
from .common import table
from .oracle import ORACLE


def op1_decontamination(spark, sf_dir):
    found = decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def tokenizer() -> dict:
    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_packing(spark, sf_dir):
    return packing.pieces_digest(packing.pack(table(spark, sf_dir, "documents"), **tokenizer()))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op5_warc(spark, sf_dir):
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_pages(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_substring_dedup(spark, sf_dir):
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written("base_spans"), 256).alias("base_sha256"), pii.written("spans").alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_dedup(spark, sf_dir):
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_embedding_dedup, op3_packing, op4_language_id, op5_warc, op6_substring_dedup,
                                   op7_license_scan, op8_quality, op9_jaccard_join, op10_pii, op11_hard_negatives, op12_spelling, op13_line_dedup)}

__all__ = ["ORACLE", "QUERIES"]
