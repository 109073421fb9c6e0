"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import alignment, bpe, codebooks, contamination, jaccard, licenses, lines, packing, pii, quality, repeats, toxicity
from veriframe.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("_quality")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs).select(
        "doc_id", *[m[c].alias(c) for c in counts],
        quality.base_failed(m).alias("base_failed"), m.kept.alias("kept"),
    )


def _vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    base = F.col("pii").base
    return found.select(
        "doc_id", *[pii.count(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii").spans).alias("spans"),
        (F.size(F.col("pii").spans) > 0).alias("has_personal_data"),
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).membership.drop("tag", "first")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.count(docs, _vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return lines.dedup(docs).select("doc_id", "n_lines", "n_removed", kept)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codes = codebooks.fit(vectors)
    found = codebooks.encode(vectors, codes)
    digest = F.lit(codes.digest() if codes else None).cast("string").alias("codebooks_sha256")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")).documents


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_license_scan": op4_license_scan,
        "op5_token_counts": op5_token_counts,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_toxicity": op9_toxicity,
        "op10_repeated_passages": op10_repeated_passages,
        "op11_vector_codes": op11_vector_codes,
        "op12_token_alignment": op12_token_alignment,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": licenses.oracle(),
        "op6_quality_rules": quality.oracle(),
        "op7_line_dedup": lines.oracle(),
        "op10_repeated_passages": repeats.ORACLE,
        "op11_vector_codes": codebooks.oracle(),
    }
