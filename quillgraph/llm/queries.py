"""The registered queries of this subpackage: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, jaccard_join, line_dedup, mixing, pii_crf, quality_rules, sharding, simhash, site_style, suffix_dedup, token_align, window_index
from .storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    measured = quality_rules.measure(_table(spark, sf_dir, "documents"), labels)
    return quality_rules.judge(measured, quality_rules.cutoffs_for(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_toxic_words", "base_failed", "kept"
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return window_index.deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in pii_crf.KINDS]
    every = F.size("all_spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(pii_crf.joined("base_spans"), 256).alias("base_sha256"), pii_crf.joined("all_spans").alias("spans"), every)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeated(docs)
    digest = found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    # passages of over 50 words are often shorter than 400 bytes: they are counted, not cut
    passages = materialize(suffix_dedup.repeated_passages(docs), "passages")
    return digest.join(passages, "doc_id", "left").withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0).cast("long")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        sharding.size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    hit = F.expr(decontaminate.match_words())
    return found.select(
        "doc_id",
        F.col("n_match_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("match_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *(f"p_{d}" for d in mixing.DOMAINS), "rate", "copies")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_style.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = token_align.align(_table(spark, sf_dir, "documents"))
    return scored.select(F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_substring_dedup,
        op3_line_dedup,
        op4_pii,
        op5_simhash,
        op6_suffix_dedup,
        op7_sharding,
        op8_decontamination,
        op9_mixing,
        op10_html,
        op11_divergence,
        op12_token_alignment,
        op13_jaccard_join,
        pipeline,
    )
}
#: Where SQL can't express an operator, tests/llm compares it with a brute-force version.
SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.sql(),
    "op2_substring_dedup": window_index.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op11_divergence": divergence.SQL,
    "op13_jaccard_join": jaccard_join.SQL,
}
