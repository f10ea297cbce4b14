"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, lattice, near, pii, quality, repeats, rules, search, shards, template, toxicity
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.learn(docs)))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can say."""
    return op4_lattice_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say."""
    return op6_quality_rules(spark, sf_dir).drop("kept", "rule")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8, which SQL can say."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_decontamination, op3_byte_bpe, op4_lattice_score, op5_html_template, op6_quality_rules, op7_sharding, op8_pii, op9_minhash_dedup, op10_repeated_spans, op11_source_divergence, op12_ranked_search, op13_toxicity, base_lm_score, base_quality_rules, base_pii)
}
ORACLES: dict[str, str] = {"op2_decontamination": decontaminate.ORACLE, "op9_minhash_dedup": near.ORACLE, "base_lm_score": lattice.BASE_ORACLE, "base_quality_rules": rules.BASE_ORACLE, "base_pii": pii.BASE_ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_ranked_search": search.ORACLE}
