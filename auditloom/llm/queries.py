"""Queries over the operators of this package, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import oracles
from auditloom.llm.audit import filter_audit, judged
from auditloom.llm.bpe import token_counts
from auditloom.llm.conversations import damage, repair_digest
from auditloom.llm.cotraining import fit_quality, quality_scores
from auditloom.llm.decontaminate import contamination
from auditloom.llm.lines import line_dedup
from auditloom.llm.mixing import mix
from auditloom.llm.naming import exact_dedup
from auditloom.llm.rules import quality_rules
from auditloom.llm.sharding import sharded_digest
from auditloom.llm.simhash import simhash_groups
from auditloom.llm.substring import substring_dedup
from auditloom.llm.toxicity import fit_toxicity, held_out, toxicity
from auditloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which every executor has installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_substring_dedup", oracles.OP1)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after passages of 20 words that occur earlier are removed."""
    return substring_dedup(table(spark, sf_dir, "documents"), width=20).drop("kept_text")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_simhash_groups")
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the group of near copies it is in."""
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.select("doc_id", "fingerprint", "component_id")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document and the verdict of the voting rules."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "quality", "kept",
    )


@query("op7_line_dedup", oracles.OP7)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that many pages of their site carry."""
    return line_dedup(table(spark, sf_dir, "pages"), ratio=0.3, least_pages=5)


@query("op9_mixing", oracles.OP9)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of its sources."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


@query("op10_sharding", oracles.OP10)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 40 equal shards, and its shard among 41."""
    return sharded_digest(table(spark, sf_dir, "documents"), [1.0] * 40)


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with changed parameters."""
    return contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True, few_items=None
    ).drop("mark")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views of the labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "content", "metadata", "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


@query("op11_conversation_repair", oracles.OP11)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return repair_digest(conversations, damage(conversations))


@query("op12_filter_audit", oracles.OP12)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order they can be applied in, by language."""
    flags = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit(flags, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


@query("op13_exact_dedup", oracles.OP13)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for white space, and the one of each group that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))
