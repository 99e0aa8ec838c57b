"""A corpus pipeline: documents through five of the training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. A caller may write each stage's result as Parquet and
read it back as the next one's ``docs``, as :func:`run` does.

What holds for every stage: an empty table gives no rows; columns beyond those of
``documents`` pass through whatever their names; a null text counts as empty and a null
doc_id or source as a value of its own; texts are read whole, however long. Rows repeated as
a whole stay together through the quality, decontamination, mixing and sharding stages, and
the near-copy stage keeps one of them. No stage relies on the order of its input but the
last one (see :func:`shard`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.decontaminate import decontaminate
from auditloom.llm.mixing import mix
from auditloom.llm.rules import quality_rules
from auditloom.llm.sharding import sharded_digest
from auditloom.llm.simhash import near_dedup
from auditloom.session import materialize, partitions_for, tune

SHARDS = 40


def _through(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a stage and give back the columns of ``docs``, whatever the stage adds.

    Columns beyond those of ``documents`` travel under names that no operator uses.
    """
    own = ("doc_id", "text", "lang", "source", "n_chars")
    names = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in own}
    out = stage(docs.withColumnsRenamed(names))
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior quality accept."""
    return _through(docs, lambda d: quality_rules(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies are linked by SimHash fingerprints of three-word shingles that differ in
    three bits at most.
    """
    return _through(docs, lambda d: near_dedup(d, shingle=3, radius=3))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _through(docs, lambda d: decontaminate(d, benchmark, any_case=True, few_items=None))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the interleaved order of their sources, as the order of the files.

    No document is dropped: what this stage decides is the order, which the next stage reads
    back from the files and numbers its slots by.
    """
    tasks = partitions_for(docs, 64 << 20)

    def ordered(d: DataFrame) -> DataFrame:
        return mix(d).repartitionByRange(tasks, "position").sortWithinPartitions("position")

    return _through(docs, ordered)


def _file_order() -> tuple[Column, Column]:
    """Order of the rows as they were written: number and name of the file, row in the file.

    Both are read from the files, whatever the order in which tasks read them.
    """
    name = F.col("_metadata.file_name")
    number = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return F.concat(F.lpad(number.cast("string"), 19, "0"), F.lit("/"), name), F.col("_metadata.row_index")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; slots keep the order of the files.

    Documents that come from no file are mixed here. The order is that of the files the
    mixing stage wrote, by part number and row; whoever writes these files anew in between,
    such as a compaction, loses the mix, and slots then follow the new files.
    """
    order = _file_order()
    try:
        docs.select(*order)
    except AnalysisException:
        docs = mix(docs)
        order = (F.lpad(F.expr("position div 65536").cast("string"), 19, "0"), F.col("position"))
    return sharded_digest(docs, [1.0] * SHARDS, order=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Votes with estimated accuracies and fingerprints of shingles are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder in between."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
