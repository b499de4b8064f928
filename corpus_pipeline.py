"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of ``documents``, but
for the last, which adds ``shard_id`` and ``slot_id``. ``run`` stores each stage's rows in the shared folder and reads
them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, hilbert, mixing, near_copies, toxicity
from vellum.llm._common import free_name, stored

#: Shares of tokens by domain; the tokens of "high" stay as they are.
MIX_TARGET = {"high": 0.90, "low": 0.10, "toxic": 0.0}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under the threshold."""
    chain = toxicity.train_chain(docs, toxicity.label_table(spark, sf_dir))
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more; SimHash trie join, then minimum
    hashes for what its bits do not reach, each link verified): the one with the smallest
    id, then the smallest text hash, and of equal rows one. A null id ranks after all others; repeated ids with texts of
    different groups each stay."""
    groups = near_copies.near_copies(docs.select("doc_id", "text"))
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"))
    kept = least.select("row.doc_id", "row.text_hash")
    hashed, kept_id, kept_hash = (free_name(docs, n) for n in ("text_hash", "kept_id", "kept_hash"))
    keyed, kept = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit("")))), kept.toDF(kept_id, kept_hash)
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(hashed) == F.col(kept_hash))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", hashed]).drop(hashed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing rates say. The classifier learns from the labelled documents of the whole table."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs, mixing.domain_table(spark, sf_dir), MIX_TARGET, mixing.KEEP, train_on=whole)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it along the Hilbert curve."""
    return hilbert.shard_table(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("hilbert_shards", shard),
]

#: Several stages (trained models, SimHash components, the curve) have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
