"""Ownership of spans by several claimants: scores, resolution, ledgers, duplicates, cardinality of what is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = ("table", "formula", "figure", "text")


def score(covered: Column, area: Column, baseline: Column, math_font: Column, numbered: Column) -> Column:
    return 1 + 2 * covered.cast("int") + 3 / (1 + area / 100) + 2 / (1 + baseline) + 0.5 * math_font.cast("int") + 1.5 * numbered.cast("int")


def resolve(candidates: DataFrame, keys: list[str], score_col: str, position: str) -> DataFrame:
    """Each row's best candidate: the largest score, then the first. This is an arg-max row by row, not a matching."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score_col), position)
    return candidates.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def by_priority(claims: DataFrame, keys: list[str], priority=PRIORITY) -> DataFrame:
    """claims(keys, owner_type, owner_id): the owner of the highest type, then the smallest id; and how many claimed."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("owner_type"))
    return claims.groupBy(*keys).agg(F.min_by(F.struct("owner_type", "owner_id"), F.struct(rank, F.col("owner_id"))).alias("o"), F.countDistinct("owner_type", "owner_id").alias("n_claims")).select(*keys, "o.owner_type", "o.owner_id", "n_claims")


def ledger(spans: DataFrame, claims: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """By group: spans, owned once, owned more than once, unowned."""
    per = claims.groupBy(*keys).agg(F.countDistinct("owner_type", "owner_id").alias("n_"))
    j = spans.select(*keys, *[g for g in group if g not in keys]).join(per, keys, "left")
    n = F.coalesce(F.col("n_"), F.lit(0))
    return j.groupBy(*group).agg(F.count("*").alias("spans"), F.count_if(n == 1).alias("owned"), F.count_if(n > 1).alias("duplicated"), F.count_if(n == 0).alias("unowned"))


def cardinality(expected: DataFrame, placements: DataFrame, keys: list[str]) -> DataFrame:
    """expected(keys, expected_count) against the number of placements: ok, missing or duplicate."""
    got = placements.groupBy(*keys).agg(F.count("*").alias("actual_count"))
    j = expected.join(got, keys, "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))
    return j.withColumn("verdict", F.when(F.col("actual_count") == F.col("expected_count"), "ok").when(F.col("actual_count") < F.col("expected_count"), "missing").otherwise("duplicate"))


def reuse(fragments: DataFrame, key: str, consumer: str) -> DataFrame:
    """Fragments that more than one consumer uses."""
    return fragments.groupBy(key).agg(F.countDistinct(consumer).alias("consumers")).where("consumers > 1")


def drop_subsets(blocks: DataFrame, keys: list[str], block_id: str, items: str) -> DataFrame:
    """Blocks whose items are a proper part of another block's, or equal to those of an earlier one, go. A pair needs a
    common item, so pairs come from a join on items and not from all pairs of blocks."""
    size = blocks.select(*keys, block_id, F.size(F.array_distinct(items)).alias("n"))
    item = blocks.select(*keys, block_id, F.explode(F.array_distinct(items)).alias("item"))
    a, b = item.withColumnRenamed(block_id, "a_"), item.withColumnRenamed(block_id, "b_")
    common = a.join(b, [*keys, "item"]).where("a_ <> b_").groupBy(*keys, "a_", "b_").agg(F.count("*").alias("c_"))
    n = common.join(size.select(*keys, F.col(block_id).alias("a_"), F.col("n").alias("na_")), [*keys, "a_"]).join(size.select(*keys, F.col(block_id).alias("b_"), F.col("n").alias("nb_")), [*keys, "b_"])
    gone = n.where((F.col("c_") == F.col("na_")) & ((F.col("nb_") > F.col("na_")) | ((F.col("nb_") == F.col("na_")) & (F.col("b_") < F.col("a_"))))).select(*keys, F.col("a_").alias(block_id)).distinct()
    return blocks.join(gone, [*keys, block_id], "left_anti")
