"""Evidence for typographic values, as states that merge: for each metric a sketch of its values, the pages it was seen on, the
number of samples. Made by document, stored, rolled up to any larger group from the states alone, without the rows.

Values are kept in KLL sketches: a quantile's rank is off by at most about 1.3 % of the samples (``K`` = 200, 99 % sure), and by
nothing as long as a group has fewer than ``K`` samples, since then they are all kept. Samples are exact. Pages are counted
from bitmaps by document, so they are exact too; numbers of pages below ``MOST_PAGES`` a document are a stated bound, beyond which
it is an error, not a wrong count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 200
RANK_ERROR = 0.0133
#: Pages of a document that a bitmap holds.
MOST_PAGES = 32_768


def states(values: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """values(keys, page, metric, value) to (keys, metric, sketch, samples, pages, first_page, last_page); null values are no samples."""
    n = F.col(page).cast("bigint")
    bounded = F.when((n >= 0) & (n < MOST_PAGES), F.bitmap_bit_position(n + 1)).otherwise(F.raise_error(F.lit(f"a page's number is outside 0 to {MOST_PAGES - 1}")).cast("bigint"))
    known = values.where("value is not null").withColumn("bit_", bounded)
    return known.groupBy(*keys, "metric").agg(
        F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(K)).alias("sketch"), F.count("*").alias("samples"), F.bitmap_count(F.bitmap_construct_agg("bit_")).alias("pages"), F.min(n).alias("first_page"), F.max(n).alias("last_page")
    )


def merged(held: DataFrame, keys: list[str]) -> DataFrame:
    """States of smaller groups, each with its own pages, as one of a larger group."""
    return held.groupBy(*keys, "metric").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("samples").alias("samples"), F.sum("pages").alias("pages"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.count("*").alias("parts"))


def confidence(samples: Column, pages: Column, spread: Column, centre: Column) -> Column:
    """0 to 1: full with 30 samples on 4 pages, less the relative distance between the quartiles."""
    support = F.least(F.lit(1.0), samples / 30.0) * F.least(F.lit(1.0), pages / 4.0)
    return F.round(support * F.greatest(F.lit(0.0), 1.0 - spread / F.greatest(F.abs(centre), F.lit(1e-9))), 4)


def tokens(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, p10, p25, value, p75, p90, samples, pages, confidence): the value is the median."""
    at = {"p10": 0.1, "p25": 0.25, "value": 0.5, "p75": 0.75, "p90": 0.9}
    q = held.select(*keys, "metric", "samples", "pages", *(F.kll_sketch_get_quantile_double("sketch", F.lit(v)).alias(k) for k, v in at.items()))
    return q.withColumn("confidence", confidence(F.col("samples"), F.col("pages"), F.col("p75") - F.col("p25"), F.col("value")))


def ratios(found: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Tokens as shares of the base metric's value, with the lesser confidence of the two; the base itself is left out."""
    b = found.where(F.col("metric") == base).select(*keys, F.col("value").alias("base_"), F.col("confidence").alias("sure_"))
    j = found.where(F.col("metric") != base).join(b, keys)
    return j.select(*keys, "metric", (F.col("value") / F.nullif("base_", F.lit(0.0))).alias("ratio"), F.least("confidence", "sure_").alias("confidence"), "samples", "pages")
