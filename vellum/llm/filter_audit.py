"""Filter interaction audit: what five filters remove in every order, and each one's share, from a multilinear extension.

The documents of a part (a source) are counted by the set of filters they fail, a mask of five bits. With x_i the degree
to which filter i is in use, 0 to 1, a part's removal polynomial is

    f(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)),

written out as 32 coefficients of products of distinct x_i. At a corner (every x_i 0 or 1) it is the number of documents
that those filters remove together, so a part's rows less f are its survivors, and steps of an order are differences of
corners. Filter i's Shapley value is the integral from 0 to 1 of df/dx_i along the diagonal x = (t, ..., t), taken with
exact rationals; times 120 it is the number of documents that it removes, summed over all orders.

Masks are counted by Spark; a part's polynomials are 3 x 32 integers, whatever it holds. Equal texts are found by
SHA-256: rows of one text, part and label are added up before they meet, and then hold a row for each part and label
only, so a text that a third of all rows share is a few rows. Texts themselves are never shuffled.

Defined cases: a null text is empty (no words: it fails A alone, and E if it isn't the first empty text); a null id is
neither smaller nor larger than another, so such a row doesn't fail E and makes no other row fail it, and it has no
label; rows that repeat id and text are counted each, and none of them is the other's copy; a document with several
label rows is good (toxic) if one of them says so; a null source is the part ''; an empty table has no parts and gives
no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm._common import documents

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")
#: Parts of a salted join: rows without an id meet no label and are spread over so many keys.
SALT = 256

ROWS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failures(text: Column) -> Column:
    """Bits 0 to 3 of the mask: the failure conditions A to D, which a text decides alone."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (count < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * count, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(MARKS))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests[1:], 1)), F.when(tests[0], 1).otherwise(0))


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id_"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failures(text).alias("mask"),
    ).withColumn("salt_", F.when(F.col("id_").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALT))).otherwise(F.lit(0)).cast("int"))
    said = labels.select(F.col("doc_id").cast("bigint").alias("id_"), F.lit(0).alias("salt_"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    said = said.where("id_ is not null").groupBy("id_", "salt_").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    known = rows.join(said, ["id_", "salt_"], "left").select("id_", "salt_", "part", "digest", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    cell = ["digest", "mask", "part", "good", "toxic"]
    each = known.groupBy("id_", "salt_", *cell).agg(F.count("*").alias("c"))
    cells = each.groupBy(*cell).agg(F.sum("c").alias("n"), F.min("id_").alias("first"), F.coalesce(F.min_by("c", "id_"), F.lit(0)).alias("at_first"), F.coalesce(F.sum(F.when(F.col("id_").isNull(), F.col("c"))), F.lit(0)).alias("no_id"))
    first = F.min("first").over(Window.partitionBy("digest"))
    own = F.col("no_id") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0))
    split = cells.withColumn("least", first).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))).alias("s"))
    return split.where("s.n > 0").groupBy("part", F.col("s.mask").cast("int").alias("mask")).agg(F.sum("s.n").alias("n"), *(F.sum(F.col("s.n") * F.col(c)).alias(c) for c in ("good", "toxic")))


def removal_polynomial(counts: dict[int, int]) -> list[int]:
    """Coefficients, by the set of variables in a product (bits), of f for counts by mask: 1 - prod(1 - x_i) has -(-1)^|s| at every subset s of m but the empty one."""
    found = [0] * (1 << len(FILTERS))
    for mask, n in counts.items():
        subset = mask
        while subset:
            found[subset] += n if subset.bit_count() % 2 else -n
            subset = (subset - 1) & mask
    return found


def corner(polynomial: list[int], chosen: int) -> int:
    """The value where the chosen variables are 1 and the others 0: products of chosen variables alone are left."""
    return sum(c for s, c in enumerate(polynomial) if s & ~chosen == 0)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """Integral over t in [0, 1] of the partial derivative by x_i at (t, ..., t)."""
    diagonal = [0] * len(FILTERS)  # coefficients of powers of t
    for s, c in enumerate(polynomial):
        if s >> i & 1:
            diagonal[s.bit_count() - 1] += c
    return sum((Fraction(c, power + 1) for power, c in enumerate(diagonal)), Fraction(0))


def part_rows(part: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """All orders and steps of one part."""
    size = 1 << len(FILTERS)
    polynomials = [removal_polynomial({m: c[k] for m, c in counts.items()}) for k in range(len(COUNTS))]
    gone, good, toxic = ([corner(p, s) for s in range(size)] for p in polynomials)
    total = sum(c[0] for c in counts.values())
    orders = list(permutations(range(len(FILTERS))))
    share = []
    for i in range(len(FILTERS)):
        scaled = shapley(polynomials[0], i) * len(orders)
        if scaled.denominator != 1:
            raise ArithmeticError(f"the scaled Shapley value of {FILTERS[i]} in {part!r} is {scaled}")
        share.append(scaled.numerator)
    rows = []
    for order in orders:
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            alone = gone[size - 1] - gone[size - 1 & ~(1 << i)]
            rows.append((part, "".join(FILTERS[j] for j in order), step, total - gone[after], removed, gone[1 << i] - removed, alone, good[after] - good[before], toxic[after] - toxic[before], share[i]))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order of the filters and step. A part is one row of at most 32 mask counts before Python sees it."""
    per_part = mask_counts(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def expand(batches):
        for b in batches:
            for part, counts in zip(b["part"], b["counts"], strict=True):
                yield pd.DataFrame(part_rows(part, {c["mask"]: tuple(c[k] for k in COUNTS) for c in counts}), columns=names)

    return per_part.mapInPandas(expand, ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), w AS (
  SELECT doc_id, part, x, first_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 200 AS fa,
         100 * len(list_distinct(words)) < 50 * len(words) AS fb,
         100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS fc,
         regexp_matches(x, '[#$%&*|]') AS fd,
         coalesce(first_id < w.doc_id, false) AS fe
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), m AS (
  SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM d GROUP BY 1, 2
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step) AS used FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN translate(fails, used, '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, f) AND translate(fails, substr(used, 1, step - 1), '') = fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, f) AND translate(fails, substr(used, 1, step - 1), '') <> fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, f) AND translate(fails, substr(used, 1, step - 1), '') = fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, f) AND translate(fails, substr(used, 1, step - 1), '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
