"""Sharding along a Hilbert curve, for files that prune on several columns at once.

Each dimension (language, source, length by default) is quantised to ``2^bits`` cells that hold like shares of the rows:
numbers by approximate quantiles, strings by the values at which the running count of the sorted distinct values passes
each share (counted by ranges, so no task sees all values; whole strings are compared). The cell numbers give a curve index, rows are sorted by (index, doc_id, text hash) and the sequence is cut into ``shards`` runs. A shard is a
run of neighbouring cells, so its minimum and maximum of every dimension are narrow and a filter on any of them skips
most files. The law is ``rows``: counts of shards differ by one at most.

The order is made by a range sort; each range's row count (one number a range) gives its offset, so ranks are exact
and no task sees all rows. Texts don't move in the query: only the digest columns are sorted.

Defined cases: null text is empty for the digest and has size 1; null dimensions sort first; fewer rows than shards
leave shards empty; equal rows keep separate slots; an empty table gives no rows; extra columns are kept by
``shard_table`` and ignored by the query. ``shard_table`` carries a row as one struct, so no name made within can meet a
column's; columns named ``shard_id`` or ``slot_id`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm._common import documents, plan_partitions, stored

SHARDS = 16
BITS = 5
DIMENSIONS = ("lang", "source", "n_chars")
#: Relative error of the quantiles that bound the cells; cells needn't be exact.
QUANTILE_ERROR = 0.002


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of cells (n, dimensions), by exchanging and inverting low bits from the top bit down, then undoing the Gray code."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry = np.where((x[-1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def string_bounds(values: DataFrame, cells: int) -> list[str]:
    """values(v): for each i from 1 to cells - 1 the string at which the running count over sorted strings passes i / cells of all."""
    counts = stored(values.where("v is not null").groupBy("v").count().repartitionByRange(plan_partitions(values.sparkSession), "v").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("count").alias("n")).collect()}  # one row a range
    total, before, at = sum(sizes.values()), {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    if not total:
        return []
    up_to = F.sum("count").over(Window.partitionBy("part").orderBy("v")) + F.element_at(F.create_map(*(F.lit(int(x)) for kv in before.items() for x in kv)), F.col("part"))
    placed = counts.withColumn("up_to", up_to)
    passes = placed.select("v", (F.least(F.floor(F.col("up_to") * cells / total), F.lit(cells - 1)) - F.floor((F.col("up_to") - F.col("count")) * cells / total)).alias("times")).where("times > 0")
    return sorted(v for r in passes.collect() for v in [r.v] * r.times)


def cell_columns(df: DataFrame, dimensions, bits: int) -> list[Column]:
    """The cell of each dimension; nulls and absent columns are in cell 0."""
    kinds, cells = dict(df.dtypes), 1 << bits
    numbers = [c for c in dict.fromkeys(dimensions) if c in kinds and kinds[c] != "string"]
    found = df.select(*(F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers))).approxQuantile([f"n{i}" for i in range(len(numbers))], [i / cells for i in range(1, cells)], QUANTILE_ERROR) if numbers else []
    cuts = {c: [F.lit(float(x)) for x in b] for c, b in zip(numbers, found, strict=True)}
    # a value that passes several shares is that many bounds, so few values spread over the whole range of cells
    # a string's bound is the last value of a cell, a number's the first of the next
    cuts |= {c: [F.lit(x) for x in string_bounds(df.select(F.col(c).alias("v")), cells)] for c in dict.fromkeys(dimensions) if kinds.get(c) == "string"}

    def cell(c: str) -> Column:
        if not cuts.get(c):
            return F.lit(0)
        passed = (lambda x: x < F.col(c)) if kinds[c] == "string" else (lambda x: x <= F.col(c).cast("double"))
        return F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(F.array(*cuts[c]), passed)))

    return [cell(c) for c in dimensions]


def with_curve(df: DataFrame, name: str, dimensions=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """df plus the curve index. Bounds are 2^bits values a dimension, whatever the table's size."""

    @F.pandas_udf("bigint")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in columns], axis=1), bits))

    return df.withColumn(name, index(*cell_columns(df, dimensions, bits)))


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df plus ``rank__`` (from 0, gapless) by the given order, and the number of rows. df is stored in range order on the way."""
    parts = plan_partitions(df.sparkSession)
    placed = stored(df.repartitionByRange(parts, *order).withColumn("part__", F.spark_partition_id()))
    sizes = {r["part__"]: r["count"] for r in placed.groupBy("part__").count().collect()}  # one row a range
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    before = F.create_map(*(F.lit(int(v)) for kv in offsets.items() for v in kv)) if offsets else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return placed.withColumn("rank__", (within - 1 + F.element_at(before, F.col("part__"))).cast("bigint")).drop("part__"), total


def shard_rows(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """rows plus ``shard__`` and ``slot__``: runs of the order, counts at most one apart."""
    df, total = ranked(rows, order)
    total = max(1, total)
    # the shard of rank r is the s with ceil(s * n / shards) <= r < ceil((s + 1) * n / shards), that is floor(r * shards / n)
    shard = F.expr(f"cast(rank__ * {shards} div {total} as int)")
    return df.withColumn("shard__", shard).withColumn("slot__", F.expr(f"rank__ - (shard__ * {total}L + {shards - 1}) div {shards}")).drop("rank__")


def placed_rows(docs: DataFrame, row: list[Column], id_col: str, text_col: str, dimensions, bits: int, shards: int) -> DataFrame:
    """row (a struct of the given columns), curve, shard__, slot__ of each row."""
    own = {c: f"d{i}" for i, c in enumerate(c for c in dict.fromkeys(dimensions) if c in docs.columns)}
    narrow = docs.select(F.struct(*row).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), *(F.col(c).alias(n) for c, n in own.items()))
    curved = with_curve(narrow, "curve", [own.get(c, c) for c in dimensions], bits).drop(*own.values())
    return shard_rows(curved, ["curve", "id", "hash"], shards)


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dimensions=DIMENSIONS, bits: int = BITS, shards: int = SHARDS) -> DataFrame:
    """The digest of every row's place: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = [
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
    ]
    placed = placed_rows(docs, digest, id_col, text_col, dimensions, bits, shards)
    return placed.select("row.*", F.lit("rows").alias("law"), F.col("shard__").alias("shard"), F.col("slot__").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dimensions=DIMENSIONS, bits: int = BITS, shards: int = SHARDS) -> DataFrame:
    """docs with ``shard_id`` and ``slot_id`` (in place of columns of these names), ready for a write partitioned by shard; all columns move once."""
    docs = docs.drop("shard_id", "slot_id")
    placed = placed_rows(docs, [F.col(c) for c in docs.columns], id_col, text_col, dimensions, bits, shards)
    return placed.select("row.*", F.col("shard__").alias("shard_id"), F.col("slot__").alias("slot_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
