"""Robust statistics and profiles, exact, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bands of values for each doubling of their size. Bands depend on the value alone, so no pass is needed to find them.
BANDS = 32


def band(value: Column) -> Column:
    """A whole number that never falls as the value rises; NaN is above all others."""
    v = value.cast("double")
    return F.when(F.isnan(v), 2**31 - 1).otherwise((F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * BANDS)).cast("int"))


def _before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys, band_, n_) plus the rows of lower bands and of all: a window over one row a band."""
    w = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("n_").over(w.orderBy("band_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*keys, "band_", below.alias("below_"), F.sum("n_").over(w).alias("all_"))


def ranked(df: DataFrame, keys: list[str], value: str, order: list[str] = ()) -> DataFrame:
    """df plus ``r_`` (rank from 1 by value, then order) and ``n_``. Rows are sorted by band, not by key, so a key that holds a
    third of the table is many tasks' work."""
    banded = df.withColumn("band_", band(F.col(value)))
    places = _before(banded.groupBy(*keys, "band_").agg(F.count("*").alias("n_")), keys)
    within = F.row_number().over(Window.partitionBy(*keys, "band_").orderBy(value, *order))
    return banded.join(places, [*keys, "band_"]).withColumn("r_", F.col("below_") + within).withColumnRenamed("all_", "n_").drop("band_", "below_")


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, n, q array): exact quantiles, interpolated. Values are counted first, then bands of distinct values are sorted,
    so neither a key nor a value is one task's work."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_")).withColumn("band_", band(F.col("v_")))
    places = _before(counted.groupBy(*keys, "band_").agg(F.sum("c_").alias("n_")), keys)
    up_to = F.col("below_") + F.sum("c_").over(Window.partitionBy(*keys, "band_").orderBy("v_"))
    j = counted.join(places, [*keys, "band_"]).withColumn("to_", up_to)

    def at(rank: Column) -> Column:
        """The value at a rank from 0."""
        return F.max(F.when((F.col("to_") > rank) & (F.col("to_") - F.col("c_") <= rank), F.col("v_")))

    place = [(F.col("all_") - 1) * f for f in fractions]
    found = j.groupBy(*keys).agg(F.max("all_").alias("n"), *(at(F.floor(p)).alias(f"lo{i}_") for i, p in enumerate(place)), *(at(F.ceil(p)).alias(f"hi{i}_") for i, p in enumerate(place)))
    rest = [(F.col("n") - 1) * f - F.floor((F.col("n") - 1) * f) for f in fractions]
    return found.select(*keys, "n", F.array(*(F.when(w == 0, F.col(f"lo{i}_")).otherwise((1 - w) * F.col(f"lo{i}_") + w * F.col(f"hi{i}_")) for i, w in enumerate(rest))).alias("q"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, median, p10, p90, min, max and the median absolute deviation; null and NaN values are left out."""
    v = F.col(value).cast("double")
    clean = df.where(v.isNotNull() & ~F.isnan(v))
    centred = quantiles(clean, keys, value, [0.5, 0.1, 0.9, 0.0, 1.0])
    off = clean.join(centred.select(*keys, F.col("q")[0].alias("m_")), keys).withColumn("off_", F.abs(F.col(value) - F.col("m_")))
    mad = quantiles(off, keys, "off_", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    return centred.join(mad, keys).select(*keys, F.col("n").alias("sample_count"), *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p10", "p90", "min", "max"))), "mad")


def robust_z(value: Column, centre: Column, spread: Column, floor: float = 1e-9) -> Column:
    return F.abs(value - centre) / F.greatest(1.4826 * spread, F.lit(floor))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper of the two middle values; not an average."""
    r = ranked(df.where(F.col(value).isNotNull()), keys, value)
    return r.where(F.col("r_") - 1 == F.floor(F.col("n_") / 2)).select(*keys, F.col(value).alias("upper_median"))


def trimmed(df: DataFrame, keys: list[str], value: str, order: list[str], fraction: float = 0.1, least: int = 8) -> DataFrame:
    """Without the lowest and highest tenth, in groups of eight or more."""
    r = ranked(df, keys, value, order)
    cut = F.when(F.col("n_") >= least, F.floor(F.col("n_") * fraction)).otherwise(0)
    return r.where((F.col("r_") > cut) & (F.col("r_") <= F.col("n_") - cut)).drop("r_", "n_")


def first_mode(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value; the one met first of equals."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n_"), F.min(position).alias("p_"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n_"), -F.col("p_"))).alias("mode"), F.max("n_").alias("mode_count"))


def outliers(df: DataFrame, keys: list[str], value: str, relative: float, absolute: float) -> DataFrame:
    """Rows further from their group's median than the larger of a share of it and a fixed distance."""
    m = df.groupBy(*keys).agg(F.expr(f"median({value})").alias("median_"))
    joined = df.join(m, keys)
    return joined.where(F.abs(F.col(value) - F.col("median_")) > F.greatest(F.abs("median_") * relative, F.lit(absolute))).drop("median_")


def occupancy(df: DataFrame, keys: list[str], lo: str, hi: str, smooth: int = 5) -> DataFrame:
    """Coverage by unit bins from floor(lo) to floor(hi), and its mean over ``smooth`` bins to either side of the bins from the least to the largest."""
    # a rise where an interval begins and a fall after its end: two rows an interval, not one for each bin; between two
    # steps the level stays, so the bins come from each step and the next, without a join
    ends = F.array(F.struct(F.floor(lo).alias("bin"), F.lit(1).alias("d")), F.struct((F.floor(hi) + 1).alias("bin"), F.lit(-1).alias("d")))
    steps = df.select(*keys, F.explode(ends).alias("e_")).groupBy(*keys, F.col("e_.bin").alias("bin")).agg(F.sum("e_.d").alias("d_"))
    order = Window.partitionBy(*keys).orderBy("bin")
    level = steps.select(*keys, "bin", F.sum("d_").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("bin").over(order).alias("next_"))
    full = level.where("next_ is not null").select(*keys, F.explode(F.sequence("bin", F.col("next_") - 1)).alias("bin"), "n")
    return full.withColumn("smoothed", F.avg("n").over(order.rowsBetween(-smooth, smooth)))


def multiset_recall(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """sum(min(counts)) / sum(expected counts); 1 if nothing is expected."""
    e, f = expected.groupBy(key).agg(F.count("*").alias("e")), found.groupBy(key).agg(F.count("*").alias("f"))
    joined = e.join(f, key, "left")
    total = F.sum("e")
    return joined.agg(total.alias("expected"), F.coalesce(F.sum(F.least("e", F.coalesce("f", F.lit(0)))), F.lit(0)).alias("matched")).select(
        F.coalesce("expected", F.lit(0)).alias("expected"), "matched", F.when(F.coalesce("expected", F.lit(0)) == 0, 1.0).otherwise(F.col("matched") / F.col("expected")).alias("recall")
    )


def _medians(df: DataFrame, key: str, values: dict[str, Column], prefix: str) -> DataFrame:
    """(key, a median a value): all values as rows of one table, counted, and their ranks found by bands, so that no key is one
    task's work and no task holds a key's values."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()))).alias("x")
    q = quantiles(df.select(key, named).select(key, "x.name", "x.v"), [key, "name"], "v", [0.5])
    return q.groupBy(key).agg(*(F.max(F.when(F.col("name") == n, F.col("q")[0])).alias(f"{prefix}{n}") for n in values))


def robust_profile(df: DataFrame, key: str, features: list[str], limit: float = 4.5, floor: float = 1.0) -> DataFrame:
    """Two passes over the groups' feature rows: medians and deviations, rows within ``limit`` scaled deviations of every
    one, then the medians of those; support and confidence."""
    med = _medians(df, key, {f: F.col(f) for f in features}, "m_").join(df.groupBy(key).agg(F.count("*").alias("n_rows")), key)
    joined = df.join(F.broadcast(med), key)
    mad = _medians(joined, key, {f: F.abs(F.col(f) - F.col(f"m_{f}")) for f in features}, "d_")
    scored = joined.join(F.broadcast(mad), key)
    inside = F.lit(True)
    for f in features:
        inside = inside & (robust_z(F.col(f), F.col(f"m_{f}"), F.col(f"d_{f}"), floor) <= limit)
    near = scored.where(inside)
    kept = _medians(near, key, {f: F.col(f) for f in features}, "").join(near.groupBy(key).agg(F.count("*").alias("support")), key)
    out = kept.join(med.select(key, "n_rows"), key)
    share = F.least(F.lit(1.0), F.col("support") / F.greatest(F.lit(4.0), 0.55 * F.col("n_rows")))
    return out.withColumn("confidence", F.when(F.col("support") < 2, share * 0.4).otherwise(share))
