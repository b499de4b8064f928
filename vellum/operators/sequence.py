"""Ordered sequences: islands, interval algebra, running-mean clustering, gaps, and state machines over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Overlapping or touching intervals as one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("new_", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    numbered = flagged.withColumn("island", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n_merged"))


def complement(merged: DataFrame, frames: DataFrame, keys: list[str], lo: str, hi: str, least: float = 0.0) -> DataFrame:
    """What merged intervals leave free of each frame (keys, frame_lo, frame_hi), in pieces of ``least`` or more."""
    clipped = merged.join(frames, keys).select(*keys, "frame_lo", "frame_hi", F.greatest(lo, "frame_lo").alias(lo), F.least(hi, "frame_hi").alias(hi)).where(F.col(lo) < F.col(hi))
    w = Window.partitionBy(*keys).orderBy(lo)
    before = clipped.select(*keys, F.coalesce(F.lag(hi).over(w), F.col("frame_lo")).alias("free_lo"), F.col(lo).alias("free_hi"))
    last = frames.join(clipped.groupBy(*keys).agg(F.max(hi).alias("end_")), keys, "left").select(*keys, F.coalesce("end_", "frame_lo").alias("free_lo"), F.col("frame_hi").alias("free_hi"))
    return before.union(last).where(F.col("free_hi") - F.col("free_lo") >= least).where(F.col("free_hi") > F.col("free_lo"))


def gap_islands(df: DataFrame, keys: list[str], order: list[str], gap: Column, name: str = "island") -> DataFrame:
    """df plus the number of the run a row is in; ``gap`` is true where a row begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bands(df: DataFrame, keys: list[str], position: str, value: str, threshold: float, bridge: int = 4) -> DataFrame:
    """Runs of consecutive positions at the threshold or above; runs less than ``bridge`` apart are one."""
    w = Window.partitionBy(*keys).orderBy(position)
    over = df.where(F.col(value) >= threshold)
    apart = F.col(position) - F.lag(position).over(w) > bridge
    return gap_islands(over, keys, [position], apart).groupBy(*keys, "island").agg(F.min(position).alias("band_lo"), F.max(position).alias("band_hi"))


def valleys(df: DataFrame, keys: list[str], position: str, value: str, threshold: float) -> DataFrame:
    """Runs below the threshold that lie between two bands: runs at either end are left out."""
    w = Window.partitionBy(*keys).orderBy(position)
    over = F.when(F.col(value) >= threshold, F.col(position))
    inside = df.withColumns({"a_": F.min(over).over(Window.partitionBy(*keys)), "b_": F.max(over).over(Window.partitionBy(*keys))})
    low = inside.where((F.col(value) < threshold) & (F.col(position) > F.col("a_")) & (F.col(position) < F.col("b_")))
    apart = F.col(position) - F.lag(position).over(w) > 1
    return gap_islands(low, keys, [position], apart).groupBy(*keys, "island").agg(F.min(position).alias("valley_lo"), F.max(position).alias("valley_hi"))


class _Clusters:
    """Clusters of sorted values, batch by batch: the group and the last cluster's sum, count and number are all that is carried.

    A value more than the tolerance over the one before is over the mean by more too, so it begins a cluster; a run without such
    a step that is no longer than the tolerance is one cluster. Only runs in between, and one that goes on from the batch
    before, are folded value by value; rounding is kept out of both tests by a margin."""

    def __init__(self, tolerance: float):
        self.tolerance, self.group, self.last, self.total, self.n, self.k = tolerance, None, 0.0, 0.0, 0, -1

    def _fold(self, values: list[float]) -> list[int]:
        out, total, n, k = [], self.total, self.n, self.k
        for v in values:
            if n and v - total / n <= self.tolerance:
                total, n = total + v, n + 1
            else:
                total, n, k = v, 1, k + 1
            out.append(k)
        self.total, self.n, self.k = total, n, k
        return out

    def numbers(self, values, groups):
        """values (no nulls) and groups of a batch, as arrays."""
        import numpy as np

        if not len(values):
            return np.empty(0, np.int32)
        margin = 1e-9 * abs(self.tolerance) + 1e-12 * np.abs(values)
        goes_on = self.group is not None and groups[0] == self.group
        fresh = np.concatenate(([not goes_on], groups[1:] != groups[:-1]))
        step = np.concatenate(([goes_on and values[0] - self.last > self.tolerance + margin[0]], values[1:] - values[:-1] > self.tolerance + margin[1:]))
        starts = np.flatnonzero(fresh | step | (np.arange(len(values)) == 0))
        ends = np.append(starts[1:], len(values))
        long = values[ends - 1] - values[starts] > self.tolerance - margin[ends - 1]
        if goes_on and not step[0]:
            long[0] = True
        long[-1] = True  # its sum is carried
        out = np.empty(len(values), np.int32)
        # between two folded runs all are one cluster each
        for i, j in zip(np.concatenate(([-1], np.flatnonzero(long)[:-1])).tolist(), np.flatnonzero(long).tolist(), strict=True):
            if j > i + 1:
                first = starts[i + 1 : j]
                new = fresh[first]
                since = np.maximum.accumulate(np.where(new, np.arange(len(first)), -1))
                k = np.where(since >= 0, np.arange(len(first)) - since, np.arange(len(first)) + self.k + 1)
                out[first[0] : starts[j]] = np.repeat(k, ends[i + 1 : j] - first)
                self.k = int(k[-1])
            a, z = int(starts[j]), int(ends[j])
            if fresh[a]:
                self.k = -1
            if fresh[a] or step[a]:
                self.n = 0
            out[a:z] = self._fold(values[a:z].tolist())
        self.group, self.last = groups[-1], float(values[-1])
        return out


def cluster_1d(df: DataFrame, keys: list[str], value: str, tolerance: float, order: list[str] = (), carry: list[str] = (), dealt: bool = False) -> DataFrame:
    """Greedy clusters along sorted values: a value joins the last cluster if it is at most ``tolerance`` over the
    cluster's running mean. df has ``id_``; returns keys, id_, the carried columns, cluster. A running mean has no associative form: rows are
    sorted within hash partitions and folded once in Arrow batches, most of them by whole runs; only a sum and a count are
    carried, so a group may be of any length. Null values have cluster -1. ``dealt`` says that df's rows are dealt by the keys
    already, as after a window over them."""
    import numpy as np
    import pyarrow as pa

    own = [*keys, "id_", *carry]
    rows = df.select(*own, F.col(value).cast("double").alias("v_"), *(c for c in order if c not in own), F.xxhash64(*keys).alias("g_"))
    placed = (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, "v_", *order, "id_").select(*own, "v_", "g_")
    kept = len(own)

    def fold(batches):
        clusters = _Clusters(tolerance)
        for b in batches:
            known = b.column(kept).is_valid().to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, -1, np.int32)
            out[known] = clusters.numbers(b.column(kept).to_numpy(zero_copy_only=False)[known], b.column(kept + 1).to_numpy()[known])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(kept)), pa.array(out)], names=[*own, "cluster"])

    types = dict(df.dtypes)
    return placed.mapInArrow(fold, ", ".join(f"`{c}` {types[c]}" for c in own) + ", cluster int")


def median_gap(df: DataFrame, keys: list[str], order: list[str], lo: str, hi: str, least: float = 2, most: float = 40, clamp=(3.0, 14.0), default: float = 8.0) -> DataFrame:
    """Upper-median gap between neighbours, of gaps in (least, most), clamped; the default where there is none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gaps = df.withColumn("gap_", F.col(lo) - F.lag(hi).over(w))
    kept = F.filter(F.sort_array(F.collect_list("gap_")), lambda g: (g > least) & (g < most))
    grouped = gaps.groupBy(*keys).agg(kept.alias("g_"))
    mid = F.element_at("g_", (F.floor(F.size("g_") / 2) + 1).cast("int"))
    return grouped.select(*keys, F.when(F.size("g_") == 0, default).otherwise(F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), mid))).alias("gap"))


#: States in document order.
STATES = ("normal_body", "references", "appendix", "acknowledgement")


def document_states(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """pages(doc, page, heading, numbered_section, reference_density): the state at the end of each page. A heading
    enters its state; density of 0.6 or more enters references; a numbered section returns to the body; else it is
    inherited. ``last(..., ignorenulls)`` carries it, so a document of any length streams through a window."""
    heading = F.lower(F.trim("heading"))
    event = (
        F.when(heading.rlike("^(?:references|bibliography)$"), "references")
        .when(heading.rlike("^(?:appendix|appendices)\\b"), "appendix")
        .when(heading.rlike("^acknowledge?ments?$"), "acknowledgement")
        .when(F.col("numbered_section"), "normal_body")
        .when(F.col("reference_density") >= 0.6, "references")
    )
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("event_", event).withColumn("state", F.coalesce(F.last("event_", ignorenulls=True).over(w), F.lit("normal_body"))).withColumn("inherited", F.col("event_").isNull()).drop("event_")


def stitch(df: DataFrame, keys: list[str], order: list[str], linked: Column, name: str = "unit") -> DataFrame:
    """Consecutive rows that ``linked`` joins to the row before have one number, dense from 1."""
    return gap_islands(df, keys, order, ~F.coalesce(linked, F.lit(False)), name)
