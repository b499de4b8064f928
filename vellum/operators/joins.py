"""Joins by ranges, overlap, nearness and order, with equi keys so that none becomes a nested loop."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import sweep


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], on=None, bucket: float | None = None, how: str = "inner", reach: float | None = None) -> DataFrame:
    """Pairs of boxes for which ``on(l, r)`` holds (closed intersection if None). Columns: keys, l_*, r_*. Where ``on`` can hold
    only for boxes that touch once the left one is grown by ``reach``, a plane sweep finds the candidates; then, with
    ``bucket``, rows are also dealt by horizontal strips of that height, for keys that hold very many boxes. Else pairs of
    equal keys are tested."""
    if how == "inner" and (on is None or reach is not None):
        pairs = sweep.overlaps(left, right, keys, strip=bucket, reach=reach or 0.0)
        return pairs if on is None else pairs.where(on(G.box("l_"), G.box("r_")))
    l, r = _prefixed(left, "l_", keys), _prefixed(right, "r_", keys)
    cond = (on or G.intersects_closed)(G.box("l_"), G.box("r_"))
    return l.join(r, keys, how).where(cond) if how == "inner" else l.join(r, [l[k] == r[k] for k in keys] + [cond], how)


#: Each left row with the right row of the largest common area, or with the nearest one: both by a plane sweep.
best_overlap = sweep.best_overlap
nearest = sweep.nearest


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the last right row at or before them: one union and one window, no pairs."""
    own = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_on).alias("t_"), F.lit(1).alias("side_"), F.struct(*own).alias("l_"), F.lit(None).cast(right.select(F.struct(right_on, *values)).schema[0].dataType).alias("r_"))
    b = right.select(*keys, F.col(right_on).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("l_"), F.struct(right_on, *values).alias("r_"))
    w = Window.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.union(b).withColumn("r_", F.last("r_", ignorenulls=True).over(w)).where("side_ = 1")
    return filled.select(*keys, *(F.col(f"l_.{c}").alias(c) for c in own), *(F.col(f"r_.{c}").alias(f"asof_{c}") for c in [right_on, *values]))


def band_of(bounds: Column, value: Column) -> Column:
    """Number of the half-open band of sorted bounds that holds the value, kept within the first and last."""
    return F.least(F.size(bounds) - 2, F.greatest(F.lit(0), F.size(F.filter(bounds, lambda b: b <= value)) - 1))


def tolerance_match(expected: DataFrame, actual: DataFrame, keys: list[str], lo: str, hi: str, tolerance: float) -> DataFrame:
    """Intervals on one side only: kind lost (expected, not found) or phantom."""

    def only(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        x, y = _prefixed(a.select(*keys, lo, hi), "l_", keys), _prefixed(b.select(*keys, lo, hi), "r_", keys)
        near = (F.abs(F.col(f"l_{lo}") - F.col(f"r_{lo}")) <= tolerance) & (F.abs(F.col(f"l_{hi}") - F.col(f"r_{hi}")) <= tolerance)
        # an interval meets those that can have their ends in its cell: at most four cells of each, and a key's intervals aren't all paired
        x = x.withColumns({"cell_": cell(F.col(f"l_{lo}")), "end_": cell(F.col(f"l_{hi}"))})
        y = y.withColumn("cell_", F.explode(near_cells(F.col(f"r_{lo}")))).withColumn("end_", F.explode(near_cells(F.col(f"r_{hi}"))))
        cond = near
        for k in [*keys, "cell_", "end_"]:
            cond = cond & (x[k] == y[k])
        # sizes are guessed from before the copies, so that they would be broadcast: all pass through the driver then
        return x.join(y.hint("merge"), cond, "left_anti").select(*keys, F.col(f"l_{lo}").alias(lo), F.col(f"l_{hi}").alias(hi), F.lit(kind).alias("kind"))

    step = max(tolerance, 1)
    cell = lambda c: F.floor(c / (4 * step))
    near_cells = lambda c: F.sequence(cell(c - 1.25 * step), cell(c + 1.25 * step))
    return only(expected, actual, "lost").union(only(actual, expected, "phantom"))


def coverage(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, share: float = 0.5) -> DataFrame:
    """Left boxes with the share of their area that right boxes cover (overlaps counted as often as they occur), the best IoU, and whether the share suffices."""
    per = sweep.cover(left, right, keys, left_id).groupBy(*keys, left_id).agg(F.sum("common").alias("common"), F.max("best_iou").alias("best_iou"))
    out = left.join(per, [*keys, left_id], "left")
    covered = F.coalesce(F.col("common") / F.nullif(G.area(G.box()), F.lit(0.0)), F.lit(0.0))
    return out.select(*keys, left_id, covered.alias("covered"), F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"), (covered >= share).alias("matched"))


def tiered_text_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """Left rows with right rows of the same keys by text: first equal texts, the n-th with the n-th, so each is used once;
    then, for what is left, a right text that the left one is part of, then one that is part of the left. Columns: keys,
    left_id, right_id, tier (1 to 3); rows without a match are absent."""
    w = Window.partitionBy(*keys, text)
    a = left.select(*keys, left_id, text).withColumn("n_", F.row_number().over(w.orderBy(left_id)))
    b = right.select(*keys, right_id, text).withColumn("n_", F.row_number().over(w.orderBy(right_id)))
    equal = a.join(b, [*keys, text, "n_"]).select(*keys, left_id, right_id, F.lit(1).alias("tier"))
    rest_a = a.join(equal.select(*keys, left_id), [*keys, left_id], "left_anti")
    rest_b = b.select(*keys, right_id, F.col(text).alias("t_")).join(equal.select(*keys, right_id), [*keys, right_id], "left_anti")
    pairs = rest_a.join(rest_b, keys).where((F.length(text) > 0) & (F.length("t_") > 0)).withColumn("tier", F.when(F.contains(F.col("t_"), F.col(text)), 2).when(F.contains(F.col(text), F.col("t_")), 3)).where("tier is not null")
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("tier", right_id)).alias("m"))
    return equal.union(best.select(*keys, left_id, F.col(f"m.{right_id}"), F.col("m.tier")))


def covered_by_union(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, share: float = 0.999) -> DataFrame:
    """Exact share of each left box that the union of right boxes covers (overlaps count once), over the cells that the sides cut."""
    pairs = box_join(left, right, keys).withColumn("b_", F.struct(*(F.col(f"r_{k}") for k in ("x0", "y0", "x1", "y1"))))
    grouped = pairs.groupBy(*keys, F.col(f"l_{left_id}").alias(left_id), *(F.col(f"l_{k}").alias(k) for k in ("x0", "y0", "x1", "y1"))).agg(F.collect_list("b_").alias("boxes_"))

    @F.pandas_udf("double")
    def measured(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, boxes: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, held in zip(x0, y0, x1, y1, boxes, strict=True):
            clipped = [(max(a, r["r_x0"]), max(b, r["r_y0"]), min(c, r["r_x1"]), min(d, r["r_y1"])) for r in held]
            clipped = [r for r in clipped if r[0] < r[2] and r[1] < r[3]]
            xs, ys = sorted({v for r in clipped for v in (r[0], r[2])}), sorted({v for r in clipped for v in (r[1], r[3])})
            area = sum((q - p) * (t - s) for p, q in zip(xs, xs[1:]) for s, t in zip(ys, ys[1:]) if any(r[0] <= p and q <= r[2] and r[1] <= s and t <= r[3] for r in clipped))
            whole = (c - a) * (d - b)
            out.append(area / whole if whole > 0 else 0.0)
        return pd.Series(out)

    cov = grouped.select(*keys, left_id, measured("x0", "y0", "x1", "y1", "boxes_").alias("covered"))
    return left.select(*keys, left_id).join(cov, [*keys, left_id], "left").select(*keys, left_id, F.coalesce("covered", F.lit(0.0)).alias("covered")).withColumn("contained", F.col("covered") >= share)
