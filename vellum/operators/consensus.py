"""One column grid that a document's pages agree on, and what it does for pages whose own grid failed.

Every page elects one of its candidates; the elected are fitted by medians and deviations, those far from them are left out, and
the fit is taken again over the rest. A document's rows are one a page, so each fit is an aggregation by document; with
``rounds`` above one it is repeated until nobody else is left out, and it is an error if that doesn't come about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
#: Features of a two-column grid and the least scale that a deviation is measured by.
SCALES = {"left_x0": 2.0, "left_x1": 2.0, "right_x0": 2.0, "right_x1": 2.0, "left_w": 2.0, "right_w": 2.0, "gutter": 1.5}
LIMIT, LEAST_RATIO, TRIM = 4.5, 0.55, 0.1
FRAME = ("frame_x0", "frame_x1")


def elect(candidates: DataFrame, modes: DataFrame) -> DataFrame:
    """candidates(doc_id, page, candidate, left_x0, left_x1, right_x0, right_x1, gutter, frame_x0, frame_x1): of each page that its
    text shows as two columns, the candidate with both tracks and a gutter that has the largest narrower width times ratio of
    widths, the first of equals. modes(doc_id, page, mode)."""
    left, right = F.col("left_x1") - F.col("left_x0"), F.col("right_x1") - F.col("right_x0")
    least, most = F.least(left, right), F.greatest(left, right)
    usable = candidates.where(left.isNotNull() & right.isNotNull() & (F.coalesce("gutter", F.lit(0.0)) != 0)).withColumns({"left_w": left, "right_w": right, "ratio": F.when(most != 0, least / most).otherwise(0.0)})
    two = modes.where(F.col("mode").isin("two_column", "two_column_sparse")).select(*PAGE)
    own = [c for c in usable.columns if c not in PAGE]
    best = usable.join(two, PAGE).groupBy(*PAGE).agg(F.max_by(F.struct(*own), F.struct(F.col("ratio") * F.least("left_w", "right_w"), -F.col("candidate"))).alias("b"))
    return best.select(*PAGE, "b.*")


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    at = lambda k: F.get(values, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _spread(values: Column) -> Column:
    return F.transform(F.array(_middle(values)), lambda m: _middle(F.array_sort(F.transform(values, lambda v: F.abs(v - m)))))[0]


def _trimmed(values: Column) -> Column:
    """A sorted array without a tenth at either end, if it has eight values or more."""
    cut = F.when(F.size(values) >= 8, F.floor(F.size(values) * TRIM)).otherwise(0).cast("int")
    return F.slice(values, cut + 1, F.size(values) - 2 * cut)


def supporters(elected: DataFrame, evidence: DataFrame) -> DataFrame:
    """Elected pages with tracks that are alike enough and with body text in both columns, as far as anything is known of the page.
    evidence(doc_id, page, left, right): whether body text is in each."""
    shown = evidence.select(*PAGE, (F.col("left") & F.col("right")).alias("both_"))
    return elected.join(shown, PAGE, "left").where((F.least("left_w", "right_w") > 0) & (F.col("ratio") >= LEAST_RATIO) & F.coalesce("both_", F.lit(True))).drop("both_")


def exclude(rows: DataFrame) -> DataFrame:
    """Rows within the limit of every feature's median, by the document's deviations."""
    centre = rows.groupBy("doc_id").agg(*(F.median(f).alias(f"m_{f}") for f in SCALES))
    near = rows.join(centre, "doc_id")
    spread = near.groupBy("doc_id").agg(*(F.median(F.abs(F.col(f) - F.col(f"m_{f}"))).alias(f"s_{f}") for f in SCALES))
    inside = F.lit(True)
    for f, floor in SCALES.items():
        inside = inside & (F.abs(F.col(f) - F.col(f"m_{f}")) <= LIMIT * F.greatest(1.4826 * F.col(f"s_{f}"), F.lit(floor)))
    return near.join(spread, "doc_id").where(inside).select(*rows.columns)


def document_profile(candidates: DataFrame, modes: DataFrame, evidence: DataFrame, rounds: int = 1) -> DataFrame:
    """One row a document of ``modes``: tracks, gutter, frame and their deviations over the supporting pages (trimmed), support
    and excluded pages, confidence, and whether the profile is resolved."""
    elected = elect(candidates, modes)
    rows = exclude(supporters(elected, evidence))
    left_out = None
    for _ in range(rounds - 1):
        fewer = exclude(rows)
        n = fewer.count()
        if n == (left_out if left_out is not None else rows.count()):
            break
        rows, left_out = fewer, n
    else:
        if rounds > 1:
            raise RuntimeError(f"pages were still left out after {rounds} rounds")
    names = (*SCALES, *FRAME)
    gathered = rows.groupBy("doc_id").agg(*(F.array_sort(F.collect_list(f)).alias(f) for f in names), F.array_sort(F.collect_list("page")).alias("support_pages"))
    kept = gathered.select("doc_id", "support_pages", *(_trimmed(F.col(f)).alias(f"{f}_s") for f in names))
    ratios = F.array_sort(F.filter(F.zip_with("left_w_s", "right_w_s", lambda a, b: F.when(F.greatest(a, b) != 0, F.least(a, b) / F.greatest(a, b))), lambda r: r.isNotNull()))
    fitted = kept.select(
        "doc_id", "support_pages", *(F.round(_middle(F.col(f"{f}_s")), 3).alias(f) for f in names), *(F.round(_spread(F.col(f"{f}_s")), 3).alias(f"{f}_mad") for f in ("left_w", "right_w", "gutter", *FRAME)),
        F.round(F.get(ratios, F.greatest(F.lit(0), F.floor(F.size(ratios) * TRIM) - 1).cast("int")), 4).alias("width_ratio_p10"),
    )
    counted = modes.groupBy("doc_id").agg(F.count("*").alias("scanned"), F.array_sort(F.collect_set("page")).alias("pages_"))
    n_elected = elected.groupBy("doc_id").agg(F.count("*").alias("elected"))
    j = counted.join(n_elected, "doc_id", "left").join(fitted, "doc_id", "left")
    support = F.coalesce(F.size("support_pages"), F.lit(0))
    share = F.least(F.lit(1.0), support / F.greatest(F.lit(4.0), F.col("elected") * 0.55)) * F.when(support < 2, 0.4).otherwise(1.0)
    confidence = F.when(support > 0, share).otherwise(0.0)
    return j.withColumns({
        "layout_mode": F.when(support > 0, "two_column").otherwise("unresolved"), "confidence": F.round(confidence, 3), "resolved": (confidence >= 0.68) & (support >= 2), "support": support,
        "excluded_pages": F.array_except("pages_", F.coalesce("support_pages", F.array().cast("array<bigint>"))),
    }).drop("pages_")


def snapped(grids: DataFrame, profile: DataFrame) -> DataFrame:
    """grids(doc_id, page, page_class, confidence, tracks: left_x0 to right_x1, gutter, text_in_both) with the document's tracks where
    the page's own are lost though its text stands in both columns, and a confidence from what the page shows, its gutter,
    how alike its tracks are, and how well it agrees with the document. A resolved profile has one row a document."""
    p = profile.where("resolved").select("doc_id", *(F.col(c).alias(f"p_{c}") for c in ("left_x0", "left_x1", "right_x0", "right_x1", "gutter")))
    j = grids.join(p, "doc_id", "left")
    edges = ("left_x0", "left_x1", "right_x0", "right_x1")
    two = F.col("right_x0").isNotNull() & (F.coalesce("gutter", F.lit(0.0)) != 0)
    restored = ~two & F.col("text_in_both") & F.col("p_left_x0").isNotNull() & (F.col("page_class") != "reference_dense")
    same = two
    for e in edges:
        same = same & F.coalesce(F.abs(F.col(e) - F.col(f"p_{e}")) <= 0.15, F.lit(False))
    marked = j.withColumns({"restored": restored, "snapped": restored | same})
    out = marked.withColumns({
        **{e: F.when(F.col("restored"), F.col(f"p_{e}")).otherwise(F.col(e)) for e in edges}, "gutter": F.when(F.col("restored"), F.round(F.col("p_right_x0") - F.col("p_left_x1"), 2)).otherwise(F.col("gutter")),
    })
    widths = [F.greatest(F.col(f"{s}_x1") - F.col(f"{s}_x0"), F.lit(1.0)) for s in ("left", "right")]
    both = F.col("right_x0").isNotNull()
    alignment = F.when(both, F.greatest(F.lit(0.0), 1.0 - F.abs(widths[0] - widths[1]) / F.greatest(*widths))).otherwise(0.9)
    occupancy = F.when(F.col("text_in_both"), 1.0).when(~both, 0.82).otherwise(0.68)
    agreement = F.when((F.coalesce("gutter", F.lit(0.0)) != 0) & (F.coalesce("p_gutter", F.lit(0.0)) != 0), F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("gutter") - F.col("p_gutter")) / 20.0)).when(F.col("snapped"), 1.0).otherwise(0.8)
    own = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.col("confidence")).otherwise(0.75)
    return out.withColumn("grid_confidence", F.round(0.28 * occupancy + 0.24 * own + 0.24 * alignment + 0.24 * agreement, 3)).select(*grids.columns, "restored", "snapped", "grid_confidence")
