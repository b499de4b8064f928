"""Page layout: reading lines, column grid, traits and classes of pages, obstacles and capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import sequence, stats

PAGE = ["doc_id", "page"]


def lines(spans: DataFrame, gap: float = 12.0) -> DataFrame:
    """Spans of a line joined: a line breaks where two neighbours are more than ``gap`` apart."""
    w = Window.partitionBy(*PAGE, "y0").orderBy("x0", "ordinal")
    apart = F.col("x0") - F.lag("x1").over(w) > gap
    runs = sequence.gap_islands(spans, [*PAGE, "y0"], ["x0", "ordinal"], apart, "segment")
    return runs.groupBy(*PAGE, "y0", "segment").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ordinal").alias("ordinal"), F.count("*").alias("n_spans"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ordinal", "text"))), lambda s: s["text"]), " ").alias("text"),
    )


def column_grid(spans: DataFrame, least_gutter: float = 6.0, share: float = 0.2) -> DataFrame:
    """One row a page: content frame, number of columns, gutter. Occupancy of unit bins, smoothed; the widest valley below
    a share of the page's peak, at least ``least_gutter`` wide and with bands on both sides, is the gutter. All steps are windows
    and groupings within pages, so spans are read and dealt once."""
    page = Window.partitionBy(*PAGE)
    occ = stats.occupancy(spans, PAGE, "x0", "x1", smooth=2)
    level = occ.select(*PAGE, "bin", F.min("bin").over(page).alias("frame_x0"), F.max("bin").over(page).alias("frame_x1"), (F.col("smoothed") / F.max("smoothed").over(page)).alias("level"))
    high = F.when(F.col("level") >= share, F.col("bin"))
    low = (F.col("level") < share) & (F.col("bin") > F.min(high).over(page)) & (F.col("bin") < F.max(high).over(page))
    # a valley's bins follow one another: number less place in order is the same for all of them
    flagged = level.withColumn("low_", low)
    run = F.when(F.col("low_"), F.col("bin") - F.row_number().over(Window.partitionBy(*PAGE, "low_").orderBy("bin")))
    runs = flagged.withColumn("run_", run).groupBy(*PAGE, "frame_x0", "frame_x1", "run_").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    wide = F.when(F.col("run_").isNotNull() & (F.col("hi") - F.col("lo") + 1 >= least_gutter), F.struct("lo", "hi"))
    best = runs.groupBy(*PAGE, "frame_x0", "frame_x1").agg(F.max_by(wide, F.when(wide.isNotNull(), F.struct(F.col("hi") - F.col("lo"), -F.col("lo")))).alias("v"))
    return best.select(*PAGE, "frame_x0", "frame_x1", F.when(F.col("v").isNull(), 1).otherwise(2).alias("n_columns"), F.col("v.lo").alias("gutter_lo"), F.col("v.hi").alias("gutter_hi"))


# The opening of an appendix's heading.
APPENDIX_HEADING = r"(?i)^\s*(?:Appendix\s+)?[A-Z](?:\.\d+)*(?:[.\s:]|$)"
#: Roles whose paragraphs show columns.
COLUMN_ROLES = ("body", "heading", "list_item", "caption")


def page_traits(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts that page classes are decided on. regions as in ``semantics``; pages(doc_id, page, width, front_matter, grid_columns, has_gutter)."""
    from vellum.operators.translation import is_reference

    text, role = F.col("kind") == "text", F.coalesce("role", F.lit("body"))
    long = text & role.isin(*COLUMN_ROLES) & (F.length(F.trim("text")) >= 40)
    full = lambda share: (F.col("x1") - F.col("x0")) / F.greatest(F.col("width"), F.lit(1.0)) >= share
    counted = regions.join(pages.select(*PAGE, "width"), PAGE).groupBy(*PAGE).agg(
        F.count_if(text).alias("paragraphs"),
        F.count_if(text & is_reference(F.col("text"))).alias("references"),
        F.count_if(text & (role == "heading") & F.col("text").rlike(APPENDIX_HEADING)).alias("appendix_headings"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("table", "figure", "formula")),
        *(F.count_if((F.col("kind") == k) & full(s)).alias(f"full_width_{k}s") for k, s in (("table", 0.64), ("figure", 0.64), ("formula", 0.60))),
        *(F.count_if(long & (F.col("column") == c)).alias(f"substantive_{c}") for c in (0, 1)),
    )
    return pages.join(counted, PAGE, "left").na.fill(0)


def page_class(traits: DataFrame) -> DataFrame:
    """Seven classes, the first rule that holds: semantics before geometry, the page's number never."""
    c = F.col
    both = (c("substantive_0") > 0) & (c("substantive_1") > 0)
    dense = (c("references") >= 3) & ((c("references") / F.greatest("paragraphs", F.lit(1)) >= 0.48) | (c("references") >= 7))
    plate = (c("figures") > 0) & (c("tables") + c("formulas") + c("appendix_headings") == 0) & (c("paragraphs") <= F.greatest(F.lit(4), 2 * c("figures")))
    cls = (
        F.when(c("front_matter"), "front_matter_two_column")
        .when(dense, "reference_dense")
        .when(plate, "single_column")
        .when(c("full_width_tables") > 0, "full_width_table_plus_two_column")
        .when(c("appendix_headings") > 0, "appendix_dense")
        .when(both & ((c("full_width_figures") > 0) | ((c("figures") > 0) & (c("formulas") > 0))), "mixed_layout")
        .when(both | (c("has_gutter") & (c("grid_columns") == 2)), "standard_two_column")
        .otherwise("single_column")
    )
    return traits.withColumn("page_class", cls)


def obstacles(regions: DataFrame, columns: DataFrame, kinds=("table", "figure", "image", "display_formula")) -> DataFrame:
    """regions(doc_id, page, id, kind, box) of fixed kinds with the columns (doc_id, page, col, x0, x1) they touch by over a point."""
    r = regions.where(F.col("kind").isin(*kinds))
    c = columns.select(*PAGE, F.col("col").alias("c_col"), F.col("x0").alias("c_x0"), F.col("x1").alias("c_x1"))
    hit = r.join(c, PAGE).where(F.least("x1", "c_x1") - F.greatest("x0", "c_x0") > 1.0)
    return hit.groupBy(*PAGE, "id", "kind", "x0", "y0", "x1", "y1").agg(F.array_sort(F.collect_set("c_col")).alias("columns_affected"))


def column_capacity(columns: DataFrame, blocked: DataFrame, needed: DataFrame, least: float = 12.0) -> DataFrame:
    """columns(keys, frame_lo, frame_hi), blocked(keys, lo, hi), needed(keys, height): free height, ratio, overflow by column."""
    keys = [*PAGE, "col"]
    free = sequence.complement(sequence.merge_intervals(blocked, keys, "lo", "hi"), columns, keys, "lo", "hi", least)
    height = free.groupBy(*keys).agg(F.sum(F.col("free_hi") - F.col("free_lo")).alias("available"))
    out = columns.join(height, keys, "left").join(needed, keys, "left").withColumn("available", F.coalesce("available", F.lit(0.0))).withColumn("height", F.coalesce("height", F.lit(0.0)))
    return out.select(*keys, "available", "height", F.when(F.col("available") > 0, F.col("height") / F.col("available")).alias("ratio"), F.greatest(F.lit(0.0), F.col("height") - F.col("available")).alias("overflow"))


def reliability(scores: DataFrame, score_cols: list[str], local: str, reasons: str, hard: str) -> DataFrame:
    """0.15 of the local confidence and 0.85 of the mean score, capped at 0.24 (hard reason) or 0.58 (three reasons or more)."""
    mean = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in score_cols), F.lit(0.0)) / F.greatest(F.lit(1), sum((F.col(c).isNotNull().cast("int") for c in score_cols), F.lit(0)))
    blend = 0.15 * F.col(local) + 0.85 * mean
    capped = F.when(F.col(hard), F.least(blend, F.lit(0.24))).when(F.size(reasons) >= 3, F.least(blend, F.lit(0.58))).otherwise(blend)
    return scores.withColumn("confidence", capped).withColumn("status", F.when(F.col(hard), "invalid").when(capped >= 0.68, "valid").otherwise("suspect"))


def resolve_grid(local: DataFrame, profile: DataFrame) -> DataFrame:
    """Protected modes and valid grids stay; else the document's two-column profile if it is sure enough; else unresolved. The profile has one row a document."""
    p = profile.select("doc_id", F.col("n_columns").alias("p_columns"), F.col("confidence").alias("p_confidence"))
    j = local.join(p, "doc_id", "left")
    source = F.when(F.col("mode").isin("single_column", "front_matter"), "page_local").when(F.col("status") == "valid", "page_local").when((F.col("p_columns") == 2) & (F.col("p_confidence") >= 0.68), "document_profile").otherwise("unresolved")
    return j.withColumn("source", source)


def voids(covered: DataFrame, keys: list[str], lo: str, hi: str, least: float = 96.0) -> DataFrame:
    """Gaps of ``least`` or more between what is covered so far and the next interval."""
    w = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    reach = covered.withColumn("reach_", F.max(hi).over(w))
    return reach.where(F.col(lo) - F.col("reach_") >= least).select(*keys, F.col("reach_").alias("void_lo"), F.col(lo).alias("void_hi"))


def order_defects(paragraphs: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Upward steps of more than 4 points and jumps of more than 15 % of a page, by page."""
    w = Window.partitionBy(*PAGE, "col").orderBy("ordinal")
    d = paragraphs.withColumn("step_", F.col("y0") - F.lag("y0").over(w))
    return d.groupBy(*PAGE).agg(F.count_if(F.col("step_") < -4).alias("inversions"), F.count_if(F.col("step_") > 0.15 * page_height).alias("jumps"))


def density_class(regions: DataFrame) -> DataFrame:
    """Pages by what they hold: references, a mix of formulas, tables and figures, or the densest kind. regions(doc_id, page, kind, semantic_role)."""
    n = {k: F.count_if(F.col("kind").isin(*v)) for k, v in (("formula", ("formula",)), ("table", ("table",)), ("figure", ("figure", "image")))}
    c = regions.groupBy(*PAGE).agg(*(v.alias(k) for k, v in n.items()), F.bool_or(F.coalesce(F.col("semantic_role") == "references", F.lit(False))).alias("refs_"))
    kinds = sum(((F.col(k) >= 1).cast("int") for k in n), F.lit(0))
    cls = F.when(F.col("refs_"), "reference_dense").when(kinds >= 2, "mixed_content")
    for k, least in (("formula", 8), ("table", 2), ("figure", 2), ("table", 1), ("formula", 1), ("figure", 1)):
        cls = cls.when(F.col(k) >= least, f"{k}_dense")
    return c.withColumn("density_class", cls.otherwise("text_only")).drop("refs_")


def bottom_reserve(notes: DataFrame, frames: DataFrame, gap: float = 16.0, line_height: float = 1.3) -> DataFrame:
    """notes(keys, em, width, size), frames(keys, frame_y1): the strip that notes need at a page's end, and where the body must stop."""
    lines = F.ceil(F.col("em") / F.greatest(F.lit(1.0), F.col("width") / F.col("size")))
    need = notes.groupBy(*PAGE).agg(F.sum(lines * F.col("size") * line_height).alias("height"))
    return frames.join(need, PAGE).select(*PAGE, "height", (F.col("frame_y1") - F.col("height")).alias("y0"), (F.col("frame_y1") - F.col("height") - gap).alias("body_bottom"))


def reentry_defects(paragraphs: DataFrame, obstacles_: DataFrame, reach: float = 3.0, slack: float = 4.0) -> DataFrame:
    """Paragraphs that begin right below an obstacle of their column (as-of by its bottom) but not at the column's left edge."""
    o = obstacles_.select(*PAGE, F.explode("columns_affected").alias("col"), F.col("y1").alias("bottom"))
    j = paragraphs.join(o, [*PAGE, "col"]).where((F.col("y0") >= F.col("bottom") - 1) & (F.col("y0") - F.col("bottom") <= reach))
    return j.where(F.abs(F.col("x0") - F.col("track_x0")) > slack).select(*PAGE, "col", "ordinal").distinct()
