"""Where a page's flow begins and ends, what a document's grids have in common, and where a heading was rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.semantics import EDGE_ROLES

PAGE = ["doc_id", "page"]
# Roles of text that flows, and kinds whose place is locked.
FLOW_ROLES = ("body", "body_bold_lead", "list_item", "reference", "reference_item", "reference_continuation", "appendix", "appendix_body", "heading", "appendix_heading")
LOCKED = ("table", "figure", "image", "display_formula")
FOOTER_FROM, HEADER_TO = 0.86, 0.07
# How far a rendered heading may stand from its source, and how long its line may be.
LINE_CHARS, COLUMN_TOLERANCE, ABOVE, BELOW, FALLBACK = 60, 20.0, 6.0, 20.0, 170.0
NUMBER = r"^\s*([A-Z](?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)*)"


def content_bounds(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, height, frame_y0, frame_y1) with flow_y0 and flow_y1: from the first flowing text or locked box to the last
    of them or the frame's end, but not past a footer or a number at the page's foot. A running head does not begin the
    flow. One aggregation by page."""
    h = F.coalesce("height", F.lit(0.0))
    j = regions.join(pages.select(*PAGE, h.alias("h_")), PAGE)
    role, text = F.coalesce("semantic_role", "role", F.lit("body")), F.trim(F.coalesce("text", F.lit("")))
    is_text = F.col("kind") == "text"
    foot = is_text & (role.isin(*EDGE_ROLES) | (text.rlike(r"(?i)^(?:page\s*)?[0-9]+(?:\s*/\s*[0-9]+)?$") & (F.col("h_") > 0) & (F.col("y0") >= F.col("h_") * FOOTER_FROM)))
    in_column = F.coalesce(F.col("column").isin(0, 1), F.lit(False))
    head = is_text & (F.col("h_") > 0) & (F.col("y1") <= F.col("h_") * HEADER_TO) & ~in_column
    flows = F.col("kind").isin(*LOCKED) | (is_text & ~foot & ~head & in_column & role.isin(*FLOW_ROLES))
    found = j.groupBy(*PAGE).agg(F.min(F.when(flows, F.col("y0"))).alias("a_"), F.max(F.when(flows, F.col("y1"))).alias("z_"), F.min(F.when(foot, F.col("y0"))).alias("foot_"))
    p = pages.join(found, PAGE, "left")
    y0, y1 = F.coalesce("a_", "frame_y0", F.lit(0.0)), F.coalesce("foot_", F.greatest(F.coalesce("frame_y1", h), F.col("z_")))
    low = F.when(h > 0, F.greatest(F.lit(0.0), F.least(y0, h))).otherwise(y0)
    high = F.when(h > 0, F.greatest(low, F.least(y1, h))).otherwise(y1)
    return p.select(*pages.columns, F.round(low, 3).alias("flow_y0"), F.round(high, 3).alias("flow_y1"))


def layout_profile(grids: DataFrame) -> DataFrame:
    """grids(doc_id, page, width, frame_x0, frame_x1, left_x0, left_x1, right_x0, right_x1), tracks null on pages of one column: by document
    the numbers of pages, medians of margins, widths and tracks, and the gutter of each page of two columns as a map."""
    two = F.col("right_x0").isNotNull()
    gutter = F.col("right_x0") - F.col("left_x1")
    middle = lambda v: F.round(F.median(v), 2)
    return grids.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(two).alias("two_column_pages"), F.count_if(~two).alias("single_column_pages"), middle(gutter).alias("gutter"), middle(F.col("left_x1") - F.col("left_x0")).alias("left_width"),
        middle(F.when(two, F.col("right_x1") - F.col("right_x0"))).alias("right_width"), middle(F.col("frame_x0")).alias("left_margin"), middle(F.col("width") - F.col("frame_x1")).alias("right_margin"),
        *(middle(F.col(c)).alias(c) for c in ("left_x0", "left_x1", "right_x0", "right_x1")),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(two, F.struct("page", F.round(gutter, 2)))))).alias("gutters"),
    )


def locate_headings(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """headings(doc_id, page, heading, text, box), lines(doc_id, page, line, text, x0, y): the line that a heading was rendered as, or
    null: a short line that begins near its left edge, in the band round its place, or, for a numbered heading, further
    below; the number must be the same; the nearest of them, the first of equals. Lines are met by cells of the left
    edge, as wide as the tolerance."""
    own = headings.withColumn("number_", F.nullif(F.regexp_extract("text", NUMBER, 1), F.lit("")))
    cell = lambda v: F.floor(v / COLUMN_TOLERANCE)
    asked = own.select(*PAGE, "heading", "number_", "x0", "y0", "y1", F.explode(F.sequence(cell(F.col("x0")) - 1, cell(F.col("x0")) + 1)).alias("cell_"))
    there = lines.where(F.length("text") <= LINE_CHARS).select(*PAGE, "line", F.col("x0").alias("lx_"), F.col("y").alias("ly_"), F.nullif(F.regexp_extract("text", NUMBER, 1), F.lit("")).alias("ln_"), cell(F.col("x0")).alias("cell_"))
    tight = (F.col("ly_") >= F.col("y0") - ABOVE) & (F.col("ly_") <= F.col("y1") + BELOW)
    wide = F.col("number_").isNotNull() & (F.col("ly_") >= F.col("y0") - ABOVE) & (F.col("ly_") <= F.col("y0") + FALLBACK)
    met = asked.join(there, [*PAGE, "cell_"]).where((F.abs(F.col("lx_") - F.col("x0")) < COLUMN_TOLERANCE) & (tight | wide) & (F.col("number_").isNull() | (F.col("ln_") == F.col("number_"))))
    best = met.groupBy(*PAGE, "heading").agg(F.min(F.struct((~tight).cast("int").alias("band"), F.abs(F.col("ly_") - (F.col("y0") + F.col("y1")) / 2).alias("off"), "line")).alias("b"))
    return headings.join(best, [*PAGE, "heading"], "left").select(*PAGE, "heading", F.col("b.line").alias("line"), F.coalesce(F.col("b.band") == 1, F.lit(False)).alias("fallback"))
