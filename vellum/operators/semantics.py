"""What a page is about, from the roles and places of its regions: intended layout mode, body support, front matter, sanity of
resolved grids, and the document's sections.

regions(doc_id, page, region, kind, role, semantic_role, column, continues, text, col_width, size, x0, y0, x1, y1): ``role`` is the
style role, null meaning body; ``column`` is 0, 1 or -1. Every operator is one aggregation by page, or a join of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
# Roles that count as body.
BODY_ROLES = ("body", "body_bold_lead", "list_item", "reference", "reference_item", "reference_continuation", "appendix", "acknowledgement")
# What is at a page's edge, and captions.
EDGE_ROLES = ("page_number", "footer", "header_footer")
CAPTION_ROLES = ("caption", "figure_caption", "table_caption")
PLATES = ("table", "figure", "image")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _style() -> Column:
    return F.coalesce("role", F.lit("body"))


def _body() -> Column:
    """A text region of a body role in one of two columns."""
    return (F.col("kind") == "text") & F.col("column").isin(0, 1) & _style().isin(*BODY_ROLES)


def semantic_mode(regions: DataFrame, pages: DataFrame, fallback: str = "unknown") -> DataFrame:
    """pages(doc_id, page, width) plus ``mode``: mixed_non_dominant for plates with short captions only, two_column where both
    columns have body, two_column_sparse where one has but its text goes on across or its tracks are under 0.46 of the page,
    single_column, else the fallback."""
    own_role, text = F.coalesce("semantic_role", _style()), stripped(F.col("text"))
    meaningful = (F.col("kind") == "text") & ~own_role.isin(*EDGE_ROLES) & ~((own_role == "heading") & text.rlike("^[0-9]+$"))
    counted = regions.groupBy(*PAGE).agg(
        F.count_if(meaningful).alias("n_text"),
        F.count_if(F.col("kind").isin(*PLATES)).alias("n_plates"),
        F.count_if(meaningful & F.coalesce("continues", F.lit(False))).alias("n_across"),
        F.count_if(meaningful & ~_style().isin(*CAPTION_ROLES) & (F.length(text) >= 120)).alias("n_long"),
        F.count_if(_body() & (F.col("column") == 0)).alias("n_left"),
        F.count_if(_body() & (F.col("column") == 1)).alias("n_right"),
        F.count_if(_body() & F.coalesce("continues", F.lit(False))).alias("n_body_across"),
        F.median(F.when(_body() & (F.col("col_width") > 0), F.col("col_width"))).alias("track"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    plates = (n("n_plates") > 0) & (n("n_text") <= F.greatest(F.lit(4), 2 * n("n_plates"))) & (n("n_across") == 0) & (n("n_long") == 0)
    mode = (
        F.when(plates, "mixed_non_dominant")
        .when((n("n_left") > 0) & (n("n_right") > 0), "two_column")
        .when(n("n_left") + n("n_right") == 0, fallback)
        .when((n("n_body_across") > 0) | ((F.col("width") > 0) & (F.col("track") <= 0.46 * F.col("width"))), "two_column_sparse")
        .otherwise("single_column")
    )
    return pages.join(counted, PAGE, "left").select(*PAGE, mode.alias("mode"))


def grid_mode(n_columns: Column, has_gutter: Column, evidence: Column, left: Column, right: Column) -> Column:
    """The mode that a projected grid itself speaks for."""
    return F.when((n_columns == 2) & has_gutter, "two_column").when(n_columns == 1, "single_column").when(evidence | ((left > 0) & (right > 0)), "two_column").otherwise("unknown")


def grid_evidence(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """By page: how much body supports a grid, and the share that hard obstacles take. pages(doc_id, page, width, height)."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    hard = F.col("kind").isin(*PLATES) | (F.col("kind") == "display_formula")
    role = F.coalesce("semantic_role", _style())
    body = (F.col("kind") == "text") & role.isin(*BODY_ROLES) & F.col("column").isin(0, 1)
    found = regions.where("x0 is not null").groupBy(*PAGE).agg(
        F.count_if(body).alias("body_records"),
        F.sum(F.when(body, F.length(stripped(F.col("text")))).otherwise(0)).alias("body_characters"),
        F.array_sort(F.collect_set(F.when(body, F.col("column")))).alias("body_columns"),
        F.count_if((F.col("kind") == "text") & ~body).alias("excluded_records"),
        F.sum(F.when(hard, area).otherwise(0.0)).alias("hard_area"),
    )
    j = pages.join(found, PAGE, "left")
    n, chars = F.coalesce("body_records", F.lit(0)), F.coalesce("body_characters", F.lit(0))
    return j.select(
        *PAGE,
        n.cast("bigint").alias("body_records"),
        chars.cast("bigint").alias("body_characters"),
        F.array_join(F.coalesce("body_columns", F.array().cast("array<int>")), ",").alias("body_columns"),
        F.coalesce("excluded_records", F.lit(0)).cast("bigint").alias("excluded_records"),
        F.round(F.least(F.lit(1.0), F.coalesce("hard_area", F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))), 4).alias("hard_ratio"),
        F.round(F.least(F.lit(1.0), n / 6.0) * F.least(F.lit(1.0), chars / 500.0), 4).alias("body_support"),
    )


def front_matter(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, height) plus ``front_matter``: a large heading and two other sizeable texts across the columns, above the body."""
    body = regions.where(_body() & (F.col("size") > 0)).groupBy(*PAGE).agg(F.median("size").alias("body_size"))
    top = F.when(F.col("height") > 0, 0.36 * F.col("height")).otherwise(300.0)
    across = regions.where((F.col("kind") == "text") & (F.col("column") == -1)).join(pages, PAGE).where(F.col("y0") < top).join(body, PAGE)
    n = F.length(stripped(F.col("text")))
    size = F.coalesce("size", F.lit(0.0))
    shown = across.groupBy(*PAGE).agg(
        F.count_if((_style() == "heading") & (size >= 1.2 * F.col("body_size")) & (n >= 20)).alias("titles"), F.count_if((size >= 0.65 * F.col("body_size")) & (n >= 8)).alias("others")
    )
    return pages.join(shown, PAGE, "left").select(*PAGE, F.coalesce((F.col("titles") > 0) & (F.col("others") >= 2), F.lit(False)).alias("front_matter"))


def grid_sanity(resolved: DataFrame, profiles: DataFrame) -> DataFrame:
    """resolved(doc_id, page, local_status, tracks array<struct<x0, x1>>; null if unresolved), profiles(doc_id, left_width, right_width,
    ratio_p10). By document: tracks without width, pages with a track under 0.55 of the profile's narrower, pages whose
    asymmetry is beyond what the profile supports, and unresolved pages with an invalid local grid."""
    j = resolved.join(profiles, "doc_id", "left")
    widths = F.transform("tracks", lambda t: t["x1"] - t["x0"])
    narrowest, widest = F.array_min(widths), F.array_max(widths)
    expected = F.coalesce(F.least(F.coalesce("left_width", F.lit(0.0)), F.coalesce("right_width", F.lit(0.0))), F.lit(0.0))
    support = F.when(F.coalesce("ratio_p10", F.lit(0.0)) == 0, 0.7).otherwise(F.col("ratio_p10"))
    found, two = F.size("tracks") >= 0, F.size("tracks") == 2
    return j.groupBy("doc_id").agg(
        F.count_if(found & ((F.size("tracks") == 0) | F.exists(widths, lambda v: v <= 0))).alias("invalid_tracks"),
        F.count_if(two & (expected > 0) & (narrowest < 0.55 * expected)).alias("narrow_tracks"),
        F.count_if(two & F.when(widest > 0, narrowest / widest < F.greatest(F.lit(0.45), 0.65 * support)).otherwise(True)).alias("asymmetric_pages"),
        F.count_if(F.col("tracks").isNull() & (F.col("local_status") == "invalid")).alias("unresolved"),
    ).withColumn("passed", F.col("invalid_tracks") + F.col("narrow_tracks") + F.col("asymmetric_pages") + F.col("unresolved") == 0)


def page_evidence(regions: DataFrame, is_reference: Column) -> DataFrame:
    """By page: texts, headings, and the shares of texts that are reference entries or open with a citation number."""
    t = regions.where((F.col("kind") == "text") & (stripped(F.col("text")) != ""))
    heading = _style().isin("heading", "appendix_heading")
    return t.groupBy(*PAGE).agg(
        F.count("*").alias("texts"),
        F.count_if(heading).alias("headings"),
        F.min_by(F.when(heading, stripped(F.col("text"))), F.when(heading, F.col("region"))).alias("first_heading"),
        (F.count_if(is_reference) / F.count("*")).alias("reference_density"),
        (F.count_if(F.col("text").rlike(r"^\s*(?:\[\d+\]|\d+\.)\s+")) / F.count("*")).alias("citation_density"),
    )


def section_roles(regions: DataFrame, states: DataFrame) -> DataFrame:
    """states(doc_id, page, state, inherited, reference_y): each text region with the role that the document's sections give it. On
    the page where references begin, what stands above their heading is body."""
    t = regions.where((F.col("kind") == "text") & (stripped(F.col("text")) != "")).join(states, PAGE)
    within = F.col("inherited") | F.col("reference_y").isNull() | ((F.col("y0") + F.col("y1")) / 2 >= F.col("reference_y"))
    return t.withColumn("section_role", F.when(F.col("state") != "references", F.col("state")).when(within, "reference_item").otherwise("normal_body"))


def section_audit(placed: DataFrame) -> DataFrame:
    """By document: where references begin, whether they go on, and where the written role (``semantic_role``) disagrees."""
    written = F.coalesce(F.col("semantic_role").startswith("reference"), F.lit(False))
    item = F.col("section_role") == "reference_item"
    first = F.min(F.when(F.col("state") == "references", F.col("page"))).over(Window.partitionBy("doc_id"))
    d = placed.withColumn("first_", first)
    return d.groupBy("doc_id").agg(
        F.max("first_").alias("reference_start"),
        F.bool_or((F.col("state") == "references") & F.col("inherited") & (F.col("page") > F.col("first_"))).alias("goes_on"),
        F.count_if(item & ~written & ~_style().isin("caption")).alias("role_gaps"),
        F.count_if(written & ~item).alias("orphans"),
    ).withColumn("goes_on", F.coalesce("goes_on", F.lit(False))).withColumn("decision", F.when((F.col("role_gaps") == 0) & (F.col("orphans") == 0), "pass").otherwise("fail"))
