"""Queries over bounds of the flow, layout profiles and rendered headings of synthetic pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import bounds, layout, synth
from vellum.plans.layout_queries import ORACLE_SQL as LAYOUT_SQL
from vellum.plans.text_queries import _long, _t

PAGE = ["doc_id", "page"]
HEIGHT = 700.0


def _regions(spark, sf_dir):
    return synth.regions(_t(spark, sf_dir, "documents")).withColumn("region", F.col("region").cast("bigint"))


def content_bounds(spark, sf_dir):
    """Every 29th line is a footer. Pages are 700 high, so the first row of a page may be a running head."""
    r = _regions(spark, sf_dir).withColumn("semantic_role", F.when(F.col("region") % 29 == 7, "page_number").otherwise(F.col("semantic_role"))).withColumns({"y0": F.col("y0") - 72, "y1": F.col("y1") - 84})
    pages = r.select(*PAGE).distinct().select(*PAGE, F.lit(HEIGHT).alias("height"), F.lit(40.0).alias("frame_y0"), F.lit(500.0).alias("frame_y1"))
    return bounds.content_bounds(r, pages).select(*PAGE, "flow_y0", "flow_y1")


def layout_profiles(spark, sf_dir):
    g = layout.column_grid(synth.spans(_t(spark, sf_dir, "documents"))).withColumn("page", F.col("page").cast("bigint"))
    d = {c: F.col(c).cast("double") for c in ("frame_x0", "frame_x1")}
    two = F.col("n_columns") == 2
    tracks = {"left_x0": F.when(two, F.col("frame_x0")), "left_x1": F.when(two, F.col("gutter_lo")), "right_x0": F.when(two, F.col("gutter_hi")), "right_x1": F.when(two, F.col("frame_x1"))}
    p = bounds.layout_profile(g.select(*PAGE, F.lit(612.0).alias("width"), *(v.alias(k) for k, v in d.items()), *(v.cast("double").alias(k) for k, v in tracks.items())))
    text = F.array_join(F.transform(F.map_entries("gutters"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("bigint").cast("string"))), ",")
    return _long(p.withColumn("gutters", text))


def heading_lines(spark, sf_dir):
    """Rendered lines stand up to 60 points lower and 24 to the right."""
    r = _regions(spark, sf_dir)
    n = F.length("text")
    lines = r.select(*PAGE, F.col("region").alias("line"), "text", (F.col("x0") + 12 * (n % 3)).alias("x0"), (F.col("y0") + 30 + 15 * (n % 5)).alias("y"))
    heads = r.where("role = 'heading'").select(*PAGE, F.col("region").alias("heading"), "text", "x0", "y0", "x1", "y1")
    return bounds.locate_headings(heads, lines)


QUERIES = {f.__name__: f for f in (content_bounds, layout_profiles, heading_lines)}

_R = synth.REGIONS_SQL
_NO = "nullif(regexp_extract({t}, '^\\s*([A-Z](?:\\.[0-9]+)*|[0-9]+(?:\\.[0-9]+)*)', 1), '')"
ORACLE_SQL = {
    "content_bounds": f"""WITH {_R}, t AS (SELECT doc_id, page, kind, col, text, y0 - 72 AS a, y0 + 60 - 84 AS z, CASE WHEN region % 29 = 7 THEN 'page_number' ELSE coalesce(semantic_role, role) END AS role FROM regions),
        k AS (SELECT *, kind = 'text' AND (role = 'page_number' OR (regexp_matches(trim(text), '(?i)^(?:page\\s*)?[0-9]+(?:\\s*/\\s*[0-9]+)?$') AND a >= 602)) AS foot, kind = 'text' AND z <= 49 AND col NOT IN (0, 1) AS head FROM t),
        g AS (SELECT *, kind IN ('table', 'figure', 'display_formula') OR (kind = 'text' AND NOT foot AND NOT head AND col IN (0, 1) AND role IN ('body', 'list_item', 'heading', 'reference_item')) AS flows FROM k),
        s AS (SELECT doc_id, page, min(a) FILTER (WHERE flows) AS a, max(z) FILTER (WHERE flows) AS z, min(a) FILTER (WHERE foot) AS foot FROM g GROUP BY 1, 2), b AS (SELECT doc_id, page, greatest(0.0, least(coalesce(a, 40.0), 700.0)) AS lo, coalesce(foot, greatest(500.0, coalesce(z, 500.0))) AS hi FROM s)
        SELECT doc_id, page, round(lo, 3)::DOUBLE AS flow_y0, round(greatest(lo, least(hi, 700.0)), 3)::DOUBLE AS flow_y1 FROM b""",
    "layout_profiles": f"""WITH g AS ({LAYOUT_SQL["column_grids"]}) SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE n_columns = 2) AS two_column_pages, count(*) FILTER (WHERE n_columns = 1) AS single_column_pages, round(median(gutter_hi - gutter_lo), 2) AS gutter,
        round(median(CASE WHEN n_columns = 2 THEN gutter_lo - frame_x0 END), 2) AS left_width, round(median(CASE WHEN n_columns = 2 THEN frame_x1 - gutter_hi END), 2) AS right_width, round(median(frame_x0), 2) AS left_margin, round(median(612 - frame_x1), 2) AS right_margin,
        round(median(CASE WHEN n_columns = 2 THEN frame_x0 END), 2) AS left_x0, round(median(gutter_lo), 2) AS left_x1, round(median(gutter_hi), 2) AS right_x0, round(median(CASE WHEN n_columns = 2 THEN frame_x1 END), 2) AS right_x1,
        coalesce(string_agg(page || ':' || (gutter_hi - gutter_lo), ',' ORDER BY page) FILTER (WHERE n_columns = 2), '') AS gutters FROM g GROUP BY 1""",
    "heading_lines": f"""WITH {_R}, l AS (SELECT doc_id, page, region AS line, {_NO.format(t="text")} AS no, x0 + 12 * (n % 3) AS x0, y0 + 30 + 15 * (n % 5) AS y FROM regions WHERE n <= 60), h AS (SELECT doc_id, page, region AS heading, {_NO.format(t="text")} AS no, x0, y0, y0 + 60 AS y1 FROM regions WHERE role = 'heading'),
        m AS (SELECT h.doc_id, h.page, h.heading, l.line, NOT (l.y BETWEEN h.y0 - 6 AND h.y1 + 20) AS far, abs(l.y - (h.y0 + h.y1) / 2) AS off FROM h JOIN l ON l.doc_id = h.doc_id AND l.page = h.page AND abs(l.x0 - h.x0) < 20 AND (l.y BETWEEN h.y0 - 6 AND h.y1 + 20 OR (h.no IS NOT NULL AND l.y BETWEEN h.y0 - 6 AND h.y0 + 170)) AND (h.no IS NULL OR l.no = h.no)),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, heading ORDER BY far, off, line) AS r FROM m) SELECT h.doc_id, h.page, h.heading, o.line, coalesce(o.far, false) AS fallback FROM h LEFT JOIN o ON o.doc_id = h.doc_id AND o.page = h.page AND o.heading = h.heading AND o.r = 1""",
}
