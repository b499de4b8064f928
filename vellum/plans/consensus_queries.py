"""Queries over consensus grids: candidates are made of the columns that a page's text regions stand in."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import consensus, rounds, semantics, synth
from vellum.plans.text_queries import _t

PAGE = ["doc_id", "page"]


def _inputs(spark, sf_dir):
    """Two candidates a page: the narrowest text of each column, and the same with a left track that is moved by the page's number."""
    r = rounds.cut(synth.regions(_t(spark, sf_dir, "documents")).where("kind = 'text'"))
    edge = {0: F.when(F.col("column") == 0, F.col("x0")), 1: F.when(F.col("column") == 1, F.col("x0"))}
    begins, ends = (lambda c: F.max(edge[c])), (lambda c: F.min(edge[c] + F.col("col_width")))
    per = r.groupBy(*PAGE).agg(begins(0).alias("left_x0"), ends(0).alias("left_x1"), begins(1).alias("right_x0"), ends(1).alias("right_x1"), F.count_if(F.col("column") == 0).alias("l_"), F.count_if(F.col("column") == 1).alias("r_"))
    per = per.withColumn("gutter", F.when(F.col("right_x0") > F.col("left_x1"), F.col("right_x0") - F.col("left_x1")))
    frame = {"frame_x0": F.coalesce("left_x0", F.lit(72.0)), "frame_x1": F.coalesce("right_x1", F.lit(540.0))}
    first = per.withColumns({"candidate": F.lit(0), **frame})
    second = first.withColumns({"candidate": F.lit(1), "left_x0": F.col("left_x0") - F.col("page") % 3})
    pages = per.select(*PAGE, F.lit(612.0).alias("width"))
    return per, first.unionByName(second).drop("l_", "r_"), semantics.semantic_mode(r, pages), per.select(*PAGE, (F.col("l_") > 0).alias("left"), (F.col("r_") > 0).alias("right"))


def consensus_grids(spark, sf_dir):
    _, candidates, modes, evidence = _inputs(spark, sf_dir)
    p = consensus.document_profile(candidates, modes, evidence)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return p.select("doc_id", "layout_mode", F.col("scanned").cast("bigint").alias("scanned"), F.coalesce("elected", F.lit(0)).cast("bigint").alias("elected"), F.col("support").cast("bigint").alias("support"), *consensus.SCALES, *consensus.FRAME, "left_w_mad", "right_w_mad", "gutter_mad", "width_ratio_p10", "confidence", "resolved", text("excluded_pages").alias("excluded_pages"))


def snapped_grids(spark, sf_dir):
    """Every fourth page has lost its grid."""
    per, candidates, modes, evidence = _inputs(spark, sf_dir)
    profile = rounds.cut(consensus.document_profile(candidates, modes, evidence))
    lost = F.col("page") % 4 == 1
    edges = ("left_x0", "left_x1", "right_x0", "right_x1", "gutter")
    grids = per.select(*PAGE, F.when(F.col("page") % 7 == 6, "reference_dense").otherwise("mixed_layout").alias("page_class"), F.lit(0.7).alias("confidence"), *(F.when(~lost, F.col(e)).alias(e) for e in edges), ((F.col("l_") > 0) & (F.col("r_") > 0)).alias("text_in_both"))
    return consensus.snapped(grids, profile).select(*PAGE, *edges, "restored", "snapped", "grid_confidence")


QUERIES = {f.__name__: f for f in (consensus_grids, snapped_grids)}

_FEATURES = tuple(consensus.SCALES)
_NAMES = (*_FEATURES, *consensus.FRAME)
_INSIDE = " AND ".join(f"abs({f} - m_{f}) <= 4.5 * greatest(1.4826 * s_{f}, {v})" for f, v in consensus.SCALES.items())
_MODE = """md AS (
  SELECT doc_id, page, count(*) FILTER (WHERE m) AS n_text, count(*) FILTER (WHERE m AND continues) AS n_across, count(*) FILTER (WHERE m AND role NOT IN ('caption', 'figure_caption', 'table_caption') AND n >= 120) AS n_long, count(*) FILTER (WHERE b AND col = 0) AS n_left, count(*) FILTER (WHERE b AND col = 1) AS n_right,
         count(*) FILTER (WHERE b AND continues) AS n_body_across, median(CASE WHEN b THEN col_width END) AS track
  FROM (SELECT *, NOT (coalesce(semantic_role, role) = 'heading' AND regexp_matches(text, '^[0-9]+$')) AS m, col IN (0, 1) AND role IN ('body', 'list_item') AS b FROM regions WHERE kind = 'text') GROUP BY 1, 2
), modes AS (
  SELECT doc_id, page, CASE WHEN n_left > 0 AND n_right > 0 THEN 'two_column' WHEN n_left + n_right = 0 THEN 'unknown' WHEN n_body_across > 0 OR track <= 0.46 * 612 THEN 'two_column_sparse' ELSE 'single_column' END AS mode FROM md
)"""
_PROFILE = f"""{synth.REGIONS_SQL}, {_MODE}, per0 AS (
  SELECT doc_id, page, max(x0) FILTER (WHERE col = 0) AS left_x0, min(x0 + col_width) FILTER (WHERE col = 0) AS left_x1, max(x0) FILTER (WHERE col = 1) AS right_x0, min(x0 + col_width) FILTER (WHERE col = 1) AS right_x1, count(*) FILTER (WHERE col = 0) AS l, count(*) FILTER (WHERE col = 1) AS r FROM regions WHERE kind = 'text' GROUP BY 1, 2
), per AS (SELECT *, CASE WHEN right_x0 > left_x1 THEN right_x0 - left_x1 END AS gutter FROM per0
), cand AS (
  SELECT *, 0 AS candidate, coalesce(left_x0, 72.0) AS frame_x0, coalesce(right_x1, 540.0) AS frame_x1 FROM per UNION ALL SELECT * REPLACE (left_x0 - page % 3 AS left_x0), 1, coalesce(left_x0, 72.0), coalesce(right_x1, 540.0) FROM per
), use AS (
  SELECT c.*, left_x1 - left_x0 AS left_w, right_x1 - right_x0 AS right_w FROM cand c JOIN modes m ON c.doc_id = m.doc_id AND c.page = m.page AND m.mode IN ('two_column', 'two_column_sparse') WHERE left_x1 - left_x0 IS NOT NULL AND right_x1 - right_x0 IS NOT NULL AND gutter > 0
), el AS (SELECT * FROM use QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN greatest(left_w, right_w) <> 0 THEN least(left_w, right_w) / greatest(left_w, right_w) ELSE 0 END * least(left_w, right_w) DESC, candidate) = 1
), sup AS (SELECT * FROM el WHERE least(left_w, right_w) > 0 AND least(left_w, right_w) / greatest(left_w, right_w) >= 0.55 AND l > 0 AND r > 0
), med AS (SELECT doc_id, {", ".join(f"median({f}) AS m_{f}" for f in _FEATURES)} FROM sup GROUP BY 1
), spr AS (SELECT doc_id, {", ".join(f"median(abs({f} - m_{f})) AS s_{f}" for f in _FEATURES)} FROM sup JOIN med USING (doc_id) GROUP BY 1
), ins AS (SELECT sup.* FROM sup JOIN med USING (doc_id) JOIN spr USING (doc_id) WHERE {_INSIDE}
), arr AS (SELECT doc_id, list_sort(list(page)) AS pages, {", ".join(f"list_sort(list({f})) AS {f}" for f in _NAMES)} FROM ins GROUP BY 1
), trm AS (SELECT doc_id, pages, {", ".join(f"CASE WHEN len({f}) >= 8 THEN {f}[1 + len({f}) // 10 : len({f}) - len({f}) // 10] ELSE {f} END AS {f}" for f in _NAMES)} FROM arr
), fit AS (
  SELECT doc_id, pages, {", ".join(f"round(list_aggregate({f}, 'median'), 3) AS {f}" for f in _NAMES)}, {", ".join(f"round(list_aggregate(list_transform({f}, lambda v: abs(v - list_aggregate({f}, 'median'))), 'median'), 3) AS {f}_mad" for f in ("left_w", "right_w", "gutter"))},
         list_sort(list_transform(list_zip(left_w, right_w), lambda z: least(z[1], z[2]) / greatest(z[1], z[2]))) AS ratios FROM trm
), prof AS (
  SELECT d.doc_id, d.scanned, coalesce(e.n, 0) AS elected, coalesce(len(f.pages), 0) AS support, f.* EXCLUDE (doc_id, pages, ratios), round(ratios[greatest(0, len(ratios) // 10 - 1) + 1], 4) AS width_ratio_p10,
         CASE WHEN len(f.pages) > 0 THEN least(1.0, len(f.pages) / greatest(4.0, e.n * 0.55)) * CASE WHEN len(f.pages) < 2 THEN 0.4 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS conf, list_sort(list_filter(d.pages, lambda p: NOT list_contains(coalesce(f.pages, []), p))) AS excluded
  FROM (SELECT doc_id, count(*) AS scanned, list(page) AS pages FROM modes GROUP BY 1) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM el GROUP BY 1) e ON e.doc_id = d.doc_id LEFT JOIN fit f ON f.doc_id = d.doc_id
)"""

ORACLE_SQL = {
    "consensus_grids": f"""WITH {_PROFILE} SELECT doc_id, CASE WHEN support > 0 THEN 'two_column' ELSE 'unresolved' END AS layout_mode, scanned, elected, support, {", ".join(_NAMES)}, left_w_mad, right_w_mad, gutter_mad, width_ratio_p10, round(conf, 3) AS confidence, conf >= 0.68 AND support >= 2 AS resolved, array_to_string(excluded, ',') AS excluded_pages FROM prof""",
    "snapped_grids": f"""WITH {_PROFILE}, g AS (
          SELECT doc_id, page, page % 7 = 6 AS refs, l > 0 AND r > 0 AS bt, {", ".join(f"CASE WHEN page % 4 <> 1 THEN {e} END AS {e}" for e in ("left_x0", "left_x1", "right_x0", "right_x1", "gutter"))} FROM per
        ), j AS (
          SELECT g.*, p.left_x0 AS a, p.left_x1 AS b, p.right_x0 AS c, p.right_x1 AS d, p.gutter AS pg, g.right_x0 IS NOT NULL AND coalesce(g.gutter, 0) <> 0 AS two FROM g LEFT JOIN prof p ON p.doc_id = g.doc_id AND p.conf >= 0.68 AND p.support >= 2
        ), k AS (SELECT *, NOT two AND bt AND a IS NOT NULL AND NOT refs AS restored, two AND coalesce(abs(left_x0 - a) <= 0.15 AND abs(left_x1 - b) <= 0.15 AND abs(right_x0 - c) <= 0.15 AND abs(right_x1 - d) <= 0.15, false) AS same FROM j
        ), o AS (
          SELECT doc_id, page, bt, pg, restored, restored OR same AS snapped, CASE WHEN restored THEN a ELSE left_x0 END AS left_x0, CASE WHEN restored THEN b ELSE left_x1 END AS left_x1, CASE WHEN restored THEN c ELSE right_x0 END AS right_x0, CASE WHEN restored THEN d ELSE right_x1 END AS right_x1, CASE WHEN restored THEN round(c - b, 2) ELSE gutter END AS gutter FROM k
        ), w AS (SELECT *, greatest(left_x1 - left_x0, 1.0) AS lw, greatest(right_x1 - right_x0, 1.0) AS rw FROM o)
        SELECT doc_id, page, left_x0, left_x1, right_x0, right_x1, gutter, restored, snapped, round(0.28::DOUBLE * CASE WHEN bt THEN 1.0 WHEN right_x0 IS NULL THEN 0.82 ELSE 0.68 END::DOUBLE + 0.24::DOUBLE * 0.7::DOUBLE + 0.24::DOUBLE * CASE WHEN right_x0 IS NOT NULL THEN greatest(0.0, 1.0 - abs(lw - rw) / greatest(lw, rw)) ELSE 0.9 END::DOUBLE
          + 0.24::DOUBLE * CASE WHEN coalesce(gutter, 0) <> 0 AND coalesce(pg, 0) <> 0 THEN greatest(0.0, 1.0 - abs(gutter - pg) / 20.0) WHEN snapped THEN 1.0 ELSE 0.8 END::DOUBLE, 3) AS grid_confidence FROM w""",
}
