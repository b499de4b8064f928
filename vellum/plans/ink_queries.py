"""Queries over ink of formulas: counts and sources of assets are made from the synthetic formulas' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import ink, synth
from vellum.plans.trace_queries import TABLES_SQL, tables

PAGE = ["doc_id", "page"]
_ASSETS = """SELECT doc_id, page, formula_id, segment, has_asset, viewbox_crop, CAST(CASE WHEN formula_id % 64 = 0 THEN 0 ELSE 30 END AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height, CASE WHEN formula_id % 12 = 0 THEN 0 ELSE ink END AS ink,
  CASE WHEN formula_id % 72 = 0 THEN 'no glyph' END AS raster_error, CASE WHEN formula_id % 9 = 0 THEN '<svg/>' WHEN formula_id % 10 = 0 THEN '<svg><path opacity="0" d="M0"/></svg>' WHEN formula_id % 7 = 0 THEN '<svg><g:use fill="#fff"/></svg>' ELSE '<svg><path d="M0 0"/></svg>' END AS svg FROM t_segments"""
_FINAL = """SELECT doc_id, page, formula_id, placement, formula_id % 48 <> 0 AS placed, CASE WHEN formula_id % 16 = 0 THEN 0 WHEN formula_id % 5 = 0 THEN 9 ELSE 400 END AS a_ink, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN formula_id % 40 = 0 THEN 0 WHEN formula_id % 5 = 0 THEN 8 ELSE 410 END AS b_ink,
  formula_id % 3 = 0 AS a_edge, formula_id % 6 = 0 AS b_edge, 300 + formula_id % 7 AS asset_ink, CAST(CASE WHEN formula_id % 11 = 0 THEN 0 ELSE 4 END AS DOUBLE) AS asset_scale, formula_id % 9 = 0 AS asset_edge FROM t_placements"""


def _read(spark, sf_dir, sql: str, table: str):
    return spark.sql(sql.replace(f"FROM t_{table}", "FROM {t}"), t=tables(spark, sf_dir)[table])


def asset_ink(spark, sf_dir):
    v = ink.asset_verdicts(_read(spark, sf_dir, _ASSETS, "segments"))
    return v.groupBy("doc_id", F.coalesce("zero_ink_cause", F.lit("inked")).alias("cause")).agg(F.count("*").alias("n"), F.count_if("zero_size").alias("zero_size"), F.count_if("zero_ink").alias("zero_ink"))


def asset_gate(spark, sf_dir):
    return ink.asset_gate(ink.asset_verdicts(_read(spark, sf_dir, _ASSETS, "segments")), PAGE)


def final_ink(spark, sf_dir):
    return ink.final_verdicts(_read(spark, sf_dir, _FINAL, "placements")).select(*PAGE, "placement", "final_missing", "final_blank", "disagreement", "ink_ratio", "final_crop")


def final_gate(spark, sf_dir):
    return ink.final_gate(ink.final_verdicts(_read(spark, sf_dir, _FINAL, "placements")), PAGE)


QUERIES = {f.__name__: f for f in (asset_ink, asset_gate, final_ink, final_gate)}

_T = f"{synth.SPANS_SQL}, {TABLES_SQL}"
_V = f"""{_T}, a AS ({_ASSETS}), v AS (
  SELECT *, NOT has_asset AS missing, has_asset AND width <= 0 AS zero_size, has_asset AND ink <= 0 AS zero_ink,
         CASE WHEN NOT has_asset THEN 'asset_missing' WHEN ink > 0 THEN 'inked' WHEN raster_error IS NOT NULL THEN 'rasterization_or_path_conversion_failed' WHEN formula_id % 9 = 0 THEN 'empty_svg_no_drawable_nodes' WHEN formula_id % 10 = 0 THEN 'transparent_drawable_nodes'
              WHEN formula_id % 7 = 0 THEN 'white_drawable_nodes' ELSE 'drawable_nodes_outside_viewbox_or_glyph_missing' END AS cause FROM a
)"""
_W = f"""{_T}, p AS ({_FINAL}), q AS (SELECT *, coalesce(b_ink, 0) AS b, asset_ink / CASE WHEN asset_scale = 0 THEN 1 ELSE 16 END AS before FROM p
), r AS (SELECT *, CASE WHEN placed AND a_ink > 0 AND b > 0 THEN least(a_ink, b) / 16 / before ELSE 0 END AS ratio FROM q
), v AS (
  SELECT *, NOT placed AS final_missing, NOT placed OR a_ink = 0 OR b = 0 AS final_blank, placed AND b_ink IS NOT NULL AND (a_ink > 0) <> (b > 0) AS disagreement, placed AND a_ink > 0 AND b > 0 AND before >= 4 AND ratio < 0.04 AND a_edge AND b_edge AND NOT asset_edge AS final_crop FROM r
)"""
ORACLE_SQL = {
    "asset_ink": f"WITH {_V} SELECT doc_id, cause, count(*) AS n, count(*) FILTER (WHERE zero_size) AS zero_size, count(*) FILTER (WHERE zero_ink) AS zero_ink FROM v GROUP BY 1, 2",
    "asset_gate": f"WITH {_V} SELECT doc_id, page, count(*) AS assets, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE zero_size) AS zero_size, count(*) FILTER (WHERE zero_ink) AS zero_ink, count(*) FILTER (WHERE viewbox_crop) AS viewbox_crop, CASE WHEN bool_or(missing OR zero_size OR zero_ink OR viewbox_crop) THEN 'fail' ELSE 'pass' END AS decision FROM v GROUP BY 1, 2",
    "final_ink": f"WITH {_W} SELECT doc_id, page, placement, final_missing, final_blank, disagreement, round(ratio, 4)::DOUBLE AS ink_ratio, final_crop FROM v",
    "final_gate": f"WITH {_W} SELECT doc_id, page, count(*) AS placements, count(*) FILTER (WHERE final_missing) AS final_missing, count(*) FILTER (WHERE final_blank) AS final_blank, count(*) FILTER (WHERE final_crop) AS final_crop, count(*) FILTER (WHERE disagreement) AS disagreement, CASE WHEN bool_or(final_missing OR final_blank OR final_crop OR disagreement OR (placed AND b_ink IS NULL)) THEN 'fail' ELSE 'pass' END AS decision FROM v GROUP BY 1, 2",
}
