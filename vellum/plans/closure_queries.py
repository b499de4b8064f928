"""The closure of pages. Words of documents stand for spans; what each stage lost is planted by remainders, in one piece of SQL
that both sides read. The plain SQL takes every counter by its own join or anti join."""

from __future__ import annotations

from vellum.operators import closure, rounds, synth
from vellum.plans.text_queries import _t

_P = "doc_id, page"
TABLES_SQL = f"""v_words AS (
  SELECT {_P}, CAST(ordinal AS BIGINT) AS i, text, x0, y0, x1, y1, CAST(col * 10 + floor(line / 9) AS BIGINT) AS paragraph FROM spans
), v_pages AS (SELECT DISTINCT {_P} FROM spans
), v_spans AS (SELECT {_P}, i AS span_id FROM v_words
), v_owned AS (
  SELECT {_P}, i AS span_id, CASE WHEN i % 10 = 8 THEN 'formula' WHEN i % 10 = 9 THEN 'figure' ELSE 'text' END AS owner FROM v_words WHERE i % 97 <> 0
  UNION ALL SELECT {_P}, i, 'table' FROM v_words WHERE i % 53 = 0 UNION ALL SELECT {_P}, i, 'text' FROM v_words WHERE i % 590 = 0
), v_members AS (SELECT {_P}, paragraph, i AS span_id FROM v_words WHERE i % 10 < 8 AND i % 61 <> 0
), v_paras AS (SELECT DISTINCT {_P}, paragraph FROM v_words
), v_paragraphs AS (
  SELECT {_P}, paragraph, CASE WHEN (paragraph + page) % 11 = 0 THEN NULL WHEN (paragraph + page) % 13 = 0 THEN ' ' ELSE 'done' END AS translation, paragraph % 5 = 0 AS crossing FROM v_paras
), v_fragments AS (
  SELECT {_P}, CAST(paragraph AS STRING) || '_0' AS fragment FROM v_paras WHERE paragraph % 5 = 0 UNION ALL SELECT {_P}, CAST(paragraph AS STRING) || '_1' FROM v_paras WHERE paragraph % 5 = 0
), v_dom_fragments AS (
  SELECT {_P}, CAST(paragraph AS STRING) || '_0' AS fragment FROM v_paras UNION ALL SELECT {_P}, CAST(paragraph AS STRING) || '_1' FROM v_paras WHERE (paragraph + page) % 3 <> 0
), v_formulas AS (SELECT {_P}, i AS formula_id, i % 20 = 8 AS inline FROM v_words WHERE i % 10 = 8
), v_segments AS (
  SELECT {_P}, i AS formula_id, 0 AS segment, x0 - 2 AS x0, y0, x1 + 2 AS x1, y1 FROM v_words WHERE i % 10 = 8 UNION ALL SELECT {_P}, i, 1, x0 + 1, y0 + 6, x1 + 9, y1 + 6 FROM v_words WHERE i % 30 = 8
), v_dom_formulas AS (
  SELECT {_P}, formula_id, formula_id % 20 = 8 AS inline, formula_id % 90 <> 8 AS ink FROM v_segments WHERE formula_id % 70 <> 8 OR segment = 1
), v_codes AS (SELECT {_P}, text AS value FROM v_words WHERE i % 17 = 0
), v_dom_codes AS (SELECT {_P}, text AS value, i % 68 <> 0 AS ink FROM v_words WHERE i % 34 = 0 OR i % 51 = 0
), v_tokens AS (SELECT {_P}, CASE WHEN i % 76 = 0 THEN text || '_x' ELSE text END AS token, CASE WHEN i % 38 = 0 THEN 2 ELSE 1 END AS lines FROM v_words WHERE i % 19 = 0
), v_code_targets AS (SELECT DISTINCT {_P}, text AS token FROM v_words WHERE i % 57 = 0
), v_citation_targets AS (SELECT DISTINCT {_P}, text AS token FROM v_words WHERE i % 95 = 0
), v_placeholders AS (SELECT {_P}, CAST(paragraph AS STRING) || '|' || text AS key FROM v_words WHERE i % 23 = 0
), v_found_placeholders AS (SELECT {_P}, CAST(paragraph AS STRING) || '|' || text AS key FROM v_words WHERE i % 46 = 0
), v_figures AS (SELECT {_P}, 0 AS figure FROM v_pages WHERE page % 2 = 0
), v_dom_figures AS (SELECT {_P}, page % 4 <> 0 AS ink FROM v_pages WHERE page % 3 <> 0
), v_tables AS (SELECT {_P}, 't' AS tab FROM v_pages WHERE page % 3 = 0 UNION ALL SELECT {_P}, 'u' FROM v_pages WHERE page % 6 = 0
), v_cells AS (SELECT {_P}, 't' AS tab, i % 58 = 0 AS translated, i % 87 = 0 AS overflow FROM v_words WHERE i % 29 = 0 AND page % 3 = 0
), v_rules AS (SELECT {_P}, 't' AS tab, i % 2 = 0 AS horizontal FROM v_words WHERE i % 31 = 0 AND page % 3 = 0
), v_snapshots AS (SELECT {_P}, page % 4 AS rendered_cells, page % 2 AS clipped, page % 5 AS overflowing, page % 3 AS single_char_lines, CAST(1 - (page % 4) / 100.0 AS DOUBLE) AS recovery FROM v_pages
)"""
NAMES = (
    "spans", "owned", "members", "paragraphs", "fragments", "dom_fragments", "formulas", "segments", "dom_formulas", "codes", "dom_codes", "tokens", "code_targets", "citation_targets",
    "placeholders", "found_placeholders", "figures", "dom_figures", "tables", "cells", "rules", "snapshots",
)


def tables(spark, sf_dir):
    """The tables by name; the documents are read once."""
    spans = rounds.cut(synth.spans(_t(spark, sf_dir, "documents")))
    return {n: spark.sql(f"WITH {TABLES_SQL.replace('FROM spans', 'FROM {spans}')} SELECT * FROM v_{n}", spans=spans) for n in NAMES}


def page_closure(spark, sf_dir):
    return closure.page_closure(tables(spark, sf_dir))


QUERIES = {"page_closure": page_closure}

_ON = "b.doc_id = a.doc_id AND b.page = a.page"


def _without(key: str, other: str, more: str = "true") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {other} b WHERE {_ON} AND b.{key} = a.{key} AND {more})"


_COUNTERS = {
    "spans": "count(*) FROM v_spans a",
    "conflicts": "count(*) FROM (SELECT doc_id, page, span_id FROM v_owned GROUP BY 1, 2, 3 HAVING count(DISTINCT owner) > 1) a",
    "duplicates": "count(*) - count(DISTINCT span_id) FROM v_owned a",
    "unowned": f"count(*) FROM v_spans a WHERE {_without('span_id', 'v_owned')}",
    "text_spans": "count(DISTINCT span_id) FROM v_owned a WHERE owner = 'text'",
    "paragraph_spans": f"count(DISTINCT span_id) FROM v_owned a WHERE owner = 'text' AND EXISTS (SELECT 1 FROM v_members b WHERE {_ON} AND b.span_id = a.span_id)",
    "dropped": f"count(DISTINCT span_id) FROM v_owned a WHERE owner = 'text' AND {_without('span_id', 'v_members')}",
    "figure_spans": "count(DISTINCT span_id) FROM v_owned a WHERE owner = 'figure'",
    "paragraphs": "count(*) FROM v_paragraphs a",
    "translated": "count(*) FROM v_paragraphs a WHERE trim(translation) <> ''",
    "untranslated": "count(*) FROM v_paragraphs a WHERE coalesce(trim(translation), '') = ''",
    "crossing": "count(*) FROM v_paragraphs a WHERE crossing",
    "split_translations": "count(*) FROM v_paragraphs a WHERE crossing AND translation IS NULL",
    "orphan_fragments": f"count(*) FROM v_fragments a WHERE {_without('fragment', 'v_dom_fragments')}",
    "inline_formulas": "count(*) FROM v_formulas a WHERE inline",
    "display_formulas": "count(*) FROM v_formulas a WHERE NOT inline",
    "inline_segments": "count(*) FROM v_segments a JOIN v_formulas f USING (doc_id, page, formula_id) WHERE f.inline",
    "display_segments": "count(*) FROM v_segments a JOIN v_formulas f USING (doc_id, page, formula_id) WHERE NOT f.inline",
    "inline_nodes": "count(*) FROM v_dom_formulas a WHERE inline",
    "display_nodes": "count(*) FROM v_dom_formulas a WHERE NOT inline",
    "inline_rendered": "count(DISTINCT formula_id) FROM v_dom_formulas a WHERE inline",
    "inline_blank": "count(*) FROM v_dom_formulas a WHERE inline AND NOT ink",
    "display_blank": "count(*) FROM v_dom_formulas a WHERE NOT inline AND NOT ink",
    "inline_absent": f"count(*) FROM v_formulas a WHERE inline AND {_without('formula_id', 'v_dom_formulas', 'b.inline')}",
    "display_absent": f"count(*) FROM v_formulas a WHERE NOT inline AND {_without('formula_id', 'v_dom_formulas', 'NOT b.inline')}",
    "codes": "count(*) FROM v_codes a",
    "codes_exact": f"count(*) FROM v_codes a WHERE EXISTS (SELECT 1 FROM v_dom_codes b WHERE {_ON} AND b.value = a.value)",
    "code_nodes": "count(*) FROM v_dom_codes a",
    "code_blank": "count(*) FROM v_dom_codes a WHERE NOT ink",
    "latin_split": f"count(*) FROM v_tokens a WHERE lines > 1 AND {_without('token', 'v_code_targets')}",
    "code_split": f"count(*) FROM v_tokens a WHERE lines > 1 AND EXISTS (SELECT 1 FROM v_code_targets b WHERE {_ON} AND b.token = a.token)",
    "citation_split": f"count(*) FROM v_tokens a WHERE lines > 1 AND EXISTS (SELECT 1 FROM v_citation_targets b WHERE {_ON} AND b.token = a.token)",
    "identifier_split": "count(*) FROM v_tokens a WHERE lines > 1 AND contains(token, '_')",
    "placeholders_lost": f"count(*) FROM v_placeholders a WHERE {_without('key', 'v_found_placeholders')}",
    "figures": "count(*) FROM v_figures a",
    "figure_nodes": "count(*) FROM v_dom_figures a",
    "figure_blank": "count(*) FROM v_dom_figures a WHERE NOT ink",
    "tables": "count(*) FROM v_tables a",
    "cells": "count(*) FROM v_cells a",
    "cells_translated": "count(*) FROM v_cells a WHERE translated",
    "cells_overflowing": "count(*) FROM v_cells a WHERE overflow",
    "horizontal_rules": "count(*) FROM v_rules a WHERE horizontal",
    "vertical_rules": "count(*) FROM v_rules a WHERE NOT horizontal",
    "filled_tables": f"count(*) FROM v_tables a WHERE EXISTS (SELECT 1 FROM v_cells b WHERE {_ON} AND b.tab = a.tab)",
    **{m: f"sum({m}) FROM v_snapshots a" for m in closure.SIDES["page"][:4]},
    "overlaps": "count(*) FROM v_segments a JOIN v_segments b ON b.doc_id = a.doc_id AND b.page = a.page AND (a.formula_id < b.formula_id OR (a.formula_id = b.formula_id AND a.segment < b.segment)) AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 4",
}
_CTES = ", ".join(f"c_{k} AS (SELECT a.doc_id, a.page, {v} GROUP BY a.doc_id, a.page)" if "USING" not in v else f"c_{k} AS (SELECT doc_id, page, {v} GROUP BY doc_id, page)" for k, v in _COUNTERS.items())
_CTES = _CTES.replace("GROUP BY 1, 2, 3 HAVING", "GROUP BY doc_id, page, span_id HAVING")
_NAMED = ", ".join(f"d_{k} AS (SELECT * FROM c_{k} AS c_{k}(doc_id, page, n))" for k in _COUNTERS)
_JOINS = " ".join(f"LEFT JOIN d_{k} ON d_{k}.doc_id = p.doc_id AND d_{k}.page = p.page" for k in _COUNTERS)

ORACLE_SQL = {
    "page_closure": f"""WITH {synth.SPANS_SQL}, {TABLES_SQL}, {_CTES}, {_NAMED},
        k AS (SELECT p.doc_id, p.page, {", ".join(f"CAST(coalesce(d_{k}.n, 0) AS BIGINT) AS {k}" for k in _COUNTERS)} FROM v_pages p {_JOINS}),
        m AS (SELECT k.*, figure_nodes - figure_blank AS figure_rendered, greatest(0, inline_segments - inline_nodes) + greatest(0, display_segments - display_nodes) AS segments_absent, greatest(0, codes - code_nodes) AS codes_absent, CASE WHEN figures = 0 THEN figure_spans ELSE 0 END AS figure_spans_alone,
              inline_blank + display_blank + figure_blank + code_blank AS blank, inline_absent + display_absent + greatest(0, figures - figure_nodes) + CASE WHEN k.rendered_cells = 0 THEN filled_tables ELSE 0 END AS regions_absent, round(s.recovery, 4) AS recovery FROM k JOIN v_snapshots s ON s.doc_id = k.doc_id AND s.page = k.page),
        u AS (SELECT *, regions_absent + segments_absent + codes_absent + figure_spans_alone + blank + dropped AS unrendered FROM m),
        h AS (SELECT *, conflicts = 0 AND duplicates = 0 AND unowned = 0 AS ownership_closed, untranslated = 0 AND dropped = 0 AS text_closed, unrendered = 0 AND regions_absent = 0 AND blank = 0 AS render_closed, inline_blank = 0 AND display_blank = 0 AS formula_visible, latin_split = 0 AND code_split = 0 AS tokens_intact,
              orphan_fragments = 0 AND split_translations = 0 AS continuations_closed, clipped = 0 AND overflowing = 0 AND single_char_lines = 0 AND recovery >= 0.99 AS typography_closed FROM u)
        SELECT *, ownership_closed AND text_closed AND render_closed AND formula_visible AND tokens_intact AND continuations_closed AND typography_closed AS passed FROM h""",
}
