"""Queries over candidates of formulas: words of documents on synthetic pages, some of them turned to signs, numbers, bullets and
citations by remainders, in one piece of SQL that both sides read."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import candidates, formulas, rounds, synth
from vellum.plans.text_queries import _t

PAGE_HEIGHT = 700.0
TABLES_SQL = """w_spans AS (
  SELECT doc_id, page, CAST(ordinal AS BIGINT) AS ordinal, CASE WHEN ordinal % 17 = 0 THEN '×' WHEN ordinal % 19 = 0 THEN '•' WHEN ordinal % 23 = 0 THEN '−' WHEN ordinal % 29 = 0 THEN '12' WHEN ordinal % 31 = 0 THEN '[3, 4]' WHEN ordinal % 37 = 0 THEN 'α' WHEN ordinal % 41 = 0 THEN '(7)' ELSE text END AS text,
         CASE WHEN ordinal % 43 = 0 THEN 'CMMI10' ELSE 'Times' END AS font, x0, y0, x1, y1 + CASE WHEN ordinal % 7 = 0 THEN 8 ELSE 0 END AS y1, size
  FROM spans
)"""


def _spans(spark, sf_dir):
    spans = synth.spans(_t(spark, sf_dir, "documents"))
    s = spark.sql(f"WITH {TABLES_SQL.replace('FROM spans', 'FROM {spans}')} SELECT * FROM w_spans", spans=spans)
    return candidates.true_candidates(candidates.segmented(s), PAGE_HEIGHT)


def formula_candidates(spark, sf_dir):
    return _spans(spark, sf_dir).where("candidate").select("doc_id", "page", "ordinal", "kept_first", "kept")


def block_contexts(spark, sf_dir):
    """Blocks are runs of kept candidates on a line, at most 15 points apart."""
    s = rounds.cut(_spans(spark, sf_dir))
    kept = formulas.numbered(s.withColumn("is_candidate", F.col("kept")), 15.0)
    members = kept.withColumn("block", F.concat_ws("/", F.col("y0").cast("bigint").cast("string"), F.col("run").cast("string")))
    return candidates.block_context(members, s).select("doc_id", "page", "block", "x0", "y0", "x1", "y1", "band_width", "plain_width", F.col("runs").cast("bigint").alias("runs"))


def render_segments(spark, sf_dir):
    """Blocks of three lines each: the kept candidates of a third of a column, every other one a display block."""
    s = rounds.cut(_spans(spark, sf_dir))
    third = (F.floor((F.col("y0") - 72) / 36) * 2 + F.when(F.col("x0") < 306, 0).otherwise(1)).cast("bigint")
    members = s.where("kept").select("doc_id", "page", third.alias("block"), "ordinal", "x0", "y0", "x1", "y1")
    blocks = members.groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("is_display", F.col("block") % 4 < 2)
    return candidates.render_segments(blocks, members, s).withColumn("segment", F.col("segment").cast("bigint"))


QUERIES = {f.__name__: f for f in (formula_candidates, block_contexts, render_segments)}

_MATH = f"[{T.GREEK}{T.MATH_SYMBOLS}]"
_LINE = "doc_id, page, y0, segment"
_SAME = "o.doc_id = s.doc_id AND o.page = s.page AND o.y0 = s.y0 AND o.segment = s.segment AND o.ordinal <> s.ordinal AND o.y0 < s.y1 - 1 AND o.y1 > s.y0 + 1"
_KEPT = f"""w_first AS (
  SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal) > 12 OR lag(x1) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal) IS NULL THEN 1 ELSE 0 END AS f, font = 'CMMI10' AS math, regexp_matches(text, '{_MATH}') AS glyph FROM w_spans
), w_seg AS (
  SELECT *, CAST(sum(f) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment, trim(text) <> '' AND (math OR glyph OR regexp_matches(trim(text), '^\\p{{Sm}}+$') OR regexp_matches(trim(text), '^[0-9]+$')) AS candidate FROM w_first
), w_signs AS (SELECT * FROM w_seg WHERE candidate AND (math OR text IN ('×', '−'))
), w_before AS (
  SELECT s.doc_id, s.page, s.ordinal, o.candidate, (o.y0 + o.y1) / 2 AS cy, row_number() OVER (PARTITION BY s.doc_id, s.ordinal ORDER BY o.x1 DESC, o.ordinal) AS r FROM w_signs s JOIN w_seg o ON {_SAME} AND o.x1 <= s.x0 + 2
), w_after AS (
  SELECT s.doc_id, s.page, s.ordinal, o.candidate, (o.y0 + o.y1) / 2 AS cy, row_number() OVER (PARTITION BY s.doc_id, s.ordinal ORDER BY o.x0, o.ordinal) AS r FROM w_signs s JOIN w_seg o ON {_SAME} AND o.x0 >= s.x1 - 2
), w_framed AS (
  SELECT b.doc_id, b.ordinal FROM w_before b JOIN w_after a ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal AND a.r = 1 AND b.r = 1 WHERE NOT a.candidate AND NOT b.candidate AND abs(a.cy - b.cy) <= 3
), w_one AS (
  SELECT s.*, s.candidate AND NOT (trim(text) IN ('•', '·', '∙', '*') AND NOT math) AND NOT regexp_matches(trim(text), '^\\[[0-9,\\-;\\s–]*[0-9][0-9,\\-;\\s–]*\\]$') AND NOT (regexp_matches(trim(text), '^[0-9]+$') AND (y0 < 40 OR y1 > {PAGE_HEIGHT} - 40)) AND f.ordinal IS NULL AS kept_first
  FROM w_seg s LEFT JOIN w_framed f ON f.doc_id = s.doc_id AND f.ordinal = s.ordinal
), w_kept AS (
  SELECT *, kept_first AND (math OR NOT regexp_matches(trim(text), '^[0-9.,\\- ]*$') OR bool_or(kept_first AND (math OR glyph)) OVER (PARTITION BY {_LINE})) AS kept FROM w_one
)"""

ORACLE_SQL = {
    "formula_candidates": f"WITH {synth.SPANS_SQL}, {TABLES_SQL}, {_KEPT} SELECT doc_id, page, ordinal, kept_first, kept FROM w_kept WHERE candidate",
    "block_contexts": f"""WITH {synth.SPANS_SQL}, {TABLES_SQL}, {_KEPT}, k AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 15 OR lag(x1) OVER w IS NULL THEN 1 ELSE 0 END AS g FROM w_kept WHERE kept WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal)),
        m AS (SELECT doc_id, page, y0, segment, ordinal, CAST(y0 AS BIGINT) || '/' || CAST(sum(g) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM k),
        e AS (SELECT *, CASE WHEN regexp_matches(trim(text), '^[0-9(),.\\- ]*[0-9][0-9(),.\\- ]*$') AND NOT math AND size >= 8.8 THEN 0.0 ELSE x1 - x0 END AS width FROM w_kept),
        s AS (SELECT {_LINE}, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM w_kept GROUP BY ALL),
        o AS (SELECT m.doc_id, m.page, m.block, min(s.x0) AS x0, min(s.y0) AS y0, max(s.x1) AS x1, max(s.y1) AS y1 FROM m JOIN s USING ({_LINE}) GROUP BY 1, 2, 3),
        b AS (SELECT o.doc_id, o.page, o.block, s.y0, s.segment FROM o JOIN s ON s.doc_id = o.doc_id AND s.page = o.page AND s.y1 >= o.y0 - 2 AND s.y0 <= o.y1 + 2 AND s.x1 > o.x0 + 2 AND s.x0 < o.x1 - 2),
        c AS (SELECT b.doc_id, b.page, b.block, count(DISTINCT (b.y0, b.segment)) AS runs, sum(CASE WHEN m.ordinal IS NULL THEN e.width ELSE 0 END) AS band_width, sum(CASE WHEN m.ordinal IS NULL AND NOT e.candidate THEN e.width ELSE 0 END) AS plain_width
              FROM b JOIN e ON e.doc_id = b.doc_id AND e.page = b.page AND e.y0 = b.y0 AND e.segment = b.segment LEFT JOIN m ON m.doc_id = b.doc_id AND m.page = b.page AND m.block = b.block AND m.ordinal = e.ordinal GROUP BY 1, 2, 3)
        SELECT o.*, coalesce(band_width, 0.0)::DOUBLE AS band_width, coalesce(plain_width, 0.0)::DOUBLE AS plain_width, coalesce(runs, 0) AS runs FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.page = o.page AND c.block = o.block""",
    "render_segments": f"""WITH RECURSIVE {synth.SPANS_SQL}, {TABLES_SQL}, {_KEPT}, m AS (SELECT doc_id, page, CAST(floor((y0 - 72) / 36) * 2 + CASE WHEN x0 < 306 THEN 0 ELSE 1 END AS BIGINT) AS block, ordinal, x0, y0, x1, y1, (y0 + y1) / 2 AS cy FROM w_kept WHERE kept),
        b AS (SELECT doc_id, page, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, block % 4 < 2 AS is_display FROM m GROUP BY 1, 2, 3),
        p AS (SELECT * FROM w_kept WHERE NOT kept AND NOT math AND trim(text) <> ''),
        fo AS (SELECT DISTINCT b.doc_id, b.page, b.block FROM b JOIN p ON p.doc_id = b.doc_id AND p.page = b.page AND NOT (p.x1 < b.x0 - 1 OR p.x0 > b.x1 + 1 OR p.y1 < b.y0 - 1 OR p.y0 > b.y1 + 1)
          UNION SELECT a.doc_id, a.page, a.block FROM b a JOIN b o ON o.doc_id = a.doc_id AND o.page = a.page AND o.block <> a.block AND least(a.x1, o.x1) - greatest(a.x0, o.x0) > 2 AND least(a.y1, o.y1) - greatest(a.y0, o.y0) > 2),
        h AS (SELECT b.*, b.is_display AND fo.block IS NULL AS one FROM b LEFT JOIN fo ON fo.doc_id = b.doc_id AND fo.page = b.page AND fo.block = b.block),
        c AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id, page, block ORDER BY cy, ordinal) AS i FROM m),
        w AS (SELECT doc_id, page, block, ordinal, i, cy AS total, 1 AS n, 0 AS r FROM c WHERE i = 1
          UNION ALL SELECT c.doc_id, c.page, c.block, c.ordinal, c.i, CASE WHEN c.cy - w.total / w.n <= 3 THEN w.total + c.cy ELSE c.cy END, CASE WHEN c.cy - w.total / w.n <= 3 THEN w.n + 1 ELSE 1 END, CASE WHEN c.cy - w.total / w.n <= 3 THEN w.r ELSE w.r + 1 END FROM w JOIN c ON c.doc_id = w.doc_id AND c.page = w.page AND c.block = w.block AND c.i = w.i + 1),
        x AS (SELECT h.doc_id, h.page, h.block, CASE WHEN h.one THEN 0 ELSE w.r END AS r, count(*) AS n, min(m.x0) AS x0, min(m.y0) AS y0, max(m.x1) AS x1, max(m.y1) AS y1 FROM w JOIN m ON m.doc_id = w.doc_id AND m.ordinal = w.ordinal JOIN h ON h.doc_id = w.doc_id AND h.page = w.page AND h.block = w.block GROUP BY 1, 2, 3, 4),
        y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block ORDER BY r) AS i FROM x),
        z AS (SELECT doc_id, page, block, i, 0 AS segment, n, x0, y0, x1, y1 FROM y WHERE i = 1
          UNION ALL SELECT y.doc_id, y.page, y.block, y.i, CASE WHEN g THEN z.segment ELSE z.segment + 1 END, CASE WHEN g THEN z.n + y.n ELSE y.n END, CASE WHEN g THEN least(z.x0, y.x0) ELSE y.x0 END, CASE WHEN g THEN least(z.y0, y.y0) ELSE y.y0 END, CASE WHEN g THEN greatest(z.x1, y.x1) ELSE y.x1 END, CASE WHEN g THEN greatest(z.y1, y.y1) ELSE y.y1 END
          FROM z JOIN (SELECT * FROM y) y ON y.doc_id = z.doc_id AND y.page = z.page AND y.block = z.block AND y.i = z.i + 1, LATERAL (SELECT y.y0 < z.y1 AND y.y1 > z.y0 AND y.x0 - z.x1 < 15 AS g))
        SELECT doc_id, page, block, CAST(segment AS BIGINT) AS segment, arg_max(n, i) AS n_spans, arg_max(x0, i) AS x0, arg_max(y0, i) AS y0, arg_max(x1, i) AS x1, arg_max(y1, i) AS y1 FROM z GROUP BY 1, 2, 3, 4""",
}
