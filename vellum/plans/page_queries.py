"""Queries over paragraphs and quality checks of synthetic pages, and edits of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import edits
from vellum.operators import flow, layout, paragraphs, quality, synth
from vellum.functions import text as T
from vellum.plans.layout_queries import S
from vellum.plans.text_queries import PARAGRAPHS, _t

PAGE = ["doc_id", "page"]


def _spans(spark, sf_dir):
    return synth.spans(_t(spark, sf_dir, "documents"))


def _lines(spark, sf_dir):
    l = layout.lines(_spans(spark, sf_dir))
    return l.withColumn("column", F.when(F.col("x0") < 306, 0).otherwise(1)).withColumn("size", F.lit(10.0)).withColumn("bold", F.col("text").rlike("^[A-Z]"))


def merged_paragraphs(spark, sf_dir):
    p = paragraphs.merge_lines(_lines(spark, sf_dir))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("n_lines").cast("bigint").alias("lines"), F.count_if("heading").alias("headings"))


def logical_paragraphs(spark, sf_dir):
    p = paragraphs.logical_paragraphs(paragraphs.merge_lines(_lines(spark, sf_dir)))
    return p.groupBy("doc_id").agg(F.max("logical").cast("bigint").alias("logical"), F.count("*").alias("fragments"))


def page_continuations(spark, sf_dir):
    return paragraphs.crosses_page(paragraphs.merge_lines(_lines(spark, sf_dir))).select("doc_id", F.col("next_page").cast("bigint").alias("next_page"), "continues")


def column_flows(spark, sf_dir):
    l = _lines(spark, sf_dir)
    p = paragraphs.merge_lines(l).select("doc_id", F.col("page").cast("bigint").alias("page"), "column", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("y0").alias("anchor"), (F.col("y1") - F.col("y0")).alias("height"))
    o = _spans(spark, sf_dir).where("text rlike '[0-9]'").select("doc_id", F.col("page").cast("bigint").alias("page"), F.col("col").cast("int").alias("column"), (F.col("x0") * 0 + F.col("y0")).alias("top"), F.col("y1").alias("bottom"))
    f = flow.column_flow(p, o)
    return flow.overflow(f)


def density_by_column(spark, sf_dir):
    d = quality.column_density(_spans(spark, sf_dir))
    return d.select("doc_id", F.col("page").cast("bigint").alias("page"), F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), F.round("difference", 6).alias("difference"))


def residual_spans(spark, sf_dir):
    l = _lines(spark, sf_dir).withColumn("role", F.when(F.col("text").rlike("[0-9]"), "code").otherwise("body"))
    return quality.residual(l).groupBy("doc_id").agg(F.count("*").alias("residual"))


def benchmark_recall(spark, sf_dir):
    r = quality.script_recall(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"))
    return r.select("script", F.col("expected").cast("bigint").alias("expected"), F.col("matched").cast("bigint").alias("matched"), "recall", "passed")


def code_templates(spark, sf_dir):
    from vellum.operators import routing

    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy("source").agg(F.count_if(edits.template_markup(F.col("src")) != F.col("src")).alias("with_code"), F.count("*").alias("paragraphs"))


def split_halves(spark, sf_dir):
    p = _t(spark, sf_dir, "benchmark")
    s = p.select("item_id", "text", edits.split_fragments(F.col("text"), F.array(F.lit(1.0), F.lit(1.0))).alias("f"))
    return s.select("item_id", F.length(F.col("f")[0]).cast("bigint").alias("left"), F.length(F.col("f")[1]).cast("bigint").alias("right"), (F.concat(F.col("f")[0], F.col("f")[1]) == F.col("text")).alias("whole"))


def item_similarity(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    n = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before"))
    return b.join(n, "item_id").select("item_id", F.round(edits.similarity(F.col("text"), F.col("before")), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (merged_paragraphs, logical_paragraphs, page_continuations, column_flows, density_by_column, residual_spans, benchmark_recall, code_templates, split_halves, item_similarity)}

_CONNECTIVES = ", ".join(f"'{w}'" for w in T.CONNECTIVES)
_LINES = """g AS (
  SELECT *, CASE WHEN x0 - lag(x1) OVER w > 12 OR lag(x1) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM spans WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal)
), n AS (
  SELECT *, sum(f) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM g
), lines AS (
  SELECT doc_id, page, y0, segment, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1, min(ordinal) AS ordinal, CASE WHEN min(x0) < 306 THEN 0 ELSE 1 END AS side, string_agg(text, ' ' ORDER BY x0, ordinal) AS text FROM n GROUP BY 1, 2, 3, 4
)"""
_PARTS = """a1 AS (
  SELECT *, length(text) <= 90 AND regexp_matches(text, '^(?:[0-9]+|[A-Z])(?:\\.[0-9]+)*\\.?\\s+[A-Z]') AS own, regexp_matches(text, '^[A-Z]') AS bold, y0 - lag(y1) OVER (PARTITION BY doc_id, page, side ORDER BY y0, ordinal) AS gap, greatest(1.0, y1 - y0) AS h FROM lines
), a2 AS (
  SELECT *, sum(CASE WHEN coalesce(bold AND gap < 1.8 * h AND NOT own, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, side ORDER BY y0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM a1
), a3 AS (SELECT *, first_value(own) OVER (PARTITION BY doc_id, page, side, run ORDER BY y0, ordinal) AS heading FROM a2
), a4 AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1.6 * h OR heading <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, side ORDER BY y0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paragraph
  FROM (SELECT *, lag(heading) OVER (PARTITION BY doc_id, page, side ORDER BY y0, ordinal) AS before FROM a3)
), parts AS (
  SELECT doc_id, page, side, paragraph, any_value(heading) AS heading, count(*) AS n_lines, min(y0) AS y0, max(y1) AS y1, min(ordinal) AS ordinal, arg_min(text, (y0, ordinal)) AS head, arg_max(text, (y0, ordinal)) AS tail FROM a4 GROUP BY 1, 2, 3, 4
)"""
_GOES = "NOT regexp_matches(trim({a}), '[.!?:;。！？]$') AND regexp_matches(trim({b}), '^[a-zà-ÿ(]')"
_TURNS = f"""lasts AS (SELECT doc_id, page, arg_max(tail, (side, y1, ordinal)) AS tail, arg_max(y1, (side, y1, ordinal)) AS y1 FROM parts GROUP BY 1, 2
), firsts AS (SELECT doc_id, page, arg_min(head, (side, y0, ordinal)) AS head, arg_min(y0, (side, y0, ordinal)) AS y0, arg_min(ordinal, (side, y0, ordinal)) AS ordinal FROM parts GROUP BY 1, 2
), turns AS (
  SELECT f.doc_id, f.page AS next_page, f.ordinal, {_GOES.format(a="l.tail", b="f.head")} AND l.y1 >= 682 AND f.y0 <= 165 AS continues FROM lasts l JOIN firsts f ON f.doc_id = l.doc_id AND f.page = l.page + 1
)"""
_ACROSS = f"""lefts AS (SELECT doc_id, page, arg_max(tail, (y1, ordinal)) AS tail, max(y1) AS y1, arg_max(heading, (y1, ordinal)) AS heading FROM parts WHERE side = 0 GROUP BY 1, 2
), rights AS (SELECT doc_id, page, arg_min(head, (y0, ordinal)) AS head, min(y0) AS y0, arg_min(heading, (y0, ordinal)) AS heading, arg_min(ordinal, (y0, ordinal)) AS ordinal FROM parts WHERE side = 1 GROUP BY 1, 2
), links AS (
  SELECT doc_id, ordinal FROM turns WHERE continues UNION
  SELECT r.doc_id, r.ordinal FROM lefts l JOIN rights r ON l.doc_id = r.doc_id AND l.page = r.page WHERE {_GOES.format(a="l.tail", b="r.head")} AND l.y1 >= 672 AND r.y0 <= 180 AND NOT l.heading AND NOT r.heading
)"""

ORACLE_SQL = {
    "merged_paragraphs": f"WITH {S}, {_LINES}, {_PARTS} SELECT doc_id, count(*) AS paragraphs, CAST(sum(n_lines) AS BIGINT) AS lines, count(*) FILTER (WHERE heading) AS headings FROM parts GROUP BY 1",
    "page_continuations": f"WITH {S}, {_LINES}, {_PARTS}, {_TURNS} SELECT doc_id, next_page, continues FROM turns",
    "logical_paragraphs": f"""WITH {S}, {_LINES}, {_PARTS}, {_TURNS}, {_ACROSS} SELECT p.doc_id, 1 + count(*) - count(k.ordinal) - CAST(count(*) FILTER (WHERE k.ordinal IS NULL AND p.ordinal = f.ordinal) AS BIGINT) AS logical, count(*) AS fragments
        FROM parts p LEFT JOIN links k ON k.doc_id = p.doc_id AND k.ordinal = p.ordinal LEFT JOIN (SELECT doc_id, arg_min(ordinal, (page, side, y0, ordinal)) AS ordinal FROM parts GROUP BY 1) f ON f.doc_id = p.doc_id GROUP BY 1""",
    "residual_spans": f"""WITH {S}, {_LINES} SELECT doc_id, count(*) AS residual FROM lines WHERE NOT regexp_matches(text, '{T.CJK}') AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '^(?:[A-Z][\\w.-]*\\s*)+$')
        AND (len(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9_\\s''’.-]', ' ', 'g')), '\\s+'), lambda w: w IN ({_CONNECTIVES}))) > 0 OR regexp_matches(text, '[A-Za-z]{{20,}}|(?:[A-Za-z]+\\s+){{3}}[A-Za-z]')) GROUP BY 1""",
    "code_templates": f"WITH {PARAGRAPHS} SELECT source, count(*) FILTER (WHERE regexp_matches(src, '\\b[A-Za-z_][A-Za-z0-9_.]*\\s*=\\s*(?:\\[[^\\]]*\\]|[A-Za-z0-9_.+-]+)')) AS with_code, count(*) AS paragraphs FROM paragraphs GROUP BY 1",
    "density_by_column": f"WITH {S}, c AS (SELECT doc_id, page, col, CASE WHEN max(y1) > min(y0) THEN 100.0::DOUBLE * sum(length(text)) / (max(y1) - min(y0)) END AS d FROM spans GROUP BY 1, 2, 3), p AS (SELECT doc_id, page, max(d) FILTER (WHERE col = 0) AS l, max(d) FILTER (WHERE col = 1) AS r FROM c GROUP BY 1, 2) SELECT doc_id, page, round(l, 6) AS \"left\", round(r, 6) AS \"right\", round(abs(l - r), 6) AS difference FROM p",
    "benchmark_recall": """WITH e AS (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S')) AS c FROM benchmark) GROUP BY 1), f AS (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\S')) AS c FROM documents) GROUP BY 1),
        j AS (SELECT CASE WHEN regexp_matches(e.c, '[一-鿿㐀-䶿]') THEN 'cjk' WHEN regexp_matches(e.c, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(e.c, '[0-9]') THEN 'number' ELSE 'other' END AS script, e.n, least(e.n, coalesce(f.n, 0)) AS m FROM e LEFT JOIN f ON e.c = f.c)
        SELECT script, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(m) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS recall, CAST(sum(m) AS DOUBLE) / CAST(sum(n) AS DOUBLE) >= 0.99 AS passed FROM j GROUP BY 1""",
}
