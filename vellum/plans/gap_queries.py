"""Queries over gaps of scripts: characters of words on synthetic pages, vowels standing for East Asian ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import gaps, synth
from vellum.plans.text_queries import _t

PAGE = ["doc_id", "page"]


def _spans(spark, sf_dir):
    s = synth.spans(_t(spark, sf_dir, "documents"))
    return s.withColumns({"ordinal": F.col("ordinal").cast("bigint"), "row": F.col("col") * 100 + F.col("line"), "text": F.translate("text", "aeiou", "一二三四五")})


def _chars(s):
    """A character is 4 points wide and 5 from the next, but 5 wide at odd places of every third word; every other word has a blank behind."""
    cs = F.when(F.col("ordinal") % 2 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    c = s.select(*PAGE, F.col("row").alias("paragraph"), F.col("row").alias("line"), F.col("ordinal").alias("span"), "x0", "y0", "y1", F.posexplode(F.filter(F.split(cs, ""), lambda x: x != "")).alias("i", "c"))
    x0 = F.col("x0") + 5 * F.col("i")
    wide = F.when((F.col("span") % 3 == 0) & (F.col("i") % 2 == 1), 5).otherwise(4)
    return c.select(*PAGE, "paragraph", "line", "span", "c", (F.col("span") * 1000 + F.col("i")).alias("place"), x0.alias("x0"), "y0", (x0 + wide).alias("x1"), "y1")


def script_gaps(spark, sf_dir):
    s = _spans(spark, sf_dir)
    words = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda w: w["text"])
    p = s.groupBy(*PAGE, F.col("row").alias("paragraph")).agg(F.when(F.first("line") % 2 == 0, F.array_join(words, " ")).otherwise(F.array_join(words, "")).alias("translation"), F.when(F.first("line") % 5 == 0, F.concat(F.lit("<code class='code-run'>"), F.array_join(words, ""), F.lit("</code>"))).alias("context"))
    g = gaps.script_gaps(_chars(s), p)
    return g.groupBy("doc_id", "gap_class", "cause").agg(F.count("*").alias("n"), F.sum("gap").alias("width"))


def formula_gaps(spark, sf_dir):
    """Words of every eleventh place stand for formulas, which characters don't."""
    s = _spans(spark, sf_dir)
    formula = F.col("ordinal") % 11 == 5
    f = s.where(formula).select(*PAGE, F.col("ordinal").alias("formula_id"), (F.col("x0") + 0.5).alias("x0"), "y0", "x1", "y1")
    return gaps.around_formulas(f, _chars(s.where(~formula)))


QUERIES = {f.__name__: f for f in (script_gaps, formula_gaps)}

_CHARS = f"""{synth.SPANS_SQL}, ws AS (SELECT doc_id, page, col * 100 + line AS line, ordinal, translate(text, 'aeiou', '一二三四五') AS text, x0, y0, y1, x1, line % 2 AS odd, line % 5 AS fifth FROM spans
), cs AS (SELECT *, unnest(string_split(CASE WHEN ordinal % 2 = 0 THEN text || ' ' ELSE text END, '')) AS c, generate_subscripts(string_split(CASE WHEN ordinal % 2 = 0 THEN text || ' ' ELSE text END, ''), 1) - 1 AS i FROM ws
), chars AS (SELECT doc_id, page, line, ordinal AS span, c, ordinal * 1000 + i AS place, x0 + 5 * i AS x0, y0, x0 + 5 * i + CASE WHEN ordinal % 3 = 0 AND i % 2 = 1 THEN 5 ELSE 4 END AS x1, y1 FROM cs
), seen AS (
  SELECT *, lead(c) OVER w AS r, lead(x0) OVER w AS rx0, lead(span) OVER w AS rspan FROM chars WHERE trim(c) <> '' WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x0, y0, place)
)"""
_KIND = lambda c: f"CASE WHEN regexp_matches({c}, '{T.CJK}') THEN 'CJK' WHEN regexp_matches({c}, '[A-Za-z]') THEN 'Latin' WHEN regexp_matches({c}, '[0-9]') THEN 'number' END"
ORACLE_SQL = {
    "script_gaps": f"""WITH {_CHARS}, t AS (SELECT doc_id, page, line, CASE WHEN any_value(odd) = 0 THEN string_agg(text, ' ' ORDER BY ordinal) ELSE string_agg(text, '' ORDER BY ordinal) END AS t, CASE WHEN any_value(fifth) = 0 THEN string_agg(text, '' ORDER BY ordinal) END AS code FROM ws GROUP BY 1, 2, 3),
        k AS (SELECT *, {_KIND("c")} AS a, {_KIND("r")} AS b FROM seen WHERE r IS NOT NULL), g AS (SELECT *, CASE WHEN a || b IN ('CJKLatin', 'LatinCJK', 'CJKnumber', 'numberCJK') THEN a || '-' || b WHEN (a = 'CJK' AND r IN ('%', '％')) OR (c IN ('%', '％') AND b = 'CJK') THEN 'CJK-percent' END AS gap_class FROM k),
        q AS (SELECT g.*, EXISTS (SELECT 1 FROM chars s WHERE s.doc_id = g.doc_id AND s.page = g.page AND s.line = g.line AND s.c = ' ' AND s.x0 >= g.x1 - 0.2 AND s.x1 <= g.rx0 + 0.2) AS parted, t.t, t.code FROM g JOIN t ON t.doc_id = g.doc_id AND t.page = g.page AND t.line = g.line WHERE gap_class IS NOT NULL)
        SELECT doc_id, gap_class, CASE WHEN parted OR contains(t, c || ' ' || r) THEN 'translation_literal_space' WHEN code IS NOT NULL AND contains(code, c || r) THEN 'protected_span_boundary' WHEN span <> rspan THEN 'pdf_span_boundary' ELSE 'shaping_sidebearing' END AS cause, count(*) AS n, CAST(sum(rx0 - x1) AS DOUBLE) AS width FROM q GROUP BY 1, 2, 3""",
    "formula_gaps": f"""WITH {_CHARS}, f AS (SELECT doc_id, page, ordinal AS formula_id, x0 + 0.5 AS x0, y0, x1, y1 FROM ws WHERE ordinal % 11 = 5), v AS (SELECT * FROM seen WHERE span % 11 <> 5),
        b AS (SELECT f.doc_id, f.formula_id, arg_max(v.x1, (v.x1, -v.place)) AS x FROM f JOIN v ON v.doc_id = f.doc_id AND v.page = f.page AND v.y0 < f.y1 AND v.y1 > f.y0 AND v.x1 <= f.x0 + 0.5 GROUP BY 1, 2),
        a AS (SELECT f.doc_id, f.formula_id, arg_min(v.x0, (v.x0, v.place)) AS x, arg_min(v.c, (v.x0, v.place)) AS c FROM f JOIN v ON v.doc_id = f.doc_id AND v.page = f.page AND v.y0 < f.y1 AND v.y1 > f.y0 AND v.x0 >= f.x1 - 0.5 GROUP BY 1, 2)
        SELECT f.doc_id, f.page, f.formula_id, f.x0 - b.x AS left_gap, a.x - f.x1 AS right_gap, coalesce(regexp_matches(a.c, '[，。、；：！？,.;:!?)）]'), false) AS mark_follows FROM f LEFT JOIN b ON b.doc_id = f.doc_id AND b.formula_id = f.formula_id LEFT JOIN a ON a.doc_id = f.doc_id AND a.formula_id = f.formula_id""",
}
