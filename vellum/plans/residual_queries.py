"""Queries over residue of the source language. Lines of documents stand for paragraphs; what was rendered of one is its first
eight words, in its place, moved to the right, or off the page, by the line's number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import residual, rounds, synth
from vellum.plans.text_queries import _t


def _rendered(spark, sf_dir):
    """(spans, regions) as ``residual.spans_to_regions`` takes them."""
    r = rounds.cut(synth.regions(_t(spark, sf_dir, "documents")).withColumn("region", F.col("region").cast("bigint")))
    box = ("x0", "y0", "x1", "y1")
    formula = F.col("kind").isin("formula", "display_formula")
    regions = r.where((F.col("kind") == "text") | formula).select("doc_id", "page", "region", F.when(formula, "formula").otherwise("text").alias("kind"), F.when(formula, "formula").otherwise(F.col("role")).alias("role"), F.concat(F.when(formula, "f").otherwise("p"), F.col("region").cast("string")).alias("owner"), F.col("text").alias("source"), *box)
    words = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    turn = F.col("region") % 3
    right, down = F.when(turn == 1, 150.0).otherwise(0.0), F.when(turn == 2, 5000.0).otherwise(0.0)
    spans = r.select("doc_id", "page", F.col("region").alias("span_id"), F.when(F.col("region") % 2 == 1, F.translate(words, "aeiou", "AEIOU")).otherwise(words).alias("text"), (F.col("x0") + right).alias("x0"), (F.col("y0") + down).alias("y0"), (F.col("x1") + right).alias("x1"), (F.col("y1") + down).alias("y1"))
    return spans, regions


def rendered_regions(spark, sf_dir):
    return residual.spans_to_regions(*_rendered(spark, sf_dir)).select("doc_id", "page", "span_id", "role", "owner", "by_content")


def _pairs(spark, sf_dir):
    """Each line with the next of its document."""
    r = synth.regions(_t(spark, sf_dir, "documents"))
    return r.select("doc_id", F.col("region").cast("bigint").alias("region"), "text", F.lead("text").over(Window.partitionBy("doc_id").orderBy("region")).alias("rendered"))


def surviving_words(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    # a generated row, since a filter on the words would have them made a second time
    kept = p.select("doc_id", "region", F.explode(F.filter(F.array(residual.surviving_words(F.col("text"), F.col("rendered"))), lambda w: F.array_join(w, " ") != "")).alias("w"))
    return kept.select("doc_id", "region", F.array_join("w", " ").alias("words"), F.array_join(residual.without_joining(F.col("w")), " ").alias("page_words"))


def residual_details(spark, sf_dir):
    p = synth.regions(_t(spark, sf_dir, "documents")).select("doc_id", F.explode(residual.details(F.col("text"))).alias("d"))
    return p.groupBy("doc_id", F.col("d.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("d.text")).cast("bigint").alias("chars"))


QUERIES = {f.__name__: f for f in (rendered_regions, surviving_words, residual_details)}

_Q = lambda s: s.replace("'", "''")
_LAST = (r"[0-9]+[.,]?[0-9]*", r"[^\p{L}\p{N}_\s'’.-]")


def _clean(column: str, *patterns: str) -> str:
    out = f"coalesce({column}, '')"
    for p in (*patterns, *_LAST):
        out = f"regexp_replace({out}, '{_Q(p)}', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_SOURCE = _clean("text", residual.MODEL_NAMES, residual.PROTECTED_NAMES, residual.ADDRESSES, T.PLACEHOLDER, residual.CITATION_GROUP, residual.YEAR_LIST)
_STOP = ", ".join(f"'{w}'" for w in residual.STOPWORDS)
_RENDERED = f"""{synth.REGIONS_SQL}, s AS (
  SELECT doc_id, page, region AS span_id, CASE WHEN region % 2 = 1 THEN translate(array_to_string(string_split(text, ' ')[1:8], ' '), 'aeiou', 'AEIOU') ELSE array_to_string(string_split(text, ' ')[1:8], ' ') END AS text,
         x0 + CASE WHEN region % 3 = 1 THEN 150 ELSE 0 END AS x0, y0 + CASE WHEN region % 3 = 2 THEN 5000 ELSE 0 END AS y0, x0 + width + CASE WHEN region % 3 = 1 THEN 150 ELSE 0 END AS x1, y0 + 60 + CASE WHEN region % 3 = 2 THEN 5000 ELSE 0 END AS y1 FROM regions
), r AS (
  SELECT doc_id, page, region, CASE WHEN kind = 'text' THEN role ELSE 'formula' END AS role, CASE WHEN kind = 'text' THEN 'p' ELSE 'f' END || region AS owner, x0, y0, x0 + width AS x1, y0 + 60 AS y1,
         CASE WHEN kind = 'text' THEN lower(array_to_string(regexp_extract_all(regexp_replace(text, '{T.PLACEHOLDER}', '', 'g'), '{_Q(residual.WORD)}')[1:12], ' ')) END AS prefix
  FROM regions WHERE kind IN ('text', 'formula', 'display_formula')
), o AS (
  SELECT s.*, r.role, r.owner, r.prefix, row_number() OVER (PARTITION BY s.doc_id, s.page, s.span_id ORDER BY (least(s.x1, r.x1) - greatest(s.x0, r.x0)) * (least(s.y1, r.y1) - greatest(s.y0, r.y0)) DESC, r.region) AS n
  FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND s.page = r.page AND s.x0 < r.x1 AND r.x0 < s.x1 AND s.y0 < r.y1 AND r.y0 < s.y1
), p AS (
  SELECT *, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z''’.\\- ]', '', 'g'), ' '), lambda w: length(w) >= 3)[1:6], ' ') AS probe FROM o WHERE n = 1
), c AS (
  SELECT p.doc_id, p.page, p.span_id, min_by(r.owner, r.region) AS owner FROM p JOIN r ON p.doc_id = r.doc_id AND p.page = r.page AND r.prefix <> '' AND length(p.probe) >= 12 AND contains(r.prefix, p.probe) WHERE coalesce(p.prefix, '') = '' GROUP BY 1, 2, 3
)"""

# residual_details has no SQL: its word boundaries go by letters of all alphabets, which DuckDB's don't; plain Python is its test.
ORACLE_SQL = {
    "rendered_regions": f"WITH {_RENDERED} SELECT p.doc_id, p.page, p.span_id, coalesce(p.role, 'unmapped') AS role, coalesce(c.owner, p.owner) AS owner, c.owner IS NOT NULL AS by_content FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.page = c.page AND p.span_id = c.span_id",
    "surviving_words": rf"""WITH {synth.REGIONS_SQL}, n AS (SELECT doc_id, region, text, lead(text) OVER (PARTITION BY doc_id ORDER BY region) AS rendered FROM regions),
        w AS (SELECT doc_id, region, lower(array_to_string(list_filter(regexp_split_to_array(coalesce(rendered, ''), '{T.CJK}+'), lambda r: length(trim(r, chr(9) || chr(10) || chr(13) || ' 。，：；、！？（）()"''‘’“”·•∙▪●')) >= 2), ' ')) AS low,
              list_sort(list_distinct(list_filter(regexp_split_to_array({_SOURCE}, '\s+'), lambda w: regexp_full_match(w, '[A-Za-z''’.-]{{2,}}')))) AS ws FROM n),
        k AS (SELECT doc_id, region, list_filter(ws, lambda w: regexp_matches(low, '(^|[^a-z0-9+])' || regexp_escape(w) || '($|[^a-z0-9+])')) AS ws FROM w)
        SELECT doc_id, region, array_to_string(ws, ' ') AS words, array_to_string(list_filter(ws, lambda w: lower(w) NOT IN ({_STOP})), ' ') AS page_words FROM k WHERE len(ws) > 0""",
}
