"""Queries over evidence: gaps and sizes of lines on synthetic pages, by document and rolled up by source from the stored states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import evidence, layout, rounds, synth
from vellum.plans.text_queries import _t


def _values(spark, sf_dir):
    """(source, doc_id, page, metric, value): lines' widths, words a line, the gap to the line above."""
    docs = _t(spark, sf_dir, "documents")
    l = layout.lines(synth.spans(docs))
    above = F.col("y0") - F.lag("y1").over(Window.partitionBy("doc_id", "page", F.col("x0") < 306).orderBy("y0", "ordinal"))
    each = l.withColumn("gap", above).select("doc_id", F.col("page").cast("bigint").alias("page"), F.explode(F.create_map(F.lit("width"), F.col("x1") - F.col("x0"), F.lit("words"), F.col("n_spans").cast("double"), F.lit("gap"), F.col("gap"))).alias("metric", "value"))
    return each.join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")


def document_evidence(spark, sf_dir):
    """Samples, pages and extremes are exact; so are quantiles of groups with fewer than 200 samples."""
    held = evidence.states(_values(spark, sf_dir), ["source", "doc_id"])
    t = evidence.tokens(held, ["source", "doc_id"])
    few = F.col("samples") < evidence.K
    return t.select("doc_id", "metric", "samples", "pages", *(F.when(few, F.col(q)).alias(q) for q in ("p10", "value", "p90")))


def source_evidence(spark, sf_dir):
    """From the documents' states, which are stored first: sketches are not made of the rows again."""
    held = rounds.cut(evidence.states(_values(spark, sf_dir), ["source", "doc_id"]))
    return evidence.tokens(evidence.merged(held, ["source"]), ["source"])


def evidence_counts(spark, sf_dir):
    held = evidence.states(_values(spark, sf_dir), ["source", "doc_id"])
    return evidence.merged(held, ["source"]).select("source", "metric", "samples", "pages", "first_page", "last_page", "parts")


QUERIES = {f.__name__: f for f in (document_evidence, source_evidence, evidence_counts)}

_VALUES = f"""{synth.SPANS_SQL}, g AS (
  SELECT *, CASE WHEN x0 - lag(x1) OVER w > 12 OR lag(x1) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM spans WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal)
), n AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM g
), l AS (SELECT doc_id, page, y0, segment, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1, min(ordinal) AS ordinal, count(*) AS n FROM n GROUP BY 1, 2, 3, 4
), m AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page, x0 < 306 ORDER BY y0, ordinal) AS gap FROM l
), v AS (
  SELECT doc_id, page, 'width' AS metric, x1 - x0 AS value FROM m UNION ALL SELECT doc_id, page, 'words', CAST(n AS DOUBLE) FROM m UNION ALL SELECT doc_id, page, 'gap', gap FROM m WHERE gap IS NOT NULL
)"""
# a quantile of q of n values is the value at place ceil(q * n) in their order
_AT = lambda q: f"CASE WHEN count(*) < 200 THEN list_sort(list(value))[CAST(greatest(1, ceil({q} * count(*))) AS BIGINT)] END"
ORACLE_SQL = {
    "document_evidence": f"WITH {_VALUES} SELECT doc_id, metric, count(*) AS samples, count(DISTINCT page) AS pages, {_AT('0.1::DOUBLE')} AS p10, {_AT('0.5::DOUBLE')} AS value, {_AT('0.9::DOUBLE')} AS p90 FROM v GROUP BY 1, 2",
    "evidence_counts": f"""WITH {_VALUES}, d AS (SELECT coalesce(source, '') AS source, v.doc_id, metric, count(*) AS n, count(DISTINCT page) AS pages, min(page) AS a, max(page) AS z FROM v JOIN documents USING (doc_id) GROUP BY 1, 2, 3)
        SELECT source, metric, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(pages) AS BIGINT) AS pages, min(a) AS first_page, max(z) AS last_page, count(*) AS parts FROM d GROUP BY 1, 2""",
}
