"""Queries in Spark SQL over the registered functions."""

from __future__ import annotations

from vellum import sql
from vellum.operators import routing
from vellum.plans.text_queries import PARAGRAPHS, _t


def sql_clusters(spark, sf_dir):
    """Prices of an order's lines in clusters of 5,000."""
    sql.register(spark)
    return spark.sql(
        "SELECT l_orderkey, l_linenumber, CAST(cluster AS BIGINT) AS cluster FROM cluster_values(TABLE(SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lines}) PARTITION BY l_orderkey ORDER BY (l_extendedprice, l_linenumber), 'l_extendedprice', 5000.0D)",
        lines=_t(spark, sf_dir, "lineitem"),
    )


def sql_templates(spark, sf_dir):
    """What a text is after its mathematics was taken out and put back: itself."""
    sql.register(spark)
    p = routing.paragraphs(_t(spark, sf_dir, "documents")).select("source", "src")
    return spark.sql("SELECT source, count_if(restore_template(template, mapping) = src) AS restored, count(*) AS paragraphs, sum(length(normal_form(src))) AS chars FROM protected_templates(TABLE({p}), 'src') GROUP BY source", p=p)


QUERIES = {f.__name__: f for f in (sql_clusters, sql_templates)}

ORACLE_SQL = {
    "sql_clusters": """WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS i FROM lineitem),
        w AS (SELECT l_orderkey, l_linenumber, i, v AS total, 1 AS n, 0 AS cluster FROM o WHERE i = 1
          UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.i, CASE WHEN o.v - w.total / w.n <= 5000 THEN w.total + o.v ELSE o.v END, CASE WHEN o.v - w.total / w.n <= 5000 THEN w.n + 1 ELSE 1 END, CASE WHEN o.v - w.total / w.n <= 5000 THEN w.cluster ELSE w.cluster + 1 END FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.i = w.i + 1)
        SELECT l_orderkey, l_linenumber, CAST(cluster AS BIGINT) AS cluster FROM w""",
    "sql_templates": rf"WITH {PARAGRAPHS} SELECT source, count(*) AS restored, count(*) AS paragraphs, CAST(sum(length(lower(regexp_replace(src, '\s+', '', 'g')))) AS BIGINT) AS chars FROM paragraphs GROUP BY 1",
}
