"""Queries over numbers, intervals and ordered events: robust statistics, interval algebra, as-of lookups, gates, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import gate, joins, ownership, sequence, stats, tables
from vellum.plans.text_queries import _long, _t


def summary_stats(spark, sf_dir):
    return stats.summary(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def upper_medians(spark, sf_dir):
    return stats.upper_median(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


def trimmed_prices(spark, sf_dir):
    t = stats.trimmed(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"])
    return t.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


def first_modes(spark, sf_dir):
    return stats.first_mode(_t(spark, sf_dir, "lineitem").withColumn("p", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["l_returnflag"], "l_quantity", "p")


def price_outliers(spark, sf_dir):
    o = stats.outliers(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.8, 1000.0)
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice")


def robust_profile(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return stats.robust_profile(p, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])


def _intervals(spark, sf_dir):
    """Each event covers as many seconds from its time as its value says, whole seconds."""
    e = _t(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", start.cast("bigint").alias("lo"), (start + F.floor(F.abs("value"))).cast("bigint").alias("hi"))


def merged_intervals(spark, sf_dir):
    return sequence.merge_intervals(_intervals(spark, sf_dir), ["user_id"], "lo", "hi").select("user_id", "lo", "hi", "n_merged")


def free_intervals(spark, sf_dir):
    i = _intervals(spark, sf_dir)
    frames = i.groupBy("user_id").agg(F.min("lo").alias("frame_lo"), F.max("hi").alias("frame_hi"))
    return sequence.complement(sequence.merge_intervals(i, ["user_id"], "lo", "hi"), frames, ["user_id"], "lo", "hi", 12)


def voids(spark, sf_dir):
    from vellum.operators import layout

    return layout.voids(_intervals(spark, sf_dir), ["user_id"], "lo", "hi", 96)


def activity_islands(spark, sf_dir):
    i = _intervals(spark, sf_dir)
    gap = F.expr("lo - lag(lo) over (partition by user_id order by lo, event_id) > 3600")
    runs = sequence.gap_islands(i, ["user_id"], ["lo", "event_id"], gap)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("lo").alias("hi"))


def median_gaps(spark, sf_dir):
    i = _intervals(spark, sf_dir).withColumn("at", F.col("lo").cast("double"))
    return sequence.median_gap(i, ["user_id"], ["lo", "event_id"], "at", "at", 2, 100000, (3.0, 50000.0), 8.0)


def asof_events(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value")
    last = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    out = joins.asof(e.select("user_id", "event_id", "t"), last, ["user_id"], "t", "t", ["value"])
    return out.select("user_id", "event_id", F.coalesce("asof_t", F.lit(-1)).cast("bigint").alias("asof_t"), "asof_value")


def interval_differences(spark, sf_dir):
    i = sequence.merge_intervals(_intervals(spark, sf_dir), ["user_id"], "lo", "hi").select("user_id", "lo", "hi")
    own = _intervals(spark, sf_dir).select("user_id", "lo", "hi").distinct()
    return joins.tolerance_match(i, own, ["user_id"], "lo", "hi", 2)


STAGES = ("language", "quality", "toxicity")


def _executions(spark, sf_dir):
    d, l = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    lang = d.select("doc_id", F.lit("language").alias("stage"), F.when(F.col("lang") == "en", "pass").otherwise("fail").alias("status"))
    return lang.union(l.select("doc_id", F.lit("quality"), F.when(F.col("quality") == 1, "pass").otherwise("fail"))).union(l.select("doc_id", F.lit("toxicity"), F.when(F.col("toxic") == 0, "pass").otherwise("error")))


def _manifest(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return gate.manifest(_executions(spark, sf_dir), d, STAGES, ["doc_id"]).join(d.select("doc_id", "source"), "doc_id")


def integrity_gate(spark, sf_dir):
    out = gate.integrity(_manifest(spark, sf_dir), ["source"], ["doc_id"])
    return _long(out.select("source", *(F.col(f"n_{s}").cast("bigint").alias(f"n_{s}") for s in ("pass", "fail", "error", "not_run", "missing")), F.col("required").cast("bigint").alias("required"), "complete_pages", "pages", "coverage", "integrity"))


def gate_layers(spark, sf_dir):
    return gate.layers(_manifest(spark, sf_dir), ["source"], ["quality"])


def gate_decision(spark, sf_dir):
    return gate.decide(gate.layers(_manifest(spark, sf_dir), ["source"], ["quality"]), ["source"])


def manifest_counts(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("stage").pivot("status", ["pass", "fail", "error", "missing"]).count().na.fill(0)


def defect_ranking(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") >= 0.1).alias("deep_discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") >= 49).alias("bulk"))
    return gate.weighted_defects(o, {"deep_discount": 23, "returned": 30, "bulk": 50}, ["l_orderkey"]).select("l_orderkey", F.col("score").cast("bigint").alias("score"), "defects")


def complexity_ranking(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("formulas"), F.sum("l_linenumber").alias("cells"), F.countDistinct("l_suppkey").alias("figures"), F.countDistinct("l_returnflag").alias("level"),
        F.lit(0).alias("class_weight"), F.count_if(F.col("l_tax") > 0.04).alias("full_width"), F.count("*").alias("references"),
    )
    return gate.complexity(o, ["l_orderkey"]).select("l_orderkey", F.col("score").cast("bigint").alias("score"))


def failure_taxonomy(spark, sf_dir):
    o = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.filter(F.array(F.when(F.col("l_discount") >= 0.08, F.lit("discount")), F.when(F.col("l_tax") >= 0.06, F.lit("tax")), F.when(F.col("l_quantity") >= 45, F.lit("quantity"))), lambda x: x.isNotNull()).alias("defects"))
    return gate.taxonomy(o, ["l_returnflag"])


def owner_resolution(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", ownership.score(F.col("l_quantity") > 25, F.col("l_extendedprice"), F.col("l_tax"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p"))
    return ownership.resolve(l, ["l_partkey"], "score", "p").select("l_partkey", "l_suppkey", "p", F.round("score", 6).alias("score"))


def owner_priority(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "formula").otherwise("text")
    return ownership.by_priority(_t(spark, sf_dir, "lineitem").select("l_partkey", kind.alias("owner_type"), F.col("l_suppkey").alias("owner_id")), ["l_partkey"])


def owner_ledger(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.lit("all").alias("g"))
    claims = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.lit("order").alias("owner_type"), F.col("l_suppkey").alias("owner_id"))
    return ownership.ledger(parts, claims, ["part"], ["g"])


def placement_cardinality(spark, sf_dir):
    expected = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).cast("bigint").alias("expected_count"))
    out = ownership.cardinality(expected, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return out.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("actual_count").cast("bigint").alias("placements"))


def fragment_reuse(spark, sf_dir):
    return ownership.reuse(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def subset_blocks(spark, sf_dir):
    """Orders whose set of suppliers is part of another's that shares their customer."""
    b = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("items"))
    return ownership.drop_subsets(b, ["o_custkey"], "l_orderkey", "items").select("o_custkey", "l_orderkey")


TABLE_LINES = 100_000


def _table_texts(spark, sf_dir):
    """Each order as a table: a row a line, four columns of figures 100 points apart, in whole points. Lines are dealt by order into
    parts of about ``TABLE_LINES``, since they grow to some hundred times as many bytes in a task's sorts."""
    l = _t(spark, sf_dir, "lineitem")
    l = l.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-l.count() // TABLE_LINES)), "l_orderkey").withColumn("l_linenumber", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"))
    cols = F.array(*(F.struct(F.lit(i).alias("c"), F.format_string("%d", v.cast("bigint")).alias("text")) for i, v in enumerate((F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.round(F.col("l_extendedprice"))))))
    t = l.select("l_orderkey", "l_linenumber", F.explode(cols).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    return t.select("l_orderkey", (F.col("l_linenumber") * 10 + F.col("c")).cast("bigint").alias("ordinal"), "text", (72 + 100.0 * F.col("c")).alias("x0"), (72 + 12.0 * F.col("l_linenumber")).alias("y0"), (72 + 100.0 * F.col("c") + 5 * F.length("text")).alias("x1"), (82 + 12.0 * F.col("l_linenumber")).alias("y1"))


def table_cells(spark, sf_dir):
    c = tables.cells(_table_texts(spark, sf_dir), ["l_orderkey"])
    return c.select("l_orderkey", F.col("row").cast("bigint").alias("row"), F.col("column").cast("bigint").alias("column"), "text")


def table_alignment(spark, sf_dir):
    a = tables.alignment(tables.cells(_table_texts(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])
    return a.groupBy("column", "alignment").agg(F.count("*").alias("n")).select(F.col("column").cast("bigint").alias("column"), "alignment", "n")


def table_quality(spark, sf_dir):
    t = _table_texts(spark, sf_dir)
    n = t.groupBy("l_orderkey").agg(F.count("*").alias("n_texts"))
    return tables.quality(tables.cells(t, ["l_orderkey"]), ["l_orderkey"], n).select("l_orderkey", F.col("assigned").cast("bigint").alias("assigned"), "n_texts", "column_variance", "row_variance", "coverage", F.round("confidence", 9).alias("confidence"))


def table_html(spark, sf_dir):
    return tables.to_html(tables.cells(_table_texts(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"]).select("l_orderkey", F.sha2("html", 256).alias("html_sha256"))


def table_types(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("n_texts"), F.count_if(F.col("l_returnflag") == "R").alias("n_h"), F.count_if(F.col("l_returnflag") == "A").alias("n_v"), (F.max("l_tax") >= 0.08).alias("has_image"))
    return tables.table_type(t).groupBy("table_type").agg(F.count("*").alias("n"))


def rule_roles(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("y0"), F.col("l_partkey").cast("double").alias("x0"))
    return tables.rule_roles(r, ["l_orderkey"]).groupBy("role").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (summary_stats, upper_medians, trimmed_prices, first_modes, price_outliers, robust_profile, merged_intervals, free_intervals, voids, activity_islands, median_gaps, asof_events, interval_differences, integrity_gate, gate_layers, gate_decision, manifest_counts, defect_ranking, complexity_ranking, failure_taxonomy, owner_resolution, owner_priority, owner_ledger, placement_cardinality, fragment_reuse, subset_blocks, table_cells, table_alignment, table_quality, table_html, table_types, rule_roles)}

_INTERVALS = """iv AS (
  SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) + floor(abs(value)) AS BIGINT) AS hi FROM events
), reach AS (
  SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv
), islands AS (
  SELECT *, sum(CASE WHEN r IS NULL OR lo > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reach
), merged AS (
  SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n_merged FROM islands GROUP BY user_id, island
)"""
_MANIFEST = """ex AS (
  SELECT doc_id, 'language' AS stage, CASE WHEN lang = 'en' THEN 'pass' ELSE 'fail' END AS status FROM documents
  UNION ALL SELECT doc_id, 'quality', CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END FROM labels
  UNION ALL SELECT doc_id, 'toxicity', CASE WHEN toxic = 0 THEN 'pass' ELSE 'error' END FROM labels
), spine AS (
  SELECT doc_id, source, stage FROM documents CROSS JOIN (VALUES ('language'), ('quality'), ('toxicity')) s(stage)
), manifest AS (
  SELECT s.doc_id, s.source, s.stage, coalesce(e.status, 'missing') AS status FROM spine s LEFT JOIN ex e ON s.doc_id = e.doc_id AND s.stage = e.stage
)"""
_CELLS = """c AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, CAST(l_partkey AS VARCHAR) AS c0, CAST(l_suppkey AS VARCHAR) AS c1,
    CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS c2, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS c3 FROM lineitem
), cells AS (
  SELECT l_orderkey, row, 0 AS col, c0 AS text FROM c UNION ALL SELECT l_orderkey, row, 1, c1 FROM c UNION ALL SELECT l_orderkey, row, 2, c2 FROM c UNION ALL SELECT l_orderkey, row, 3, c3 FROM c
)"""
_SIDES = "sides AS (SELECT *, 72.0::DOUBLE + 100 * col AS x0, 72.0::DOUBLE + 100 * col + 5 * length(text) AS x1, 84.0::DOUBLE + 12 * row AS y0, 94.0::DOUBLE + 12 * row AS y1 FROM cells)"

ORACLE_SQL = {
    "summary_stats": """WITH m AS (SELECT l_returnflag, l_linestatus, median(l_quantity) AS med FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, l_linestatus, count(*) AS sample_count, median(l_quantity) AS median, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.9) AS p90, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1, 2),
        d AS (SELECT l.l_returnflag, l.l_linestatus, median(abs(l.l_quantity - m.med)) AS mad FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag AND l.l_linestatus = m.l_linestatus GROUP BY 1, 2) SELECT s.l_returnflag, s.l_linestatus, sample_count, median, p10, p90, min, max, mad FROM s JOIN d ON s.l_returnflag = d.l_returnflag AND s.l_linestatus = d.l_linestatus""",
    "upper_medians": "WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_totalprice AS upper_median FROM r WHERE r = n // 2",
    "trimmed_prices": "WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), t AS (SELECT *, CASE WHEN n >= 8 THEN floor(n * 0.1) ELSE 0 END AS cut FROM r) SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM t WHERE r > cut AND r <= n - cut GROUP BY 1",
    "first_modes": "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, p) AS r FROM c) SELECT l_returnflag, l_quantity AS mode, n AS mode_count FROM r WHERE r = 1",
    "price_outliers": "WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1) SELECT o_orderkey, o.o_orderpriority, o_totalprice FROM orders o JOIN m ON o.o_orderpriority = m.o_orderpriority WHERE abs(o_totalprice - med) > greatest(abs(med) * 0.8::DOUBLE, 1000.0::DOUBLE)",
    "robust_profile": """WITH m AS (SELECT l_returnflag, median(l_quantity) AS a, median(l_extendedprice) AS b, median(l_discount) AS c, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT l.l_returnflag, l_quantity AS x, l_extendedprice AS y, l_discount AS z, a, b, c, n FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag),
        d AS (SELECT l_returnflag, median(abs(x - a)) AS da, median(abs(y - b)) AS db, median(abs(z - c)) AS dc FROM j GROUP BY 1), k AS (SELECT j.l_returnflag, x, y, z, n FROM j JOIN d ON j.l_returnflag = d.l_returnflag WHERE abs(x - a) / greatest(1.4826::DOUBLE * da, 1.0::DOUBLE) <= 4.5 AND abs(y - b) / greatest(1.4826::DOUBLE * db, 1.0::DOUBLE) <= 4.5 AND abs(z - c) / greatest(1.4826::DOUBLE * dc, 1.0::DOUBLE) <= 4.5)
        SELECT l_returnflag, median(x) AS l_quantity, median(y) AS l_extendedprice, median(z) AS l_discount, count(*) AS support, max(n) AS n_rows, CASE WHEN count(*) < 2 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END * least(1.0::DOUBLE, count(*) / greatest(4.0::DOUBLE, 0.55::DOUBLE * max(n))) AS confidence FROM k GROUP BY 1""",
    "merged_intervals": f"WITH {_INTERVALS} SELECT user_id, lo, hi, n_merged FROM merged",
    "free_intervals": f"""WITH {_INTERVALS}, f AS (SELECT user_id, min(lo) AS flo, max(hi) AS fhi FROM iv GROUP BY 1), m AS (SELECT merged.user_id, lo, hi, flo, fhi FROM merged JOIN f ON merged.user_id = f.user_id WHERE lo < hi),
        g AS (SELECT user_id, coalesce(lag(hi) OVER (PARTITION BY user_id ORDER BY lo), flo) AS free_lo, lo AS free_hi FROM m UNION ALL SELECT f.user_id, coalesce(max(m.hi), f.flo), f.fhi FROM f LEFT JOIN m ON f.user_id = m.user_id GROUP BY f.user_id, f.flo, f.fhi) SELECT user_id, free_lo, free_hi FROM g WHERE free_hi - free_lo >= 12""",
    "voids": f"WITH {_INTERVALS} SELECT user_id, r AS void_lo, lo AS void_hi FROM reach WHERE lo - r >= 96",
    "activity_islands": f"WITH {_INTERVALS}, g AS (SELECT user_id, event_id, lo, lo - lag(lo) OVER (PARTITION BY user_id ORDER BY lo, event_id) AS d FROM iv), n AS (SELECT *, CAST(sum(CASE WHEN d IS NULL OR d > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM g) SELECT user_id, island, count(*) AS n, min(lo) AS lo, max(lo) AS hi FROM n GROUP BY 1, 2",
    "median_gaps": f"WITH {_INTERVALS}, g AS (SELECT user_id, CAST(lo - lag(lo) OVER (PARTITION BY user_id ORDER BY lo, event_id) AS DOUBLE) AS d FROM iv), k AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE d > 2 AND d < 100000), m AS (SELECT user_id, greatest(3.0::DOUBLE, least(50000.0::DOUBLE, d)) AS gap FROM k WHERE r = n // 2) SELECT u.user_id, coalesce(m.gap, 8.0::DOUBLE) AS gap FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m ON u.user_id = m.user_id",
    "asof_events": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type, value FROM events), p AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'purchase' GROUP BY 1, 2), j AS (SELECT e.user_id, e.event_id, p.t AS asof_t, p.value AS asof_value, row_number() OVER (PARTITION BY e.event_id ORDER BY p.t DESC NULLS LAST) AS r FROM e LEFT JOIN p ON e.user_id = p.user_id AND p.t <= e.t) SELECT user_id, event_id, coalesce(asof_t, -1) AS asof_t, asof_value FROM j WHERE r = 1",
    "interval_differences": f"WITH {_INTERVALS}, own AS (SELECT DISTINCT user_id, lo, hi FROM iv) SELECT user_id, lo, hi, 'lost' AS kind FROM merged m WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = m.user_id AND abs(o.lo - m.lo) <= 2 AND abs(o.hi - m.hi) <= 2) UNION ALL SELECT user_id, lo, hi, 'phantom' FROM own o WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE o.user_id = m.user_id AND abs(o.lo - m.lo) <= 2 AND abs(o.hi - m.hi) <= 2)",
    "integrity_gate": f"""WITH {_MANIFEST}, p AS (SELECT source, doc_id, count(*) FILTER (WHERE status IN ('error', 'not_run', 'missing')) = 0 AS complete FROM manifest GROUP BY 1, 2), c AS (SELECT source, count(*) FILTER (WHERE complete) AS complete_pages, count(*) AS pages FROM p GROUP BY 1),
        s AS (SELECT source, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'error') AS n_error, count(*) FILTER (WHERE status = 'not_run') AS n_not_run, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) AS required FROM manifest GROUP BY 1)
        SELECT s.source, n_pass, n_fail, n_error, n_not_run, n_missing, required, complete_pages, pages, (n_pass + n_fail) / CAST(required AS DOUBLE) AS coverage, CASE WHEN n_pass + n_fail = required THEN 'pass' ELSE 'blocked' END AS integrity FROM s JOIN c ON s.source = c.source""",
    "gate_layers": f"WITH {_MANIFEST} SELECT source, stage, CASE WHEN bool_or(status IN ('error', 'not_run', 'missing')) THEN 'blocked' WHEN bool_or(status = 'fail') AND stage = 'quality' THEN 'blocked' WHEN bool_or(status = 'fail') THEN 'warning' ELSE 'pass' END AS layer FROM manifest GROUP BY 1, 2",
    "gate_decision": f"WITH {_MANIFEST}, l AS (SELECT source, stage, CASE WHEN bool_or(status IN ('error', 'not_run', 'missing')) THEN 'blocked' WHEN bool_or(status = 'fail') AND stage = 'quality' THEN 'blocked' WHEN bool_or(status = 'fail') THEN 'warning' ELSE 'pass' END AS layer FROM manifest GROUP BY 1, 2) SELECT source, count(*) FILTER (WHERE layer = 'blocked') AS n_blocked, count(*) FILTER (WHERE layer = 'warning') AS n_warning, CASE WHEN bool_or(layer = 'blocked') THEN 'blocked' WHEN bool_or(layer = 'warning') THEN 'warning' ELSE 'pass' END AS decision FROM l GROUP BY 1",
    "manifest_counts": f"WITH {_MANIFEST} SELECT stage, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'missing') AS missing FROM manifest GROUP BY 1",
    "defect_ranking": """WITH o AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.1) AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b, count(*) FILTER (WHERE l_quantity >= 49) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, 23 * a + 30 * b + 50 * c AS score,
        CASE WHEN a > 0 THEN 'deep_discount' ELSE '' END || CASE WHEN a > 0 AND (b > 0 OR c > 0) THEN ',' ELSE '' END || CASE WHEN b > 0 THEN 'returned' ELSE '' END || CASE WHEN b > 0 AND c > 0 THEN ',' ELSE '' END || CASE WHEN c > 0 THEN 'bulk' ELSE '' END AS defects FROM o WHERE a + b + c > 0 ORDER BY score DESC, l_orderkey LIMIT 20""",
    "complexity_ranking": "WITH o AS (SELECT l_orderkey, 8 * count(*) + sum(l_linenumber) + 25 * count(DISTINCT l_suppkey) + 35 * count(DISTINCT l_returnflag) + 10 * count(*) FILTER (WHERE l_tax > 0.04) + least(count(*), 20) AS score FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(score AS BIGINT) AS score FROM o ORDER BY score DESC, l_orderkey LIMIT 20",
    "failure_taxonomy": "SELECT l_returnflag, defect, count(*) AS n FROM (SELECT l_returnflag, 'discount' AS defect FROM lineitem WHERE l_discount >= 0.08 UNION ALL SELECT l_returnflag, 'tax' FROM lineitem WHERE l_tax >= 0.06 UNION ALL SELECT l_returnflag, 'quantity' FROM lineitem WHERE l_quantity >= 45) GROUP BY 1, 2",
    "owner_resolution": "WITH s AS (SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS p, 1 + 2 * CAST(l_quantity > 25 AS INT) + 3 / (1 + l_extendedprice / 100) + 2 / (1 + l_tax) + 0.5::DOUBLE * CAST(l_returnflag = 'R' AS INT) + 1.5::DOUBLE * CAST(l_linestatus = 'O' AS INT) AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, p) AS r FROM s) SELECT l_partkey, l_suppkey, p, round(score, 6) AS score FROM r WHERE r = 1",
    "owner_priority": "WITH c AS (SELECT DISTINCT l_partkey, CASE l_returnflag WHEN 'R' THEN 'table' WHEN 'A' THEN 'formula' ELSE 'text' END AS owner_type, l_suppkey AS owner_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE owner_type WHEN 'table' THEN 1 WHEN 'formula' THEN 2 ELSE 4 END, owner_id) AS r, count(*) OVER (PARTITION BY l_partkey) AS n_claims FROM c) SELECT l_partkey, owner_type, owner_id, n_claims FROM r WHERE r = 1",
    "owner_ledger": "WITH c AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT 'all' AS g, count(*) AS spans, count(*) FILTER (WHERE coalesce(n, 0) = 1) AS owned, count(*) FILTER (WHERE coalesce(n, 0) > 1) AS duplicated, count(*) FILTER (WHERE coalesce(n, 0) = 0) AS unowned FROM part LEFT JOIN c ON p_partkey = l_partkey",
    "placement_cardinality": "WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT CASE WHEN n = 4 THEN 'ok' WHEN n < 4 THEN 'missing' ELSE 'duplicate' END AS verdict, count(*) AS n, CAST(sum(n) AS BIGINT) AS placements FROM c GROUP BY 1",
    "fragment_reuse": "SELECT l_partkey, count(DISTINCT l_suppkey) AS consumers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "subset_blocks": """WITH i AS (SELECT DISTINCT o_custkey, l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT o_custkey, l_orderkey, count(*) AS n FROM i GROUP BY 1, 2), p AS (SELECT a.o_custkey, a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS c FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2, 3),
        gone AS (SELECT DISTINCT p.o_custkey, p.a FROM p JOIN n na ON p.o_custkey = na.o_custkey AND p.a = na.l_orderkey JOIN n nb ON p.o_custkey = nb.o_custkey AND p.b = nb.l_orderkey WHERE p.c = na.n AND (nb.n > na.n OR (nb.n = na.n AND p.b < p.a))) SELECT n.o_custkey, n.l_orderkey FROM n LEFT JOIN gone g ON n.o_custkey = g.o_custkey AND n.l_orderkey = g.a WHERE g.a IS NULL""",
    "table_cells": f"WITH {_CELLS} SELECT l_orderkey, row, CAST(col AS BIGINT) AS \"column\", text FROM cells",
    "table_alignment": f"""WITH {_CELLS}, {_SIDES}, v AS (SELECT l_orderkey, col, var_pop(x0) AS l, var_pop(x1) AS r, var_pop((x0 + x1) / 2) AS c FROM sides GROUP BY 1, 2)
        SELECT CAST(col AS BIGINT) AS "column", CASE WHEN l <= least(l, r, c) THEN 'left' WHEN r <= least(l, r, c) THEN 'right' ELSE 'center' END AS alignment, count(*) AS n FROM v GROUP BY 1, 2""",
    "table_quality": f"""WITH {_CELLS}, {_SIDES}, v AS (SELECT l_orderkey, avg(v) AS v FROM (SELECT l_orderkey, least(var_pop(x0), var_pop(x1)) AS v FROM sides GROUP BY l_orderkey, col HAVING count(*) > 1) GROUP BY 1),
        w AS (SELECT l_orderkey, avg(v) AS w FROM (SELECT l_orderkey, var_pop((y0 + y1) / 2) AS v FROM sides GROUP BY l_orderkey, row HAVING count(*) > 1) GROUP BY 1), n AS (SELECT l_orderkey, count(*) AS n FROM cells GROUP BY 1), t AS (SELECT l_orderkey, 4 * count(*) AS t FROM lineitem GROUP BY 1)
        SELECT n.l_orderkey, n AS assigned, t AS n_texts, v AS column_variance, w AS row_variance, n / t AS coverage, round(0.4::DOUBLE / (1 + coalesce(v, 0)) + 0.4::DOUBLE / (1 + coalesce(w, 0)) + 0.2::DOUBLE * (n / t), 9) AS confidence FROM n JOIN t ON n.l_orderkey = t.l_orderkey LEFT JOIN v ON n.l_orderkey = v.l_orderkey LEFT JOIN w ON n.l_orderkey = w.l_orderkey""",
    "table_html": f"""WITH {_CELLS}, h AS (SELECT l_orderkey, row, string_agg('<' || CASE WHEN row = 0 THEN 'th' ELSE 'td' END || ' data-cell="R' || row || 'C' || col || '">' || text || '</' || CASE WHEN row = 0 THEN 'th' ELSE 'td' END || '>', '' ORDER BY col) AS h FROM cells GROUP BY 1, 2)
        SELECT l_orderkey, sha256('<table>' || string_agg(CASE WHEN row = 0 THEN '<thead><tr>' ELSE '<tr>' END || h || CASE WHEN row = 0 THEN '</tr></thead>' ELSE '</tr>' END, '' ORDER BY row) || '</table>') AS html_sha256 FROM h GROUP BY 1""",
    "table_types": "WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS h, count(*) FILTER (WHERE l_returnflag = 'A') AS v, max(l_tax) >= 0.08 AS img FROM lineitem GROUP BY 1) SELECT CASE WHEN img AND n < 5 THEN 'raster' WHEN h >= 3 AND v >= 2 THEN 'full_grid' WHEN h >= 2 AND n >= 5 THEN 'sparse_rule' ELSE 'borderless' END AS table_type, count(*) AS n FROM t GROUP BY 1",
    "rule_roles": "WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT CASE WHEN n = 1 THEN 'single' WHEN r = 1 THEN 'top' WHEN r = n THEN 'bottom' WHEN n = 3 THEN 'header_separator' ELSE 'inner' END AS role, count(*) AS n FROM r GROUP BY 1",
}
