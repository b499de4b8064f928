"""Functions from SQL give the rows of the DataFrame forms."""

import random

import pytest
from pyspark.sql import functions as F

from vellum import sql
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import formulas, routing, sequence


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    assert set(sql.register(spark)) >= {"cluster_values", "merge_blocks", "protected_templates", "restore_template"}
    sql.register(spark)  # again, in place of the first


def test_clusters(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i, rng.choice((None, rng.uniform(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id_ long, v double").repartition(5)
    got = spark.sql("SELECT k, id_, cluster FROM cluster_values(TABLE({t}) PARTITION BY k ORDER BY (v, id_), 'v', 4.0D)", t=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sequence.cluster_1d(df, ["k"], "v", 4.0).select("k", "id_", "cluster").collect()))


def test_blocks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        x, y = float(rng.randrange(200)), float(rng.randrange(30) * 12)
        rows.append((i % 2, i % 3, i, x, y, x + rng.randrange(5, 80), y + 10, rng.randrange(2)))
    df = spark.createDataFrame(rows, "doc_id int, page int, run int, x0 double, y0 double, x1 double, y1 double, open int").repartition(4)
    got = spark.sql("SELECT doc_id, page, block, run FROM merge_blocks(TABLE({t}) PARTITION BY (doc_id, page) ORDER BY (y0, x0, run))", t=df)
    want = formulas.merge_blocks(df, ["doc_id", "page"])
    sets = lambda d, run: {(r.doc_id, r.page, *sorted(run(r))) for r in d.collect()}
    assert sets(got.groupBy("doc_id", "page", "block").agg(F.collect_list("run").alias("runs")), lambda r: r.runs) == sets(want, lambda r: r.runs)


def test_templates_and_scalars(spark):
    texts = ["f(x) is {{FORMULA_B1}} where  x > 0", "H(X) and sin(x)", "", None, "状态 and more {{CODE_2}}"]
    df = spark.createDataFrame([(t,) for t in texts], "src string")
    got = spark.sql("SELECT src, template, mapping, restore_template(template, mapping) AS back, normal_form(src) AS n, strip_placeholders(src) AS s, has_cjk(src) AS c FROM protected_templates(TABLE({t}), 'src')", t=df)
    want = routing.with_template(df).select("src", "template", "mapping", routing.restore(F.col("template"), F.col("mapping")).alias("back"), T.normal_form(F.col("src")).alias("n"), T.strip_placeholders(F.col("src")).alias("s"), T.has_cjk(F.col("src")).alias("c"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    boxes = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 2.0, 1.0, 9.0, 3.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    assert [r.a for r in spark.sql("SELECT box_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) AS a FROM {b}", b=boxes).collect()] == [r.a for r in boxes.select(G.intersection_area(G.box("a"), G.box("b")).alias("a")).collect()]


@pytest.mark.parametrize("call, said", [
    ("cluster_values(TABLE({t}) PARTITION BY (k), 'w', 1.0D)", "no column w"), ("cluster_values(TABLE(SELECT *, 1 AS cluster FROM {t}) PARTITION BY (k), 'v', 1.0D)", "column cluster already"), ("merge_blocks(TABLE({t}) PARTITION BY (k))", "no column x0"),
])
def test_wrong_tables_are_refused(spark, call, said):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}", t=df).collect()
