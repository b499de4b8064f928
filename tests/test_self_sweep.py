"""A table that is swept with itself."""

import random

from pyspark.sql import functions as F

from vellum.operators import sweep


def test_one_table_is_dealt_once(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.randrange(2), i, float(x := rng.randrange(200)), float(y := rng.randrange(300)), float(x + rng.randrange(40)), float(y + rng.randrange(90))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, page long, i long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6])
    dealt = df.repartition(3, "doc_id")
    for strip in (None, 50.0):
        out = sweep.overlaps(dealt, dealt, ["doc_id", "page"], strip=strip)
        assert sorted((r.l_i, r.r_i) for r in out.select(F.col("l_i"), F.col("r_i")).collect()) == want
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
