"""Cells of tables against plain Python: texts that share a cell, nulls, and tables longer than a batch."""

import random

from pyspark.sql import functions as F

from vellum.operators import tables

TEXT = "t long, ordinal long, text string, x0 double, y0 double, x1 double, y1 double"


def test_cells_are_put_together_in_reading_order_without_another_shuffle(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(3):
        for r in range(400 if t else 1):
            for c in range(3):
                parts = [(x, rng.choice(["a", "b&", None, "字"])) for x in range(rng.randint(1, 3))]
                for x, text in parts:
                    rows.append((t, r * 100 + c * 10 + x, text, 100.0 * c + 20 * x, 12.0 * r, 100.0 * c + 20 * x + 19, 12.0 * r + 10))
                x1 = 100.0 * c + 20 * parts[-1][0] + 19
                want[t, r, c] = (" ".join(p for _, p in parts if p is not None), 100.0 * c, 12.0 * r, x1, 12.0 * r + 10, len(parts))
    rows.append((9, 1, "only", 5.0, None, 9.0, None))
    want[9, -1, 0] = ("only", 5.0, None, 9.0, None, 1)
    rng.shuffle(rows)
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = tables.cells(spark.createDataFrame(rows, TEXT), ["t"])
            got = {(r.t, r.row, r.column): (r.text, r.x0, r.y0, r.x1, r.y1, r.n_texts) for r in found.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    q = tables.quality(found, ["t"], found.groupBy("t").agg(F.sum("n_texts").alias("n_texts")))
    assert q.where("coverage <> 1").isEmpty() and q.count() == 4
