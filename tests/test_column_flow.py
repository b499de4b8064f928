import random

from vellum.operators import flow


def test_columns_are_placed_as_one_by_one(spark):
    """Any number of columns, obstacles that repeat, columns without obstacles: as ``place`` does it for each; no Python group a column."""
    rng = random.Random(3)
    items, ways = [], []
    for doc in range(6):
        for column in (0, 1):
            items += [(doc, 0, column, i, float(rng.randrange(72, 600)), float(rng.randrange(8, 40))) for i in rng.sample(range(50), 9)]
            if (doc + column) % 3:
                some = [(doc, 0, column, float(t), float(t + 10)) for t in rng.sample(range(72, 700, 12), 5)]
                ways += some * 3
    p = spark.createDataFrame(items, "doc_id long, page long, column int, ordinal long, anchor double, height double").repartition(3)
    o = spark.createDataFrame(ways, "doc_id long, page long, column int, top double, bottom double")
    placed = flow.column_flow(p, o)
    want = set()
    for key in {r[:3] for r in items}:
        mine = sorted((r for r in items if r[:3] == key), key=lambda r: (r[4], r[3]))
        ys = flow.place([(r[4], r[5]) for r in mine], sorted(r[3:] for r in ways if r[:3] == key))
        want |= {(*r[:4], y, r[5]) for r, y in zip(mine, ys, strict=True)}
    assert {tuple(r) for r in placed.collect()} == want
    assert "FlatMapGroupsInPandas" not in placed._jdf.queryExecution().executedPlan().toString()
