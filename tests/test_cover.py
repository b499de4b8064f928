import random

from vellum.operators import joins, sweep

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_coverage_is_summed_where_pairs_are_found(spark):
    """Against all pairs: overlaps counted as often as they occur, boxes that touch, boxes of no area, keys and edges that are null, left boxes alone."""
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(8), y + rng.randrange(8))
    left = [(p, 100 * p + i, *map(float, box())) for p in range(5) for i in range(12)] + [(None, 990, 0.0, 0.0, 9.0, 9.0), (1, 991, None, 0.0, 9.0, 9.0), (9, 992, 0.0, 0.0, 4.0, 4.0)]
    right = [(p, *map(float, box())) for p in range(5) for _ in range(40)] + [(None, 0.0, 0.0, 9.0, 9.0), (1, 0.0, None, 9.0, 9.0)]
    l, r = spark.createDataFrame(left, f"page int, region int, {BOX}").repartition(3), spark.createDataFrame(right, f"page int, {BOX}")
    area = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    got = {x.region: (round(x.covered, 9), round(x.best_iou, 9), x.matched) for x in joins.coverage(l, r, ["page"], "region", 0.3).collect()}
    for page, region, *b in left:
        common, best = 0.0, 0.0
        for p, *c in right if None not in b else []:
            if page is not None and p == page and None not in c and all(b[k] <= c[k + 2] and c[k] <= b[k + 2] for k in (0, 1)):
                both = max(0.0, min(b[2], c[2]) - max(b[0], c[0])) * max(0.0, min(b[3], c[3]) - max(b[1], c[1]))
                union = area(b) + area(c) - both
                common, best = common + both, max(best, both / union if union > 0 else 0.0)
        share = common / area(b) if None not in b and area(b) else 0.0
        assert got[region] == (round(share, 9), round(best, 9), share >= 0.3), region
    assert len(got) == len(left)


def test_no_pair_leaves_the_sweep(spark):
    """300 boxes over each left one give one row, not 300."""
    l = spark.createDataFrame([(p, 0, 0.0, 0.0, 10.0, 10.0) for p in range(4)], f"page int, region int, {BOX}")
    r = spark.createDataFrame([(p, 1.0, 1.0, 2.0, 2.0) for p in range(4) for _ in range(300)], f"page int, {BOX}")
    assert sorted((x.page, x.common) for x in sweep.cover(l, r, ["page"], "region").collect()) == [(p, 300.0) for p in range(4)]


def test_one_axis_with_few_candidates_is_enough(monkeypatch):
    import numpy as np

    asked = []
    ranks = sweep.ranks
    monkeypatch.setattr(sweep, "ranks", lambda *a: asked.append(1) or ranks(*a))
    rows = np.array([[0.0, 10.0 * i, 500.0, 10.0 * i + 9] for i in range(50)])
    found = [x for li, ri in sweep.overlapping(np.zeros(50, int), rows, np.zeros(50, int), rows, True) for x in zip(li.tolist(), ri.tolist(), strict=True)]
    assert sorted(found) == [(i, i) for i in range(50)] and len(asked) == 1
    turned = rows[:, [1, 0, 3, 2]]
    found = [x for li, ri in sweep.overlapping(np.zeros(50, int), turned, np.zeros(50, int), turned, True) for x in zip(li.tolist(), ri.tolist(), strict=True)]
    assert sorted(found) == [(i, i) for i in range(50)] and len(asked) == 3
