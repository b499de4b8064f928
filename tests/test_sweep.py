"""The plane sweep against all pairs, with ties, touching edges, odd boxes and a very full page."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import joins, sweep

BOX = "doc_id long, page long, id long, x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, pages=3, span=30, null_share=0.05):
    rows = []
    for i in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        box = [float(x), float(y), float(x + rng.randrange(0, 6)), float(y + rng.randrange(0, 6))]
        if rng.random() < 0.05:
            box[0], box[2] = box[2], box[0]
        if rng.random() < null_share:
            box[rng.randrange(4)] = None
        rows.append((rng.choice((1, 2, None)), rng.randrange(pages), i, *box))
    return rows


def meets(a, b, closed, reach=0.0):
    if None in a[3:] or None in b[3:] or a[0] is None or a[:2] != b[:2]:
        return False
    (p, q, r, s), (t, u, v, w) = a[3:], b[3:]
    p, q, r, s = p - reach, q - reach, r + reach, s + reach
    return p <= v and t <= r and q <= w and u <= s if closed else p < v and t < r and q < w and u < s


def common(a, b):
    return (min(a[5], b[5]) - max(a[3], b[3])) * (min(a[6], b[6]) - max(a[4], b[4]))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(12)
    l, r = boxes(rng, 260), boxes(rng, 240)
    return l, r, spark.createDataFrame(l, BOX).repartition(5), spark.createDataFrame(r, BOX).repartition(3)


@pytest.mark.parametrize("strip, reach, piece", [(None, 0.0, 1 << 20), (4.0, 0.0, 7), (None, 2.5, 64), (3.0, 2.5, 1 << 20)])
def test_overlaps_equal_all_pairs(sides, monkeypatch, strip, reach, piece):
    monkeypatch.setattr(sweep, "PIECE", piece)
    l, r, left, right = sides
    got = sweep.overlaps(left, right, ["doc_id", "page"], strip=strip, reach=reach)
    assert got.columns == ["doc_id", "page", *(f"{p}{c}" for p in ("l_", "r_") for c in ("id", "x0", "y0", "x1", "y1"))]
    want = sorted((a[2], b[2]) for a in l for b in r if meets(a, b, True, reach))
    assert sorted((x.l_id, x.r_id) for x in got.collect()) == want and want


@pytest.mark.parametrize("strip", [None, 4.0])
def test_best_overlap_with_ties(sides, strip):
    l, r, left, right = sides
    got = sorted((x.id, x.match, x.area) for x in joins.best_overlap(left, right, ["doc_id", "page"], "id", "id", strip=strip).collect())
    want = []
    for a in l:
        found = [(-common(a, b), b[2]) for b in r if meets(a, b, False) and common(a, b) > 0 and b[3] < b[5] and b[4] < b[6]]
        odd = [(-common(a, b), b[2]) for b in r if meets(a, b, False)]
        assert sorted(found) == sorted(x for x in odd if x[0] < 0 or x in found)
        best = min(found, default=None)
        want.append((a[2], best and best[1], -best[0] if best else 0.0))
    assert got == sorted(want)


def test_nearest_with_ties(sides):
    l, r, left, right = sides
    mid = lambda b: ((b[3] + b[5]) / 2, (b[4] + b[6]) / 2)
    want = []
    for a in l:
        near = [(abs(mid(a)[1] - mid(b)[1]), abs(mid(a)[0] - mid(b)[0]), b[2]) for b in r if None not in a[3:] + b[3:] and a[:2] == b[:2] and a[0] is not None]
        if near:
            want.append((a[2], min(near)[2]))
    assert sorted((x.id, x.nearest) for x in joins.nearest(left, right, ["doc_id", "page"], "id", "id").collect()) == sorted(want)


def test_empty_sides(spark, sides):
    l, _, left, _ = sides
    none = spark.createDataFrame([], BOX)
    keys = ["doc_id", "page"]
    assert sweep.overlaps(left, none, keys).count() == sweep.overlaps(none, left, keys).count() == joins.nearest(left, none, keys, "id", "id").count() == 0
    assert joins.best_overlap(none, left, keys, "id", "id").count() == 0
    assert {(x.match, x.area) for x in joins.best_overlap(left, none, keys, "id", "id").collect()} == {(None, 0.0)}
    assert joins.best_overlap(left, none, keys, "id", "id").count() == len(l)


def test_a_page_of_100_000_boxes(spark):
    """Words in 1,000 lines: each meets itself alone, and the nearest line's centre is known."""
    n = 100_000
    i = F.col("id")
    page = spark.range(n, numPartitions=4).select(F.lit(1).alias("p"), "id", (i % 100 * 6.0).alias("x0"), (F.floor(i / 100) * 12.0).alias("y0"), (i % 100 * 6.0 + 5).alias("x1"), (F.floor(i / 100) * 12.0 + 10).alias("y1"))
    got = joins.best_overlap(page, page, ["p"], "id", "id")
    assert got.where("match <> id or area <> 50").isEmpty() and got.count() == n
    assert joins.nearest(page, page, ["p"], "id", "id").where("nearest <> id").isEmpty()
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_memory_of_a_sweep_is_linear():
    rng = np.random.default_rng(3)
    n = 100_000
    corner = rng.uniform(0, 3000, (n, 2))
    box = np.concatenate([corner, corner + rng.uniform(1, 5, (n, 2))], axis=1)
    g = np.zeros(n, np.int64)
    import tracemalloc

    tracemalloc.start()
    pairs = sum(len(a) for a, _ in sweep.overlapping(g, box, g, box, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs >= n and peak < 300e6  # all pairs would be 80 GB
