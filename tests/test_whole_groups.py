"""Groups that hold much of a table: medians and intervals without a task for all of a group's values or pairs."""

import math
import random
import statistics

from vellum.operators import joins, stats


def test_profile_is_made_of_bands(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.gauss(50, 9), float(rng.randrange(40, 60)), 900.0]), rng.uniform(-5, 5)) for k in "aab" for _ in range(300)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("c", 1.0, math.nan), ("c", 3.0, math.nan), ("c", 2.0, 7.0)], "k string, x double, y double")
    out = stats.robust_profile(df, "k", ["x", "y"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    got = {r.k: r for r in out.collect()}
    for k in "ab":
        known = [(x, y) for key, x, y in rows if key == k]
        xs, ys = [x for x, _ in known], [y for _, y in known] + ([1.0] if k == "a" else [])
        mx, my = statistics.median(xs), statistics.median(ys)
        dx, dy = statistics.median(abs(x - mx) for x in xs), statistics.median(abs(y - my) for y in ys)
        near = [(x, y) for x, y in known if abs(x - mx) / max(1.4826 * dx, 1.0) <= 4.5 and abs(y - my) / max(1.4826 * dy, 1.0) <= 4.5]
        assert got[k].support == len(near) and got[k].n_rows == len(ys)
        assert math.isclose(got[k].x, statistics.median(x for x, _ in near)) and math.isclose(got[k].y, statistics.median(y for _, y in near))


def test_intervals_meet_in_cells(spark):
    rng = random.Random(6)
    side = lambda n: [(rng.randrange(2), a := rng.randrange(-300, 300), a + rng.randrange(40)) for _ in range(n)]
    left, right = side(400), side(400)
    frames = [spark.createDataFrame(x, "k int, lo long, hi long") for x in (left, [*right, (0, None, 3)])]
    for tolerance in (0, 2, 7):
        out = joins.tolerance_match(*frames, ["k"], "lo", "hi", tolerance)
        assert "cell_" in out._jdf.queryExecution().optimizedPlan().toString()
        near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) <= tolerance and abs(a[2] - b[2]) <= tolerance  # noqa: B023, E731
        only = lambda a, b, kind: [(*x, kind) for x in a if not any(near(x, y) for y in b)]
        assert sorted(tuple(r) for r in out.collect() if r.lo is not None) == sorted(only(left, right, "lost") + only(right, left, "phantom"))


def test_intervals_do_not_pass_through_the_driver(spark):
    rng = random.Random(7)
    side = lambda n: [(rng.randrange(3), a := rng.randrange(-200, 200), a + rng.randrange(30)) for _ in range(n)]
    left, right = side(300), side(300)
    frames = [spark.createDataFrame([(k, a / 4, b / 4) for k, a, b in x], "k int, lo double, hi double") for x in (left, right)]
    for tolerance in (0.5, 2.0):
        out = joins.tolerance_match(*frames, ["k"], "lo", "hi", tolerance)
        rows = sorted(tuple(r) for r in out.collect())
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
        near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) / 4 <= tolerance and abs(a[2] - b[2]) / 4 <= tolerance  # noqa: B023, E731
        only = lambda a, b, kind: [(x[0], x[1] / 4, x[2] / 4, kind) for x in a if not any(near(x, y) for y in b)]
        assert rows == sorted(only(left, right, "lost") + only(right, left, "phantom"))
