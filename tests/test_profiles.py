"""Consensus grids and evidence profiles, and how often plans read their tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import consensus, evidence, layout, stats, synth

CAND = "doc_id long, page long, candidate int, left_x0 double, left_x1 double, right_x0 double, right_x1 double, gutter double, frame_x0 double, frame_x1 double"


def grid(doc, page, n, l0, l1, r0, r1):
    return (doc, page, n, l0, l1, r0, r1, r0 - l1, l0, r1)


@pytest.fixture(scope="module")
def document(spark):
    """Nine pages: six alike, one far off, one of one column, one whose better candidate is the second."""
    rows = [grid(1, p, 0, 72.0 + p % 2, 290.0, 306.0, 524.0) for p in range(6)]
    rows += [grid(1, 6, 0, 72.0, 250.0, 380.0, 560.0), grid(1, 8, 0, 72.0, 150.0, 306.0, 524.0), grid(1, 8, 1, 72.0, 290.0, 306.0, 524.0)]
    modes = [(1, p, "single_column" if p == 7 else "two_column") for p in range(9)] + [(2, 0, "two_column")]
    seen = [(1, p, True, p != 5) for p in range(9)]
    return spark.createDataFrame(rows, CAND), spark.createDataFrame(modes, "doc_id long, page long, mode string"), spark.createDataFrame(seen, "doc_id long, page long, left boolean, right boolean")


def test_pages_agree_and_outliers_are_left_out(document):
    for rounds in (1, 5):
        got = {r.doc_id: r for r in consensus.document_profile(*document, rounds=rounds).collect()}
        one = got[1]
        assert one.support_pages == [0, 1, 2, 3, 4, 8] and sorted(one.excluded_pages) == [5, 6, 7]
        assert (one.left_x0, one.left_x1, one.right_x0, one.gutter, one.elected, one.scanned) == (72.0, 290.0, 306.0, 16.0, 8, 9)
        assert one.resolved and one.confidence == 1.0 and one.width_ratio_p10 == pytest.approx(217 / 218, abs=1e-4)
        assert (got[2].layout_mode, got[2].resolved, got[2].excluded_pages) == ("unresolved", False, [0])


def test_lost_tracks_are_restored(spark, document):
    profile = consensus.document_profile(*document)
    rows = [(1, 0, "mixed_layout", 0.7, None, None, None, None, None, True), (1, 1, "reference_dense", 0.7, None, None, None, None, None, True), (1, 2, "mixed_layout", 0.7, 72.1, 290.0, 306.0, 524.0, 16.0, True), (2, 0, "mixed_layout", 0.0, 10.0, 20.0, 30.0, 50.0, 10.0, False)]
    grids = spark.createDataFrame(rows, "doc_id long, page long, page_class string, confidence double, left_x0 double, left_x1 double, right_x0 double, right_x1 double, gutter double, text_in_both boolean")
    got = {(r.doc_id, r.page): r for r in consensus.snapped(grids, profile).collect()}
    assert (got[1, 0].restored, got[1, 0].left_x1, got[1, 0].right_x0, got[1, 0].gutter) == (True, 290.0, 306.0, 16.0)
    assert not got[1, 1].restored and got[1, 1].left_x0 is None and got[1, 2].snapped and not got[1, 2].restored
    assert got[1, 0].grid_confidence == pytest.approx(0.28 + 0.24 * 0.7 + 0.24 * (1 - 0) + 0.24, abs=2e-3)
    assert got[2, 0].grid_confidence == pytest.approx(0.28 * 0.68 + 0.24 * 0.75 + 0.24 * 0.5 + 0.24 * 0.8, abs=1e-3)


VALUE = "doc_id long, page long, metric string, value double"


def test_merged_states_equal_recomputed_ones(spark):
    rng = random.Random(4)
    rows = [(d, rng.randrange(40), m, rng.gauss(10 * (m == "a"), 3)) for d in range(30) for m in ("a", "b") for _ in range(150 if d else 5)] + [(1, 3, "a", None)]
    df = spark.createDataFrame(rows, VALUE).withColumn("all", F.lit(0))
    held = evidence.states(df, ["all", "doc_id"])
    rolled = {r.metric: r for r in evidence.tokens(evidence.merged(held, ["all"]), ["all"]).collect()}
    counts = {r.metric: r for r in evidence.merged(held, ["all"]).collect()}
    for m in ("a", "b"):
        v = np.sort([x for *_, k, x in rows if k == m and x is not None])
        assert rolled[m].samples == len(v) == counts[m].samples and counts[m].parts == 30
        assert counts[m].pages == len({(d, p) for d, p, k, x in rows if k == m and x is not None})
        for q, name in ((0.1, "p10"), (0.5, "value"), (0.9, "p90")):
            rank = np.searchsorted(v, rolled[m][name], "right") / len(v)
            assert abs(rank - q) <= 2 * evidence.RANK_ERROR + 1 / len(v), (m, name, rank)
    small = {r.metric: r for r in evidence.tokens(held.where("doc_id = 0"), ["doc_id"]).collect()}
    for m in ("a", "b"):
        v = sorted(x for d, _, k, x in rows if d == 0 and k == m)
        assert small[m].value == v[2] and small[m].p10 == v[0] and small[m].confidence < 0.2


def test_ratios_and_page_bound(spark):
    rows = [(1, p % 5, m, v) for m, v in (("body", 10.0), ("title", 16.0)) for p in range(40)]
    t = evidence.tokens(evidence.states(spark.createDataFrame(rows, VALUE), ["doc_id"]), ["doc_id"])
    r = evidence.ratios(t, ["doc_id"], "body").first()
    assert (r.metric, r.ratio, r.confidence, r.samples, r.pages) == ("title", 1.6, 1.0, 40, 5)
    far = spark.createDataFrame([(1, evidence.MOST_PAGES, "m", 1.0)], VALUE)
    with pytest.raises(Exception, match="page's number"):
        evidence.states(far, ["doc_id"]).collect()


@pytest.mark.parametrize("name", ["grid", "occupancy"])
def test_pages_are_read_and_dealt_once(spark, name):
    spans = synth.spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df = layout.column_grid(spans) if name == "grid" else stats.occupancy(spans, ["doc_id", "page"], "x0", "x1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
