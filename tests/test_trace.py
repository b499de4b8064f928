"""Clip chains on deep, broken and endless trees, and lives of formulas on small pages with planted losses."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import chains, trace

NODE = "k long, node long, parent long, x0 double, y0 double, x1 double, y1 double"


def walk(nodes):
    """Ancestor by ancestor."""
    by = {(k, n): (p, box) for k, n, p, *box in nodes}
    found = {}
    for k, n, p, *_ in nodes:
        env, seen, broken, cyclic = [None] * 4, set(), False, False
        while p is not None:
            if (k, p) not in by:
                broken = True
                break
            if p in seen:
                cyclic = True
                break
            seen.add(p)
            p, box = by[k, p]
            if box[0] is not None:
                env = box if env[0] is None else [max(env[0], box[0]), max(env[1], box[1]), min(env[2], box[2]), min(env[3], box[3])]
        found[k, n] = (None if cyclic else len(seen), *env, broken, cyclic)
    return found


def test_envelopes_of_deep_broken_and_endless_trees(spark):
    rng = random.Random(7)
    box = lambda: [None] * 4 if rng.random() < 0.3 else [float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(60, 99)), float(rng.randrange(60, 99))]
    nodes = [(1, i, i - 1 if i else None, *box()) for i in range(300)]  # a chain of 300
    nodes += [(2, i, rng.randrange(i) if i and rng.random() < 0.9 else (None if rng.random() < 0.5 else 10_000), *box()) for i in range(200)]  # a forest, some parents missing
    nodes += [(3, 0, 2, *box()), (3, 1, 0, *box()), (3, 2, 1, *box()), (3, 3, 2, *box()), (3, 4, None, *box()), (3, 5, 5, *box())]  # circles
    got = chains.envelopes(spark.createDataFrame(nodes, NODE).repartition(4), ["k"])
    assert {(r.k, r.node): (r.n_ancestors, r.clip_x0, r.clip_y0, r.clip_x1, r.clip_y1, r.broken, r.cyclic) for r in got.collect()} == walk(nodes)
    assert chains.envelopes(spark.createDataFrame([], NODE), ["k"]).count() == 0


def test_clip_collapses_to_a_point(spark):
    nodes = [(1, 0, None, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 5.0, 5.0, 20.0, 20.0), (1, 2, 1, None, None, None, None), (1, 3, 7, 50.0, 0.0, 60.0, 9.0), (1, 4, 3, None, None, None, None)]
    env = chains.envelopes(spark.createDataFrame(nodes, NODE), ["k"])
    boxes = spark.createDataFrame([(1, 2, 6.0, 0.0, 30.0, 8.0), (1, 2, 12.0, 0.0, 30.0, 8.0), (1, 0, 1.0, 1.0, 2.0, 2.0), (1, 9, 1.0, 1.0, 2.0, 2.0), (1, 2, None, None, None, None), (1, 4, 0.0, 0.0, 55.0, 20.0)], "k long, node long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.node, r.x0): (r.clip_x0, r.clip_y0, r.clip_x1, r.clip_y1) for r in chains.clip_to_ancestors(boxes, env, ["k"]).collect()}
    assert got == {(2, 6.0): (6.0, 5.0, 10.0, 8.0), (2, 12.0): (12.0, 5.0, 12.0, 5.0), (0, 1.0): (1.0, 1.0, 2.0, 2.0), (9, 1.0): (1.0, 1.0, 2.0, 2.0), (2, None): (None,) * 4, (4, 0.0): (50.0, 0.0, 55.0, 9.0)}


SPAN = "doc_id long, page long, span_id long, text string, font string, size double, owner string, x0 double, y0 double, x1 double, y1 double"
PART = "doc_id long, page long, formula_id string, component long, text string, x0 double, y0 double, x1 double, y1 double"


def test_components_match_within_tolerance_or_by_area(spark):
    spans = [(1, 0, 1, "a", "CMMI10", 10.0, "formula", 10.0, 10.0, 20.0, 20.0), (1, 0, 2, "a", "CMMI10", 10.0, "text", 10.0, 10.0, 20.0, 20.0), (1, 0, 3, "b", "CMMI10", 10.0, None, 40.0, 10.0, 50.0, 20.0), (2, 0, 4, "a", "Times", 10.0, None, 10.0, 10.0, 20.0, 20.0)]
    parts = [
        (1, 0, "f", 0, "a", 10.07, 9.95, 20.0, 20.0),  # within 0.08: the first of two
        (1, 0, "f", 1, "b", 40.5, 10.0, 50.5, 20.0),  # 95 % common
        (1, 0, "f", 2, "b", 42.0, 10.0, 52.0, 20.0),  # 80 %
        (1, 0, "g", 0, "a", 9.99, 10.01, 20.0, 20.0),  # at a cell's edge; claims span 1 too
        (1, 0, "g", 1, "z", 300.0, 10.0, 310.0, 20.0),
    ]
    got = trace.match_components(spark.createDataFrame(parts, PART), spark.createDataFrame(spans, SPAN))
    assert {(r.formula_id, r.component): r.span_id for r in got.collect()} == {("f", 0): 1, ("f", 1): 3, ("f", 2): None, ("g", 0): 1, ("g", 1): None}
    segments = spark.createDataFrame([(1, 0, "f", "a", 0.0, 0.0, 60.0, 30.0)], "doc_id long, page long, formula_id string, segment string, x0 double, y0 double, x1 double, y1 double")
    sums = {r.formula_id: r for r in trace.component_sums(spark.createDataFrame(parts, PART), spark.createDataFrame(spans, SPAN), segments).groupBy("formula_id").agg(*(F.sum(c).alias(c) for c in ("components", "unowned", "double_owned", "uncovered"))).collect()}
    assert tuple(sums["f"])[1:] == (3, 1, 1, None) and tuple(sums["g"])[1:] == (2, 1, 1, 2)


@pytest.mark.parametrize(
    "text, font, size, owner, x0, want",
    [
        ("x", "CMMI10", 10.0, None, 24.0, "ownership_missing"), ("x", "CMMI10", 10.0, None, 31.0, "ownership_missing"), ("x", "CMMI10", 10.0, None, 33.0, "detection_missing_candidate"), ("12", "CMR7", 7.0, None, 90.0, "superscript_or_citation_marker"),
        ("12", "CMR7", 9.0, None, 90.0, "detection_missing_candidate"), ("(,)", "stix", 9.0, None, 90.0, "punctuation_fragment"), ("↑", "CMSY10", 9.0, None, 90.0, "typographic_direction_marker"), ("x", "CMMI10", 10.0, "text", 24.0, "paragraph_owned_math_like_span"),
        ("x", "CMMI10", 10.0, "table", 24.0, None), ("x", "Times", 10.0, None, 24.0, None),
    ],
)
def test_loose_fragments(spark, text, font, size, owner, x0, want):
    spans = spark.createDataFrame([(1, 0, 1, text, font, size, owner, x0, 10.0, x0 + 5, 20.0)], SPAN)
    models = spark.createDataFrame([(1, 0, "f", 10.0, 12.0, 20.0, 22.0)], "doc_id long, page long, formula_id string, x0 double, y0 double, x1 double, y1 double")
    assert [r.classification for r in trace.loose_fragments(spans, models).collect()] == ([want] if want else [])


def test_status_is_the_worst_and_stage_the_first(spark):
    cases = [([], "complete"), (["model_missing"], "unrendered"), (["embed_missing", "orphan_formula"], "orphan"), (["svg_blank", "embed_missing", "orphan_formula"], "blank"), (["svg_viewbox_crop", "final_blank"], "cropped"), (["final_crop", "duplicate_formula"], "duplicate"), (["ownership_missing", "duplicate_formula"], "ownership_error")]
    df = spark.createDataFrame(cases, "defects array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", trace.status_of(F.col("defects")).alias("got")).collect())


def test_a_formula_of_one_stage_alone_has_a_life(spark):
    key = "doc_id long, page long, formula_id string"
    make = lambda rows, more="": spark.createDataFrame(rows, key + more)
    box = ", x0 double, y0 double, x1 double, y1 double"
    tables = {
        "detections": make([(1, 0, "seen")]), "models": make([(1, 0, "seen", 0.0, 0.0, 9.0, 9.0)], box), "components": spark.createDataFrame([], PART), "spans": spark.createDataFrame([], SPAN),
        "segments": make([(1, 0, "seen", "a", 0, 0.0, 0.0, 9.0, 9.0, True, 5, False)], ", segment string, place int" + box + ", has_asset boolean, ink int, viewbox_crop boolean"),
        "placements": make([(1, 0, "stray", 1, None, 0, 0.0, 0.0, 9.0, 9.0, False, True, False)], ", placement long, segment string, node long" + box + ", final_blank boolean, final_crop boolean, disagreement boolean"),
        "exclusivity": make([], ", double_render int, pollution int"),
    }
    got = {r.formula_id: r for r in trace.formula_lives(tables).collect()}
    assert got["seen"].defects == ["embed_missing", "orphan_formula"] and (got["seen"].status, got["seen"].failure_stage) == ("orphan", "embedding")
    assert got["stray"].defects == ["detection_missing", "model_missing", "final_crop", "duplicate_formula"] and got["stray"].failure_stage == "detection" and len(got) == 2


def test_spans_dealt_by_document_are_not_dealt_again(spark):
    """Exact and best matches come from one sweep, which takes spans as they are dealt; so do a span's own columns."""
    spans = spark.createDataFrame([(1, 0, i, "a", "CMMI10", 10.0, "text" if i % 2 else None, 10.0 * i, 0.0, 10.0 * i + 9, 9.0) for i in range(5)], SPAN).repartition(6, "doc_id")
    parts = spark.createDataFrame([(1, 0, "f", 0, "a", 10.05, 0.0, 19.0, 9.0), (1, 0, "f", 1, "a", 21.0, 0.0, 29.0, 9.0), (1, 0, "f", 2, "a", 25.0, 0.0, 34.0, 9.0), (1, None, "f", 3, "a", 10.0, 0.0, 19.0, 9.0), (1, 0, "f", 4, "a", None, 0.0, 19.0, 9.0)], PART)
    out = trace.match_components(parts.repartition(6, "doc_id"), spans, carry=["owner"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan
    assert {(r.component, r.text, r.span_id, r.owner) for r in out.collect()} == {(0, "a", 1, "text"), (1, "a", 2, None), (2, "a", None, None), (3, "a", None, None), (4, "a", None, None)}


def test_words_tell_members_without_joins(spark):
    from vellum.plans import trace_queries

    t = trace_queries.tables(spark, "/root/testdata/sf0.001")
    plan = t["spans"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan
    words = trace_queries.synth.spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    sql = spark.sql(f"WITH {trace_queries.TABLES_SQL.replace('FROM spans', 'FROM {s}')} SELECT * FROM t_spans", s=words)
    order = sql.columns
    assert t["spans"].select(order).exceptAll(sql).count() == 0 and sql.exceptAll(t["spans"].select(order)).count() == 0
