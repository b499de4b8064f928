"""The closure of pages: a page that closes, pages that each miss one thing, and the plan's shuffles."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import closure

KEY = "doc_id long, page long, "
BOX = ", x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "spans": "span_id long", "owned": "span_id long, owner string", "members": "paragraph string, span_id long", "paragraphs": "paragraph string, translation string, crossing boolean", "fragments": "fragment string", "dom_fragments": "fragment string",
    "formulas": "formula_id string, inline boolean", "segments": "formula_id string, segment long" + BOX, "dom_formulas": "formula_id string, inline boolean, ink boolean", "codes": "value string", "dom_codes": "value string, ink boolean", "tokens": "token string, lines int",
    "code_targets": "token string", "citation_targets": "token string", "placeholders": "key string", "found_placeholders": "key string", "figures": "figure string", "dom_figures": "ink boolean", "tables": "tab string",
    "cells": "tab string, translated boolean, overflow boolean", "rules": "tab string, horizontal boolean", "snapshots": "rendered_cells int, clipped int, overflowing int, single_char_lines int, recovery double",
}
CLOSED = {
    "spans": [(1,), (2,), (3,)], "owned": [(1, "text"), (2, "formula"), (3, "figure")], "members": [("p", 1)], "paragraphs": [("p", "ja", True)], "fragments": [("p0",)], "dom_fragments": [("p0",)], "formulas": [("f", True)],
    "segments": [("f", 0, 0.0, 0.0, 9.0, 9.0), ("f", 1, 20.0, 0.0, 29.0, 9.0)], "dom_formulas": [("f", True, True), ("f", True, True)], "codes": [("x=1",)], "dom_codes": [("x=1", True)], "tokens": [("a_b", 1)], "code_targets": [("a_b",)], "citation_targets": [("a_b",)],
    "placeholders": [("p|1",)], "found_placeholders": [("p|1",)], "figures": [("g",)], "dom_figures": [(True,)], "tables": [("t",)], "cells": [("t", True, False)], "rules": [("t", True)], "snapshots": [(1, 0, 0, 0, 1.0)],
}
#: What is changed on a page, the counter that must show it, and the assertion that must fail.
LOSSES = [
    ("owned", [(1, "text"), (1, "table"), (2, "formula"), (3, "figure")], "conflicts", 1, "ownership_closed"),
    ("owned", [(1, "text"), (1, "text"), (2, "formula"), (3, "figure")], "duplicates", 1, "ownership_closed"),
    ("owned", [(1, "text"), (3, "figure")], "unowned", 1, "ownership_closed"),
    ("members", [], "dropped", 1, "text_closed"),
    ("paragraphs", [("p", " ", False)], "untranslated", 1, "text_closed"),
    ("paragraphs", [("p", None, True)], "split_translations", 1, "continuations_closed"),
    ("dom_fragments", [], "orphan_fragments", 1, "continuations_closed"),
    ("dom_formulas", [("f", True, True)], "segments_absent", 1, "render_closed"),
    ("dom_formulas", [("f", False, True), ("f", False, True)], "inline_absent", 1, "render_closed"),
    ("dom_formulas", [("f", True, True), ("f", True, False)], "inline_blank", 1, "formula_visible"),
    ("dom_codes", [], "codes_absent", 1, "render_closed"),
    ("dom_codes", [("y", False)], "code_blank", 1, "render_closed"),
    ("tokens", [("a_b", 2), ("a_b", 3)], "code_split", 2, "tokens_intact"),
    ("tokens", [("c", 2)], "latin_split", 1, "tokens_intact"),
    ("figures", [], "figure_spans_alone", 1, "render_closed"),
    ("dom_figures", [], "regions_absent", 1, "render_closed"),
    ("snapshots", [(0, 0, 0, 0, 1.0)], "regions_absent", 1, "render_closed"),
    ("snapshots", [(1, 0, 0, 0, 0.98)], "recovery", 0.98, "typography_closed"),
    ("snapshots", [(1, 1, 0, 0, 1.0)], "clipped", 1, "typography_closed"),
    ("found_placeholders", [], "placeholders_lost", 1, None),
    ("segments", [("f", 0, 0.0, 0.0, 9.0, 9.0), ("f", 1, 5.0, 0.0, 29.0, 9.0)], "overlaps", 1, None),
    ("cells", [("t", False, True)], "cells_overflowing", 1, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    """Page 0 closes; page k has the k-th loss."""
    made = {}
    for name, schema in SCHEMAS.items():
        rows = [(1, 0, *r) for r in CLOSED[name]]
        for k, (table, changed, *_) in enumerate(LOSSES, 1):
            rows += [(1, k, *r) for r in (changed if table == name else CLOSED[name])]
        made[name] = spark.createDataFrame(rows, KEY + schema).repartition(3)
    return made


def test_each_loss_shows_in_its_counter(pages):
    got = {r.page: r for r in closure.page_closure(pages).collect()}
    assert len(got) == len(LOSSES) + 1 and got[0].passed
    for k, (_, _, counter, n, assertion) in enumerate(LOSSES, 1):
        assert got[k][counter] == pytest.approx(n), (counter, got[k])
        assert got[0][counter] == (1.0 if counter == "recovery" else 0)
        assert got[k].passed == (assertion is None) and (assertion is None or not got[k][assertion]), (counter, got[k])


def test_tables_may_be_absent(pages):
    got = closure.page_closure({"spans": pages["spans"], "owned": pages["owned"]}).where("page = 0").first()
    assert (got.spans, got.conflicts, got.paragraphs, got.dropped) == (3, 0, 0, 1)


def test_one_shuffle_for_all_counters(pages, spark):
    some = {k: v for k, v in pages.items() if k != "segments"}
    plan = closure.page_closure({k: spark.createDataFrame(v.limit(0).collect(), v.schema) for k, v in some.items()})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text, text
