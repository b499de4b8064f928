"""Paragraphs, edits, flow and quality checks on small pages."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import edits
from vellum.operators import flow, paragraphs, quality

LINE = "doc_id long, page long, column int, ordinal long, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"


def lines(spark, rows):
    return spark.createDataFrame([(1, p, c, i, t, 72.0, y, 290.0, y + 10, s, b) for i, (p, c, t, y, s, b) in enumerate(rows)], LINE)


def test_heading_flag_is_inherited_and_breaks(spark):
    got = paragraphs.merge_lines(lines(spark, [(0, 0, "1 Introduction to", 72.0, 12.0, True), (0, 0, "the subject", 84.0, 12.0, True), (0, 0, "Body text goes", 96.0, 10.0, False), (0, 0, "on here.", 108.0, 10.0, False), (0, 0, "Far below", 160.0, 10.0, False)])).orderBy("ordinal").collect()
    assert [(r.text, r.heading, r.n_lines) for r in got] == [("1 Introduction to the subject", True, 2), ("Body text goes on here.", False, 2), ("Far below", False, 1)]


def test_paragraph_goes_on_in_the_next_column_and_page(spark):
    rows = [(0, 0, "This sentence has no", 690.0, 10.0, False), (0, 1, "end in its column. But here it does.", 72.0, 10.0, False), (0, 1, "A new one that also", 700.0, 10.0, False), (1, 0, "goes over the page.", 72.0, 10.0, False), (1, 0, "Last.", 300.0, 10.0, False)]
    p = paragraphs.merge_lines(lines(spark, rows))
    assert paragraphs.crosses_column(p).where("page = 0").first().continues and paragraphs.crosses_page(p).first().continues
    assert [r.logical for r in paragraphs.logical_paragraphs(p).orderBy("ordinal").collect()] == [1, 1, 2, 2, 3]


def test_front_matter(spark):
    rows = [(1, 0, "A Title of Some Length", 16.0), (1, 1, "Yushi Bai, Jiajie Zhang", 10.0), (1, 2, "Tsinghua University", 10.0), (1, 3, "Abstract", 10.0), (1, 4, "We show.", 10.0)]
    got = paragraphs.front_matter(spark.createDataFrame(rows, "doc_id long, row int, text string, size double")).orderBy("row").collect()
    assert [r.kind for r in got] == ["title", "authors", "affiliation", "abstract_heading", "abstract"]


def test_roles_by_state(spark):
    rows = [("references", "body", "Bai, Yushi. 2024.", "reference"), ("references", "heading", "References", "reference_heading"), ("appendix", "body", "x", "appendix_body"), ("normal_body", "caption", "x", "caption")]
    df = spark.createDataFrame(rows, "state string, style string, text string, want string")
    assert all(r.got == r.want for r in df.select("want", paragraphs.semantic_role(F.col("state"), F.col("style"), F.col("text")).alias("got")).collect())


def test_items_are_pushed_below_obstacles():
    assert flow.place([(72, 20), (80, 20), (90, 30)], [(110, 150)], gap=8, y0=72) == [72, 158, 186]
    assert flow.place([], [], 8) == []


def test_column_flow(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, 72.0, 20.0), (1, 0, 0, 1, 80.0, 20.0)], "doc_id long, page long, column int, ordinal long, anchor double, height double")
    none = spark.createDataFrame([], "doc_id long, page long, column int, top double, bottom double")
    f = flow.column_flow(p, none)
    assert [r.flow_y for r in f.orderBy("ordinal").collect()] == [72.0, 100.0]
    assert flow.overflow(f, limit=110.0).first().overflow == 10.0


def test_capacity_takes_the_first_level_that_fits(spark):
    p = spark.createDataFrame([(1, 0, 0, 0, 100.0, 200.0, False, False), (1, 1, 0, 0, 4000.0, 200.0, False, False), (1, 2, 0, 0, 100.0, 200.0, False, True)], "doc_id long, page long, ordinal long, column int, em double, width double, movable boolean, reference boolean")
    i = spark.createDataFrame([(1, 0, 0, 72.0, 151.1), (1, 1, 0, 72.0, 100.0), (1, 2, 0, 72.0, 135.0)], "doc_id long, page long, column int, a double, b double")
    got = {r.page: r for r in flow.resolve_capacity(p, i).collect()}
    # five lines: 75 points and a gap of 8, 6, 4; in the third setting they fit
    assert (got[0].level, got[0].gap_scale, got[0].attempts, got[0].spill_required) == (2, 0.5, 3, False)
    assert (got[1].level, got[1].attempts, got[1].spill_required) == (5, 7, True)
    assert (got[2].level, got[2].reference_compact, got[2].spill_required) == (5, True, False)  # only references shrink so far


def test_greedy_choice():
    assert flow.greedy_diverse([("a", {1, 2}), ("b", {1, 2, 3}), ("c", {4})], 2) == ["b", "c"]


def test_edits_keep_text_whole():
    text = "set lr = 0.1 for the big model"
    assert edits.code_ranges(text) == [(4, 12)]
    marked = edits.markup(text, [(*(text.index("big model"), len(text)), "BOLD")], edits.code_ranges(text))
    assert marked == "set {{CODE_1}} for the {{BOLD_1}}big model{{END_BOLD_1}}"
    assert edits.style_ranges("a  big\nmodel, a big model", [("big model", "BOLD"), ("big model", "ITALIC")]) == [(3, 12, "BOLD"), (16, 25, "ITALIC")]


@pytest.mark.parametrize("shares", [[1.0], [1.0, 1.0], [1.0, 2.0, 1.0], [0.0, 1.0]])
def test_split_never_cuts_a_placeholder(shares):
    text = "第一句话。" * 3 + "{{FORMULA_B12}}" + "第二句话，还有。" * 3
    parts = edits.split_at(text, shares)
    assert "".join(parts) == text and len(parts) == len(shares)
    assert sum(p.count("{{FORMULA_B12}}") for p in parts) == 1
    assert edits.split_at("", shares) == [""] * len(shares)


def test_script_gaps_skip_addresses():
    assert edits.script_gaps("使用GPU训练") == [2, 5]
    assert edits.script_gaps("见a.b@cd.ef处") == [10] and edits.script_gaps("x") == []


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("", ""), ("ab", "cd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(edits.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.0]


def test_residue_and_recall(spark):
    s = spark.createDataFrame([("the cat and the dog sat", "body"), ("这是中文", "body"), ("Deep Residual Nets", "body"), ("x and y", "code")], "text string, role string")
    assert [r.text for r in quality.residual(s).collect()] == ["the cat and the dog sat"]
    e, f = spark.createDataFrame([("中文ab",)], "text string"), spark.createDataFrame([("中ab",)], "text string")
    got = {r.script: r.recall for r in quality.script_recall(e, f).collect()}
    assert got == {"cjk": 0.5, "latin": 1.0}


def test_collisions_and_footnotes(spark):
    t = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 0, "b", 50.0, 50.0, 60.0, 60.0)], "doc_id long, page long, id string, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame([(1, 0, "table", 5.0, 5.0, 20.0, 20.0)], "doc_id long, page long, kind string, x0 double, y0 double, x1 double, y1 double")
    assert [(x.kind, x.collisions) for x in quality.collisions(t, r).collect()] == [("table", 1)]
    n = spark.createDataFrame([(1, 0, "n", 0.0, 14.0, 100.0, 20.0)], "doc_id long, page long, id string, x0 double, y0 double, x1 double, y1 double")
    got = quality.footnotes(t, n).first()
    assert (got.overlaps, got.least_gap) == (0, 4.0)


def test_values(spark):
    from vellum.functions import values as V

    df = spark.createDataFrame([('a { b(c] ', "color: red; WIDTH:12.5pt;; color:blue; url:http://x", '{"a":{"b":3}}')], "t string, s string, j string")
    r = df.select(V.bracket_balance(F.col("t")).alias("b"), V.parse_style(F.col("s")).alias("m"), V.path(F.col("j"), "a.b").alias("p"), V.path(F.col("j"), "a.c").alias("q"), V.content_id("FTR-", F.col("t"), F.col("s")).alias("i"), V.points(F.lit("w 12.5pt")).alias("n"), V.points(F.lit("none")).alias("z")).first()
    assert r.b == 1 and r.m == {"color": "blue", "width": "12.5pt", "url": "http://x"} and (r.p, r.q) == ("3", None) and len(r.i) == 24 and r.n == 12.5 and r.z is None
    for value, blocked in (("false", True), ("true", False), ('"blocked"', True), ('"pass"', False), ('{"status":"error"}', True), ('{"blocked":true}', True), ('{"passed":false}', True), ('{"passed":true}', False)):
        assert spark.range(1).select(V.is_blocked(F.lit(value))).first()[0] is blocked, value


def test_tiered_match_uses_equal_texts_once(spark):
    from vellum.operators import joins

    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "par"), (1, 3, "whole text"), (1, 4, "zzz")], "k int, l int, text string")
    b = spark.createDataFrame([(1, 10, "x"), (1, 11, "part of"), (1, 12, "text")], "k int, r int, text string")
    got = {x.l: (x.r, x.tier) for x in joins.tiered_text_match(a, b, ["k"], "l", "r").collect()}
    assert got == {0: (10, 1), 1: (12, 2), 2: (11, 2), 3: (12, 3)}


def test_union_coverage(spark):
    from vellum.operators import joins

    box = "k int, id int, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 60.0, 10.0)], box)
    b = spark.createDataFrame([(1, 1, -1.0, -1.0, 6.0, 11.0), (1, 2, 4.0, -1.0, 10.0, 11.0), (1, 3, 4.0, 0.0, 5.0, 5.0)], box)
    got = {r.id: (r.covered, r.contained) for r in joins.covered_by_union(a, b, ["k"], "id").collect()}
    assert got == {1: (1.0, True), 2: (0.0, False)}


def test_blocks_merge_to_a_fixpoint(spark):
    from vellum.operators import formulas

    rows = [(1, 0, 1, 0.0, 0.0, 50.0, 10.0, 0), (1, 0, 2, 10.0, 14.0, 60.0, 24.0, 0), (1, 0, 3, 20.0, 28.0, 70.0, 38.0, 0), (1, 0, 4, 300.0, 28.0, 340.0, 38.0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, page long, run long, x0 double, y0 double, x1 double, y1 double, open int")
    assert sorted(tuple(r.runs) for r in formulas.merge_blocks(df, ["doc_id", "page"]).collect()) == [(1, 2, 3), (4,)]


def test_table_html_and_bounds(spark):
    from vellum.operators import tables

    cells = spark.createDataFrame([(1, 0, 0, "A<b", 0.0, 0.0, 9.0, 9.0), (1, 1, 0, "1", 0.0, 12.0, 9.0, 21.0)], "t int, row int, column int, text string, x0 double, y0 double, x1 double, y1 double")
    html = tables.to_html(cells, ["t"])
    assert html.first().html == '<table><thead><tr><th data-cell="R0C0">A&lt;b</th></tr></thead><tr><td data-cell="R1C0">1</td></tr></table>'
    q = tables.html_structure(html, cells, ["t"]).first()
    assert q.unique and q.complete and q.has_head
    assert tables.to_positioned_html(cells, ["t"]).first().html.count("<div") == 2
    rows = spark.createDataFrame([(1, 0, 5.0, 0.0, 30.0), (1, 1, 15.0, 0.0, 30.0)], "t int, row int, centre double, top_rule double, bottom_rule double")
    assert [(r.lo, r.hi) for r in tables.row_bounds(rows, ["t"]).orderBy("row").collect()] == [(0.0, 10.0), (10.0, 30.0)]
    rules = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 40.0)], "t int, y0 double")
    assert tables.header_row(rows, rules, ["t"]).first().header_row == 1


def test_links_need_paragraphs_once(spark):
    """Pages that aren't neighbours and rows without a document aren't linked; the input is read once for all links."""
    rows = [(1, 0, "Begins here and", 690.0), (1, 1, "goes on.", 72.0), (1, 3, "later with no end", 700.0), (2, 0, "another that", 700.0), (2, 2, "is far away.", 72.0), (None, 0, "no document has", 700.0), (None, 1, "this one.", 72.0)]
    p = spark.createDataFrame([(d, g, 0, i, t, 72.0, y, 290.0, y + 10, 10.0, False) for i, (d, g, t, y) in enumerate(rows)], LINE.replace("bold", "heading"))
    got = paragraphs.logical_paragraphs(p)
    assert [(r.ordinal, r.logical) for r in got.where("doc_id is not null").orderBy("ordinal").collect()] == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 2)]
    assert [r.logical for r in got.where("doc_id is null").orderBy("ordinal").collect()] == [1, 2]
    assert [tuple(r)[:4] for r in paragraphs.crosses_page(p).orderBy("doc_id").collect()] == [(1, 1, 0, 1)]
    for out in (got, paragraphs.crosses_page(p)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_lines_join_by_the_end_of_long_texts(spark):
    from vellum.functions import text as T

    pairs = [("x" * 3000 + "-", "goes"), ("x" * 3000 + "A-", "goes"), ("X" * 3000 + "-", "Goes"), ("ab-", "c"), ("b-", "c"), ("-", "c"), ("", "c"), ("a", ""), ("ab-\n", "c"), ("ab-\r\n", "c"), ("字" * 10, "字"), ("字a", "字"), ("a-b", "c")]
    got = [r.j for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(T.join_lines(F.col("a"), F.col("b")).alias("j")).collect()]
    whole = ["x" * 3000 + "goes", "x" * 3000 + "A-goes", "X" * 3000 + "-Goes", "abc", "b-c", "- c", "c", "a", "ab\nc", "ab\r\nc", "字" * 11, "字a 字", "a-b c"]
    assert got == whole
