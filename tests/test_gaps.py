"""Seams of scripts: pairs, blanks between them, causes, and neighbours of formulas."""

from pyspark.sql import functions as F

from vellum.operators import candidates, gaps

CHAR = "doc_id long, page long, paragraph long, line long, place long, c string, x0 double, y0 double, x1 double, y1 double, span long"


def line(number, text, spans=None, step=6.0, paragraph=None):
    return [(1, 0, paragraph if paragraph is not None else number, number, 100 * number + i, c, step * i, 20.0 * number, step * i + 5, 20.0 * number + 10, 0 if spans is None else spans[i]) for i, c in enumerate(text)]


def test_causes(spark):
    chars = line(1, "用A") + line(2, "用 A") + line(3, "用A", [0, 1]) + line(4, "用A") + line(5, "用A", [0, 1]) + line(6, "3用%") + line(7, "AB12") + line(8, "用A", paragraph=99)
    paragraphs = [(1, 0, 1, "用A", None), (1, 0, 2, "x", None), (1, 0, 3, None, ""), (1, 0, 4, "用  A {{CODE_1}}", None), (1, 0, 5, "用A", "<b class='code-run'>用<i>A</i></b>"), (1, 0, 6, "用{{X}} %", None)]
    got = gaps.script_gaps(spark.createDataFrame(chars, CHAR).repartition(3), spark.createDataFrame(paragraphs, "doc_id long, page long, paragraph long, translation string, context string"))
    assert {(r.line, r.left + r.right): (r.gap_class, r.cause, r.gap) for r in got.collect()} == {
        (1, "用A"): ("CJK-Latin", "shaping_sidebearing", 1.0), (2, "用A"): ("CJK-Latin", "translation_literal_space", 7.0), (3, "用A"): ("CJK-Latin", "pdf_span_boundary", 1.0), (4, "用A"): ("CJK-Latin", "translation_literal_space", 1.0),
        (5, "用A"): ("CJK-Latin", "protected_span_boundary", 1.0), (6, "3用"): ("number-CJK", "shaping_sidebearing", 1.0), (6, "用%"): ("CJK-percent", "translation_literal_space", 1.0), (8, "用A"): ("CJK-Latin", "shaping_sidebearing", 1.0),
    }


def test_a_blank_that_reaches_into_a_neighbour_is_not_between(spark):
    chars = [(1, 0, 1, 1, 0, "用", 0.0, 0.0, 5.0, 10.0, 0), (1, 0, 1, 1, 1, " ", 3.0, 0.0, 6.0, 10.0, 0), (1, 0, 1, 1, 2, "A", 7.0, 0.0, 9.0, 10.0, 0), (1, 0, 1, 1, 3, "\t", 9.0, 0.0, 10.0, 10.0, 0), (1, 0, 1, 1, 4, "用", 10.0, 0.0, 15.0, 10.0, 0)]
    got = gaps.visible_pairs(spark.createDataFrame(chars, CHAR))
    assert [(r.left, r.right, r.gap, r.parted) for r in got.orderBy("place").collect()] == [("用", "A", 2.0, False), ("A", "用", 1.0, False)]


def test_neighbours_of_formulas(spark):
    chars = spark.createDataFrame(line(1, "ab    ，c") + line(2, "far"), CHAR)
    formulas = spark.createDataFrame([(1, 0, 7, 14.0, 21.0, 33.0, 29.0), (1, 0, 8, 100.0, 500.0, 110.0, 510.0)], "doc_id long, page long, formula_id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.formula_id: (r.left_gap, r.right_gap, r.mark_follows) for r in gaps.around_formulas(formulas, chars).collect()}
    assert got == {7: (3.0, 3.0, True), 8: (None, None, False)}
    assert gaps.around_formulas(formulas, chars.where(F.lit(False))).count() == 2


def test_characters_of_formula_gaps_stay_with_their_document(spark):
    """Only texts are shuffled: neither characters nor what is found for formulas."""
    from vellum.plans import gap_queries

    plan = gap_queries.formula_gaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_columns_of_formulas_come_along(spark):
    chars = spark.createDataFrame(line(1, "ab    ，c"), CHAR)
    left = spark.createDataFrame([(1, 0, -8, 14.0, 21.0, 33.0, 29.0, "f"), (1, 0, -9, 100.0, 500.0, 110.0, 510.0, None)], "doc_id long, page long, own long, x0 double, y0 double, x1 double, y1 double, name string")
    out = candidates.neighbours(left, chars.withColumn("id", F.col("place")), gaps.PAGE, "own", "id", 0.5, 0.0, ["c"], keep=["name"])
    assert {(r.own, r.name) for r in out.collect()} == {(-8, "f"), (-9, None)}


def test_pairs_run_from_the_left_only(spark):
    """Frames that reach to a line's end cost its square; one order is sorted once."""
    chars = spark.createDataFrame(line(1, " 用 A\tb "), CHAR)
    pairs = gaps.visible_pairs(chars)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and plan.count("Sort [") == 1
    assert [(r.left, r.right, r.gap, r.parted, r.left_script, r.right_script) for r in pairs.orderBy("place").collect()] == [("用", "A", 7.0, True, "cjk", "latin"), ("A", "b", 7.0, False, "latin", "latin")]
