"""Bounds of the flow, layout profiles and rendered headings on small pages."""

from vellum.operators import bounds

REGION = "doc_id long, page long, kind string, role string, semantic_role string, column int, text string, y0 double, y1 double"


def test_flow_between_head_and_foot(spark):
    rows = [
        (1, 0, "text", "body", None, None, "Running head", 10.0, 30.0), (1, 0, "text", "body", None, 0, "Body", 80.0, 300.0), (1, 0, "figure", None, None, None, None, 60.0, 200.0), (1, 0, "text", "body", None, None, "12 / 30", 750.0, 760.0),
        (1, 1, "text", "body", None, 0, "Body", 5.0, 50.0), (1, 1, "text", "caption", None, 0, "Not flow", 0.0, 790.0), (1, 1, "text", "body", "footer", 0, "foot", 700.0, 710.0), (1, 3, "formula", None, None, None, None, 1.0, 2.0),
    ]
    pages = spark.createDataFrame([(1, p, 792.0, 40.0, 600.0) for p in range(4)], "doc_id long, page long, height double, frame_y0 double, frame_y1 double")
    got = {r.page: (r.flow_y0, r.flow_y1) for r in bounds.content_bounds(spark.createDataFrame(rows, REGION), pages).collect()}
    assert got == {0: (60.0, 750.0), 1: (5.0, 700.0), 2: (40.0, 600.0), 3: (40.0, 600.0)}


def test_layout_profile(spark):
    two = [(1, p, 612.0, 70.0, 540.0, 70.0, 290.0 + p, 306.0, 540.0) for p in range(3)]
    got = bounds.layout_profile(spark.createDataFrame([*two, (1, 3, 612.0, 60.0, 550.0, None, None, None, None)], "doc_id long, page long, width double, frame_x0 double, frame_x1 double, left_x0 double, left_x1 double, right_x0 double, right_x1 double")).first()
    assert (got.pages, got.two_column_pages, got.single_column_pages, got.gutter, got.left_margin, got.right_margin, got.left_x1) == (4, 3, 1, 15.0, 70.0, 72.0, 291.0)
    assert got.gutters == {0: 16.0, 1: 15.0, 2: 14.0}


def test_headings_are_found_near_or_by_number(spark):
    heads = spark.createDataFrame([(1, 0, 1, "2.1 Data", 72.0, 100.0, 200.0, 112.0), (1, 0, 2, "results", 306.0, 100.0, 400.0, 112.0), (1, 0, 3, "3 Model", 72.0, 300.0, 200.0, 312.0), (1, 1, 4, "2.1 Data", 72.0, 100.0, 200.0, 112.0)], "doc_id long, page long, heading long, text string, x0 double, y0 double, x1 double, y1 double")
    lines = [(1, 0, 10, "2.1 数据", 85.0, 240.0), (1, 0, 11, "2.2 其他", 72.0, 106.0), (1, 0, 12, "x" * 61, 306.0, 106.0), (1, 0, 13, "结果", 318.0, 130.0), (1, 0, 14, "也", 306.0, 82.0 + 12), (1, 0, 15, "3 模型", 72.0, 480.0), (1, 0, 16, "3 远", 93.0, 306.0)]
    got = {r.heading: (r.line, r.fallback) for r in bounds.locate_headings(heads, spark.createDataFrame(lines, "doc_id long, page long, line long, text string, x0 double, y double")).collect()}
    assert got == {1: (10, True), 2: (14, False), 3: (None, False), 4: (None, False)}
