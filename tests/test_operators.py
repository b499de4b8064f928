"""Fixtures with known results for operators that the driver's tables don't exercise."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import formulas, gate, joins, layout, lifecycle, ownership, routing, sequence, stats, tables, translation


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit_box(*v):
    return tuple(F.lit(float(x)) for x in v)


def test_merge_touching(spark):
    df = spark.createDataFrame([(1, a, b) for a, b in ((0, 5), (4, 9), (12, 15), (15, 16))], "k int, lo int, hi int")
    got = sorted((r.lo, r.hi) for r in sequence.merge_intervals(df, ["k"], "lo", "hi").collect())
    assert got == [(0, 9), (12, 16)]


def test_complement_drops_short_pieces(spark):
    df = spark.createDataFrame([(1, 10, 20), (1, 20, 30), (1, 95, 100)], "k int, lo int, hi int")
    frames = spark.createDataFrame([(1, 0, 100)], "k int, frame_lo int, frame_hi int")
    got = sequence.complement(sequence.merge_intervals(df, ["k"], "lo", "hi"), frames, ["k"], "lo", "hi", 12).collect()
    assert [(r.free_lo, r.free_hi) for r in got] == [(30, 95)]


def test_complement_without_blocks_is_the_frame(spark):
    frames = spark.createDataFrame([(1, 0, 100)], "k int, frame_lo int, frame_hi int")
    none = spark.createDataFrame([], "k int, lo int, hi int")
    got = sequence.complement(sequence.merge_intervals(none, ["k"], "lo", "hi"), frames, ["k"], "lo", "hi").collect()
    assert [(r.free_lo, r.free_hi) for r in got] == [(0, 100)]


def test_table_type_and_rule_roles(spark):
    t = spark.createDataFrame([(1, 6, 3, 0, False), (2, 9, 4, 3, False), (3, 1, 0, 0, True), (4, 9, 0, 0, False)], "table_id int, n_texts int, n_h int, n_v int, has_image boolean")
    assert [r.table_type for r in tables.table_type(t).orderBy("table_id").collect()] == ["sparse_rule", "full_grid", "raster", "borderless"]
    r = spark.createDataFrame([(1, 10.0, 0.0), (1, 30.0, 0.0), (1, 90.0, 0.0), (2, 5.0, 0.0)], "k int, y0 double, x0 double")
    assert [x.role for x in tables.rule_roles(r, ["k"]).orderBy("k", "y0").collect()] == ["top", "header_separator", "bottom", "single"]


def test_small_overlap_is_no_collision(spark):
    assert not one(spark, G.collides(lit_box(0, 0, 10, 10), lit_box(9, 8, 20, 20)))
    assert one(spark, G.collides(lit_box(0, 0, 10, 10), lit_box(5, 5, 20, 20)))


def test_boxes(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 0, 15, 10)
    assert one(spark, G.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, G.contains(a, lit_box(-0.5, 0, 10, 10))) and not one(spark, G.contains(a, lit_box(-2, 0, 10, 10)))
    assert one(spark, G.same_box(a, lit_box(0.04, 0, 10, 10))) and not one(spark, G.same_box(a, lit_box(0.2, 0, 10, 10)))
    assert one(spark, G.rule_kind(lit_box(0, 0, 50, 1))) == "h_line"
    assert one(spark, G.iou(lit_box(0, 0, 0, 0), lit_box(0, 0, 0, 0))) == 0


def test_summary(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 2, 7)] + [(1, None)], "k int, v double")
    r = stats.summary(df, ["k"], "v").first()
    assert (r.sample_count, r["median"], r["mad"]) == (4, 2, 0.5) and r.p10 == pytest.approx(1.3)


def test_row_clusters(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((100.0, 106.0, 120.0))], "k int, id_ int, v double")
    got = {r.id_: r.cluster for r in sequence.cluster_1d(df, ["k"], "v", 7.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_line_joins(spark):
    assert one(spark, T.join_lines(F.lit("em-"), F.lit("bedding"))) == "embedding"
    assert one(spark, T.join_lines(F.lit("NLP-"), F.lit("based"))) == "NLP-based"
    assert one(spark, T.join_lines(F.lit("a"), F.lit("b"))) == "a b"


def test_missing_tokens_are_restored_once(spark):
    src, out = F.lit("a {{FORMULA_B1}} b {{FORMULA_B2}}"), F.lit("x {{FORMULA_B1}} y")
    got = one(spark, translation.restore_missing(src, out))
    assert got.count("{{FORMULA_B1}}") == 1 and got.count("{{FORMULA_B2}}") == 1
    assert one(spark, translation.placeholder_loss(src, out)) == ["{{FORMULA_B2}}"]


PAGES = [(1, 0, "", False, 0.0), (1, 1, "References", False, 0.2), (1, 2, "", False, 0.1), (1, 3, "", True, 0.0)]
STATES = [("normal_body", True), ("references", False), ("references", True), ("normal_body", False)]


def test_document_states(spark):
    df = spark.createDataFrame(PAGES, "doc_id long, page long, heading string, numbered_section boolean, reference_density double")
    assert [(r.state, r.inherited) for r in sequence.document_states(df).orderBy("page").collect()] == STATES


def test_document_states_as_a_stream(spark, tmp_path):
    from vellum.streaming.states import document_state_stream

    schema = "doc_id long, page long, heading string, numbered_section boolean, reference_density double"
    spark.createDataFrame(PAGES, schema).write.parquet(str(tmp_path / "in"))
    q = document_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r.state, r.inherited) for r in spark.table("states").orderBy("page").collect()] == STATES
    finally:
        q.stop()


def test_states_of_silent_documents_are_given_up(spark, tmp_path):
    import datetime

    from vellum.streaming.states import document_state_stream

    schema = "doc_id long, page long, heading string, numbered_section boolean, reference_density double, at timestamp"
    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [[(1, 0, "References", False, 0.0, hour(0)), (2, 0, "References", False, 0.0, hour(0))], [(1, 1, None, False, 0.0, hour(0.5)), (3, 0, None, False, 0.0, hour(10))], [(4, 0, None, False, 0.0, hour(20))], [(1, 2, None, False, 0.0, hour(20))]]
    folder = tmp_path / "in"
    folder.mkdir()
    pages = spark.readStream.schema(schema).parquet(str(folder)).withWatermark("at", "1 minute")
    q = document_state_stream(pages, 3_600_000, "at").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        got = {(r.doc_id, r.page): r.state for r in spark.table("silent").collect()}
        assert got == {(1, 0): "references", (2, 0): "references", (1, 1): "references", (3, 0): "normal_body", (4, 0): "normal_body", (1, 2): "normal_body"}
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    finally:
        q.stop()


@pytest.mark.parametrize("word", "article(i.e., example(e.g., method(s) model(s) result(s) section(s) reference(s) image(s) paper(s) function(s) condition(s)".split())
def test_words_are_not_protected(word):
    letter = word.split("(")[0][-1]
    assert letter not in routing.protect(word)[1].values()


@pytest.mark.parametrize("text, want", [("f(x)", "f"), ("g(x)", "g"), ("h(t)", "h"), ("sin(x)", "sin"), ("log(x)", "log"), ("softmax(x)", "softmax"), ("L(x)", "L"), ("H(X)", "H"), ("f_i(x)", "f_i"), ("g_θ(x)", "g_θ")])
def test_atoms_are_protected(text, want):
    template, mapping = routing.protect(text)
    assert want in mapping.values()
    back = template
    for k, v in mapping.items():
        back = back.replace(k, v)
    assert back == text


CASES = [
    ("R", "FORMULA 表示速率", "FORMULA 表示速率", False),
    ("x", "{{MATH_TOKEN_001}} 是值", "x 是值", True),
    ("x", "{{MATH_TOKEN_001}} {{MATH_TOKEN_001}} 是值", "x x 是值", False),
]


@pytest.mark.parametrize("value, output, restored, valid", CASES)
def test_validator(spark, value, output, restored, valid):
    df = spark.createDataFrame([("s", {"{{MATH_TOKEN_001}}": value}, output, restored)], "source_text string, mapping map<string,string>, protected_output string, restored string")
    assert routing.validate(df).first().valid is valid


@pytest.mark.parametrize("output", ["{{MATH_TOKEN_002}} 和 {{MATH_TOKEN_001}} 是值", "{{MATH_TOKEN_001}} 和 是值"])
def test_validator_order_and_loss(spark, output):
    df = spark.createDataFrame([("s", {"{{MATH_TOKEN_001}}": "a", "{{MATH_TOKEN_002}}": "b"}, output, "a 和 b 是值")], "source_text string, mapping map<string,string>, protected_output string, restored string")
    assert routing.validate(df).first().valid is False


STAGES = [f"s{i}" for i in range(11)]


@pytest.mark.parametrize("broken, verdict", [(None, "pass"), ("error", "blocked"), ("missing", "blocked")])
def test_fail_closed(spark, broken, verdict):
    rows = [(1, s, "pass") for s in STAGES[:-1]] + ([(1, STAGES[-1], broken or "pass")] if broken != "missing" else [])
    ex = spark.createDataFrame(rows, "page int, stage string, status string")
    m = gate.manifest(ex, spark.createDataFrame([(1,)], "page int"), STAGES, ["page"]).withColumn("doc", F.lit(1))
    assert gate.integrity(m, ["doc"], ["page"]).first().integrity == verdict
    assert gate.integrity(m, ["doc"], ["page"], expected_pages=2).first().integrity == "blocked"
    assert gate.decide(gate.layers(m, ["doc"], STAGES), ["doc"]).first().decision == verdict


def test_grid_resolution(spark):
    local = spark.createDataFrame([(1, 0, "single_column", "suspect"), (1, 1, "front_matter", "suspect"), (1, 2, "two_column", "suspect"), (1, 3, "two_column", "valid")], "doc_id int, page int, mode string, status string")
    sure = spark.createDataFrame([(1, 2, 0.9)], "doc_id int, n_columns int, confidence double")
    assert [r.source for r in layout.resolve_grid(local, sure).orderBy("page").collect()] == ["page_local", "page_local", "document_profile", "page_local"]
    unsure = spark.createDataFrame([(1, 2, 0.5)], "doc_id int, n_columns int, confidence double")
    assert [r.source for r in layout.resolve_grid(local, unsure).orderBy("page").collect()][2] == "unresolved"


def test_recovery_policies(spark):
    """Lives of formulas and what may be done for them: whole, doubly owned, orphans with and without evidence, lost crops, assets and places."""
    base = dict(status="incomplete", stage=None, double_owned=0, reattachable=False, duplicate_embed=0, embed_missing=0, svg_missing=0, viewbox_crops=0, model_exists=False, all_ink=False)
    cases = [
        (dict(status="complete", double_owned=9), "NO_ACTION"), (dict(status=None), "NO_ACTION"), (dict(double_owned=1), "BLOCK_UNSAFE"), (dict(status="orphan", reattachable=True), "READOPT_ORPHAN_FRAGMENT"),
        (dict(status="ownership_error"), "BLOCK_UNSAFE"), (dict(stage="embedding", all_ink=True, duplicate_embed=1), "BLOCK_UNSAFE"), (dict(stage="embedding", all_ink=True, embed_missing=1), "REEMBED_EXISTING_SVG"),
        (dict(stage="svg_generation", model_exists=True, embed_missing=1, svg_missing=1), "BLOCK_UNSAFE"), (dict(stage="svg_generation", viewbox_crops=2, model_exists=True), "REBUILD_VIEWBOX"),
        (dict(stage="svg_generation", model_exists=True), "REGENERATE_SVG_FROM_EXISTING_MODEL"), (dict(stage="final_pdf", all_ink=True), "REEMBED_EXISTING_SVG"), (dict(stage="final_pdf"), "BLOCK_UNSAFE"), (dict(stage="detection", model_exists=True), "BLOCK_UNSAFE"),
    ]
    schema = "status string, stage string, double_owned int, reattachable boolean, duplicate_embed int, embed_missing int, svg_missing int, viewbox_crops int, model_exists boolean, all_ink boolean"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).coalesce(1)
    assert [r[0] for r in df.select(lifecycle.recovery()).collect()] == [p for _, p in cases]


def test_adopted_kinds_and_placeholders(spark):
    want = {" ( 12 ) ": "equation_number", "(1234)": "ordinary_natural_language", "Where,": "condition_word", "correctly   supports.": "condition_word", "we show": "ordinary_natural_language", None: "ordinary_natural_language"}
    assert [one(spark, lifecycle.adopted_kind(F.lit(k).cast("string"))) for k in want] == list(want.values())
    p = spark.createDataFrame([(1, "a {{FORMULA_F1}} b {{FORMULA_F1}}"), (1, "{{FORMULA_F2}}")], "doc_id int, text string")
    f = spark.createDataFrame([(1, "F1"), (1, "F2"), (1, "F3")], "doc_id int, formula string")
    assert {r.formula: r.occurrences for r in lifecycle.placeholder_occurrences(p, f, ["doc_id"]).collect()} == {"F1": 2, "F2": 1, "F3": 0}


def test_typographic_roles(spark):
    cases = [("heading", "4 Method", "section_heading"), ("heading", "4.3 Setup", "subsection_heading"), ("heading", "D.1.1 More", "subsubsection_heading"), ("heading", "{{BOLD_0}}摘要{{END_BOLD_0}}", "abstract_heading"), ("heading", "4方法", "section_heading"), ("heading", "no number", "subsection_heading"), ("caption", "Figure 1", "caption"), ("footer", "x", "footnote"), (None, "plain", "body"), ("body", "[3] A study of 2019. x", "reference"), ("bibliography_item", "x", "reference")]
    for style, text, role in cases:
        assert one(spark, T.text_role(F.lit(style).cast("string"), F.lit(text), F.lit(text), F.lit(False), F.lit(None).cast("string"))) == role
    assert one(spark, T.model_text(F.lit(" a {{BOLD_1}}b{{END_BOLD_1}}  {{FORMULA_F1}} "))) == "a b □"
    assert [one(spark, T.span_script(F.lit(t))) for t in ("中1", "中", "a1", "12", "—")] == ["mixed", "cjk", "latin", "number", "punct"]
    assert one(spark, T.connective_tokens(F.lit("A, and B; Where and if."))) == ["and", "where"]
    assert one(spark, T.clean_heading(F.lit("{{BOLD_0}}A 综述生成中的信息瓶颈{{END_BOLD_0}} {{BOLD_1}}生成{{END_BOLD_1}}"))) == "{{BOLD_0}}综述生成中的信息瓶颈{{END_BOLD_0}}" and one(spark, T.clean_heading(F.lit("{{BOLD_0}}方法{{END_BOLD_0}}"))) == "{{BOLD_0}}方法{{END_BOLD_0}}"
    fonts = lambda *f: F.array(*map(F.lit, f))
    assert one(spark, T.is_code_expression(F.lit("layers = 6"), fonts("Times"))) and not one(spark, T.is_code_expression(F.lit("layers = 6"), fonts("Times", "CMMI10"))) and not one(spark, T.is_code_expression(F.lit("a + b"), fonts("Times")))


def test_author_lines_are_references(spark):
    for text, want in (("Jane Doe, John Roe, and Max Mustermann. 2020. A title.", True), ("Jane Doe 1 Big State University, 2019. Report", True), ("The limits of current methods are known (Wang et al., 2024)", False), ("", False)):
        assert one(spark, translation.is_reference(F.lit(text))) == want


def test_page_and_density_classes(spark):
    r = "front_matter boolean, paragraphs int, references int, appendix_headings int, tables int, figures int, formulas int, full_width_tables int, full_width_figures int, substantive_0 int, substantive_1 int, grid_columns int, has_gutter boolean"
    cases = [((True, 9, 9, 0, 0, 0, 0, 0, 0, 1, 1, 2, True), "front_matter_two_column"), ((False, 6, 3, 0, 0, 0, 0, 0, 0, 1, 1, 2, True), "reference_dense"), ((False, 7, 3, 0, 0, 0, 0, 0, 0, 1, 1, 2, True), "standard_two_column"), ((False, 30, 7, 0, 0, 0, 0, 0, 0, 1, 1, 2, True), "reference_dense"), ((False, 4, 0, 0, 0, 1, 0, 0, 0, 1, 1, 2, True), "single_column"), ((False, 9, 0, 1, 1, 0, 0, 1, 0, 1, 1, 2, True), "full_width_table_plus_two_column"), ((False, 9, 0, 1, 1, 0, 0, 0, 0, 1, 1, 2, True), "appendix_dense"), ((False, 9, 0, 0, 1, 1, 1, 0, 0, 1, 1, 2, True), "mixed_layout"), ((False, 9, 0, 0, 0, 0, 0, 0, 0, 1, 0, 2, True), "standard_two_column"), ((False, 9, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, False), "single_column")]
    df = spark.createDataFrame([c for c, _ in cases], r).coalesce(1)
    assert [x.page_class for x in layout.page_class(df).collect()] == [c for _, c in cases]
    kinds = {0: ["formula"] * 8, 1: ["formula"], 2: ["table", "image"], 3: ["figure", "figure"], 4: ["text"], 5: ["formula", "figure"]}
    d = spark.createDataFrame([(1, p, k, None) for p, ks in kinds.items() for k in ks] + [(1, 6, "table", "references")], "doc_id int, page int, kind string, semantic_role string")
    assert [x.density_class for x in layout.density_class(d).orderBy("page").collect()] == ["formula_dense", "formula_dense", "mixed_content", "figure_dense", "text_only", "mixed_content", "reference_dense"]


def test_box_join_by_strips_is_whole(spark):
    import random

    rng = random.Random(3)
    boxes = [(1, i, x := rng.uniform(0, 100), y := rng.uniform(0, 100), x + rng.uniform(1, 30), y + rng.uniform(1, 30)) for i in range(60)]
    df = spark.createDataFrame(boxes, "k int, id int, x0 double, y0 double, x1 double, y1 double")
    plain = sorted((r.l_id, r.r_id) for r in joins.box_join(df, df, ["k"]).collect())
    strips = sorted((r.l_id, r.r_id) for r in joins.box_join(df, df, ["k"], bucket=7.0).collect())
    assert plain == strips and len(plain) == len(set(plain))


def test_drop_subsets_keeps_one_of_equals(spark):
    df = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [1, 2]), (1, 3, [2]), (1, 4, [3])], "k int, b int, items array<int>")
    assert sorted(r.b for r in ownership.drop_subsets(df, ["k"], "b", "items").collect()) == [1, 4]


def test_translate_reports_failed_batches(spark):
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(4)], "item_id int, source_text string").coalesce(1)
    got = {r.item_id: (r.translation, r.error) for r in translation.translate(df, call, batch=2).collect()}
    assert got[0] == ("OK", None) and got[3][0] is None and "RuntimeError" in got[3][1]


def test_reference_items(spark):
    assert one(spark, translation.is_reference(F.lit("Yushi Bai, Jiajie Zhang, and Li Wang. 2024. A title.")))
    assert not one(spark, translation.is_reference(F.lit("The limitations of currently available methods (Wang et al., 2024).")))


def test_library_does_not_import_the_training_data_package():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "vellum"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"vellum\.llm|from \.+llm|import llm", f.read_text()), f


def test_clusters_equal_a_plain_fold(spark):
    """Nulls, ties, values a tolerance apart, and runs that go on over Arrow batches."""
    import random

    from vellum.operators import sequence

    rng = random.Random(3)
    rows = [(g, i, rng.choice((None, rng.uniform(0, 40), float(rng.randrange(0, 40, 2))))) for i, g in enumerate(rng.choice((1, 2, 3)) for _ in range(600))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "k int, id_ int, v double").repartition(3)
        got = {r.id_: r.cluster for r in sequence.cluster_1d(df, ["k"], "v", 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2, 3):
        total = n = 0
        cluster = -1
        for v, i in sorted((v, i) for g, i, v in rows if g == k and v is not None):
            if n and v - total / n <= 2.0:
                total, n = total + v, n + 1
            else:
                total, n, cluster = v, 1, cluster + 1
            assert got[i] == cluster
    assert all(got[i] == -1 for _, i, v in rows if v is None)
