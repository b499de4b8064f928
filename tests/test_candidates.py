"""Neighbours on a line against all pairs, and the two passes of the candidate filter."""

import random

from pyspark.sql import functions as F

from vellum.operators import candidates

BOX = "k long, id long, x0 double, y0 double, x1 double, y1 double"


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(320):
        x, y = float(rng.randrange(60)), float(rng.randrange(6))
        rows.append((rng.choice((1, 2, 3, None)), i, x, y, x + rng.randrange(0, 6), y + rng.randrange(1, 7)))
    rows += [(1, 900 + i, None, 0.0, 1.0, 9.0) for i in range(2)]
    want = []
    for a in rows:
        if a[0] is None or a[2] is None:
            continue
        fit = [b for b in rows if b[0] == a[0] and b[1] != a[1] and b[2] is not None and b[3] < a[5] - 1 and b[5] > a[3] + 1]
        before = min(((-b[4], b[1]) for b in fit if b[4] <= a[2] + 2), default=(0, None))[1]
        after = min(((b[2], b[1]) for b in fit if b[2] >= a[4] - 2), default=(0, None))[1]
        want.append((a[1], before, after))
    df = spark.createDataFrame(rows, BOX).repartition(4)
    assert sorted(map(tuple, candidates.neighbours(df, df, ["k"], "id", "id").select("id", "before", "after").collect())) == sorted(want)
    assert {(r.before, r.after) for r in candidates.neighbours(df, df.limit(0), ["k"], "id", "id").collect()} == {(None, None)}


SPAN = "doc_id long, page long, ordinal long, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"


def line(y, *words):
    """(text, font) side by side."""
    return [(1, 0, int(y * 100) + i, t, f, 10.0, 20.0 * i, y, 20.0 * i + 12, y + 10) for i, (t, f) in enumerate(words)]


def test_passes_of_the_filter(spark):
    plain = "Times"
    rows = (
        line(100.0, ("LLM", plain), ("×", plain), ("Reduce", plain))  # a sign between words
        + line(120.0, ("x", "CMMI10"), ("×", plain), ("y", "CMMI10"), ("3", plain))  # mathematics; its number stays
        + line(140.0, ("Section", plain), ("3", plain))  # a number on a line of words
        + line(160.0, ("•", plain), ("[1, 2]", plain), ("α", plain))
        + line(780.0, ("7", plain), ("β", plain))  # a page's number
    )
    s = candidates.true_candidates(candidates.segmented(spark.createDataFrame(rows, SPAN)))
    got = {(r.y0, r.text): (r.candidate, r.kept_first, r.kept) for r in s.collect()}
    assert got[100.0, "×"] == (True, False, False) and got[100.0, "LLM"] == (False, False, False)
    assert all(got[120.0, t] == (True, True, True) for t in ("x", "×", "y", "3"))
    assert got[140.0, "3"] == (True, True, False)
    assert not got[160.0, "•"][1] and not got[160.0, "[1, 2]"][2] and got[160.0, "α"] == (True, True, True)
    assert got[780.0, "7"] == (True, False, False)


def test_context_leaves_out_the_block_itself(spark):
    rows = line(100.0, ("x", "CMMI10"), ("words", "Times"), ("(3)", "Times")) + line(111.0, ("below", "Times")) + line(300.0, ("far", "Times"))
    s = candidates.true_candidates(candidates.segmented(spark.createDataFrame(rows, SPAN)))
    block = spark.createDataFrame([(1, 0, "b", 10_000)], "doc_id long, page long, block string, ordinal long")
    got = candidates.block_context(block, s).first()
    assert (got.runs, got.band_width, got.plain_width, got.x1) == (2, 24.0, 24.0, 52.0)


def test_segments_of_blocks(spark):
    """A clean display block is one piece; one with foreign words, and one that isn't displayed, is cut into rows; a row that shares
    height goes on."""
    m = lambda block, i, x, y: (1, 0, block, i, x, y, x + 10, y + 10)
    parts = [m("clean", 1, 10.0, 100.0), m("clean", 2, 10.0, 120.0), m("mixed", 3, 10.0, 200.0), m("mixed", 4, 10.0, 220.0), m("inline", 5, 10.0, 300.0), m("inline", 6, 24.0, 304.5), m("inline", 7, 80.0, 309.0), m("crossed", 8, 10.0, 400.0), m("crossed", 9, 10.0, 420.0), m("other", 10, 12.0, 412.0)]
    box = "x0 double, y0 double, x1 double, y1 double"
    members = spark.createDataFrame(parts, f"doc_id long, page long, block string, ordinal long, {box}")
    spans = [(1, 0, i, "x", "CMMI10", True, True, *b) for _, _, _, i, *b in parts] + [(1, 0, 90, "word", "Times", False, False, 12.0, 212.0, 18.0, 218.0), (1, 0, 91, " ", "Times", False, False, 12.0, 112.0, 18.0, 118.0)]
    s = spark.createDataFrame(spans, f"doc_id long, page long, ordinal long, text string, font string, candidate boolean, kept boolean, {box}")
    blocks = members.groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("is_display", F.col("block") != "inline")
    got = candidates.render_segments(blocks, members.select("doc_id", "page", "block", "ordinal"), s)
    assert {(r.block, r.segment): (r.n_spans, r.x0, r.y0, r.x1, r.y1) for r in got.collect()} == {
        ("clean", 0): (2, 10.0, 100.0, 20.0, 130.0), ("mixed", 0): (1, 10.0, 200.0, 20.0, 210.0), ("mixed", 1): (1, 10.0, 220.0, 20.0, 230.0), ("inline", 0): (2, 10.0, 300.0, 34.0, 314.5), ("inline", 1): (1, 80.0, 309.0, 90.0, 319.0),
        ("crossed", 0): (1, 10.0, 400.0, 20.0, 410.0), ("crossed", 1): (1, 10.0, 420.0, 20.0, 430.0), ("other", 0): (1, 12.0, 412.0, 22.0, 422.0),
    }


def test_candidates_take_no_shuffle_of_words(spark):
    """Texts are dealt once, as whole documents; words aren't."""
    from vellum.operators import synth

    docs = spark.createDataFrame([(i, "a × b 12 α " * (1 + i % 40)) for i in range(200)], "doc_id long, text string")
    df = candidates.true_candidates(candidates.segmented(synth.spans(docs).withColumn("font", F.lit("Times"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert df.count() == sum(5 * (1 + i % 40) for i in range(200))


def test_words_without_a_box_or_key_are_never_framed(spark):
    row = lambda page, y1: [(1, page, i, t, "Times", 10.0, 20.0 * i, 5.0, 20.0 * i + 12, y1) for i, t in enumerate(("word", "×", "word"))]
    s = candidates.true_candidates(candidates.segmented(spark.createDataFrame(row(0, 15.0) + row(None, 15.0) + row(2, None), SPAN)))
    assert sorted((r.page is None, r.page) for r in s.where("kept").collect()) == [(False, 2), (True, None)]


def test_neighbours_by_key_bring_columns_along(spark):
    rng = random.Random(4)
    rows = [(rng.choice((1, 2, None)), i, x := float(rng.randrange(50)), y := float(rng.randrange(6)), x + rng.randrange(6), y + rng.randrange(1, 7)) for i in range(200)]
    df = spark.createDataFrame(rows, BOX)
    some = df.where("id % 5 = 0").withColumn("x0", F.col("x0") + 0.5)
    named = df.withColumn("c", F.col("id").cast("string"))
    plain, both, by_key = (sorted(map(tuple, candidates.neighbours(some, named, ["k"], "id", "id", carry=c, grouped=g).collect())) for c, g in (((), False), (["c", "x1"], False), (["c", "x1"], True)))
    end = {r[1]: (str(r[1]), r[4]) for r in rows} | {None: (None, None)}
    assert both == by_key == [(*r, *end[r[2]], *end[r[3]]) for r in plain]


def test_members_that_bring_their_columns_are_not_looked_up(spark):
    s = spark.createDataFrame([(1, 0, 12.0 * (i // 5), 1, i, ("x", "α", "12")[i % 3], "Times", 10.0, 20.0 * (i % 5), 20.0 * (i % 5) + 15, 12.0 * (i // 5) + 10, i % 3 > 0, i % 3 == 1) for i in range(20)],
        "doc_id long, page long, y0 double, segment long, ordinal long, text string, font string, size double, x0 double, x1 double, y1 double, candidate boolean, kept boolean")
    members = s.where("kept").withColumn("block", F.floor(F.col("ordinal") / 7))
    blocks = members.groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("is_display", F.col("block") == 1)
    bare = members.select("doc_id", "page", "block", "ordinal")
    for of in (lambda m: candidates.block_context(m, s), lambda m: candidates.render_segments(blocks, m, s)):
        short, long = of(members), of(bare)
        joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (short, long)]
        assert joins[0] < joins[1]
        assert sorted(map(tuple, short.select(sorted(short.columns)).collect())) == sorted(map(tuple, long.select(sorted(short.columns)).collect()))
