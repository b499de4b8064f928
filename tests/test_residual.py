"""Residue of the source language against plain Python, and rendered spans with ties and common beginnings."""

import re

from pyspark.sql import functions as F

from vellum.operators import residual as R

CJK = "[一-鿿㐀-䶿]"


def cleaned(t, patterns):
    for p in (*patterns, r"[0-9]+[.,]?[0-9]*", r"[^\w\s'’.-]"):
        t = re.sub(p, " ", t)
    return re.sub(r"\s+", " ", t).strip()


PLACE = r"\{\{[A-Z_0-9]+\}\}"


def plain_details(t):
    c = cleaned(t, (R.MODEL_NAMES, R.PROTECTED_NAMES, R.ADDRESSES, PLACE, r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)", R.CITATION_GROUP, r"et al\.?", r"\bal\.?,?\s*(?:19|20)\d{2}[a-z]?[\s;,]*", R.YEAR_LIST))
    found = [("long_run", r) for r in re.findall("[A-Za-z]{4,}", c) if len(r) >= 20]
    return found + ([("english_sentence", " ".join(c.split()[:16]))] if len(c.split()) >= 4 else [])


def plain_survivors(source, rendered, scoped):
    runs = [r for r in re.split(f"{CJK}+", rendered) if len(r.strip(" \t\r\n。，：；、！？（）()\"'‘’“”·•∙▪●")) >= 2]
    c = cleaned(source, (R.MODEL_NAMES, R.PROTECTED_NAMES, R.ADDRESSES, PLACE, R.CITATION_GROUP, R.YEAR_LIST))
    words = [w for w in c.split() if re.fullmatch(r"[A-Za-z'’.-]{2,}", w) and (scoped or w.lower() not in R.STOPWORDS)]
    low = " ".join(runs).lower()
    return sorted({w for w in words if re.search(rf"(?<![a-z0-9+]){re.escape(w)}(?![a-z0-9+])", low)})


TEXTS = [
    "The model where Qwen2.5-72B-Instruct-AWQ wins, and if (Bai et al., 2024b; Shao et al., 2024) holds", "internationalizationandmore words here now", "See https://a.b/c and Table 3. of 2021, 2022; but al., 2023 too", "", "{{FORMULA_B1}} where x", "únLi éTime élan ÇTable Li wie",
    "don't re-use state-of-the-art e.g. methods", "(no citation, 1999) yet and or", "short", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen",
]
RENDERED = ["模型 where 使用", "。•where：是 and or", "这里，and", "don't re-use", "prewhere +where where+", "", "Where AND if", "x", "使用 methods. e.g. 好", "one，two。three"]


def test_details_equal_plain_python(spark):
    real = [t for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for t in (r.text or "").split("\n")]
    texts = TEXTS + real
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.details(F.col("t")).alias("d"))
    for r in df.collect():
        assert [(d.type, d.text) for d in r.d] == plain_details(texts[r.i]), texts[r.i]
    assert [tuple(d) for d in spark.range(1).select(R.details(F.lit(None).cast("string")).alias("d")).first().d] == []


def test_survivors_equal_plain_python(spark):
    pairs = [(a, b) for a in TEXTS for b in RENDERED]
    for scoped in (True, False):
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, r string").select("i", R.surviving_words(F.col("s"), F.col("r"), scoped).alias("w"))
        got = {r.i: r.w for r in df.collect()}
        assert [got[i] for i in range(len(pairs))] == [plain_survivors(*p, scoped) for p in pairs]
    assert any(got.values())


SPAN = "doc_id long, page long, span_id long, text string, x0 double, y0 double, x1 double, y1 double"
REGION = "doc_id long, page long, region long, kind string, role string, owner string, source string, x0 double, y0 double, x1 double, y1 double"


def test_spans_by_place_then_by_content(spark):
    regions = [
        (1, 0, 0, "text", "body", "p0", "Attention is all that anyone needs in here", 0.0, 0.0, 100.0, 10.0), (1, 0, 1, "text", "heading", "p1", "Attention is all that anyone needs in here", 0.0, 5.0, 100.0, 15.0),
        (1, 0, 2, "formula", "formula", "f2", None, 0.0, 100.0, 100.0, 110.0), (1, 0, 3, "text", "body", "p3", "1 2", 0.0, 200.0, 100.0, 210.0), (1, 0, 4, "text", "body", "p4", "Learning rates decay with steps taken", 0.0, 300.0, 100.0, 310.0),
    ]
    spans = [
        (1, 0, 1, "anything", 0.0, 5.0, 50.0, 10.0),  # both regions by as much: the first
        (1, 0, 2, "anything", 0.0, 6.0, 50.0, 15.0),  # the second by more
        (1, 0, 3, "Attention, is ALL that", 500.0, 0.0, 510.0, 10.0),  # nowhere: the first paragraph with these words
        (1, 0, 4, "all that anyone", 0.0, 100.0, 10.0, 105.0),  # in a formula, which has no words: by content, role stays
        (1, 0, 5, "earning rates decay", 0.0, 200.0, 10.0, 205.0),  # in a paragraph without words; begins within a word
        (1, 0, 6, "short", 500.0, 0.0, 510.0, 10.0), (1, 1, 7, "Attention is all that", 0.0, 0.0, 10.0, 10.0),
    ]
    got = {r.span_id: (r.role, r.owner, r.by_content) for r in R.spans_to_regions(spark.createDataFrame(spans, SPAN), spark.createDataFrame(regions, REGION)).collect()}
    assert got == {1: ("body", "p0", False), 2: ("heading", "p1", False), 3: ("unmapped", "p0", True), 4: ("formula", "p0", True), 5: ("body", "p4", True), 6: ("unmapped", None, False), 7: ("unmapped", None, False)}


def test_common_beginnings_are_not_paired(spark):
    """2,000 texts that begin alike and 2,000 probes of the same beginning: a probe meets the text of its own ending alone."""
    n = 2000
    end = F.concat(F.lit(" zz"), F.lpad(F.conv(F.col("id").cast("string"), 10, 26), 6, "-"))
    word = F.translate(end, "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")
    t = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.concat(F.lit("the figure shows that results"), word).alias("text"), "id", F.col("id").cast("string").alias("owner"))
    found = R.first_containing(t.select("doc_id", "page", F.col("text").alias("probe")), t, "id", "owner")
    rows = found.join(t.withColumnRenamed("id", "own"), found.probe == t.text)
    assert rows.where("id <> own").isEmpty() and rows.count() == n
    hot = found._jdf.queryExecution()
    found.collect()
    assert "CartesianProduct" not in hot.executedPlan().toString() and "NestedLoop" not in hot.executedPlan().toString()


def test_prefixes_and_probes_are_made_once_and_pages_of_few_texts_need_no_index(spark):
    """A page of as many texts as are compared one by one, and one of more, against plain containment; the stored parts aren't made again."""
    word = lambda n: "".join("abcdefghij"[int(d)] for d in f"{n:03d}")
    for n in (3, R.FEW_TEXTS, R.FEW_TEXTS + 1):
        texts = [(1, 0, f"the common beginning {word(i % 50)} and {word(i)} ends", i, f"p{i}") for i in range(n)]
        asked = [f"common beginning {word(k)}" for k in (0, 1, 7, 49, 60)] + ["common beginning", f"and {word(n - 1)} ends", "nowhere at all here"]
        t = spark.createDataFrame(texts, "doc_id long, page long, text string, id long, owner string")
        p = spark.createDataFrame([(1, 0, a) for a in asked] + [(1, 5, asked[0]), (1, 0, None)], "doc_id long, page long, probe string")
        got = {(r.page, r.probe): r.owner for r in R.first_containing(p, t, "id", "owner").collect()}
        assert got == {(0, a): next(x[4] for x in texts if a in x[2]) for a in asked if any(a in x[2] for x in texts)}
    spans = spark.range(4).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("page"), F.col("id").alias("span_id"), F.lit("some words of a line").alias("text"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 9.0), ("y1", 9.0))))
    regions = spans.select("doc_id", "page", F.col("span_id").alias("region"), F.lit("text").alias("kind"), F.lit("body").alias("role"), F.lit("p").alias("owner"), F.col("text").alias("source"), "x0", "y0", "x1", "y1")
    plan = R.spans_to_regions(spans, regions)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "regexp_extract_all" not in plan


def test_words_are_made_once_and_names_are_tried_by_letters(spark):
    from vellum.plans import residual_queries as Q

    names = [n for n in re.sub(r"^\(\?i\)\\b\(\?:|\)\\b$", "", R.PROTECTED_NAMES).split("|")]
    said = [n.replace("\\.?", dot).replace("\\.", ".") for n in names for dot in ("", ".")]
    texts = [f"{a}{join}{b}" for a, b in zip(said, said[7:] + said[:7], strict=True) for join in ("", " ", "-", "s ", ".x")] + [s.upper() for s in said] + [s[:-1] for s in said]
    for t in texts:
        assert re.sub(R._NAMES, "_", t) == re.sub(R.PROTECTED_NAMES, "_", t), t
    plan = Q.surviving_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1
    plan = Q.residual_details(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Vanilla") == 1
