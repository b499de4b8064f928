"""Gaps between characters of unlike scripts: neighbours on a line, what kind of seam they make, and where its width comes from.

chars(doc_id, page, paragraph, line, place, c, x0, y0, x1, y1, span): one row a character; ``place`` tells equal boxes apart.
paragraphs(doc_id, page, paragraph, translation, context): the text that was set, and the markup that it was set from. All
steps are windows over a line's characters and one join by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import candidates

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "line"]
#: How far a blank may reach into its neighbours and still lie between them.
SLACK = 0.2
WRAPPERS = "protected-token|code-run"


def visible_pairs(chars: DataFrame) -> DataFrame:
    """Each visible character with the next on its line, from left to right: left, right, their scripts and spans, the gap, and whether
    a blank lies between them. All windows run from the left, in one order: the work is linear in a line's characters."""
    order = Window.partitionBy(*LINE).orderBy("x0", "y0", "place")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.col("c").rlike(r"\S"), F.lit(False))
    own = F.struct("c", "script_", "x1", "span", "place", "paragraph")
    rows = chars.withColumn("seen_", seen).where(F.col("seen_") | (F.col("c") == " ")).withColumn("script_", F.when(F.col("seen_"), T.script_of(F.col("c"))))
    carried = rows.withColumns({"nth_": F.count_if("seen_").over(so_far), "left_": F.last(F.when(F.col("seen_"), own), ignorenulls=True).over(before)})
    # of the blanks behind the last visible character that don't reach into it, the one that ends first
    blank = ~F.col("seen_") & (F.col("x0") >= F.col("left_.x1") - SLACK) & F.col("x1").isNotNull()
    ends = F.min(F.when(blank, F.struct((-F.col("nth_")).alias("n"), "x1"))).over(before)
    pairs = carried.withColumn("blank_", ends).where("seen_ and left_ is not null")
    parted = F.coalesce((F.col("blank_.n") == 1 - F.col("nth_")) & (F.col("blank_.x1") <= F.col("x0") + SLACK), F.lit(False))
    return pairs.select(
        *PAGE, "left_.paragraph", "line", "left_.place", F.col("left_.c").alias("left"), F.col("c").alias("right"), F.col("left_.script_").alias("left_script"), F.col("script_").alias("right_script"),
        F.col("left_.span").alias("left_span"), F.col("span").alias("right_span"), (F.col("x0") - F.col("left_.x1")).alias("gap"), parted.alias("parted"),
    )


def gap_class(left: Column, right: Column, left_script: Column, right_script: Column) -> Column:
    """The kind of a seam, by both characters and their scripts; null within a script."""
    names = {"cjk": "CJK", "latin": "Latin", "number": "number"}
    out = None
    for p, q in (("cjk", "latin"), ("latin", "cjk"), ("cjk", "number"), ("number", "cjk")):
        test = (left_script == p) & (right_script == q)
        out = F.when(test, f"{names[p]}-{names[q]}") if out is None else out.when(test, f"{names[p]}-{names[q]}")
    return out.when(((left_script == "cjk") & right.isin("%", "％")) | (left.isin("%", "％") & (right_script == "cjk")), "CJK-percent")


def script_gaps(chars: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pairs at a seam of scripts, with the gap's cause: a blank that was set, the edge of a protected run, the edge of a span, or
    the shapes of the glyphs."""
    seams = visible_pairs(chars).where("left_script <> right_script")
    p = seams.withColumn("gap_class", gap_class(*map(F.col, ("left", "right", "left_script", "right_script")))).where("gap_class is not null").drop("left_script", "right_script")
    # what is wrapped is made bare once a paragraph, not at each of its seams
    context = F.coalesce("context", F.lit(""))
    said = paragraphs.select(
        *PAGE, "paragraph", F.regexp_replace(F.coalesce("translation", F.lit("")), r"\{\{[^}]+\}\}", "").alias("set_"), F.when(context.rlike(WRAPPERS), F.regexp_replace(context, "<[^>]+>", "")).alias("bare_")
    )
    j = p.join(said, [*PAGE, "paragraph"], "left")
    a, b = F.col("left"), F.col("right")
    spaced = F.contains(F.col("set_"), F.concat(a, F.lit(" "), b)) | F.contains(F.col("set_"), F.concat(a, F.lit("  "))) & F.regexp_like(F.col("set_"), F.concat(F.lit(r"\Q"), a, F.lit(r"\E +\Q"), b, F.lit(r"\E")))
    wrapped = F.contains(F.col("bare_"), F.concat(a, b))
    cause = F.when(F.col("parted") | F.coalesce(spaced, F.lit(False)), "translation_literal_space").when(F.coalesce(wrapped, F.lit(False)), "protected_span_boundary").when(~F.col("left_span").eqNullSafe(F.col("right_span")), "pdf_span_boundary").otherwise("shaping_sidebearing")
    return j.select(*p.columns, cause.alias("cause"))


def around_formulas(formulas: DataFrame, chars: DataFrame) -> DataFrame:
    """formulas(doc_id, page, formula_id, box) on a line: the gaps to the last visible character before and the first after that share
    their height, and whether a mark follows. Neighbours are searched outward from the formula's place, without pairs."""
    seen = chars.where(F.col("c").rlike(r"\S")).select(*PAGE, F.col("place").alias("id_"), "c", "x0", "y0", "x1", "y1")
    own = formulas.select(*PAGE, (-F.col("formula_id") - 1).alias("own_"), "x0", "y0", "x1", "y1", F.col("x0").alias("x0_"), F.col("x1").alias("x1_"))
    near = candidates.neighbours(own, seen, PAGE, "own_", "id_", slack=0.5, band=0.0, carry=["c", "x0", "x1"], keep=["x0_", "x1_"])
    mark = F.coalesce(F.col("after_c").rlike(r"[，。、；：！？,.;:!?)）]"), F.lit(False)).alias("mark_follows")
    return near.select(*PAGE, (-F.col("own_") - 1).alias("formula_id"), (F.col("x0_") - F.col("before_x1")).alias("left_gap"), (F.col("after_x0") - F.col("x1_")).alias("right_gap"), mark)
