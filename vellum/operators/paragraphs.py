"""Lines to paragraphs: reading columns, paragraph breaks with heading state, continuation across columns and pages, front matter, semantic roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import sequence

PAGE = ["doc_id", "page"]


def column_of(x0: Column, x1: Column, page_width: Column | float, two: Column, full: float = 0.55) -> Column:
    """-1 for a line wider than ``full`` of the page that crosses its centre, else 0 or 1; 0 on a page of one column."""
    width, mid = F.lit(page_width) if isinstance(page_width, int | float) else page_width, None
    mid = width / 2
    return F.when(~two, 0).when((x1 - x0 > full * width) & (x0 < mid) & (x1 > mid), -1).when((x0 + x1) / 2 < mid, 0).otherwise(1)


def page_columns(lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Two columns if lines lie on both sides of the page's centre."""
    c = (F.col("x0") + F.col("x1")) / 2
    two = lines.groupBy(*PAGE).agg((F.bool_or(F.col("x1") < page_width / 2) & F.bool_or(F.col("x0") > page_width / 2) & (F.count_if(c > page_width / 2) > 0)).alias("two"))
    j = lines.join(two, PAGE)
    return j.withColumn("column", column_of(F.col("x0"), F.col("x1"), page_width, F.col("two"))).drop("two")


def merge_lines(lines: DataFrame, body_size: float = 10.0) -> DataFrame:
    """lines(doc_id, page, column, ordinal, text, box, size, bold) to paragraphs. A new one begins at a gap of 1.6 line
    heights or more, or where the heading flag flips. A bold line right below a heading (gap under 1.8 heights) inherits the
    flag: the flag of a run of such lines is that of its first, so it is a window over islands and no fold."""
    keys = [*PAGE, "column"]
    w = Window.partitionBy(*keys).orderBy("y0", "ordinal")
    own = (F.length("text") <= 90) & (F.col("text").rlike(r"^(?:[0-9]+|[A-Z])(?:\.[0-9]+)*\.?\s+[A-Z]") | (F.col("bold") & (F.col("size") >= 1.12 * body_size)))
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    d = lines.withColumns({"own_": own, "gap_": F.col("y0") - F.lag("y1").over(w), "h_": height})
    tied = F.col("bold") & (F.col("gap_") < 1.8 * F.col("h_")) & ~F.col("own_")
    runs = sequence.gap_islands(d, keys, ["y0", "ordinal"], ~F.coalesce(tied, F.lit(False)), "run_")
    flag = F.first("own_").over(Window.partitionBy(*keys, "run_").orderBy("y0", "ordinal").rowsBetween(Window.unboundedPreceding, 0))
    flagged = runs.withColumn("heading_", flag)
    breaks = F.col("gap_").isNull() | (F.col("gap_") >= 1.6 * F.col("h_")) | (F.col("heading_") != F.lag("heading_").over(w))
    p = sequence.gap_islands(flagged, keys, ["y0", "ordinal"], breaks, "paragraph")
    ordered = F.sort_array(F.collect_list(F.struct("y0", "ordinal", "text")))
    joined = F.aggregate(F.transform(ordered, lambda s: s["text"]), F.lit(""), T.join_lines)
    return p.groupBy(*keys, "paragraph").agg(
        joined.alias("text"), F.first("heading_").alias("heading"), F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("ordinal").alias("ordinal"), F.max("size").alias("size")
    )


def crosses_column(paragraphs: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Pages whose left column's last paragraph goes on in the right column's first: near the bottom and the top, no
    sentence end, a small letter or bracket next, equal sizes, no heading, caption or list item."""
    left = paragraphs.where("column = 0").groupBy(*PAGE).agg(F.max_by(F.struct("text", "y1", "size", "heading", "ordinal"), F.struct("y1", "ordinal")).alias("l"))
    right = paragraphs.where("column = 1").groupBy(*PAGE).agg(F.min_by(F.struct("text", "y0", "size", "heading", "ordinal"), F.struct("y0", "ordinal")).alias("r"))
    j = left.join(right, PAGE)
    goes = continues(F.col("l.text"), F.col("r.text")) & (F.col("l.y1") >= page_height - 120) & (F.col("r.y0") <= 180) & (F.abs(F.col("l.size") - F.col("r.size")) <= 1) & ~F.col("r.heading") & ~F.col("l.heading")
    return j.select(*PAGE, F.col("l.ordinal").alias("left"), F.col("r.ordinal").alias("right"), goes.alias("continues"))


def _left_open(text: Column) -> Column:
    """No sentence end, no placeholder at the end."""
    return ~F.trim(text).rlike(r"[.!?:;。！？]$") & ~text.rlike(r"\}\}$")


def _taken_up(text: Column) -> Column:
    """A small letter or an opening bracket first, no placeholder."""
    return F.trim(text).rlike(r"^[a-zà-ÿ(]") & ~text.rlike(r"^\{\{")


def continues(before: Column, after: Column) -> Column:
    """No sentence end before, a small letter or an opening bracket after, no placeholder at the seam."""
    return _left_open(before) & _taken_up(after)


def crosses_page(paragraphs: DataFrame, page_height: float = 792.0) -> DataFrame:
    """The same from the last paragraph of a page to the first of the next: one grouping by page, and of a document's pages in
    order each with the one before, so paragraphs are made once."""
    ends = paragraphs.where("doc_id is not null and page is not null").groupBy(*PAGE).agg(
        F.max_by(F.struct(_left_open(F.col("text")).alias("open"), "y1", "ordinal"), F.struct("column", "y1", "ordinal")).alias("l"), F.min_by(F.struct(_taken_up(F.col("text")).alias("goes"), "y0", "ordinal"), F.struct("column", "y0", "ordinal")).alias("r")
    )
    w = Window.partitionBy("doc_id").orderBy("page")
    j = ends.withColumns({"l": F.lag("l").over(w), "before_": F.lag("page").over(w)}).where("before_ = page - 1")
    goes = F.col("l.open") & F.col("r.goes") & (F.col("l.y1") >= page_height - 110) & (F.col("r.y0") <= 165)
    return j.select("doc_id", F.col("page").alias("next_page"), F.col("l.ordinal").alias("left"), F.col("r.ordinal").alias("right"), goes.alias("continues"))


def logical_paragraphs(paragraphs: DataFrame, page_height: float = 792.0) -> DataFrame:
    """paragraphs in document order with a number that continuing fragments share, dense from 1 in a document. The links are those
    of ``crosses_page`` and ``crosses_column``, found by windows over a document's pages: paragraphs are made and dealt once."""
    page = Window.partitionBy(*PAGE)
    p = paragraphs.withColumns({"open_": _left_open(F.col("text")), "goes_": _taken_up(F.col("text"))})
    tail, head, right = F.struct("column", "y1", "ordinal", "open_"), F.struct("column", "y0", "ordinal"), F.struct("y0", "ordinal")
    p = p.withColumns({
        "before_": F.max(tail).over(Window.partitionBy("doc_id").orderBy("page").rangeBetween(-1, -1)),
        "first_": F.min(head).over(page),
        "left_": F.max(F.when(F.col("column") == 0, F.struct("y1", "ordinal", "open_", "size", "heading"))).over(page),
        "right_": F.min(F.when(F.col("column") == 1, right)).over(page),
    })
    over_page = (head == F.col("first_")) & F.col("before_.open_") & (F.col("before_.y1") >= page_height - 110) & (F.col("y0") <= 165)
    sizes = F.abs(F.col("left_.size") - F.col("size")) <= 1
    over_column = (F.col("column") == 1) & (right == F.col("right_")) & F.col("left_.open_") & (F.col("left_.y1") >= page_height - 120) & (F.col("y0") <= 180) & sizes & ~F.col("heading") & ~F.col("left_.heading")
    linked = F.col("goes_") & (F.coalesce(over_page, F.lit(False)) | F.coalesce(over_column, F.lit(False))) & F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    numbered = sequence.stitch(p.withColumn("linked_", linked), ["doc_id"], ["page", "column", "y0", "ordinal"], F.col("linked_"), "logical")
    return numbered.select(*paragraphs.columns, "logical")


def front_matter(rows: DataFrame, body_size: float = 10.0) -> DataFrame:
    """rows of a first page, top down (doc_id, row, text, size): title, authors, affiliation, abstract, body."""
    w = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.lower(F.trim("text")).rlike("^abstract"), 1).otherwise(0)).over(w) == 1
    institution = F.regexp_count("text", F.lit(r"(?i)\b(?:university|institute|laboratory|college|department|school)\b")) >= 1
    names = F.col("text").rlike(r"^(?:[A-Z][\w'’.-]*\s+){1,3}[A-Z][\w'’.-]*(?:\s*,\s*(?:[A-Z][\w'’.-]*\s+){1,3}[A-Z][\w'’.-]*)*$")
    kind = F.when(begun & F.lower(F.trim("text")).rlike("^abstract"), "abstract_heading").when(begun, "abstract").when(F.col("size") >= 1.2 * body_size, "title").when(institution, "affiliation").when(names, "authors").otherwise("body")
    return rows.withColumn("kind", kind)


def semantic_role(state: Column, style: Column, text: Column) -> Column:
    """The role of a paragraph from its document's state and its style."""
    entry = text.rlike(r"^\s*(?:\[[0-9]+\]|[A-Z][\w'’-]+,?\s+[A-Z])")
    return (
        F.when((state == "references") & (style == "heading"), "reference_heading")
        .when((state == "references") & entry, "reference")
        .when(state == "references", "reference_continuation")
        .when((state == "appendix") & (style == "heading"), "appendix_heading")
        .when(state == "appendix", "appendix_body")
        .when(state == "acknowledgement", "acknowledgement")
        .otherwise(style)
    )
