"""Quality checks over what was rendered: collisions, residue of the source language, recall of text, footnotes, headings, typography, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import joins, stats

PAGE = ["doc_id", "page"]


def collisions(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """By page and kind of region: texts that overlap it by more than two square points and a twentieth of the smaller box."""
    hit = joins.box_join(texts, regions, PAGE, G.collides, reach=0.0)
    return hit.groupBy(*PAGE, F.col("r_kind").alias("kind")).agg(F.count("*").alias("collisions"))


def residual(spans: DataFrame, skip_roles=("reference", "formula", "code")) -> DataFrame:
    """Spans that still hold the source language: not East Asian, not an exempt role, not all capitalised names; connectives or a run of English."""
    joins_ = F.size(T.connective_tokens(F.col("text"))) > 0
    names = F.col("text").rlike(r"^(?:[A-Z][\w.-]*\s*)+$")
    return spans.where(~T.has_cjk(F.col("text")) & ~F.col("role").isin(*skip_roles) & ~names & (joins_ | T.residual_english(F.col("text"))))


def script_recall(expected: DataFrame, found: DataFrame, threshold: float = 0.99) -> DataFrame:
    """By script, the share of expected characters (as a multiset) that were found again."""
    def chars(df):
        c = df.select(F.explode(F.split("text", "")).alias("c")).where("c rlike '\\\\S'")
        return c.withColumn("script", T.script_of(F.col("c"))).groupBy("script", "c").agg(F.count("*").alias("n"))

    e, f = chars(expected), chars(found).select("c", F.col("n").alias("m"))
    g = e.join(f, "c", "left").groupBy("script").agg(F.sum("n").alias("expected"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("matched"))
    return g.withColumn("recall", F.col("matched") / F.col("expected")).withColumn("passed", F.col("recall") >= threshold)


def footnotes(bodies: DataFrame, notes: DataFrame) -> DataFrame:
    """By page: overlap of body and notes, and the least gap above a note; pages without notes have no row (not applicable)."""
    hit = joins.box_join(bodies, notes, PAGE, lambda a, b: G.x_overlap(a, b) > 0)
    a, b = G.box("l_"), G.box("r_")
    return hit.groupBy(*PAGE).agg(F.count_if(G.intersection_area(a, b) > 0).alias("overlaps"), F.min(F.when(a[3] <= b[1], b[1] - a[3])).alias("least_gap"))


def duplicate_words(headings: DataFrame) -> DataFrame:
    return headings.withColumn("repeated", T.repeated_words(F.col("text"))).where(F.size("repeated") > 0)


def role_sizes(spans: DataFrame) -> DataFrame:
    """Median size by role, and by document whether headings are larger than the body, and titles than headings."""
    med = spans.groupBy("doc_id", "role").agg(F.expr("median(size)").alias("size"))
    p = med.groupBy("doc_id").pivot("role", ["title", "heading", "body"]).agg(F.first("size"))
    return p.withColumn("violations", F.when(F.col("heading") <= F.col("body"), 1).otherwise(0) + F.when(F.col("title") <= F.col("heading"), 1).otherwise(0))


def body_outliers(spans: DataFrame) -> DataFrame:
    """Body spans over 1.5 or under 0.6 of the most frequent size of their document."""
    mode = stats.first_mode(spans, ["doc_id"], "size", "ordinal")
    j = spans.join(mode, "doc_id")
    return j.where((F.col("size") > 1.5 * F.col("mode")) | (F.col("size") < 0.6 * F.col("mode"))).drop("mode", "mode_count")


def line_gap_outliers(lines: DataFrame) -> DataFrame:
    """Gaps between lines of a column over 1.6 or under 0.4 of the document's median gap."""
    w = Window.partitionBy(*PAGE, "column").orderBy("y0")
    g = lines.withColumn("gap", F.col("y0") - F.lag("y0").over(w)).where("gap > 0")
    m = g.groupBy("doc_id").agg(F.expr("median(gap)").alias("m_"))
    return g.join(m, "doc_id").where((F.col("gap") > 1.6 * F.col("m_")) | (F.col("gap") < 0.4 * F.col("m_"))).drop("m_")


def column_density(spans: DataFrame) -> DataFrame:
    """Characters a hundred points of height by column, and the difference between the two columns."""
    c = spans.groupBy(*PAGE, "col").agg(F.sum(F.length("text")).alias("chars"), (F.max("y1") - F.min("y0")).alias("height"))
    d = c.withColumn("density", F.when(F.col("height") > 0, 100.0 * F.col("chars") / F.col("height")))
    return d.groupBy(*PAGE).pivot("col", [0, 1]).agg(F.first("density")).withColumnsRenamed({"0": "left", "1": "right"}).withColumn("difference", F.abs(F.col("left") - F.col("right")))


def expansion(source: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered over source length and height by role."""
    j = source.alias("s").join(rendered.alias("r"), keys)
    return j.groupBy(F.col("s.role").alias("role")).agg(F.count("*").alias("n"), F.avg(F.length("r.text") / F.length("s.text")).alias("length_ratio"), F.avg(F.col("r.height") / F.col("s.height")).alias("height_ratio"))


def hanging_indent(items: DataFrame) -> DataFrame:
    """List items (bullet_x, text_x, continuation_x, size) whose continuation lines don't hang by half an em."""
    return items.where(F.col("continuation_x") - F.col("bullet_x") < 0.5 * F.col("size"))


def half_width_marks(text: Column) -> Column:
    """ASCII commas, stops and brackets between East Asian characters."""
    return F.regexp_count(text, F.lit("(?<=[一-鿿])[,.;:!?()](?=[一-鿿]|$)"))


def ink_flags(pages: DataFrame, blank: float = 0.0005, mostly: float = 0.01) -> DataFrame:
    """pages(ink share): blank, mostly blank or fine."""
    return pages.withColumn("ink", F.when(F.col("ink_ratio") <= blank, "blank").when(F.col("ink_ratio") <= mostly, "mostly_blank").otherwise("ok"))


def closure(identities: dict[str, Column], df: DataFrame, keys: list[str]) -> DataFrame:
    """Accounting identities that don't hold: one row a key and name."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in identities.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("identity"))
