"""Formula candidates among spans, runs of them, scripts bound to their bases, equation numbers, and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import sequence


def is_candidate(text: Column, font: Column, digits: bool = True) -> Column:
    """A mathematical font, symbols or Greek, or digits."""
    t = F.trim(text)
    out = T.is_math_font(font) | (T.count_of(t, T.MATH_SYMBOLS + T.GREEK) > 0) | t.rlike(r"^\p{Sm}+$")
    return (t != "") & ((out | t.rlike("^[0-9]+$")) if digits else out)


def is_equation_number(text: Column, font: Column, size: Column, main_size: Column, strict: bool = False) -> Column:
    shape = r"^\([0-9]+(?:\.[0-9]+)*\)$" if strict else r"^[0-9(),.\- ]*[0-9][0-9(),.\- ]*$"
    return F.trim(text).rlike(shape) & ~T.is_math_font(font) & (size >= 0.88 * main_size)


def is_page_number(text: Column, y0: Column, y1: Column, page_height: float = 792.0) -> Column:
    return F.trim(text).rlike("^[0-9]+$") & ((y0 < 40) | (y1 > page_height - 40))


def fragment_kind(text: Column, font: Column) -> Column:
    """The first that holds: equation number, glyph, condition word, mark, prose of two words, roman label."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\([0-9]{1,3}\)$"), "equation_number")
        .when(T.is_math_font(font) | (T.count_of(t, T.GREEK + T.MATH_SYMBOLS) > 0), "math_glyph")
        .when(F.lower(t).rlike(r"^(?:if|otherwise|where|and|for|with|subject|to|s\.t\.)$"), "condition_word")
        .when(t.rlike(r"^[^\w\s]+$"), "punctuation")
        .when(t.rlike(r"[A-Za-z]{2,}\s+[A-Za-z]{2,}"), "prose")
        .when(t.rlike(r"^[A-Za-z]+$"), "roman_label")
        .otherwise("symbol")
    )


def numbered(spans: DataFrame, gap: float = 15.0) -> DataFrame:
    """Candidate spans with the number of their run on a line: neighbours of a run are at most ``gap`` apart."""
    keys = ["doc_id", "page", "y0"]
    w = Window.partitionBy(*keys).orderBy("x0", "ordinal")
    return sequence.gap_islands(spans.where("is_candidate"), keys, ["x0", "ordinal"], F.col("x0") - F.lag("x1").over(w) > gap, "run")


def runs(spans: DataFrame, gap: float = 15.0) -> DataFrame:
    """Maximal runs of candidate spans on a line, at most ``gap`` apart: a block with its box and members."""
    b = numbered(spans, gap).groupBy("doc_id", "page", "y0", "run")
    return b.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_spans"), F.array_sort(F.collect_list("ordinal")).alias("members"))


def bind_numbers(blocks: DataFrame, numbers: DataFrame, reach: float = 60.0) -> DataFrame:
    """Each equation number with the nearest block to its left on its line, at most ``reach`` away."""
    n = numbers.select("doc_id", "page", "y0", F.col("ordinal").alias("number"), F.col("x0").alias("n_x0"))
    j = n.join(blocks.select("doc_id", "page", "y0", "run", "x1"), ["doc_id", "page", "y0"]).where((F.col("x1") <= F.col("n_x0")) & (F.col("n_x0") - F.col("x1") <= reach))
    return j.groupBy("doc_id", "page", "y0", "number").agg(F.max_by("run", F.col("x1")).alias("run"))


def bind_scripts(spans: DataFrame, keys: list[str], main: float = 0.88) -> DataFrame:
    """Small spans with the adjacent full-size span to their left: superscript above its centre, subscript below."""
    big = spans.where(F.col("size") >= main * F.col("main_size")).select(*keys, F.col("ordinal").alias("base"), F.col("x1").alias("b_x1"), F.col("y0").alias("b_y0"), F.col("y1").alias("b_y1"))
    small = spans.where(F.col("size") < main * F.col("main_size"))
    near = small.join(big, keys).where((F.abs(F.col("x0") - F.col("b_x1")) <= 2) & (F.least("y1", "b_y1") >= F.greatest("y0", "b_y0")))
    best = near.groupBy(*keys, "ordinal").agg(F.min_by(F.struct("base", "y0", "y1", "b_y0", "b_y1"), F.struct(F.abs(F.col("x0") - F.col("b_x1")), "base")).alias("m"))
    return best.select(*keys, "ordinal", F.col("m.base").alias("base"), F.when((F.col("m.y0") + F.col("m.y1")) < (F.col("m.b_y0") + F.col("m.b_y1")), "sup").otherwise("sub").alias("script"))


def fractions(rules: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Thin bars (at most 1.2 high, 8 wide or more) with spans both above and below that overlap them in x."""
    bar = rules.where((F.col("y1") - F.col("y0") <= 1.2) & (F.col("x1") - F.col("x0") >= 8)).select(*keys, "rule_id", F.col("x0").alias("r_x0"), F.col("x1").alias("r_x1"), F.col("y0").alias("r_y0"), F.col("y1").alias("r_y1"))
    j = bar.join(spans, keys).where(F.least("x1", "r_x1") > F.greatest("x0", "r_x0"))
    return j.groupBy(*keys, "rule_id").agg(F.count_if(F.col("y1") <= F.col("r_y0") + 0.5).alias("above"), F.count_if(F.col("y0") >= F.col("r_y1") - 0.5).alias("below")).where("above > 0 and below > 0")


def block_class(rows: Column, width_share: Column, numbered: Column, in_line: Column) -> Column:
    return F.when(in_line & (rows == 1), "inline").when(in_line, "complex_inline").when((rows == 1) & (numbered | (width_share < 0.9)), "display").otherwise("complex_display")


def merge_blocks(blocks: DataFrame, keys: list[str], line_height: float = 12.0) -> DataFrame:
    """Blocks joined until none can be: neighbours on rows that overlap in x by over 0.3 of the narrower and lie less than
    1.7 line heights apart, or up to 2.2 if the upper one's brackets are open. A page's blocks are few, so its components
    are found in one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["y0", "x0", "run"], kind="stable").itertuples())
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                b = rows[j]
                gap = b.y0 - a.y1
                if gap > 2.2 * line_height:
                    break
                common = min(a.x1, b.x1) - max(a.x0, b.x0)
                narrow = max(1e-9, min(a.x1 - a.x0, b.x1 - b.x0))
                if (a.open > 0 and gap < 2.2 * line_height) or (common > 0.3 * narrow and gap < 1.7 * line_height and b.y0 > a.y0):
                    parent[find(j)] = find(i)
        block = [find(i) for i in range(len(rows))]
        number = {r: n for n, r in enumerate(dict.fromkeys(block))}
        out = pd.DataFrame(rows).drop(columns=["Index"])
        out["block"] = [number[r] for r in block]
        return out[[*keys, "run", "block", "x0", "y0", "x1", "y1"]]

    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "run"]) + ", block int, x0 double, y0 double, x1 double, y1 double"
    joined = blocks.groupBy(*keys).applyInPandas(run, schema)
    return joined.groupBy(*keys, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list("run")).alias("runs"))
