"""Does a page close: is all that its source holds owned, translated, placed and inked, and nothing else.

Every input is a set of keys: spans, owners of spans, paragraphs, fragments, formulas, code values, tokens, tables. All of them meet
in one tagged union, ``(doc_id, page, space, key, side, n)``. By key, the sides that hold it make a bit mask, so each set
difference or intersection is a test of bits; by page, the counters are conditional sums. Both groupings lie within the
pages that the union is dealt by, so there is one shuffle, whatever the number of counters.

Tables, all by (doc_id, page); a table that is absent counts as empty:

- spans(span_id), owned(span_id, owner: text, formula, figure, table), members(paragraph, span_id)
- paragraphs(paragraph, translation, crossing), fragments(fragment), dom_fragments(fragment): parts of paragraphs that cross columns
- formulas(formula_id, inline), segments(formula_id, segment, box), dom_formulas(formula_id, inline, ink)
- codes(value), dom_codes(value, ink), tokens(token, lines), code_targets(token), citation_targets(token)
- placeholders(key), found_placeholders(key), figures(figure), dom_figures(ink)
- cells(tab, translated, overflow), rules(tab, horizontal), tables(tab), snapshots(rendered_cells, clipped, overflowing, single_char_lines, recovery)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators import sweep

PAGE = ["doc_id", "page"]
OWNERS = ("text", "formula", "figure", "table")
#: Sides of each space, by bit.
SIDES = {
    "span": ("exists", *OWNERS, "paragraph"),
    "paragraph": ("model", "translated", "crossing", "present"),
    "fragment": ("source", "dom"),
    "formula": ("inline", "display", "segment", "dom_inline", "dom_display", "blank_inline", "blank_display"),
    "code": ("expected", "dom", "blank"),
    "token": ("split", "code", "citation"),
    "placeholder": ("expected", "found"),
    "figure": ("region", "dom", "blank"),
    "table": ("region", "cell", "translated", "overflow", "horizontal", "vertical"),
    "page": ("rendered_cells", "clipped", "overflowing", "single_char_lines", "recovery", "overlap"),
}
WIDTH = max(map(len, SIDES.values()))
RECOVERY_UNIT = 10_000
#: Common area of two segments, in square points, that is an overlap.
LEAST_OVERLAP = 4.0


def _entries(t: dict[str, DataFrame]) -> list[DataFrame]:
    out: list[DataFrame] = []

    def add(name: str, space: str, side: str, key: Column, where: Column | None = None, n: Column | None = None):
        if name in t:
            df = t[name] if where is None else t[name].where(where)
            out.append(df.select(*PAGE, F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(SIDES[space].index(side)).alias("side"), (F.lit(1) if n is None else n).cast("bigint").alias("n")))

    c, whole = F.col, F.lit("")
    add("spans", "span", "exists", c("span_id"))
    for o in OWNERS:
        add("owned", "span", o, c("span_id"), c("owner") == o)
    add("members", "span", "paragraph", c("span_id"))
    add("paragraphs", "paragraph", "model", c("paragraph"))
    add("paragraphs", "paragraph", "translated", c("paragraph"), F.trim("translation") != "")
    add("paragraphs", "paragraph", "crossing", c("paragraph"), c("crossing"))
    add("paragraphs", "paragraph", "present", c("paragraph"), c("translation").isNotNull())
    add("fragments", "fragment", "source", c("fragment"))
    add("dom_fragments", "fragment", "dom", c("fragment"))
    for kind, is_inline in (("inline", c("inline")), ("display", ~c("inline"))):
        add("formulas", "formula", kind, c("formula_id"), is_inline)
        add("dom_formulas", "formula", f"dom_{kind}", c("formula_id"), is_inline)
        add("dom_formulas", "formula", f"blank_{kind}", c("formula_id"), is_inline & ~c("ink"))
    add("segments", "formula", "segment", c("formula_id"))
    add("codes", "code", "expected", c("value"))
    add("dom_codes", "code", "dom", c("value"))
    add("dom_codes", "code", "blank", c("value"), ~c("ink"))
    add("tokens", "token", "split", c("token"), c("lines") > 1)
    add("code_targets", "token", "code", c("token"))
    add("citation_targets", "token", "citation", c("token"))
    add("placeholders", "placeholder", "expected", c("key"))
    add("found_placeholders", "placeholder", "found", c("key"))
    add("figures", "figure", "region", whole)
    add("dom_figures", "figure", "dom", whole)
    add("dom_figures", "figure", "blank", whole, ~c("ink"))
    add("tables", "table", "region", c("tab"))
    add("cells", "table", "cell", c("tab"))
    add("cells", "table", "translated", c("tab"), c("translated"))
    add("cells", "table", "overflow", c("tab"), c("overflow"))
    add("rules", "table", "horizontal", c("tab"), c("horizontal"))
    add("rules", "table", "vertical", c("tab"), ~c("horizontal"))
    for m in ("rendered_cells", "clipped", "overflowing", "single_char_lines"):
        add("snapshots", "page", m, whole, n=c(m))
    add("snapshots", "page", "recovery", whole, n=F.round(c("recovery") * RECOVERY_UNIT))
    if "segments" in t:
        s = t["segments"].withColumn("id_", F.struct("formula_id", "segment")).select(*PAGE, "id_", "x0", "y0", "x1", "y1")
        pairs = sweep.overlaps(s, s, PAGE, closed=False).where((F.col("l_id_") < F.col("r_id_")) & (G.intersection_area(G.box("l_"), G.box("r_")) > LEAST_OVERLAP))
        out.append(pairs.select(*PAGE, F.lit("page").alias("space"), whole.alias("key"), F.lit(SIDES["page"].index("overlap")).alias("side"), F.lit(1).cast("bigint").alias("n")))
    return out


def keys_of(t: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, page, space, key, mask, n0 to n6): what the sides hold of each key, dealt by page."""
    every = reduce(DataFrame.unionByName, _entries(t)).repartition(*PAGE)
    sums = (F.coalesce(F.sum(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(WIDTH))
    return every.groupBy(*PAGE, "space", "key").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("side"))).alias("mask"), *sums)


def page_closure(t: dict[str, DataFrame]) -> DataFrame:
    """One row a page that any table knows: the counters, the assertions, and whether all hold."""
    keys = keys_of(t)

    def in_(space: str, *sides: str, without: tuple[str, ...] = ()) -> Column:
        bits = lambda names: sum(1 << SIDES[space].index(s) for s in names)
        need, ban = bits(sides), bits(without)
        return (F.col("space") == space) & (F.col("mask").bitwiseAND(F.lit(need | ban)) == need)

    def n(space: str, side: str, *sides: str, without: tuple[str, ...] = ()) -> Column:
        return F.coalesce(F.sum(F.when(in_(space, *sides, without=without), F.col(f"n{SIDES[space].index(side)}"))), F.lit(0))

    number = lambda *a, **k: F.count_if(in_(*a, **k))
    owner_bits = sum(1 << SIDES["span"].index(o) for o in OWNERS)
    owners = F.bit_count(F.col("mask").bitwiseAND(F.lit(owner_bits)))
    is_span = F.col("space") == "span"
    counters = {
        "spans": number("span", "exists"),
        "conflicts": F.count_if(is_span & (owners > 1)),
        "duplicates": sum((n("span", o, o) for o in OWNERS), F.lit(0)) - F.count_if(is_span & (owners > 0)),
        "unowned": number("span", "exists", without=OWNERS),
        "text_spans": number("span", "text"),
        "paragraph_spans": number("span", "text", "paragraph"),
        "dropped": number("span", "text", without=("paragraph",)),
        "figure_spans": number("span", "figure"),
        "paragraphs": number("paragraph", "model"),
        "translated": number("paragraph", "model", "translated"),
        "untranslated": number("paragraph", "model", without=("translated",)),
        "crossing": number("paragraph", "crossing"),
        "split_translations": number("paragraph", "crossing", without=("present",)),
        "orphan_fragments": number("fragment", "source", without=("dom",)),
        "inline_formulas": number("formula", "inline"),
        "display_formulas": number("formula", "display"),
        "inline_segments": n("formula", "segment", "inline"),
        "display_segments": n("formula", "segment", "display"),
        "inline_nodes": n("formula", "dom_inline", "dom_inline"),
        "display_nodes": n("formula", "dom_display", "dom_display"),
        "inline_rendered": number("formula", "dom_inline"),
        "inline_blank": n("formula", "blank_inline", "blank_inline"),
        "display_blank": n("formula", "blank_display", "blank_display"),
        "inline_absent": number("formula", "inline", without=("dom_inline",)),
        "display_absent": number("formula", "display", without=("dom_display",)),
        "codes": n("code", "expected", "expected"),
        "codes_exact": n("code", "expected", "expected", "dom"),
        "code_nodes": n("code", "dom", "dom"),
        "code_blank": n("code", "blank", "blank"),
        "latin_split": n("token", "split", "split", without=("code",)),
        "code_split": n("token", "split", "split", "code"),
        "citation_split": n("token", "split", "split", "citation"),
        "identifier_split": F.coalesce(F.sum(F.when(in_("token", "split") & F.col("key").contains("_"), F.col("n0"))), F.lit(0)),
        "placeholders_lost": n("placeholder", "expected", "expected", without=("found",)),
        "figures": n("figure", "region", "region"),
        "figure_nodes": n("figure", "dom", "dom"),
        "figure_blank": n("figure", "blank", "blank"),
        "tables": number("table", "region"),
        "cells": n("table", "cell", "cell"),
        "cells_translated": n("table", "translated", "translated"),
        "cells_overflowing": n("table", "overflow", "overflow"),
        "horizontal_rules": n("table", "horizontal", "horizontal"),
        "vertical_rules": n("table", "vertical", "vertical"),
        "filled_tables": number("table", "region", "cell"),
        **{m: n("page", m, m) for m in SIDES["page"][:4]},
        "overlaps": n("page", "overlap", "overlap"),
        "recovery_": n("page", "recovery", "recovery"),
    }
    counted = keys.groupBy(*PAGE).agg(*(v.cast("bigint").alias(k) for k, v in counters.items()))
    c = F.col
    less = lambda a, b: F.greatest(F.lit(0).cast("bigint"), a - b)
    zero = lambda *names: reduce(Column.__and__, (c(x) == 0 for x in names))
    out = counted.withColumns({
        "figure_rendered": c("figure_nodes") - c("figure_blank"),
        "segments_absent": less(c("inline_segments"), c("inline_nodes")) + less(c("display_segments"), c("display_nodes")),
        "codes_absent": less(c("codes"), c("code_nodes")),
        "figure_spans_alone": F.when(c("figures") == 0, c("figure_spans")).otherwise(0),
        "blank": c("inline_blank") + c("display_blank") + c("figure_blank") + c("code_blank"),
        "regions_absent": c("inline_absent") + c("display_absent") + less(c("figures"), c("figure_nodes")) + F.when(c("rendered_cells") == 0, c("filled_tables")).otherwise(0),
        "recovery": c("recovery_") / RECOVERY_UNIT,
    }).drop("recovery_")
    out = out.withColumn("unrendered", c("regions_absent") + c("segments_absent") + c("codes_absent") + c("figure_spans_alone") + c("blank") + c("dropped"))
    holds = {
        "ownership_closed": zero("conflicts", "duplicates", "unowned"),
        "text_closed": zero("untranslated", "dropped"),
        "render_closed": zero("unrendered", "regions_absent", "blank"),
        "formula_visible": zero("inline_blank", "display_blank"),
        "tokens_intact": zero("latin_split", "code_split"),
        "continuations_closed": zero("orphan_fragments", "split_translations"),
        "typography_closed": zero("clipped", "overflowing", "single_char_lines") & (c("recovery") >= 0.99),
    }
    out = out.withColumns(holds)
    return out.withColumn("passed", reduce(Column.__and__, (c(h) for h in holds)))
