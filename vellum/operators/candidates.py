"""Which candidates of formulas are none: filters by a span's neighbours on its line and by what its line holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import formulas, sequence, sweep

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "y0", "segment"]
EDGES = ("x0", "y0", "x1", "y1")

# Marks that are bullets, and signs that also stand in titles.
BULLETS = ("•", "·", "∙", "*")
TITLE_SIGNS = ("×", "−")


def segmented(spans: DataFrame, gap: float = 12.0) -> DataFrame:
    """spans with the number of their run on the line: a run ends where two neighbours are more than ``gap`` apart."""
    w = Window.partitionBy(*PAGE, "y0").orderBy("x0", "ordinal")
    return sequence.gap_islands(spans, [*PAGE, "y0"], ["x0", "ordinal"], F.col("x0") - F.lag("x1").over(w) > gap, "segment")


def _beside(lg, l, lid, rg, r, rid, slack: float, band: float) -> np.ndarray:
    """Places in r (-1: none) of the box before and after each of l, for groups, edges and ids of both sides."""
    out = np.full((2, len(l)), -1, np.int64)
    for k, (mine, theirs, step) in enumerate((((l[:, 0] + slack), r[:, 2], -1), ((l[:, 2] - slack), r[:, 0], 1)) if len(r) else ()):
        order = np.lexsort((step * rid, theirs, rg))
        asked, known = sweep.ranks([lg, rg], [mine, theirs])
        at = np.searchsorted(known[order], asked, "right") - 1 if step < 0 else np.searchsorted(known[order], asked, "left")
        open_ = np.arange(len(l))
        while len(open_):
            inside = (at[open_] >= 0) & (at[open_] < len(order))
            open_ = open_[inside]
            found = order[at[open_]]
            same = rg[found] == lg[open_]
            open_, found = open_[same], found[same]
            fits = (r[found, 1] < l[open_, 3] - band) & (r[found, 3] > l[open_, 1] + band) & (rid[found] != lid[open_])
            out[k, open_[fits]] = found[fits]
            open_ = open_[~fits]
            at[open_] += step
    return out


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, slack: float = 2.0, band: float = 1.0, carry: list[str] = (), grouped: bool = False, keep: list[str] = ()) -> DataFrame:
    """(keys, left_id, before, after): for each left box the right box that ends last before it and the one that begins first
    after it (with slack; the smaller id of equals), of those of its key that share its height by more than ``band`` at either
    edge, itself excepted (ids are numbers). From the place in the order of ends (beginnings) the search goes outward until a
    box shares the height: no pairs of a line are formed. ``carry``: columns of the found boxes that come along, as before_* and
    after_*; ``keep``: columns of the left boxes that do, under their names. ``grouped``: a call a key, which shuffles both sides
    (and gives no ``keep``); else rows dealt by a part of the key already aren't shuffled."""
    kinds = dict(right.dtypes)
    carried = [(f"{side}_{c}", kinds[c]) for side in ("before", "after") for c in carry]
    kept = [] if grouped else list(keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in [(k, dict(left.dtypes)[k]) for k in keys] + [(left_id, "bigint"), *((c, dict(left.dtypes)[c]) for c in kept), ("before", "bigint"), ("after", "bigint"), *carried])
    own = lambda df, i, more: df.select(*keys, F.col(i).cast("bigint").alias("id_"), *(e for e in EDGES if e not in keys), *(F.col(c).alias(f"c_{c}") for c in more)).dropna(subset=keys)
    a, b = own(left, left_id, kept), own(right, right_id, carry)
    names = [*keys, left_id, *kept, "before", "after", *(n for n, _ in carried)]

    def found_rows(taken: list, ids: list, out: np.ndarray, more: list, own_: list = ()) -> pa.RecordBatch:
        at = [pa.array(np.maximum(o, 0), mask=o < 0, type=pa.int64()) for o in out]
        return pa.RecordBatch.from_arrays([*taken, pa.array(ids[0], pa.int64()), *own_, *(pa.array(ids[1], pa.int64()).take(i) for i in at), *(c.take(i) for i in at for c in more)], names=names)

    def one_key(lt: pa.Table, rt: pa.Table) -> pa.Table:
        boxes = []
        for t in (lt, rt):
            e = np.stack([t.column(f"{c}_").to_numpy(zero_copy_only=False).astype(float) for c in EDGES], axis=1)
            rows = np.flatnonzero(~np.isnan(e).any(axis=1))
            boxes.append((t.take(pa.array(rows)), e[rows], np.zeros(len(rows), np.int64)))
        (lt, l, lg), (rt, r, rg) = boxes
        ids = [t.column("id_").to_numpy(zero_copy_only=False) for t in (lt, rt)]
        flat = lambda t, c: t.column(c).combine_chunks()
        out = _beside(lg, l, ids[0], rg, r, ids[1], slack, band)
        return pa.Table.from_batches([found_rows([flat(lt, c) for c in keys], ids, out, [flat(rt, f"c_{c}") for c in carry])])

    if grouped:
        # own names, as both sides may come from one table, whose columns a cogroup gives once
        sides = [df.select(*keys, "id_", *(F.col(e).alias(f"{e}_") for e in EDGES), *(f"c_{c}" for c in more)).groupBy(*keys) for df, more in ((a, ()), (b, carry))]
        return sides[0].cogroup(sides[1]).applyInArrow(one_key, schema)

    def each(table, groups):
        lrows, lg, l = sweep.boxes_of(table, groups, 0)
        rrows, rg, r = sweep.boxes_of(table, groups, 1)
        if not len(l):
            return
        mine, theirs = (table.column(s).combine_chunks().take(pa.array(rows)).flatten() for s, rows in (("l_", lrows), ("r_", rrows)))
        ids = [x[0].to_numpy(zero_copy_only=False) for x in (mine, theirs)]
        taken = [table.column(c).combine_chunks().take(pa.array(lrows)) for c in keys]
        yield found_rows(taken, ids, _beside(lg, l, ids[0], rg, r, ids[1], slack, band), theirs[1:], mine[1:])

    return sweep.swept(a, b, keys, ["id_", *(f"c_{c}" for c in kept)], ["id_", *(f"c_{c}" for c in carry)], each, schema)


def line_flags(spans: DataFrame) -> DataFrame:
    """spans with the flags symbol_, first_, strong_, number_ and candidate: kept_first and kept in their place, by one pass over whole
    lines. ``first_`` is kept_first but for symbols whose neighbours on either side are both no candidates and stand at one height.
    A window deals the lines, which costs no shuffle where spans are dealt by a part of a line's key."""
    kinds = dict(spans.dtypes)
    kept = [c for c in spans.columns if c not in ("symbol_", "first_", "strong_", "number_")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", kept_first boolean, kept boolean"
    keyed = spans.withColumns({"g_": F.xxhash64(*LINE), "named_": F.count("*").over(Window.partitionBy(*LINE)) * F.when(F.expr(" and ".join(f"{c} is not null" for c in LINE)), 1).otherwise(0)})

    def each(table: pa.Table, groups: np.ndarray):
        flag = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(bool)
        edges = np.stack([table.column(e).to_numpy(zero_copy_only=False).astype(float) for e in EDGES], axis=1)
        boxed = (table.column("named_").to_numpy() > 0) & ~np.isnan(edges).any(axis=1)
        ids, candidate, kept_first = table.column("ordinal").to_numpy(zero_copy_only=False), flag("candidate"), flag("first_")
        right, left = np.flatnonzero(boxed), np.flatnonzero(boxed & flag("symbol_"))
        before, after = _beside(groups[left], edges[left], ids[left], groups[right], edges[right], ids[right], 2.0, 1.0)
        both = (before >= 0) & (after >= 0)
        left, before, after = left[both], right[before[both]], right[after[both]]
        centre = (edges[:, 1] + edges[:, 3]) / 2
        kept_first[left[~candidate[before] & ~candidate[after] & (np.abs(centre[before] - centre[after]) <= 3.0)]] = False
        mathematical = np.bincount(groups, kept_first & flag("strong_"))[groups] > 0
        out = [*(table.column(c) for c in kept), pa.chunked_array([kept_first]), pa.chunked_array([kept_first & (~flag("number_") | mathematical)])]
        yield from pa.table(out, names=[*kept, "kept_first", "kept"]).to_batches()

    return sweep.whole_keys(keyed.sortWithinPartitions(*LINE), each, schema)


def true_candidates(spans: DataFrame, page_height: float = 792.0) -> DataFrame:
    """spans(doc_id, page, segment, ordinal, text, font, box) with candidate, kept_first and kept. First bullets, citations, page
    numbers and signs between ordinary words go; then numbers on lines where nothing that was kept is mathematics. What
    the second pass takes away is no mathematics, so a third would take nothing."""
    text, math = F.trim("text"), T.is_math_font(F.col("font"))
    glyphs = T.count_of(text, T.MATH_SYMBOLS + T.GREEK) > 0
    sure = lambda c: F.coalesce(c, F.lit(False))
    s = spans.withColumn("candidate", sure((text != "") & formulas.is_candidate(F.col("text"), F.col("font"))))
    sign = F.col("candidate") & (math | text.isin(*TITLE_SIGNS))
    bullet = text.isin(*BULLETS) & ~math
    first = F.col("candidate") & ~bullet & ~T.is_citation(text) & ~formulas.is_page_number(F.col("text"), F.col("y0"), F.col("y1"), page_height)
    number = ~math & text.rlike(r"^[0-9.,\- ]*$")
    return line_flags(s.withColumns({"symbol_": sure(sign), "first_": sure(first), "strong_": sure(math | glyphs), "number_": sure(number)}))


def block_context(blocks: DataFrame, spans: DataFrame, main_size: float = 10.0) -> DataFrame:
    """blocks(doc_id, page, block, ordinal): the members of each block, which are looked up among the spans unless they bring the
    spans' columns themselves. By block: the box of the lines' runs that its members stand
    in, and the widths of all and of the plain spans in runs that share its height (by two points more) and its width,
    without the block's own spans and equation numbers."""
    number = formulas.is_equation_number(F.col("text"), F.col("font"), F.col("size"), F.lit(main_size))
    width = F.when(~F.coalesce(number, F.lit(False)), F.col("x1") - F.col("x0")).otherwise(0.0)
    plain = F.when(~F.col("candidate"), width).otherwise(0.0)
    runs = spans.groupBy(*LINE).agg(F.min("x0").alias("rx0"), F.max("x1").alias("rx1"), F.max("y1").alias("ry1"), F.sum(width).alias("all_"), F.sum(plain).alias("plain_"))
    measured = [*LINE, "ordinal", width.alias("w_"), plain.alias("p_")]
    if {*LINE, "ordinal", "text", "font", "size", "candidate", "x0", "x1"} <= set(blocks.columns):
        members = blocks.dropna(subset=[*PAGE, "ordinal"]).select("block", *measured)
    else:
        members = blocks.join(spans.select(*measured), [*PAGE, "ordinal"])
    own = members.join(runs, LINE).groupBy(*PAGE, "block").agg(F.min("rx0").alias("x0"), F.min("y0").alias("y0"), F.max("rx1").alias("x1"), F.max("ry1").alias("y1"))
    there = runs.select(*PAGE, F.col("y0").alias("line"), "segment", "all_", "plain_", F.col("rx0").alias("x0"), "y0", F.col("rx1").alias("x1"), F.col("ry1").alias("y1"))
    a, b = G.box("l_"), G.box("r_")
    met = sweep.overlaps(own, there, PAGE, reach=2.0).where((b[3] >= a[1] - 2) & (b[1] <= a[3] + 2) & (b[2] > a[0] + 2) & (b[0] < a[2] - 2))
    band = met.select(*PAGE, F.col("l_block").alias("block"), F.col("r_line").alias("y0"), F.col("r_segment").alias("segment"), F.col("r_all_").alias("all_"), F.col("r_plain_").alias("plain_"))
    mine = members.groupBy(*LINE, "block").agg(F.sum("w_").alias("w_"), F.sum("p_").alias("p_"))
    sums = band.join(mine, [*LINE, "block"], "left").groupBy(*PAGE, "block").agg(
        F.sum(F.col("all_") - F.coalesce("w_", F.lit(0.0))).alias("band_width"), F.sum(F.col("plain_") - F.coalesce("p_", F.lit(0.0))).alias("plain_width"), F.count("*").alias("runs")
    )
    return own.join(sums, [*PAGE, "block"], "left").na.fill(0, ["band_width", "plain_width", "runs"])


#: Rows of a block whose boxes share height and are less than this apart, in points, are one segment. A fixed value.
ROW_GAP = 15.0


def render_segments(blocks: DataFrame, members: DataFrame, spans: DataFrame, row_tolerance: float = 3.0) -> DataFrame:
    """blocks(doc_id, page, block, is_display, box), members(doc_id, page, block, ordinal, and box, else it is looked up), spans with candidate and kept: the pieces
    that each block is drawn in, (doc_id, page, block, segment, n_spans, box). A display block that holds no foreign text and no
    part of another block is one piece. Others are cut into rows (clusters of centres, from the top); a row that shares height
    with the piece before and begins less than ``ROW_GAP`` after its end goes on with it. What is foreign comes from sweeps."""
    box = ["x0", "y0", "x1", "y1"]
    b = blocks.select(*PAGE, "block", "is_display", *box)
    plain = spans.where(~F.col("kept") & ~T.is_math_font(F.col("font")) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(*PAGE, "ordinal", *box)
    met = sweep.overlaps(b.select(*PAGE, "block", *box), plain, PAGE, reach=1.0).select(*PAGE, F.col("l_block").alias("block"), F.col("r_ordinal").alias("ordinal"))
    polluted = met.join(members, [*PAGE, "block", "ordinal"], "left_anti").select(*PAGE, "block")
    l, r = G.box("l_"), G.box("r_")
    crossed = sweep.overlaps(b.select(*PAGE, "block", *box), b.select(*PAGE, "block", *box), PAGE, closed=False).where((F.col("l_block") != F.col("r_block")) & (G.x_overlap(l, r) > 2.0) & (G.y_overlap(l, r) > 2.0)).select(*PAGE, F.col("l_block").alias("block"))
    foreign = polluted.union(crossed).distinct().withColumn("foreign_", F.lit(True))
    boxed = members.dropna(subset=[*PAGE, "ordinal"]) if set(box) <= set(members.columns) else members.select(*PAGE, "block", "ordinal").join(spans.select(*PAGE, "ordinal", *box), [*PAGE, "ordinal"])
    own = boxed.withColumns({"id_": F.col("ordinal"), "v_": (F.col("y0") + F.col("y1")) / 2})
    rows = sequence.cluster_1d(own, [*PAGE, "block"], "v_", row_tolerance, carry=box)
    whole = b.join(foreign, [*PAGE, "block"], "left").select(*PAGE, "block", (F.col("is_display") & F.col("foreign_").isNull()).alias("one_"))
    placed = rows.join(whole, [*PAGE, "block"]).withColumn("row_", F.when(F.col("one_"), 0).otherwise(F.col("cluster")))
    boxed = placed.groupBy(*PAGE, "block", "row_").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    piece = "struct<n:bigint,x0:double,y0:double,x1:double,y1:double>"
    listed = boxed.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(F.struct("row_", F.struct("n", *box).cast(piece).alias("p")))).alias("rows_"))

    def joined(done: Column, row: Column) -> Column:
        last, p = F.element_at(done, -1), row["p"]
        goes_on = (F.size(done) > 0) & (p["y0"] < F.try_element_at(done, F.lit(-1))["y1"]) & (p["y1"] > F.try_element_at(done, F.lit(-1))["y0"]) & (p["x0"] - F.try_element_at(done, F.lit(-1))["x1"] < ROW_GAP)
        union = F.struct((last["n"] + p["n"]).alias("n"), F.least(last["x0"], p["x0"]).alias("x0"), F.least(last["y0"], p["y0"]).alias("y0"), F.greatest(last["x1"], p["x1"]).alias("x1"), F.greatest(last["y1"], p["y1"]).alias("y1"))
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(union))).otherwise(F.concat(done, F.array(p)))

    pieces = listed.select(*PAGE, "block", F.posexplode(F.aggregate("rows_", F.array().cast(f"array<{piece}>"), joined)).alias("segment", "s"))
    return pieces.select(*PAGE, "block", "segment", F.col("s.n").alias("n_spans"), *(F.col(f"s.{c}").alias(c) for c in box))
