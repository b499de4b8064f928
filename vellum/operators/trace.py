"""A formula's life, assembled from tables of each stage: which source fragments belong to it, which of them have another owner
or none, what its assets and placements lost, and the first stage that failed.

Tables, all by (doc_id, page); a stage that a formula is missing from has no row for it:

- spans(span_id, text, font, size, box, owner): owner is formula, text, table, figure or null
- detections(formula_id), models(formula_id, box)
- components(formula_id, component, text, box): the fragments that a model is made of
- segments(formula_id, segment, place, box, has_asset, ink, viewbox_crop): pieces that are drawn, in order
- placements(formula_id, placement, segment or null, node, box, final_blank, final_crop, disagreement)
- flows(formula_id, place, y0, y1), nodes(node, parent, box), columns(col, x0, x1), obstacles(id, box)
- exclusivity(formula_id, double_render, pollution): counts of other checks

Every stage is reduced to sums by formula first; the sums meet in one union and one aggregation, so a formula that any stage
knows has a row, and no stage has to be joined to all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import chains, sweep

PAGE = ["doc_id", "page"]
KEY = [*PAGE, "formula_id"]
EDGES = ("x0", "y0", "x1", "y1")

# Defects in the order in which they are looked for, the stage each belongs to, and why.
DEFECTS = (
    ("detection_missing", "detection", "unmodeled source formula ink"),
    ("ownership_missing", "ownership", "formula fragment has no formula owner"),
    ("ownership_pollution", "ownership", "formula fragment ownership is ambiguous"),
    ("model_missing", "model", "detected formula has no FormulaModel"),
    ("svg_missing", "svg_generation", "atomic SVG asset is missing"),
    ("svg_blank", "svg_generation", "atomic SVG raster has zero ink"),
    ("svg_viewbox_crop", "svg_generation", "owned ink exceeds SVG viewBox"),
    ("embed_missing", "embedding", "formula has no final DOM placement"),
    ("final_blank", "final_pdf", "SVG ink is absent from final PDF"),
    ("final_crop", "final_pdf", "final PDF formula ink is cropped"),
    ("orphan_formula", "embedding", "formula is orphaned from final DOM"),
    ("duplicate_formula", "embedding", "formula is embedded more than once"),
    ("equation_number_orphan", "ownership", "equation number is not attached"),
    ("condition_text_orphan", "ownership", "condition text is not attached"),
    ("renderer_disagreement", "final_pdf", "PDF renderers disagree on visible ink"),
)
# Words that go with a formula as a condition.
CONDITIONS = ("if", "iff", "otherwise", "where", "when", "whenever", "for all", "for any", "correctly supports", "does not support", "and the survey")


def match_components(components: DataFrame, spans: DataFrame, tolerance: float = 0.08, share: float = 0.9, carry: list[str] = ()) -> DataFrame:
    """components with span_id: the first span whose four sides are each within the tolerance; else the one of the largest
    common area, if that is the share of the component or more; else null. ``carry``: columns of the span that come along. Both
    are looked for in one sweep over a page, so spans are dealt once, or not at all if they are dealt by a part of its key."""
    own, theirs = [c for c in components.columns if c not in PAGE], ["span_id", *carry]
    kinds, found_kinds = dict(components.dtypes), dict(spans.dtypes)
    names = [*PAGE, *own, *theirs]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((c, kinds[c]) for c in [*PAGE, *own]), *((c, found_kinds[c]) for c in theirs)])

    def each(table: pa.Table, groups: np.ndarray):
        lrows, lg, l = sweep.boxes_of(table, groups, 0)
        rrows, rg, r = sweep.boxes_of(table, groups, 1)
        all_left = np.flatnonzero(table.column("side_").to_numpy() == 0)
        if not len(all_left):
            return
        right = table.column("r_").combine_chunks().take(pa.array(rrows)).flatten()
        by_id = pc.sort_indices(right[0]).to_numpy()
        id_rank = np.empty(len(r), np.int64)
        id_rank[by_id] = np.arange(len(r))
        first, area, best = np.full(len(l), len(r), np.int64), np.zeros(len(l)), np.full(len(l), -1, np.int64)
        upright = lambda b: np.concatenate([np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])], axis=1)
        for li, ri in sweep.overlapping(lg, upright(l), rg, upright(r), True, tolerance * 1.001 + 1e-9):
            a, b = l[li], r[ri]
            same = (np.abs(a - b) <= tolerance).all(axis=1)
            np.minimum.at(first, li[same], id_rank[ri[same]])
            over = ((a[:, :2] < b[:, 2:]) & (b[:, :2] < a[:, 2:])).all(axis=1)
            li, ri = li[over], ri[over]
            common = np.prod(np.minimum(a[over, 2:], b[over, 2:]) - np.maximum(a[over, :2], b[over, :2]), axis=1)
            order = np.lexsort((id_rank[ri], -common, li))
            li, ri, common = li[order], ri[order], common[order]
            top = np.flatnonzero(np.concatenate(([True], li[1:] != li[:-1]))) if len(li) else np.zeros(0, np.int64)
            li, ri, common = li[top], ri[top], common[top]
            held = best[li]
            better = (common > area[li]) | ((common == area[li]) & (held >= 0) & (id_rank[ri] < id_rank[np.maximum(held, 0)] if len(r) else False))
            area[li[better]], best[li[better]] = common[better], ri[better]
        enough = area / np.maximum((l[:, 2] - l[:, 0]) * (l[:, 3] - l[:, 1]), 1e-6) >= share
        match = np.where(first < len(r), np.append(by_id, -1)[first], np.where(enough, best, -1))
        where = np.full(len(all_left), -1, np.int64)
        where[np.searchsorted(all_left, lrows)] = match
        at = pa.array(np.maximum(where, 0), mask=where < 0, type=pa.int64())
        left = table.column("l_").combine_chunks().take(pa.array(all_left)).flatten()
        taken = [table.column(k).combine_chunks().take(pa.array(all_left)) for k in PAGE]
        yield pa.RecordBatch.from_arrays([*taken, *left, *(c.take(at) if len(r) else pa.nulls(len(all_left), c.type) for c in right)], names=names)

    return sweep.swept(components, spans.dropna(subset=PAGE), PAGE, own, theirs, each, schema)


def component_sums(components: DataFrame, spans: DataFrame, segments: DataFrame, **match) -> DataFrame:
    """By formula: components, those without a span (unowned), with a span that text or another formula claims too (double_owned),
    outside all of the formula's segments (uncovered), and of these, equation numbers and conditions."""
    matched = match_components(components, spans, **match, carry=["owner"])
    span = Window.partitionBy(*PAGE, "span_id")
    shared = F.coalesce(F.min("formula_id").over(span) != F.max("formula_id").over(span), F.lit(False))
    owned = matched.withColumn("shared_", shared)
    covered = sweep.best_overlap(components, segments, KEY, "component", "segment")
    double = F.col("span_id").isNotNull() & (F.col("shared_") | (F.col("owner") == "text").eqNullSafe(True))
    sums = owned.groupBy(*KEY).agg(F.count("*").alias("components"), F.count_if(F.col("span_id").isNull()).alias("unowned"), F.count_if(double).alias("double_owned"))
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    outside = components.select(*KEY, "component", text.alias("text_")).join(covered.where("area > 0"), [*KEY, "component"], "left_anti")
    bare = F.regexp_replace(F.lower("text_"), r"^[ ,.;:]+|[ ,.;:]+$", "")
    lost = outside.groupBy(*KEY).agg(F.count("*").alias("uncovered"), F.count_if(F.col("text_").rlike(r"^\([0-9]{1,4}\)$")).alias("equation_orphans"), F.count_if(bare.isin(*CONDITIONS)).alias("condition_orphans"))
    return sums.unionByName(lost, allowMissingColumns=True)


def loose_fragments(spans: DataFrame, models: DataFrame, margin: float = 4.0, gap: float = 12.0) -> DataFrame:
    """Spans in a mathematical font that no formula, table or figure owns, by what they are: text's own, near a formula (within
    the margin, or on its line and less than ``gap`` from its end) and so lost by it, marks, or candidates that detection
    missed. Nearness is a sweep of grown boxes and a semi join: no pairs of a page."""
    loose = spans.where(T.is_math_font(F.col("font")) & ~F.coalesce(F.col("owner").isin("formula", "table", "figure"), F.lit(False)))
    free = loose.where("owner is null").select(*PAGE, "span_id", *EDGES)
    a, b = G.box("l_"), G.box("r_")
    on_line = (G.y_overlap(a, b) > 1.0) & (F.least(F.abs(a[0] - b[2]), F.abs(b[0] - a[2])) < gap)
    near = sweep.overlaps(free, models.select(*PAGE, *EDGES), PAGE, reach=max(margin, gap)).where(G.intersects_closed(a, b, margin) | on_line)
    marked = loose.join(near.select(*PAGE, F.col("l_span_id").alias("span_id")).distinct().withColumn("near_", F.lit(True)), [*PAGE, "span_id"], "left")
    t = F.trim("text")
    kind = (
        F.when(F.col("owner").isNotNull(), "paragraph_owned_math_like_span")
        .when(F.col("near_"), "ownership_missing")
        .when(t.isin("↑", "↓"), "typographic_direction_marker")
        .when(t.rlike("^[0-9]{1,4}$") & (F.col("size") <= 8.5), "superscript_or_citation_marker")
        .when(t.rlike(r"^[\s,.;:(){}\[\]]+$"), "punctuation_fragment")
        .otherwise("detection_missing_candidate")
    )
    return marked.select(*spans.columns, kind.alias("classification"))


def column_class(boxes: DataFrame, columns: DataFrame, box_id: str, least: float = 0.5) -> DataFrame:
    """Columns that a box covers by more than ``least``: one's number, -1 for two or more (full width), null for none. A page has
    few columns, so they are met by its key."""
    c = columns.select(*PAGE, "col", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"))
    area = F.greatest(F.lit(0.0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    hit = boxes.join(c, PAGE).where(area > least).groupBy(*PAGE, box_id).agg(F.count("*").alias("n_"), F.min("col").alias("col_"))
    return boxes.join(hit, [*PAGE, box_id], "left").withColumn("column", F.when(F.col("n_") >= 2, -1).when(F.col("n_") == 1, F.col("col_"))).drop("n_", "col_")


def resolve_placements(placements: DataFrame, segments: DataFrame, flows: DataFrame, nodes: DataFrame, columns: DataFrame, obstacles: DataFrame) -> DataFrame:
    """placements in the order of a reader (down, then right, then segment), with the segment that each stands for (its own; else
    by turns), how often the whole formula came before (occurrence), its flow interval by turns, the part of its box that its
    ancestors' clips leave, its column, and its area in common with obstacles."""
    w = Window.partitionBy(*KEY).orderBy("y0", "x0", F.coalesce("segment", F.lit("")), "placement")
    ordered = placements.withColumn("turn_", F.row_number().over(w) - 1)
    parts = segments.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("parts_"))
    ways = flows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "y0", "y1"))).alias("flows_"))
    j = ordered.join(parts, KEY, "left").join(ways, KEY, "left")
    expected = F.greatest(F.coalesce(F.size("parts_"), F.lit(0)), F.lit(1))
    names = F.transform("parts_", lambda p: p["segment"])
    named = F.when(F.col("segment").isNotNull(), F.greatest(F.array_position(names, F.col("segment")) - 1, F.lit(0))).otherwise(F.col("turn_") % expected)
    flow = F.when(F.size("flows_") > 0, F.get("flows_", (F.col("turn_") % F.greatest(F.size("flows_"), F.lit(1))).cast("int")))
    out = j.select(
        *placements.columns, F.col("turn_").cast("bigint").alias("turn"), F.floor(F.col("turn_") / expected).alias("occurrence"),
        F.coalesce("segment", F.get(names, named.cast("int"))).alias("stands_for"), flow["y0"].alias("flow_y0"), flow["y1"].alias("flow_y1"),
    )
    out = chains.clip_to_ancestors(out, chains.envelopes(nodes, PAGE), PAGE)
    out = column_class(out, columns, "placement")
    hit = sweep.overlaps(out.select(*PAGE, "placement", *EDGES), obstacles.select(*PAGE, *EDGES), PAGE, closed=False)
    area = hit.groupBy(*PAGE, F.col("l_placement").alias("placement")).agg(F.sum(G.intersection_area(G.box("l_"), G.box("r_"))).alias("obstacle_area"))
    return out.join(area, [*PAGE, "placement"], "left").withColumn("obstacle_area", F.coalesce("obstacle_area", F.lit(0.0)))


def defects_of() -> Column:
    """The defects that the sums of a formula show, in order."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    shown = {
        "detection_missing": ~n("detected"), "ownership_missing": n("unowned"), "ownership_pollution": n("double_owned") | n("pollution"), "model_missing": ~n("modelled"),
        "svg_missing": n("svg_missing"), "svg_blank": n("svg_blank"), "svg_viewbox_crop": n("viewbox_crops"), "embed_missing": n("embed_missing"), "final_blank": n("final_blanks"), "final_crop": n("final_crops"),
        "orphan_formula": n("embed_missing"), "duplicate_formula": n("duplicate_embed"), "equation_number_orphan": n("equation_orphans"), "condition_text_orphan": n("condition_orphans"), "renderer_disagreement": n("disagreements"),
    }
    return F.filter(F.array(*(F.when(shown[d], d) for d, _, _ in DEFECTS)), lambda d: d.isNotNull())


def status_of(defects: Column) -> Column:
    """One word for the worst of a formula's defects."""
    has = lambda *names: F.arrays_overlap(defects, F.array(*map(F.lit, names)))
    return (
        F.when(F.size(defects) == 0, "complete").when(has("ownership_missing", "ownership_pollution"), "ownership_error").when(has("duplicate_formula"), "duplicate")
        .when(has("final_crop", "svg_viewbox_crop"), "cropped").when(has("final_blank", "svg_blank"), "blank").when(has("orphan_formula"), "orphan").otherwise("unrendered")
    )


SUMS = (
    "detected", "modelled", "components", "unowned", "double_owned", "uncovered", "equation_orphans", "condition_orphans", "segments", "svg_missing", "svg_blank", "viewbox_crops",
    "placements", "final_blanks", "final_crops", "disagreements", "double_render", "pollution",
)


def formula_lives(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a formula that any stage knows: sums of the stages, defects, status, and the first stage that failed with why."""
    t = tables
    blank = F.col("has_asset") & (F.coalesce("ink", F.lit(0)) <= 0)
    count = lambda df, **sums: df.groupBy(*KEY).agg(*(v.alias(k) for k, v in sums.items()))
    parts = [
        count(t["detections"], detected=F.count("*")),
        count(t["models"], modelled=F.count("*")),
        component_sums(t["components"], t["spans"], t["segments"]),
        count(t["segments"], segments=F.count("*"), svg_missing=F.count_if(~F.col("has_asset")), svg_blank=F.count_if(blank), viewbox_crops=F.count_if("viewbox_crop")),
        count(t["placements"], placements=F.count("*"), final_blanks=F.count_if("final_blank"), final_crops=F.count_if("final_crop"), disagreements=F.count_if("disagreement")),
        count(t["exclusivity"], double_render=F.sum("double_render"), pollution=F.sum(F.col("double_render") + F.col("pollution"))),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    lives = every.groupBy(*KEY).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS))
    zero = F.lit(0).cast("bigint")
    lives = lives.withColumns({"embed_missing": F.greatest(zero, F.col("segments") - F.col("placements")), "duplicate_embed": F.greatest(zero, F.col("placements") - F.col("segments"))})
    lives = lives.withColumn("defects", defects_of())
    first = F.get("defects", F.lit(0))
    pick = lambda k: F.coalesce(*(F.when(first == d[0], d[k]) for d in DEFECTS))
    return lives.withColumns({"status": status_of(F.col("defects")), "failure_stage": pick(1), "failure_reason": pick(2)})


def document_traces(lives: DataFrame, loose: DataFrame) -> DataFrame:
    """By document: models, traces, how many of the models are traced, ids that came twice, and lost and doubled fragments."""
    a = lives.groupBy("doc_id").agg(
        F.count("*").alias("traces"), F.sum(F.least(F.col("modelled"), F.lit(1))).alias("models"), F.sum(F.greatest(F.col("modelled") - 1, F.lit(0))).alias("id_collisions"), F.sum("unowned").alias("unowned"),
        F.sum("double_owned").alias("double_owned"), F.sum("double_render").alias("double_render"), F.count_if(F.size("defects") == 0).alias("complete"),
    )
    b = loose.groupBy("doc_id").agg(F.count_if(F.col("classification") == "ownership_missing").alias("lost"), F.count_if(F.col("classification") == "detection_missing_candidate").alias("undetected"))
    counts = ("traces", "models", "id_collisions", "unowned", "double_owned", "double_render", "complete", "lost", "undetected")
    both = a.unionByName(b, allowMissingColumns=True).groupBy("doc_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts))
    return both.withColumn("coverage", F.round(F.col("traces") / F.greatest(F.col("models"), F.lit(1)), 4))
