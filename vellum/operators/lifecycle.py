"""A formula's life from source to page: completeness of its model, causes of duplicates, what was lost on the way, and the
smallest safe recovery. Inputs are one row a formula with counts; everything is a column expression or one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def model_class(core: Column, owned: Column, segments: Column, assets: Column, placements: Column) -> Column:
    """The first part of a model that is missing."""
    return (
        F.when(core == 0, "component_missing")
        .when(owned == 0, "ownership_ambiguous")
        .when(segments == 0, "render_segment_missing")
        .when(assets == 0, "asset_missing")
        .when(placements == 0, "placement_missing")
        .otherwise("complete")
    )


def completeness(models: DataFrame, keys: list[str]) -> DataFrame:
    """models(keys, core, owned, segments, assets, placements): counts by class and the decision."""
    cls = model_class(count("core"), count("owned"), count("segments"), count("assets"), count("placements"))
    unrendered = F.col("class").isin("asset_missing", "placement_missing")
    out = models.withColumn("class", cls).groupBy(*keys).agg(F.count("*").alias("models"), F.count_if(F.col("class") == "complete").alias("complete"), F.count_if(unrendered).alias("unrendered"))
    return out.withColumn("decision", F.when(F.col("models") == F.col("complete"), "pass").otherwise("fail"))


def placeholder_occurrences(paragraphs: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """paragraphs(keys, text), formulas(keys, formula): how often each formula's token stands in the paragraphs. Tokens are taken
    out of the texts once and met by equality, so no text is searched for every formula."""
    found = paragraphs.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(r"\{\{FORMULA_([A-Za-z0-9_\-]+)\}\}"), F.lit(1))).alias("formula"))
    counts = found.groupBy(*keys, "formula").agg(F.count("*").alias("occurrences"))
    return formulas.join(counts, [*keys, "formula"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def duplicate_cause(inline: Column, occurrences: Column, segment_placed_twice: Column) -> Column:
    """F: an inline token in several paragraphs; A: one segment placed again; B: more segments than expected."""
    return F.when(inline & (occurrences > 1), "F").when(inline | segment_placed_twice, "A").otherwise("B")


def duplicate_causes(rendered: DataFrame, keys: list[str]) -> DataFrame:
    """rendered(keys, inline, occurrences, segment_placed_twice, expected, actual): formulas placed more often than expected, by cause."""
    over = rendered.where(F.col("actual") > F.col("expected"))
    cause = duplicate_cause(F.col("inline"), F.col("occurrences"), F.col("segment_placed_twice"))
    return over.groupBy(*keys).agg(F.count("*").alias("duplicates"), *(F.count_if(cause == c).alias(f"cause_{c.lower()}") for c in "ABCDEF"))


#: Trace columns that are faults where above zero, and the name of what they count.
LOSSES = {
    "blank_placements": "blank",
    "embed_missing": "orphan",
    "duplicate_embed": "duplicate",
    "renderer_disagreement": "renderer_disagreement",
    "double_render": "double_render",
}


def trace_completeness(traces: DataFrame, keys: list[str]) -> DataFrame:
    """traces(keys, source_ink, svg_ink, renderer_one_ink, renderer_two_ink, crop_placements, viewbox_crops, equation_orphans,
    condition_orphans, and the columns of LOSSES): hard counts, rates and the decision."""
    to_svg = (count("source_ink") > 0) & (count("svg_ink") <= 0)
    to_page = (count("svg_ink") > 0) & ((count("blank_placements") > 0) | (count("renderer_one_ink") <= 0) | (count("renderer_two_ink") <= 0))
    hard = {
        **{f"n_{v}": F.count_if(count(c) > 0) for c, v in LOSSES.items()},
        "n_cropped": F.count_if((count("crop_placements") > 0) | (count("viewbox_crops") > 0)),
        "n_unrendered": F.count_if((count("embed_missing") > 0) | (count("blank_placements") > 0)),
        "n_equation_orphans": F.sum(count("equation_orphans")),
        "n_condition_orphans": F.sum(count("condition_orphans")),
        "n_source_to_svg": F.count_if(to_svg),
        "n_svg_to_page": F.count_if(to_page),
    }
    out = traces.groupBy(*keys).agg(F.count("*").alias("traces"), *(c.cast("bigint").alias(n) for n, c in hard.items()))
    total = sum((F.col(n) for n in hard), F.lit(0))
    return (
        out.withColumn("success_rate", F.round((F.col("traces") - F.col("n_unrendered")) / F.greatest("traces", F.lit(1)), 4))
        .withColumn("ink_recovery", F.round((F.col("traces") - F.col("n_source_to_svg") - F.col("n_svg_to_page")) / F.greatest("traces", F.lit(1)), 4))
        .withColumn("decision", F.when(total == 0, "pass").otherwise("fail"))
    )


# Recovery policies.
NO_ACTION = "NO_ACTION"
REBUILD_VIEWBOX = "REBUILD_VIEWBOX"
READOPT_ORPHAN_FRAGMENT = "READOPT_ORPHAN_FRAGMENT"
REEMBED_EXISTING_SVG = "REEMBED_EXISTING_SVG"
REGENERATE_SVG_FROM_EXISTING_MODEL = "REGENERATE_SVG_FROM_EXISTING_MODEL"
BLOCK_UNSAFE = "BLOCK_UNSAFE"


def recovery() -> Column:
    """The smallest safe policy for a trace's columns: status, stage, double_owned, reattachable, duplicate_embed, embed_missing,
    svg_missing, viewbox_crops, model_exists, all_ink. What can't be shown to be safe is blocked: fragments with two owners,
    doubled or lost placements, and failures before there is an asset."""
    status, stage = F.coalesce("status", F.lit("complete")), F.coalesce("stage", F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    unsafe_placement = (count("duplicate_embed") > 0) | ((count("embed_missing") > 0) & (count("svg_missing") > 0))
    orphaned = status.isin("ownership_error", "orphan")
    return (
        F.when(status == "complete", NO_ACTION)
        .when(count("double_owned") > 0, BLOCK_UNSAFE)
        .when(orphaned & flag("reattachable"), READOPT_ORPHAN_FRAGMENT)
        .when(orphaned | unsafe_placement, BLOCK_UNSAFE)
        .when((stage == "svg_generation") & (count("viewbox_crops") > 0), REBUILD_VIEWBOX)
        .when((stage == "svg_generation") & flag("model_exists"), REGENERATE_SVG_FROM_EXISTING_MODEL)
        .when(stage.isin("embedding", "final_pdf") & flag("all_ink"), REEMBED_EXISTING_SVG)
        .otherwise(BLOCK_UNSAFE)
    )


def recovery_report(traces: DataFrame, keys: list[str]) -> DataFrame:
    p = traces.withColumn("policy", recovery())
    is_ = lambda v: F.col("policy") == v
    out = p.groupBy(*keys).agg(
        F.count("*").alias("traces"),
        F.count_if(~is_(NO_ACTION) & ~is_(BLOCK_UNSAFE)).alias("automatic"),
        F.count_if(is_(BLOCK_UNSAFE)).alias("blocked"),
        F.count_if(is_(REGENERATE_SVG_FROM_EXISTING_MODEL)).alias("regenerated"),
        F.count_if(is_(REEMBED_EXISTING_SVG)).alias("reembedded"),
        F.count_if(is_(REBUILD_VIEWBOX)).alias("rebuilt"),
        F.count_if(is_(READOPT_ORPHAN_FRAGMENT)).alias("readopted"),
    )
    return out.withColumn("decision", F.when(F.col("blocked") > 0, "blocked").otherwise("pass"))


# Words of a condition that belong to a formula.
FORMULA_CONDITIONS = ("if", "otherwise", "where", "correctly supports")


def adopted_kind(text: Column) -> Column:
    """Whether a text taken into a formula is part of it: its number, a condition's word, or ordinary language."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    normal = F.regexp_replace(F.lower(F.regexp_replace(bare, r"\s+", " ")), r"^[ ,.;:]+|[ ,.;:]+$", "")
    return F.when(bare.rlike(r"^\(\s*\d{1,3}\s*\)$"), "equation_number").when(normal.isin(*FORMULA_CONDITIONS), "condition_word").otherwise("ordinary_natural_language")


def adopted_prose(components: DataFrame, keys: list[str]) -> DataFrame:
    """components(keys, text) of formulas that were adopted from the text: how many may stay, and whether all may."""
    kind = adopted_kind(F.col("text"))
    out = components.groupBy(*keys).agg(F.count("*").alias("adopted"), F.count_if(kind != "ordinary_natural_language").alias("allowed"))
    return out.withColumn("prose", F.col("adopted") - F.col("allowed")).withColumn("passed", F.col("prose") == 0)


def adoption_trace(kind_counts: DataFrame) -> DataFrame:
    """Shares of the kinds among all adopted texts. kind_counts(kind, n)."""
    total = kind_counts.agg(F.sum("n").alias("all_"))
    return kind_counts.join(F.broadcast(total)).select("kind", "n", (F.col("n") / F.col("all_")).alias("share"))
