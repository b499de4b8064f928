"""What became of a formula's ink: counts of dark pixels of assets and of final pages, measured elsewhere, to verdicts. Rasters stay
outside: two renderers' counts, their edges and an asset's source are input columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least ink of an asset, in pixels at scale one, that a crop can be told from, and the share of it that is left of a cropped one.
LEAST_INK, LEFT_OF_CROP = 4.0, 0.04
#: Elements that draw.
DRAWABLE = ("path", "text", "use", "image")


def elements(svg: Column, name: str) -> Column:
    """Opening tags of a name in an SVG source, with or without a namespace's prefix."""
    return F.regexp_count(F.coalesce(svg, F.lit("")), F.lit(rf"(?i)<(?:[a-z0-9]+:)?{name}(?=[\s/>])"))


def zero_ink_cause(exists: Column, svg: Column, ink: Column, raster_error: Column) -> Column:
    """Why an asset shows nothing; null if it shows something."""
    drawn = sum((elements(svg, e) for e in DRAWABLE), F.lit(0))
    attribute = lambda names, values: F.coalesce(svg.rlike(rf"(?i)<[^>]*\b(?:{names})\s*=\s*[\"']?(?:{values})[\"'\s/>]"), F.lit(False))
    return (
        F.when(~exists, "asset_missing").when(F.coalesce(ink, F.lit(0)) > 0, None).when(raster_error.isNotNull(), "rasterization_or_path_conversion_failed").when(drawn == 0, "empty_svg_no_drawable_nodes")
        .when(attribute("opacity|fill-opacity|stroke-opacity", r"0(?:\.0+)?"), "transparent_drawable_nodes").when(attribute("fill|stroke", "white|#fff|#ffffff"), "white_drawable_nodes").otherwise("drawable_nodes_outside_viewbox_or_glyph_missing")
    )


def asset_verdicts(assets: DataFrame) -> DataFrame:
    """assets(..., has_asset, svg, width, height, ink, raster_error, viewbox_crop) with missing, zero_size, zero_ink (each of what is
    there only) and zero_ink_cause."""
    there = F.col("has_asset")
    return assets.withColumns({
        "missing": ~there, "zero_size": there & ((F.coalesce("width", F.lit(0.0)) <= 0) | (F.coalesce("height", F.lit(0.0)) <= 0)), "zero_ink": there & (F.coalesce("ink", F.lit(0)) <= 0),
        "zero_ink_cause": zero_ink_cause(there, F.col("svg"), F.col("ink"), F.col("raster_error")),
    })


def asset_gate(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """By group: assets, each kind of loss, and the decision."""
    losses = ("missing", "zero_size", "zero_ink", "viewbox_crop")
    out = verdicts.groupBy(*keys).agg(F.count("*").alias("assets"), *(F.count_if(c).alias(c) for c in losses))
    return out.withColumn("decision", F.when(sum((F.col(c) for c in losses), F.lit(0)) == 0, "pass").otherwise("fail"))


def final_verdicts(placements: DataFrame, scale: float = 4.0) -> DataFrame:
    """placements(..., placed, a_ink, b_ink, a_edge, b_edge, asset_ink, asset_scale, asset_edge); b_ink is null where the second renderer
    isn't there. Adds final_missing, final_blank, disagreement, ink_ratio (the lesser renderer's ink by the asset's, both at
    scale one) and final_crop: strong ink before, hardly any left in both, pinned to an edge that the asset's ink kept off."""
    a, b = F.coalesce("a_ink", F.lit(0)), F.coalesce("b_ink", F.lit(0))
    both, placed = (a > 0) & (b > 0), F.coalesce("placed", F.lit(False))
    at_one = lambda ink, s: ink / F.greatest(s * s, F.lit(1.0))
    before = at_one(F.coalesce("asset_ink", F.lit(0)), F.coalesce(F.nullif("asset_scale", F.lit(0.0)), F.lit(1.0)))
    ratio = F.when(placed & both & (before > 0), F.least(at_one(a, F.lit(scale)), at_one(b, F.lit(scale))) / before).otherwise(0.0)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return placements.withColumns({
        "final_missing": ~placed, "final_blank": ~placed | ~both, "disagreement": placed & F.col("b_ink").isNotNull() & ((a > 0) != (b > 0)), "ink_ratio": F.round(ratio, 4),
        "final_crop": placed & both & (before >= LEAST_INK) & (ratio < LEFT_OF_CROP) & yes("a_edge") & yes("b_edge") & ~yes("asset_edge"),
    })


def final_gate(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """By group: placements, each kind of loss, and the decision, which fails without the second renderer."""
    losses = ("final_missing", "final_blank", "final_crop", "disagreement")
    out = verdicts.groupBy(*keys).agg(F.count("*").alias("placements"), *(F.count_if(c).alias(c) for c in losses), F.bool_and(~F.coalesce("placed", F.lit(False)) | F.col("b_ink").isNotNull()).alias("two_"))
    return out.withColumn("decision", F.when((sum((F.col(c) for c in losses), F.lit(0)) == 0) & F.col("two_"), "pass").otherwise("fail")).drop("two_")
