"""Verdicts on ink of assets and final pages."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import ink

ASSET = "has_asset boolean, svg string, width double, height double, ink int, raster_error string, viewbox_crop boolean"


@pytest.mark.parametrize("row, cause, zero_size, zero_ink", [
    ((False, None, None, None, None, None, False), "asset_missing", False, False), ((True, "<svg><path d='M0'/></svg>", 9.0, 9.0, 5, None, False), None, False, False), ((True, "<svg><path/></svg>", 9.0, 9.0, 0, "broken", False), "rasterization_or_path_conversion_failed", False, True),
    ((True, "<svg><pathological/><g></g></svg>", 9.0, 0.0, 0, None, False), "empty_svg_no_drawable_nodes", True, True), ((True, "<s:svg><s:text fill-opacity = '0.0'>x</s:text></s:svg>", 9.0, 9.0, None, None, False), "transparent_drawable_nodes", False, True),
    ((True, "<svg><use stroke=\"#FFFFFF\"/></svg>", 9.0, None, 0, None, False), "white_drawable_nodes", True, True), ((True, "<svg><image opacity='0.5' fill='#ffe'/></svg>", 9.0, 9.0, 0, None, False), "drawable_nodes_outside_viewbox_or_glyph_missing", False, True),
])
def test_assets(spark, row, cause, zero_size, zero_ink):
    r = ink.asset_verdicts(spark.createDataFrame([row], ASSET)).first()
    assert (r.zero_ink_cause, r.zero_size, r.zero_ink, r.missing) == (cause, zero_size, zero_ink, not row[0])


FINAL = "k int, placed boolean, a_ink int, b_ink int, a_edge boolean, b_edge boolean, asset_ink int, asset_scale double, asset_edge boolean"


def test_final_pages(spark):
    rows = [
        (1, True, 160, 320, False, False, 160, 4.0, False),  # as much as before
        (2, True, 0, 5, False, False, 160, 4.0, False),  # one renderer shows nothing
        (3, True, 3, 4, True, True, 1600, 4.0, False),  # cropped
        (4, True, 3, 4, True, True, 1600, 4.0, True),  # the asset's ink stood at the edge too
        (5, True, 3, None, True, True, 1600, 4.0, False),  # no second renderer
        (6, None, None, None, None, None, None, None, None),
        (7, True, 1, 1, True, True, 48, 4.0, False),  # too little ink before to tell
    ]
    v = ink.final_verdicts(spark.createDataFrame(rows, FINAL))
    got = {r.k: (r.final_missing, r.final_blank, r.disagreement, r.final_crop, r.ink_ratio) for r in v.collect()}
    assert got == {1: (False, False, False, False, 1.0), 2: (False, True, True, False, 0.0), 3: (False, False, False, True, 0.0019), 4: (False, False, False, False, 0.0019), 5: (False, True, False, False, 0.0), 6: (True, True, False, False, 0.0), 7: (False, False, False, False, 0.0208)}
    gate = {r.k: r.decision for r in ink.final_gate(v, ["k"]).collect()}
    assert {k for k, d in gate.items() if d == "pass"} == {1, 4, 7}
    assert ink.asset_gate(ink.asset_verdicts(spark.createDataFrame([(True, "<path/>", 1.0, 1.0, 1, None, c) for c in (False, True)], ASSET)).withColumn("g", F.lit(1)), ["g"]).first().decision == "fail"
