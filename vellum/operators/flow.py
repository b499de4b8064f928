"""Placing paragraphs in columns around obstacles, and the search for a setting that fits. Cursors depend on what was
placed before, so a page is folded in Python; pages are independent and bounded."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
# Settings from roomy to tight, (level, gap, line height, font) as scales, and those of references where they differ.
# The last is taken if none fits.
LEVELS = (
    (0, 1.00, 1.00, 1.00, None),
    (1, 0.75, 1.00, 1.00, None),
    (2, 0.50, 1.00, 1.00, None),
    (3, 0.45, 0.96, 1.00, None),
    (4, 0.40, 0.92, 0.97, None),
    (4, 0.35, 0.92, 0.94, None),
    (5, 0.35, 0.92, 0.94, (0.22, 0.84, 0.88)),
)
#: Gap and line height at scale one.
GAP, LINE_HEIGHT = 8.0, 1.5


def place(items, obstacles, gap: float = 8.0, y0: float = 72.0):
    """Tops of items (anchor, height) in one column: at the anchor or below the last, pushed below any obstacle (top, bottom) in the way."""
    out, cursor = [], y0
    for anchor, height in items:
        y, moved = max(anchor, cursor), True
        while moved:
            moved = False
            for a, b in obstacles:
                if y < b and a < y + height:
                    y, moved = b + gap, True
        out.append(y)
        cursor = y + height + gap
    return out


def column_flow(paragraphs: DataFrame, obstacles: DataFrame, gap: float = 8.0) -> DataFrame:
    """paragraphs(doc_id, page, column, ordinal, anchor, height), obstacles(doc_id, page, column, top, bottom): flow_y of each. A
    column is a row of two arrays, and Python gets batches of them; equal obstacles are one."""
    keys = [*PAGE, "column"]
    last = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    items = paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(last("anchor"), "ordinal", F.col("height").cast("double").alias("height")))).alias("items"))
    blocked = obstacles.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("top", "bottom"))).alias("blocked"))

    def run(frames):
        for pdf in frames:
            rows, ys = [], []
            for doc, page, column, held, way in zip(pdf["doc_id"], pdf["page"], pdf["column"], pdf["items"], pdf["blocked"], strict=True):
                found = [(r["anchor"], math.nan if r["height"] is None else r["height"]) for r in held]
                ys += place(found, [(r["top"], r["bottom"]) for r in way] if way is not None else [], gap, 72.0)
                rows += [(doc, page, column, r["ordinal"], r["height"]) for r in held]
            out = pd.DataFrame(rows, columns=[*keys, "ordinal", "height"])
            yield out.assign(flow_y=ys)[[*keys, "ordinal", "flow_y", "height"]]

    return items.join(blocked, keys, "left").mapInPandas(run, "doc_id long, page long, column int, ordinal long, flow_y double, height double")


def overflow(flow: DataFrame, limit: float = 720.0) -> DataFrame:
    return flow.groupBy(*PAGE).agg(F.greatest(F.lit(0.0), F.max(F.col("flow_y") + F.col("height")) - limit).alias("overflow"))


def simulate(paragraphs, intervals, setting, size: float = 10.0) -> float:
    """Height that finds no place: paragraphs (column, em, width, movable, reference) into intervals {column: [(a, b), ...]} by
    cursors, the own column first, another if movable. References take their own scales where the setting has them."""
    room = {c: [b - a for a, b in v] for c, v in intervals.items()}
    lost = 0.0
    for column, em, width, movable, reference in paragraphs:
        gap, line, font = setting[4] if reference and setting[4] else setting[1:4]
        need = max(1, math.ceil(em / max(1.0, width / (size * font)))) * size * font * LINE_HEIGHT * line + GAP * gap
        for c in [column, *([k for k in room if k != column] if movable else [])]:
            for i, free in enumerate(room.get(c, [])):
                used = min(free, need)
                room[c][i] -= used
                need -= used
                if need <= 0:
                    break
            if need <= 0:
                break
        lost += max(0.0, need)
    return lost


def resolve_capacity(paragraphs: DataFrame, intervals: DataFrame, levels=LEVELS, tolerance: float = 0.01) -> DataFrame:
    """paragraphs(doc_id, page, ordinal, column, em, width, movable, reference), intervals(doc_id, page, column, a, b): the first
    setting without overflow, else the last: its level and scales, attempts made, overflow, and whether text spills."""
    rows = paragraphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ordinal", "column", "em", "width", "movable", "reference"))).alias("ps"))
    free = intervals.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("column", "a", "b"))).alias("iv"))

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                by: dict[int, list] = {}
                for x in r.iv if r.iv is not None else []:
                    by.setdefault(x["column"], []).append((x["a"], x["b"]))
                ps = [(x["column"], x["em"], x["width"], x["movable"], x["reference"]) for x in r.ps]
                for attempt, level in enumerate(levels, 1):
                    over = simulate(ps, by, level)
                    if over <= tolerance:
                        break
                out.append((r.doc_id, r.page, *level[:4], level[4] is not None, attempt, round(over, 3), over > tolerance))
            yield pd.DataFrame(out, columns=["doc_id", "page", "level", "gap_scale", "line_height_scale", "font_scale", "reference_compact", "attempts", "overflow", "spill_required"])

    return rows.join(free, PAGE, "left").mapInPandas(run, "doc_id long, page long, level int, gap_scale double, line_height_scale double, font_scale double, reference_compact boolean, attempts int, overflow double, spill_required boolean")


def greedy_diverse(candidates: list[tuple[str, set]], n: int) -> list[str]:
    """n names, each the one that adds most features not seen yet, first of equals. For short lists, such as pages to look at."""
    out, seen, left = [], set(), list(candidates)
    for _ in range(min(n, len(left))):
        best = max(left, key=lambda c: len(c[1] - seen))
        out.append(best[0])
        seen |= best[1]
        left.remove(best)
    return out
