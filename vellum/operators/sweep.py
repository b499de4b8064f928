"""Joins of boxes by a plane sweep.

Both sides are dealt by their keys (a page), or by key and horizontal strip where a key may hold very many boxes, sorted so
that a key's rows follow one another, and swept in Arrow batches of whole keys. A box meets those of the other side whose
lower edge lies between its own edges, found by binary search over ranks of (key, edge); of the two axes the one with fewer
such candidates is swept (the vertical one, if it has few), and candidates are tested in pieces of ``PIECE``. Memory is linear in a key's boxes and what
overlaps is the only thing that is written out: no pairs of a page are formed.

A box with a null coordinate or a null key meets nothing. Boxes whose edges are the wrong way round are tested as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")
#: Rows that are swept together, if not more in one key.
ROWS = 1 << 16
#: Candidates that are tested at once.
PIECE = 1 << 20
#: Candidates a box on the first axis that make a look at the second one dearer than their tests.
FEW = 2


def _side(df: DataFrame, other: DataFrame, keys: list[str], keep: list[str], other_keep: list[str], side: int, strip: float | None, reach: float) -> DataFrame:
    own = F.struct(*(F.col(c) for c in keep))
    none = F.lit(None).cast(other.select(F.struct(*other_keep)).schema[0].dataType)
    payload = (own.alias("l_"), none.alias("r_")) if side == 0 else (none.alias("l_"), own.alias("r_"))
    rows = df.select(*keys, F.lit(side).cast("int").alias("side_"), *(F.col(c).cast("double").alias(f"{c}_") for c in EDGES), *payload)
    if strip is None:
        return rows
    first, last = (F.coalesce(F.floor((F.col(f"{e}_") + by) / strip), F.lit(0)) for e, by in (("y0", -reach), ("y1", reach)))
    return rows.withColumn("strip_", F.explode(F.sequence(first, last)))


def swept(left: DataFrame, right: DataFrame, keys: list[str], left_cols: list[str], right_cols: list[str], each: Callable, schema: str, *, strip: float | None = None, reach: float = 0.0) -> DataFrame:
    """Runs ``each(table, groups)`` over Arrow tables of whole keys (and strips); the table has the keys, side_ (0 left),
    x0_ to y1_, and the chosen columns as structs l_ and r_, and with strips each row's as strip_; ``groups`` numbers the keys. A table
    that is both sides comes once, as the left one. A window deals and sorts the rows, which costs no shuffle where both
    sides are dealt by a part of the keys."""
    rows = _side(left, right, keys, left_cols, right_cols, 0, strip, reach)
    if left is not right:
        rows = rows.unionByName(_side(right, left, keys, right_cols, left_cols, 1, strip, 0.0))
    by = keys if strip is None else [*keys, "strip_"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("side_"))
    # the place is looked at, so that the window stays, but isn't sent
    dealt = rows.withColumn("g_", F.when(place > 0, F.xxhash64(*by))).sortWithinPartitions(*by, "side_")
    return whole_keys(dealt, each, schema)


def whole_keys(dealt: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Runs ``each(table, groups)`` over Arrow tables of whole keys. dealt: a key's rows follow one another in one part and have
    equal ``g_``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def tables(done: bool):
            nonlocal held, n
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g_").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            cut = table.num_rows if done else int(starts[-1])  # the last key may go on in the next batch
            if cut:
                groups = np.searchsorted(starts, np.arange(cut), "right") - 1
                yield table.slice(0, cut), groups
            rest = table.slice(cut)
            held, n = (rest.to_batches() if rest.num_rows else []), rest.num_rows

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                for t, groups in tables(False):
                    yield from each(t, groups)
        for t, groups in tables(True):
            yield from each(t, groups)

    return dealt.mapInArrow(run, schema)


def boxes_of(table: pa.Table, groups: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, groups and edges (n, 4) of a side's rows that have all four edges."""
    edges = np.stack([table.column(f"{e}_").to_numpy(zero_copy_only=False).astype(float) for e in EDGES], axis=1)
    rows = np.flatnonzero((table.column("side_").to_numpy() == side) & ~np.isnan(edges).any(axis=1))
    return rows, groups[rows], edges[rows]


def ranks(groups: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Dense ranks of (group, value) over all the arrays together: equal pairs have equal ranks."""
    g, v = np.concatenate(groups), np.concatenate(values)
    order = np.lexsort((v, g))
    fresh = np.concatenate(([0], ((g[order][1:] != g[order][:-1]) | (v[order][1:] != v[order][:-1])).astype(np.int64)))
    found = np.empty(len(g), np.int64)
    found[order] = np.cumsum(fresh)
    return np.split(found, np.cumsum([len(x) for x in groups])[:-1])


def overlapping(lg: np.ndarray, l: np.ndarray, rg: np.ndarray, r: np.ndarray, closed: bool, reach: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of left and right boxes of one group that overlap (closed: or touch), the left ones grown by ``reach``."""
    if not len(l) or not len(r):
        return
    l = l + np.array([-reach, -reach, reach, reach])
    end = "right" if closed else "left"
    best = None
    for axis in (1, 0):
        llo, lhi, rlo, rhi = ranks([lg, lg, rg, rg], [l[:, axis], l[:, axis + 2], r[:, axis], r[:, axis + 2]])
        lo, ro = np.argsort(llo, kind="stable"), np.argsort(rlo, kind="stable")
        a = np.searchsorted(rlo[ro], llo, "left"), np.searchsorted(rlo[ro], lhi, end)
        b = np.searchsorted(llo[lo], rlo, "right"), np.searchsorted(llo[lo], rhi, end)
        counts = [np.maximum(0, z - y) for y, z in (a, b)]
        total = sum(int(c.sum()) for c in counts)
        if best is None or total < best[0]:
            best = total, ((a[0], counts[0], ro, True), (b[0], counts[1], lo, False))
        if total <= FEW * (len(l) + len(r)):
            break
    for start, count, order, from_left in best[1]:
        sums = np.cumsum(count)
        i = 0
        while i < len(count):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + PIECE, "right")))
            c = count[i:j]
            one = np.repeat(np.arange(i, j), c)
            inner = np.arange(len(one)) - np.repeat(np.cumsum(c) - c, c)
            other = order[np.repeat(start[i:j], c) + inner]
            li, ri = (one, other) if from_left else (other, one)
            x, y = l[li], r[ri]
            hit = (x[:, :2] <= y[:, 2:]) & (y[:, :2] <= x[:, 2:]) if closed else (x[:, :2] < y[:, 2:]) & (y[:, :2] < x[:, 2:])
            hit = hit.all(axis=1)
            if hit.any():
                yield li[hit], ri[hit]
            i = j


def _columns(table: pa.Table, rows: np.ndarray, struct: str) -> list[pa.Array]:
    chosen = table.column(struct).combine_chunks().take(pa.array(rows))
    return chosen.flatten()


def _types(df: DataFrame, names: list[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {c: kinds[c] for c in names}


def _said(**fields: str) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], *, closed: bool = True, strip: float | None = None, reach: float = 0.0) -> DataFrame:
    """Pairs of boxes of equal keys that overlap, the left ones grown by ``reach`` on all sides: keys, l_*, r_*."""
    lc, rc = ([c for c in df.columns if c not in keys] for df in (left, right))
    schema = _said(**_types(left, keys), **{f"l_{c}": t for c, t in _types(left, lc).items()}, **{f"r_{c}": t for c, t in _types(right, rc).items()})
    names = [*keys, *(f"l_{c}" for c in lc), *(f"r_{c}" for c in rc)]
    one = left is right and (strip is None or not reach)

    def each(table, groups):
        lrows, lg, l = boxes_of(table, groups, 0)
        rrows, rg, r = (lrows, lg, l) if one else boxes_of(table, groups, 1)
        at = None if strip is None else table.column("strip_").to_numpy()
        for li, ri in overlapping(lg, l, rg, r, closed, reach):
            if strip is not None:  # a pair is written where both are met first
                here = np.maximum(np.floor((l[li, 1] - reach) / strip), np.floor(r[ri, 1] / strip)) == at[lrows[li]]
                li, ri = li[here], ri[here]
            taken = [table.column(k).combine_chunks().take(pa.array(lrows[li])) for k in keys]
            yield pa.RecordBatch.from_arrays([*taken, *_columns(table, lrows[li], "l_"), *_columns(table, rrows[ri], "l_" if one else "r_")], names=names)

    known = left.dropna(subset=keys)
    return swept(known, known if one else right.dropna(subset=keys), keys, lc, rc, each, schema, strip=strip, reach=reach)


def cover(left: DataFrame, right: DataFrame, keys: list[str], left_id: str) -> DataFrame:
    """Left boxes that right ones overlap or touch: keys, left_id, the sum of common areas, and the best share of a pair's union. Pairs
    are summed where they are found and never written."""
    schema = _said(**_types(left, [*keys, left_id]), common="double", best_iou="double")

    def each(table, groups):
        lrows, lg, l = boxes_of(table, groups, 0)
        _, rg, r = boxes_of(table, groups, 1)
        size = lambda b: np.prod(np.maximum(b[:, 2:] - b[:, :2], 0.0), axis=1)
        sums, best, met = np.zeros(len(l)), np.zeros(len(l)), np.zeros(len(l), bool)
        for li, ri in overlapping(lg, l, rg, r, True):
            common = np.prod(np.maximum(np.minimum(l[li, 2:], r[ri, 2:]) - np.maximum(l[li, :2], r[ri, :2]), 0.0), axis=1)
            union = size(l[li]) + size(r[ri]) - common
            sums += np.bincount(li, common, len(l))
            np.maximum.at(best, li, np.divide(common, union, out=np.zeros(len(li)), where=union > 0))
            met[li] = True
        hit = np.flatnonzero(met)
        taken = [table.column(k).combine_chunks().take(pa.array(lrows[hit])) for k in keys]
        yield pa.RecordBatch.from_arrays([*taken, _columns(table, lrows[hit], "l_")[0], pa.array(sums[hit]), pa.array(best[hit])], names=[*keys, left_id, "common", "best_iou"])

    return swept(left.dropna(subset=keys), right.dropna(subset=keys), keys, [left_id], EDGES[:1], each, schema)


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, *, strip: float | None = None) -> DataFrame:
    """Each left row with the right row of the largest common area, the smallest id of equals; null and 0 without one. A
    page's boxes are dealt once; with strips, the best of each strip meet in an aggregation."""
    row = {} if strip is None else {"row_": "bigint"}  # tells left rows of equal ids apart, whose strips' bests have to meet
    schema = _said(**_types(left, [*keys, left_id]), match=_types(right, [right_id])[right_id], area="double", **row)
    names = [*keys, left_id, "match", "area", *row]
    if row:
        left = left.withColumn("row_", F.monotonically_increasing_id())

    def each(table, groups):
        lrows, lg, l = boxes_of(table, groups, 0)
        rrows, rg, r = boxes_of(table, groups, 1)
        id_rank = np.empty(len(rrows), np.int64)
        ids = _columns(table, rrows, "r_")[0] if len(rrows) else pa.nulls(0)
        if len(rrows):
            id_rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(rrows))
        area, match = np.zeros(len(l)), np.full(len(l), -1, np.int64)
        for li, ri in overlapping(lg, l, rg, r, False):
            common = np.prod(np.minimum(l[li, 2:], r[ri, 2:]) - np.maximum(l[li, :2], r[ri, :2]), axis=1)
            order = np.lexsort((id_rank[ri], -common, li))
            li, ri, common = li[order], ri[order], common[order]
            first = np.flatnonzero(np.concatenate(([True], li[1:] != li[:-1])))
            li, ri, common = li[first], ri[first], common[first]
            held = match[li]
            better = (common > area[li]) | ((common == area[li]) & (held >= 0) & (id_rank[ri] < id_rank[np.maximum(held, 0)]))
            area[li[better]], match[li[better]] = common[better], ri[better]
        all_left = np.flatnonzero(table.column("side_").to_numpy() == 0)
        place = np.searchsorted(lrows, all_left)
        known = (place < len(lrows)) & (np.append(lrows, -1)[np.minimum(place, len(lrows))] == all_left)
        where, size = np.full(len(all_left), -1, np.int64), np.zeros(len(all_left))
        where[known], size[known] = match[place[known]], area[place[known]]
        found = ids.take(pa.array(np.maximum(where, 0), mask=where < 0)) if len(rrows) else pa.nulls(len(all_left), table.schema.field("r_").type.field(0).type)
        taken = [table.column(k).combine_chunks().take(pa.array(all_left)) for k in keys]
        own, *rest = _columns(table, all_left, "l_")
        yield pa.RecordBatch.from_arrays([*taken, own, found, pa.array(size), *rest], names=names)

    some = right.dropna(subset=keys)
    found = swept(left, some, keys, [left_id, *row], [right_id], each, schema, strip=strip)
    if strip is not None:
        best = F.min_by(F.struct("match", "area"), F.struct(-F.col("area"), F.coalesce(F.col("match").isNull(), F.lit(True)), F.col("match")))
        found = found.groupBy(*keys, left_id, "row_").agg(best.alias("b")).select(*keys, left_id, "b.match", "b.area")
    return found.select(*keys, left_id, "match", "area")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Each left row of a key that has right rows with the right row whose centre is nearest: by vertical distance, then
    horizontal, then the smallest id. Right centres are sorted by height; a left one looks up the levels next to it and, on
    those, the centres next to it: two binary searches, no pairs."""
    schema = _said(**_types(left, [*keys, left_id]), nearest=_types(right, [right_id])[right_id])

    def each(table, groups):
        lrows, lg, l = boxes_of(table, groups, 0)
        rrows, rg, r = boxes_of(table, groups, 1)
        if not len(l) or not len(r):
            return
        (lx, ly), (rx, ry) = (((b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2) for b in (l, r))
        ids = _columns(table, rrows, "r_")[0]
        id_rank = np.empty(len(rrows), np.int64)
        id_rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(rrows))
        order = np.lexsort((id_rank, rx, ry, rg))
        rg, rx, ry, by_id = rg[order], rx[order], ry[order], id_rank[order]
        # centres that are equal but for the id: the first stands for all
        first = np.flatnonzero(np.concatenate(([True], (rg[1:] != rg[:-1]) | (ry[1:] != ry[:-1]) | (rx[1:] != rx[:-1]))))
        order, rg, rx, ry, by_id = order[first], rg[first], rx[first], ry[first], by_id[first]
        lk, rk = ranks([lg, rg], [ly, ry])
        level = np.flatnonzero(np.concatenate(([True], rk[1:] != rk[:-1])))  # where a height begins
        ends = np.append(level[1:], len(rk))
        up = np.searchsorted(rk[level], lk, "left")
        best = np.full((len(l), 3), np.inf)
        found = np.full(len(l), -1, np.int64)
        for step in (0, -1):
            at = up + step
            ok = (at >= 0) & (at < len(level))
            ok[ok] = rg[level[at[ok]]] == lg[ok]
            rows = np.flatnonzero(ok)
            a, z = level[at[rows]], ends[at[rows]]
            # the place of lx among a..z: ranks of (level, x)
            mine, theirs = ranks([at[rows], np.repeat(np.arange(len(level)), ends - level)], [lx[rows], rx])
            place = np.searchsorted(theirs, mine, "left")
            for side in (0, -1):
                p = place + side
                good = (p >= a) & (p < z)
                i, q = rows[good], p[good]
                cand = np.stack([np.abs(ly[i] - ry[q]), np.abs(lx[i] - rx[q]), by_id[q].astype(float)], axis=1)
                held = best[i]
                less = (cand[:, 0] < held[:, 0]) | (cand[:, 0] == held[:, 0]) & ((cand[:, 1] < held[:, 1]) | (cand[:, 1] == held[:, 1]) & (cand[:, 2] < held[:, 2]))
                best[i[less]], found[i[less]] = cand[less], order[q[less]]
        hit = np.flatnonzero(found >= 0)
        taken = [table.column(k).combine_chunks().take(pa.array(lrows[hit])) for k in keys]
        yield pa.RecordBatch.from_arrays([*taken, _columns(table, lrows[hit], "l_")[0], ids.take(pa.array(found[hit]))], names=[*keys, left_id, "nearest"])

    return swept(left.dropna(subset=keys), right.dropna(subset=keys), keys, [left_id], [right_id], each, schema)
