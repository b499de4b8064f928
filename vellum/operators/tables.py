"""Tables from texts and rules: type, columns, rows, cells, alignment, quality, and HTML."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import rounds, sequence, stats

EDGES = ("x0", "y0", "x1", "y1")


def table_type(tables: DataFrame) -> DataFrame:
    """tables(table_id, n_texts, n_h, n_v, has_image): full grid, sparse rules, borderless or raster."""
    kind = (
        F.when(F.col("has_image") & (F.col("n_texts") < 5), "raster")
        .when((F.col("n_h") >= 3) & (F.col("n_v") >= 2), "full_grid")
        .when((F.col("n_h") >= 2) & (F.col("n_texts") >= 5), "sparse_rule")
        .otherwise("borderless")
    )
    return tables.withColumn("table_type", kind)


def rule_roles(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal rules from the top: top, bottom, the middle of three a header separator, else inner; a lone one single."""
    w = Window.partitionBy(*keys)
    r = rules.withColumn("r_", F.row_number().over(w.orderBy("y0", "x0"))).withColumn("n_", F.count("*").over(w))
    role = F.when(F.col("n_") == 1, "single").when(F.col("r_") == 1, "top").when(F.col("r_") == F.col("n_"), "bottom").when(F.col("n_") == 3, "header_separator").otherwise("inner")
    return r.withColumn("role", role).drop("r_", "n_")


def column_bounds(texts: DataFrame, keys: list[str], least_gap: float = 4.0) -> DataFrame:
    """Boundaries between columns: the frame's sides and the middles of empty runs of ``least_gap`` or more in x."""
    merged = sequence.merge_intervals(texts, keys, "x0", "x1")
    w = Window.partitionBy(*keys).orderBy("x0")
    mids = merged.withColumn("before_", F.lag("x1").over(w)).where(F.col("x0") - F.col("before_") >= least_gap).select(*keys, ((F.col("x0") + F.col("before_")) / 2).alias("b"))
    ends = merged.groupBy(*keys).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    both = mids.union(ends.select(*keys, F.col("lo"))).union(ends.select(*keys, F.col("hi")))
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set("b")).alias("bounds"))


def cells(texts: DataFrame, keys: list[str], least_gap: float = 4.0) -> DataFrame:
    """texts(keys, ordinal, text, box): the cell (row, column) of each text and the cells' texts in reading order. Columns are
    parted by empty runs of ``least_gap`` or more in x (as in ``column_bounds``): a text's column is the number of such runs
    before it. Rows are greedy clusters of centres with a tolerance of 0.7 of the median height, two points at least. A
    table's texts are dealt once for all of this: rows are found and their cells put together in one pass over sorted texts."""
    table = Window.partitionBy(*keys)
    order = table.orderBy("x0", "x1", "ordinal")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = texts.withColumns({"tol_": F.greatest(F.lit(2.0), 0.7 * F.median(F.col("y1") - F.col("y0")).over(table)), "gap_": F.col("x0") - reach})
    column = F.sum(F.when(F.col("gap_") >= least_gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = parted.select(*keys, "ordinal", "text", *EDGES, column.alias("column"), (((F.col("y0") + F.col("y1")) / 2) / F.col("tol_")).cast("double").alias("v_"), F.xxhash64(*keys).alias("g_"))
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((k, kinds[k]) for k in keys), ("row", "int"), ("column", "int"), ("text", "string"), *((e, kinds[e]) for e in EDGES), ("n_texts", "bigint")])
    return rows.sortWithinPartitions(*keys, "v_", "ordinal").mapInArrow(partial(_row_cells, keys=list(keys)), schema)


def _row_cells(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Cells of texts that are sorted by table and v_. A row's texts follow one another, so only the last row of a batch is held."""
    clusters, held = sequence._Clusters(1.0), None
    for b in batches:
        known = b.column("v_").is_valid().to_numpy(zero_copy_only=False)
        row = np.full(b.num_rows, -1, np.int32)
        row[known] = clusters.numbers(b.column("v_").to_numpy(zero_copy_only=False)[known], b.column("g_").to_numpy()[known])
        t = pa.Table.from_batches([b]).append_column("row", pa.array(row))
        t = t if held is None else pa.concat_tables([held, t])
        starts = np.flatnonzero(_changes(t, "g_", "row"))
        if len(starts):
            yield from _joined(t.slice(0, int(starts[-1])), keys)
            held = t.slice(int(starts[-1]))
    if held is not None:
        yield from _joined(held, keys)


def _changes(t: pa.Table, *columns: str) -> np.ndarray:
    """Where a row of the table differs from the one before."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in columns:
        v = t.column(c).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def _joined(t: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One row a cell, its texts in reading order; null texts are left out, as are null sides."""
    if not t.num_rows:
        return
    t = t.append_column("run_", pa.array(np.cumsum(_changes(t, "g_", "row"))))
    by = ("run_", "column", "x0", "ordinal", "text")
    t = t.take(pc.sort_indices(t.select(by), sort_keys=[(c, "ascending") for c in by], null_placement="at_start")).combine_chunks()
    first = np.flatnonzero(_changes(t, "run_", "column"))
    text = t.column("text").combine_chunks()
    before = np.concatenate(([0], np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))))
    offsets = pa.array(before[np.append(first, t.num_rows)], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, text.drop_null())
    sides = []
    for e in EDGES:
        v = t.column(e).to_numpy(zero_copy_only=False)
        found = (np.fmin if e in ("x0", "y0") else np.fmax).reduceat(v, first)
        sides.append(pa.array(found, t.schema.field(e).type, from_pandas=True))
    some = t.take(pa.array(first))
    n = np.diff(np.append(first, t.num_rows))
    out = [*(some.column(k) for k in keys), some.column("row"), some.column("column"), pc.binary_join(lists, " "), *sides, pa.array(n, pa.int64())]
    yield from pa.table(out, names=[*keys, "row", "column", "text", *EDGES, "n_texts"]).to_batches()


def alignment(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Left, right or centre: the anchor of least variance, ties in that order."""
    v = cells_.groupBy(*keys, "column").agg(F.var_pop("x0").alias("l"), F.var_pop("x1").alias("r"), F.var_pop((F.col("x0") + F.col("x1")) / 2).alias("c"), F.count("*").alias("n_cells"))
    least = F.least("l", "r", "c")
    return v.select(*keys, "column", "n_cells", F.when(F.col("l") <= least, "left").when(F.col("r") <= least, "right").otherwise("center").alias("alignment"))


def quality(cells_: DataFrame, keys: list[str], n_texts: DataFrame) -> DataFrame:
    """Variance of edges by column and of centres by row (groups of one left out), coverage, and confidence .4/.4/.2. Cells are stored
    without their texts, so that they are made once."""
    cells_ = rounds.cut(cells_.select(*keys, "row", "column", *EDGES, "n_texts"))
    col = cells_.groupBy(*keys, "column").agg(F.least(F.var_pop("x0"), F.var_pop("x1")).alias("v"), F.count("*").alias("n")).where("n > 1").groupBy(*keys).agg(F.avg("v").alias("column_variance"))
    row = cells_.groupBy(*keys, "row").agg(F.var_pop((F.col("y0") + F.col("y1")) / 2).alias("v"), F.count("*").alias("n")).where("n > 1").groupBy(*keys).agg(F.avg("v").alias("row_variance"))
    out = cells_.groupBy(*keys).agg(F.sum("n_texts").alias("assigned")).join(n_texts, keys).join(col, keys, "left").join(row, keys, "left")
    c = lambda x: 1 / (1 + F.coalesce(F.col(x), F.lit(0.0)))
    return out.withColumn("coverage", F.col("assigned") / F.col("n_texts")).withColumn("confidence", 0.4 * c("column_variance") + 0.4 * c("row_variance") + 0.2 * F.col("coverage"))


def to_html(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """A semantic table: the first row is the head. Escaped; rows and cells in order."""
    esc = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    one = F.concat(F.lit("<"), tag, F.lit(' data-cell="R'), F.col("row"), F.lit("C"), F.col("column"), F.lit('">'), esc, F.lit("</"), tag, F.lit(">"))
    rows = cells_.select(*keys, "row", "column", one.alias("h")).repartition(*keys).groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "h"))), lambda s: s["h"]), "").alias("h"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda s: F.concat(F.when(s["row"] == 0, "<thead><tr>").otherwise("<tr>"), s["h"], F.when(s["row"] == 0, "</tr></thead>").otherwise("</tr>")))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(table, ""), F.lit("</table>")).alias("html"))


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two cell sets: shared cells, share with equal text, largest difference of a side."""
    j = a.alias("a").join(b.alias("b"), [*keys, "row", "column"])
    diff = F.greatest(*(F.abs(F.col(f"a.{s}") - F.col(f"b.{s}")) for s in ("x0", "y0", "x1", "y1")))
    return j.groupBy(*keys).agg(F.count("*").alias("shared"), F.avg((F.col("a.text") == F.col("b.text")).cast("double")).alias("exact_text"), F.max(diff).alias("max_error"))


def to_positioned_html(cells_: DataFrame, keys: list[str], classes: str = "cell") -> DataFrame:
    """One absolutely placed element a cell, in row and column order, in points."""
    esc = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    pt = lambda c: F.format_string("%.2f", c)
    one = F.concat(F.lit(f'<div class="{classes}" data-cell="R'), F.col("row"), F.lit("C"), F.col("column"), F.lit('" style="left:'), pt(F.col("x0")), F.lit("pt;top:"), pt(F.col("y0")), F.lit("pt;width:"), pt(F.col("x1") - F.col("x0")), F.lit("pt;height:"), pt(F.col("y1") - F.col("y0")), F.lit('pt">'), esc, F.lit("</div>"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "column", one.alias("h"))))
    return cells_.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["h"]), "").alias("html"))


def html_structure(pages: DataFrame, cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a table's HTML holds every cell's id once, no other, and the head row first."""
    n = cells_.groupBy(*keys).agg(F.count("*").alias("n_cells"))
    ids = F.regexp_extract_all("html", F.lit('data-cell="(R[0-9]+C[0-9]+)"'), F.lit(1))
    return pages.join(n, keys).select(*keys, "n_cells", F.size(ids).alias("n_ids"), (F.size(F.array_distinct(ids)) == F.size(ids)).alias("unique"), (F.size(ids) == F.col("n_cells")).alias("complete"), F.col("html").rlike("^<table><thead>").alias("has_head"))


def row_bounds(rows: DataFrame, keys: list[str], top: str = "top_rule", bottom: str = "bottom_rule") -> DataFrame:
    """Middles between neighbouring rows' centres, with the rules as ends: (keys, row, lo, hi)."""
    w = Window.partitionBy(*keys).orderBy("row")
    mid = (F.col("centre") + F.lead("centre").over(w)) / 2
    before = (F.col("centre") + F.lag("centre").over(w)) / 2
    return rows.select(*keys, "row", F.coalesce(before, F.col(top)).alias("lo"), F.coalesce(mid, F.col(bottom)).alias("hi"))


def header_row(rows: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The first row whose centre lies between the first two horizontal rules, a point to spare."""
    w = Window.partitionBy(*keys).orderBy("y0")
    two = rules.withColumn("r_", F.row_number().over(w)).where("r_ <= 2").groupBy(*keys).agg(F.min("y0").alias("a_"), F.max("y0").alias("b_"), F.count("*").alias("n_")).where("n_ = 2")
    return rows.join(two, keys).where((F.col("centre") >= F.col("a_") - 1) & (F.col("centre") <= F.col("b_") + 1)).groupBy(*keys).agg(F.min("row").alias("header_row"))
