"""The library from SQL: ``register(spark)`` adds scalar functions and table functions to a session.

Scalar functions are SQL expressions, which Catalyst inlines. Table functions take a table argument; what they fold over a group
goes by the ``PARTITION BY`` and ``ORDER BY`` of that argument, so Spark deals and sorts the rows, and they keep a few numbers
(``cluster_values``) or the rows of a page (``merge_blocks``):

    SELECT * FROM cluster_values(TABLE(t) PARTITION BY (k) ORDER BY (v), 'v', 5.0D)
    SELECT * FROM merge_blocks(TABLE(t) PARTITION BY (doc_id, page) ORDER BY (y0, x0, run))
    SELECT * FROM protected_templates(TABLE(t), 'src')
    SELECT restore_template(template, mapping) FROM ...
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from vellum.functions import text as T
from vellum.operators import routing

_CLASS = T.CJK
#: Name and arguments: SQL type of the result, SQL of the body.
SCALARS = {
    "restore_template(template STRING, mapping MAP<STRING, STRING>)": ("STRING", "aggregate(map_entries(mapping), template, (s, e) -> replace(s, e.key, e.value))"),
    "strip_placeholders(text STRING)": ("STRING", rf"regexp_replace(coalesce(text, ''), r'{T.PLACEHOLDER}', ' ')"),
    "normal_form(text STRING)": ("STRING", rf"lower(regexp_replace(regexp_replace(coalesce(text, ''), r'{T.PLACEHOLDER}', ' '), r'\s+', ''))"),
    "has_cjk(text STRING)": ("BOOLEAN", f"coalesce(text, '') RLIKE '{_CLASS}'"),
    "box_overlap(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE)": ("DOUBLE", "greatest(0.0D, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0D, least(ay1, by1) - greatest(ay0, by0))"),
}


def _extended(table: AnalyzeArgument, *fields: StructField) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument has to be a table: TABLE(name) or TABLE(query)")
    taken = {f.name.lower() for f in table.dataType.fields}
    for f in fields:
        if f.name in taken:
            raise ValueError(f"the table has a column {f.name} already")
    return StructType([*table.dataType.fields, *fields])


def _named(arg: AnalyzeArgument, table: AnalyzeArgument) -> None:
    if arg.value not in table.dataType.fieldNames():
        raise ValueError(f"the table has no column {arg.value}")


@udtf
class ClusterValues:
    """Rows of a group in rising order of a column, with the number of their cluster: a value joins the last one if it is at most
    ``tolerance`` over that cluster's mean so far; null has cluster -1."""

    def __init__(self):
        self.total, self.n, self.cluster = 0.0, 0, -1

    @staticmethod
    def analyze(rows: AnalyzeArgument, value: AnalyzeArgument, tolerance: AnalyzeArgument) -> AnalyzeResult:
        schema = _extended(rows, StructField("cluster", IntegerType()))
        _named(value, rows)
        return AnalyzeResult(schema)

    def eval(self, rows: Row, value: str, tolerance: float):
        v = rows[value]
        if v is None:
            yield (*rows, -1)
            return
        v = float(v)
        if self.n and v - self.total / self.n <= float(tolerance):
            self.total, self.n = self.total + v, self.n + 1
        else:
            self.total, self.n, self.cluster = v, 1, self.cluster + 1
        yield (*rows, self.cluster)


@udtf
class MergeBlocks:
    """Rows (y0, x0, y1, x1, open, ...) of a page with the number of the block that they are merged into: boxes that overlap in
    x by over 0.3 of the narrower and lie less than 1.7 line heights (of 12 points) apart, or under 2.2 if the upper one's
    brackets are open. A page's rows are held until its end."""

    def __init__(self):
        self.rows: list[Row] = []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        for c in ("x0", "y0", "x1", "y1", "open"):
            if c not in rows.dataType.fieldNames():
                raise ValueError(f"the table has no column {c}")
        return AnalyzeResult(_extended(rows, StructField("block", IntegerType())))

    def eval(self, rows: Row):
        self.rows.append(rows)

    def terminate(self):
        root = list(range(len(self.rows)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a in enumerate(self.rows):
            for j in range(i + 1, len(self.rows)):
                b = self.rows[j]
                gap = b["y0"] - a["y1"]
                if gap > 2.2 * 12:
                    break
                common, narrow = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), max(1e-9, min(a["x1"] - a["x0"], b["x1"] - b["x0"]))
                if (a["open"] > 0 and gap < 2.2 * 12) or (common > 0.3 * narrow and gap < 1.7 * 12 and b["y0"] > a["y0"]):
                    root[find(j)] = find(i)
        number: dict[int, int] = {}
        for i, row in enumerate(self.rows):
            yield (*row, number.setdefault(find(i), len(number)))


@udtf
class ProtectedTemplates:
    """Rows with ``template``, the column's text with mathematics as numbered tokens, and ``mapping``, what they stand for."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, source: AnalyzeArgument) -> AnalyzeResult:
        schema = _extended(rows, StructField("template", StringType()), StructField("mapping", MapType(StringType(), StringType())))
        _named(source, rows)
        return AnalyzeResult(schema)

    def eval(self, rows: Row, source: str):
        yield (*rows, *routing.protect(rows[source]))


TABLE_FUNCTIONS = {"cluster_values": ClusterValues, "merge_blocks": MergeBlocks, "protected_templates": ProtectedTemplates}


def register(spark: SparkSession) -> list[str]:
    """Adds all functions to the session, in place of earlier ones of their names. Returns the names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    return [*(h.split("(")[0] for h in SCALARS), *TABLE_FUNCTIONS]
