"""Execution manifests and the fail-closed gate; ranked defect and complexity lists; recovery decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED = ("error", "not_run", "missing")


def manifest(executions: DataFrame, pages: DataFrame, stages: Sequence[str], keys: list[str]) -> DataFrame:
    """One row per page and required stage: its status, ``missing`` where nothing was recorded. A stage recorded twice counts by its worst status."""
    rank = F.when(F.col("status") == "error", 4).when(F.col("status") == "not_run", 3).when(F.col("status") == "fail", 2).otherwise(1)
    worst = executions.groupBy(*keys, "stage").agg(F.max_by("status", rank).alias("status"))
    spine = pages.select(*keys).distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return spine.join(worst, [*keys, "stage"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def integrity(rows: DataFrame, group: list[str], page_keys: list[str], expected_pages: int | None = None) -> DataFrame:
    """Counts by status, coverage, complete pages, and pass only if nothing is an error, not run or missing."""
    per_page = rows.groupBy(*dict.fromkeys([*group, *page_keys])).agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "fail", *FAILED)), F.count("*").alias("n"), (F.count_if(F.col("status").isin(*FAILED)) == 0).alias("complete")
    )
    out = per_page.groupBy(*group).agg(*(F.sum(f"n_{s}").alias(f"n_{s}") for s in ("pass", "fail", *FAILED)), F.sum("n").alias("required"), F.count_if("complete").alias("complete_pages"), F.count("*").alias("pages"))
    done = F.col("required") - F.col("n_error") - F.col("n_not_run") - F.col("n_missing")
    enough = F.lit(True) if expected_pages is None else F.col("pages") >= expected_pages
    return out.withColumn("coverage", done / F.col("required")).withColumn("integrity", F.when((done == F.col("required")) & enough, "pass").otherwise("blocked"))


def layers(rows: DataFrame, group: list[str], hard: Sequence[str]) -> DataFrame:
    """Each stage as a layer: blocked if it wasn't run everywhere, or failed and is hard; warning if it failed and isn't."""
    lost = F.bool_or(F.col("status").isin(*FAILED))
    failed = F.bool_or(F.col("status") == "fail")
    return rows.groupBy(*group, "stage").agg(F.when(lost, "blocked").when(failed & F.first("stage").isin(*hard), "blocked").when(failed, "warning").otherwise("pass").alias("layer"))


def decide(layer_rows: DataFrame, group: list[str]) -> DataFrame:
    b, w = F.count_if(F.col("layer") == "blocked"), F.count_if(F.col("layer") == "warning")
    return layer_rows.groupBy(*group).agg(b.alias("n_blocked"), w.alias("n_warning"), F.when(b > 0, "blocked").when(w > 0, "warning").otherwise("pass").alias("decision"))


def weighted_defects(pages: DataFrame, weights: dict[str, int], keys: list[str], limit: int = 20) -> DataFrame:
    """The worst pages that have any defect; ties by key. A top-k, so no full sort."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0))
    present = F.filter(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in weights)), lambda x: x.isNotNull())
    return pages.select(*keys, score.alias("score"), F.array_join(present, ",").alias("defects")).where("score > 0").orderBy(F.desc("score"), *keys).limit(limit)


def complexity(pages: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The most complex pages: 8 a formula, 1 a cell, 25 a figure, 35 a capacity level, class weight, 10 a full-width region, references up to 20."""
    score = 8 * F.col("formulas") + F.col("cells") + 25 * F.col("figures") + 35 * F.col("level") + F.col("class_weight") + 10 * F.col("full_width") + F.least("references", F.lit(20))
    return pages.select(*keys, score.alias("score")).orderBy(F.desc("score"), *keys).limit(limit)


def first_rule(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """An ordered decision list: the first rule that holds."""
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def first_defect(defects: Column, order: Sequence[str]) -> Column:
    """The first of ordered defects that is in the set."""
    return F.coalesce(*(F.when(F.array_contains(defects, d), F.lit(d)) for d in order))


def taxonomy(traces: DataFrame, group: list[str], defects: str = "defects") -> DataFrame:
    """Histogram of exploded defects."""
    return traces.select(*group, F.explode(defects).alias("defect")).groupBy(*group, "defect").agg(F.count("*").alias("n"))
