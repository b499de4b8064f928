"""Connected components of a link table, without gathering links anywhere.

Labels move by minimum over neighbours and by pointer jumping; each round is a table in the shared folder, so lineage
stays short and a lost executor costs one round. Minimums are combined before the shuffle, so a node with very many
links sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._common import stored


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(u, v): any direction, repeats allowed. Returns (node, root): root is the smallest node reachable. Nodes without links are absent."""
    both = stored(links.select("u", "v").union(links.select("v", "u")).toDF("u", "v").where("u <> v").distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(max_rounds):
        jumped = (
            labels.alias("a")
            .join(labels.alias("b"), F.col("a.root") == F.col("b.node"))
            .select(F.col("a.node").alias("node"), F.col("b.root").alias("root"))
        )
        near = both.join(labels, both.v == labels.node).groupBy(both.u).agg(F.min("root").alias("near"))
        # the label's own root also learns the smaller label: hooking by root joins whole trees at once
        hooked = (
            near.join(labels, near.u == labels.node)
            .where(F.col("near") < F.col("root"))
            .groupBy(F.col("root").alias("h"))
            .agg(F.min("near").alias("hook"))
        )
        joined = (
            jumped.join(near, jumped.node == near.u, "left")
            .join(hooked, F.col("node") == F.col("h"), "left")
            .select("node", F.least("root", "near", "hook").alias("root"))
        )
        new = stored(joined)
        changed = _changed(new, labels)
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _changed(new: DataFrame, old: DataFrame) -> bool:
    """Labels only fall, so the sum of a hash of (node, root) pairs tells whether any moved."""
    digest = [df.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")).first()["s"] for df in (new, old)]
    return digest[0] != digest[1]
