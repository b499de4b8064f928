"""Chains of parent links: what all ancestors of a node leave of a box, by pointer jumping.

A node knows the intersection over the ancestors that it has seen and the last one of them. In a round it takes over what
that one has seen, so it sees twice as many: a chain of n links takes log2(n) rounds, each one join on (keys, node), and no
node is visited ancestor by ancestor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.operators.rounds import cut

LOW, HIGH = ("x0", "y0"), ("x1", "y1")


def intersection(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, ...]:
    """Sides of the common box of two, of which either may be null (unbounded); inverted where there is none."""
    return (F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3]))


def clipped(box: tuple[Column, ...], envelope: tuple[Column, ...]) -> tuple[Column, ...]:
    """The part of a box within an envelope; a point, at the innermost upper left corner, if nothing is left; null for a null box."""
    x0, y0, x1, y1 = intersection(box, envelope)
    gone = (x1 < x0) | (y1 < y0)
    known = box[0].isNotNull()
    return tuple(F.when(known, v) for v in (x0, y0, F.when(gone, x0).otherwise(x1), F.when(gone, y0).otherwise(y1)))


def envelopes(nodes: DataFrame, keys: list[str], node: str = "node", parent: str = "parent") -> DataFrame:
    """nodes(keys, node, parent, x0, y0, x1, y1), a null box for a node that doesn't clip; ids are unique within their keys.
    Returns keys, node, n_ancestors, the sides of the intersection of all ancestors' boxes (null where none clips; inverted
    where nothing is common), ``broken`` where the chain ends at a parent that doesn't exist, ``cyclic`` where it never ends:
    then the box is that of all nodes on its way and n_ancestors is null."""
    own = nodes.select(*keys, F.col(node).alias("node_"), F.col(parent).alias("up_"), *(F.col(c).cast("double").alias(f"{c}_") for c in (*LOW, *HIGH)))
    above = own.select(*keys, F.col("node_").alias("up_"), F.lit(1).cast("bigint").alias("n_"), *(f"{c}_" for c in (*LOW, *HIGH)))
    state = own.select(*keys, "node_", "up_").join(above, [*keys, "up_"], "left").select(
        *keys, "node_", F.when(F.col("n_").isNotNull(), F.col("up_")).alias("up_"), F.coalesce("n_", F.lit(0)).cast("bigint").alias("n_"), *(f"{c}_" for c in (*LOW, *HIGH)), (F.col("up_").isNotNull() & F.col("n_").isNull()).alias("broken_")
    )
    state = cut(state)
    most = state.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(max(most, 1))) + 1):
        if state.where("up_ is not null").isEmpty():
            break
        there = state.select(*keys, F.col("node_").alias("up_"), F.col("up_").alias("next_"), F.col("n_").alias("m_"), F.col("broken_").alias("b_"), *(F.col(f"{c}_").alias(f"{c}__") for c in (*LOW, *HIGH)))
        both = intersection(*(tuple(F.col(f"{c}{tail}") for c in (*LOW, *HIGH)) for tail in ("_", "__")))
        state = cut(
            state.join(there, [*keys, "up_"], "left").select(
                *keys, "node_", F.col("next_").alias("up_"), (F.col("n_") + F.coalesce("m_", F.lit(0))).alias("n_"), *(v.alias(f"{c}_") for v, c in zip(both, (*LOW, *HIGH), strict=True)), (F.col("broken_") | F.coalesce("b_", F.lit(False))).alias("broken_")
            )
        )
    cyclic = F.col("up_").isNotNull()  # more links than a key has nodes
    return state.select(*keys, F.col("node_").alias(node), F.when(~cyclic, F.col("n_")).alias("n_ancestors"), *(F.col(f"{c}_").alias(f"clip_{c}") for c in (*LOW, *HIGH)), F.col("broken_").alias("broken"), cyclic.alias("cyclic"))


def clip_to_ancestors(boxes: DataFrame, found: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """boxes(keys, node, x0..y1, ...) with the part of each box that the ancestors of its node leave: clip_x0 to clip_y1."""
    joined = boxes.join(found.select(*keys, node, *(f"clip_{c}" for c in (*LOW, *HIGH))), [*keys, node], "left")
    part = clipped(G.box(), tuple(F.col(f"clip_{c}") for c in (*LOW, *HIGH)))
    return joined.select(*boxes.columns, *(v.alias(f"clip_{c}") for v, c in zip(part, (*LOW, *HIGH), strict=True)))
