"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint has 64 bits: bit i is set if it is set in over half the XXH64 values (UTF-8, seed 42, unsigned) of the
text's word shingles, repeats included. Two fingerprints link at ``max_bits`` or fewer differing bits.

The join: distinct fingerprints are dealt by each of ``max_bits + 1`` blocks of bits, since a pair within the budget
agrees on one block at least. Within a key the fingerprints form a binary trie (a sorted array and bit positions);
pairs of nodes are walked down together from (root, root), a step to unlike children costs one bit of the budget, and a
pair whose budget is spent is pruned. All keys of a run of rows are walked at once, level by level, in numpy. Leaves
met in pairs are united in a local forest, and only its star links leave the task, so a dense cluster of n
fingerprints yields at most n links per key, not n squared.

A key with over ``max_group`` fingerprints is dealt again by blocks of its remaining bits, and what is still larger is
cut into chunks whose pairs are walked as separate groups: no task holds more than two chunks of a key, and no pair is
lost.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle of the whole sequence; equal texts and equal fingerprints are one node, so copies are never expanded into pairs;
a null doc_id is kept and has the component of its text (the smallest non-null id reachable); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import documents, plan_partitions, short_batches, stored
from vellum.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
MAX_GROUP = 1024
#: Rows walked at once in a task; whole keys only.
RUN_ROWS = 8192
#: Node pairs held at one level before the walk goes on depth first.
MAX_FRONTIER = 1 << 16
SIGN = np.uint64(1 << 63)


def shingle_bytes(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [b" ".join(words)]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Shingles are hashed one by one; bits are counted in blocks of hashes, so memory doesn't follow the text."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingle_bytes(text, shingle)], dtype=np.uint64))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(values):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), 8192):
        counts += np.unpackbits(values[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the 64 bits as a signed long."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- the walk


def trie_links(values: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """values sorted within group; side (0, then 1) cuts a group in two: pairs are sought
    between the sides, or within the group if it has one side only. Returns for each row the first row of its local component."""
    n = len(values)
    parent, seen = np.arange(n), {}
    cuts = np.flatnonzero(np.diff(group)) + 1
    start, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
    middle = start + np.array([np.searchsorted(side[a:b], 1) for a, b in zip(start, end, strict=True)], dtype=np.int64)
    self_join = (middle == end) | (middle == start)
    todo = [(63, start, np.where(self_join, end, middle), np.where(self_join, start, middle), end, np.full(len(start), max_bits))]
    while todo:
        bit, a_lo, a_hi, b_lo, b_hi, left = todo.pop()
        if not len(a_lo):
            continue
        if bit < 0:  # pairs of leaves: values are distinct within a side
            parent = _unite(parent, a_lo, b_lo)
            continue
        if len(a_lo) > MAX_FRONTIER:  # depth first from here, so that dense clusters don't fill the memory
            todo += [(bit, *(x[i : i + MAX_FRONTIER // 2] for x in (a_lo, a_hi, b_lo, b_hi, left))) for i in range(0, len(a_lo), MAX_FRONTIER // 2)]
            continue
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))) if bit not in seen else seen[bit]
        seen[bit] = ones
        am, bm = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        parts = []
        for x0, x1, y0, y1, cost, mirrored in ((a_lo, am, b_lo, bm, 0, False), (am, a_hi, bm, b_hi, 0, False), (a_lo, am, bm, b_hi, 1, False), (am, a_hi, b_lo, bm, 1, True)):
            ok = (x0 < x1) & (y0 < y1) & (left >= cost)
            if mirrored:
                ok &= ~same  # of a node with itself, one of the two unlike pairs is enough
            ok &= ~((x1 - x0 == 1) & (x0 == y0) & (x1 == y1))  # a leaf with itself
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], left[ok] - cost))
        todo.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return parent


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components by minimum over links and pointer jumping, vectorised."""
    while True:
        ra, rb = parent[a], parent[b]
        unlike = ra != rb
        if not unlike.any():
            return parent
        a, b, ra, rb = a[unlike], b[unlike], ra[unlike], rb[unlike]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _walk(key_cols: int, max_bits: int):
    """mapInArrow body over rows (key..., side, fp) sorted by them: yields star links (u, v)."""

    def links(keys: list[np.ndarray], side: np.ndarray, fp: np.ndarray):
        change = np.zeros(len(fp), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        roots = trie_links(fp.view(np.uint64) ^ SIGN, np.cumsum(change), side, max_bits)
        kept = np.flatnonzero(roots != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[roots[kept]]), pa.array(fp[kept])], names=["u", "v"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(key_cols + 2)]
            held.append(cols)
            rows += b.num_rows
            if rows >= RUN_ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                differs = np.zeros(rows, bool)
                for k in whole[:key_cols]:
                    differs |= k != k[-1]
                cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
                if cut:
                    yield links([k[:cut] for k in whole[:key_cols]], whole[-2][:cut], whole[-1][:cut])
                held, rows = [[k[cut:] for k in whole]], rows - cut
        if rows:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield links(whole[:key_cols], whole[-2], whole[-1])

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """The given bit positions in so many runs of nearly equal length."""
    n = len(bits)
    return [bits[i * n // parts : (i + 1) * n // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def trie_self_join(fps: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """fps(fp): distinct fingerprints. Returns links (u, v) that connect all fingerprints within max_bits, transitively."""
    spark = fps.sparkSession
    parts = plan_partitions(spark)
    everything = list(range(63, -1, -1))
    first = _blocks(everything, max_bits + 1)
    second = [_blocks([b for b in everything if b not in block], max_bits + 1) for block in first]
    bits = F.col("fp")
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("b1"), bits.bitwiseAND(F.lit(_mask(x))).alias("k1")) for i, x in enumerate(first)))).alias("k")).select("fp", "k.*")
    sizes = dealt.groupBy("b1", "k1").count()
    large = stored(sizes.where(F.col("count") > max_group).select("b1", "k1"))
    walk = _walk(2, max_bits)

    def walked(rows: DataFrame, keys: list[str]) -> DataFrame:
        hashed = rows.select(F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(7), *keys).alias("h2"), "side", "fp")
        return hashed.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "side", F.col("fp")).mapInArrow(walk, "u bigint, v bigint")

    # The sort is by signed fp; the walk flips the sign bit, which keeps that order unsigned.
    small = dealt.join(large, ["b1", "k1"], "left_anti").withColumn("side", F.lit(0))
    out = walked(small, ["b1", "k1"])
    if large.isEmpty():
        return out
    again = [
        F.when(F.col("b1") == i, F.array(*(F.struct(F.lit(j).alias("b2"), bits.bitwiseAND(F.lit(_mask(x))).alias("k2")) for j, x in enumerate(blocks))))
        for i, blocks in enumerate(second)
    ]
    redealt = stored(dealt.join(large, ["b1", "k1"], "left_semi").select("b1", "k1", "fp", F.explode(F.coalesce(*again)).alias("k")).select("b1", "k1", "k.*", "fp"))
    keys = ["b1", "k1", "b2", "k2"]
    chunks = redealt.groupBy(*keys).count().withColumn("chunks", F.ceil(F.col("count") / max_group).cast("int")).drop("count")
    counted = redealt.join(chunks, keys)
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # chunk pairs (i, j), i <= j: a row of chunk c goes to (c, j) as side 0 and to (i, c) as side 1
    paired = counted.withColumn("c", chunk).select(*keys, "fp", F.col("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    paired = paired.select(*keys, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"), "fp")
    return out.union(walked(paired, [*keys, "i", "j"]))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(trie_self_join(distinct.select("fp"), max_bits, max_group))
    rooted = distinct.join(components, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
