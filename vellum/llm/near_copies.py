"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. SimHash: each text has a fingerprint of 64 bits over its five-word shingles, and those at 3 or fewer differing bits are
   found by the binary-trie self-join of ``simhash``.
2. Minimum hashes find what the budget of bits doesn't reach: at a similarity of 0.8 about 10 of 64 bits differ (standard
   deviation 3), so a budget that finds all pairs comes near the 32 bits of unlike texts, and a trie walk with it prunes
   next to nothing. Two sets share a given band with odds s^ROWS, so a pair at 0.8 is missed with odds
   (1 - 0.8^5)^40, about 1 in 8 million, and a closer pair with less.
3. Equal sets are one node, so copies are never expanded. Nodes of one fingerprint or of one band key are linked to the
   smallest: so many links as rows, however large the key; the trie's links are stars too. These links are verified by
   the exact similarity.
4. Candidate components that verified links don't hold together entirely are compared wholly: their nodes are cut into
   chunks whose pairs are walked as groups, but for pairs within the component's largest verified cluster, which is
   held together already. No pair is lost, and a dense cluster with a few strangers costs rows in proportion to its size.
5. Components over all verified links.

Defined cases: fewer words than a shingle make one shingle of the whole sequence; null and empty texts have the empty
set and are copies of each other; words are split and lowered as in SimHash; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._common import dropped, plan_partitions, short_batches, stored
from vellum.llm.components import connected_components
from vellum.llm.simhash import majority, shingle_bytes, trie_self_join

SHINGLE = 5
#: The least similarity, 4 of 5.
SHARED, OF = 4, 5
BANDS, ROWS = 40, 5
#: Nodes of a chunk in the second step.
CHUNK = 256
#: Shingles hashed at once.
BLOCK = 2048
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingle_bytes(text, shingle)], np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of 48 bits: a table of sets is larger than its texts, so they are no longer than they must be."""
    return np.unique(hashes >> np.uint64(16))


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return a | np.uint64(1), b


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[None, i : i + BLOCK] * a + b).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _GOLD
        key ^= key >> np.uint64(29)
    return key


def similar(inner, n, m):
    """Exact: inner / (n + m - inner) >= SHARED / OF."""
    return OF * inner >= SHARED * (n + m - inner)


def marked_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) as (doc_id, text_hash, node, fp, bands, hashes)."""
    short_batches(docs.sparkSession)

    def run(batches):
        a, b = coefficients()
        for batch in batches:
            each = [shingle_hashes(t, shingle) for t in batch.column(2).to_pylist()]
            fps = np.array([majority(h) for h in each], np.uint64).view(np.int64)
            sets = [shingle_set(h) for h in each]
            raw = [packed(s) for s in sets]
            nodes = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            keys = np.concatenate([band_keys(s, a, b) for s in sets] or [np.empty(0, np.uint64)]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(fps), bands, pa.array(raw, pa.binary())], names=["doc_id", "text_hash", "node", "fp", "bands", "hashes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, fp bigint, bands array<bigint>, hashes binary")


def _verified(batches):
    """(u, v, su, sv) to those (u, v) that are similar."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            n, m = len(x) // 6, len(y) // 6
            near = OF * min(n, m) >= SHARED * max(n, m)
            ok.append(near and bool(similar(len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)), n, m)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def group_links(side: np.ndarray, cluster: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of clusters with similar members; side 0 with side 1, or all with all if there is one side only."""
    n = np.array([len(s) for s in sets])
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(n)))
    label, out, flag = cluster.copy(), [], np.zeros(columns.max(initial=0) + 1, np.int64)
    # empty sets are one node that no other is similar to
    for s in np.flatnonzero((n > 0) & (side == side.min())):
        own = columns[first[s] : first[s + 1]]
        flag[own] = 1
        total = np.concatenate(([0], np.cumsum(flag[columns])))
        flag[own] = 0
        hit = np.unique(label[similar(total[first[1:]] - total[first[:-1]], n[s], n)])
        for other in hit[hit != label[s]]:
            out.append((int(label[s]), int(other)))
            label[label == other] = label[s]
    return out


def _walk(batches):
    """Rows (g1, g2, side, cluster, hashes) sorted by group."""
    held: list = []
    current = None

    def links():
        found = group_links(np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64), [unpacked(h[2]) for h in held])
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    for b in batches:
        for g1, g2, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (g1, g2) != current:
                if held:
                    yield links()
                current, held = (g1, g2), []
            held.append(row)
    if held:
        yield links()


def rest_links(rest: DataFrame, sets: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """rest(cand, node, cluster): whole candidate components. Links (u, v) of clusters."""
    sizes = rest.groupBy("cand", "cluster").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cand").agg(F.max(F.struct("n", "cluster")).alias("big"), F.sum("n").alias("all")).select("cand", F.col("big.cluster").alias("big"), F.ceil(F.col("big.n") / chunk).cast("int").alias("p"), F.ceil((F.col("all") - F.col("big.n")) / chunk).cast("int").alias("q"))
    # chunks 0 .. q - 1 are of strangers, q .. q + p - 1 of the largest cluster; a pair has a stranger's chunk at least
    placed = rest.join(largest, "cand")
    c = F.when(F.col("cluster") == F.col("big"), F.col("q") + F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")
    placed = placed.withColumn("c", c)
    others = F.when(F.col("c") >= F.col("q"), F.sequence(F.lit(0), F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("q") + F.col("p") - 1))
    paired = placed.select("cand", "node", "cluster", "c", F.explode(others).alias("o"))
    paired = paired.select("node", "cluster", F.xxhash64("cand", F.least("c", "o"), F.greatest("c", "o")).alias("g1"), F.xxhash64(F.lit(7), "cand", F.least("c", "o"), F.greatest("c", "o")).alias("g2"), F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"))
    full = paired.join(sets, "node").select("g1", "g2", "side", "cluster", "hashes")
    return full.repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_walk, "u bigint, v bigint")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp): links (u, v) that connect all nodes whose fingerprints are within the budget of bits, transitively. A
    node has one fingerprint at least; sets with other numbers of repeats may have several."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("u")))
    same = nodes.join(least, "fp").select("u", F.col("node").alias("v"))
    near = trie_self_join(least.select("fp")).toDF("f", "g")
    one, two = least.toDF("f", "u"), least.toDF("g", "v")
    return same.union(near.join(one, "f").join(two, "g").select("u", "v")).where("u <> v")


def node_roots(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of the nodes that have near copies, from stored rows of ``marked_rows``, which are deleted when the sets
    that are compared have been taken from them."""
    parts = plan_partitions(marked.sparkSession)
    nodes = marked.groupBy("node").agg(F.first("bands").alias("bands"))
    keyed = nodes.select("node", F.explode("bands").alias("key")).withColumn("u", F.min("node").over(Window.partitionBy("key")))
    trie = fingerprint_links(stored(marked.select("node", "fp").distinct()))
    stars = stored(trie.union(keyed.where("u <> node").select("u", F.col("node").alias("v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    met = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct()
    sets = stored(marked.select("node", "hashes").join(met, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    dropped(marked)
    one, two = sets.toDF("u", "su"), sets.toDF("v", "sv")
    linked = stored(stars.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(_verified, "u bigint, v bigint"))
    clusters = connected_components(linked)
    candidates = connected_components(stars)
    both = stored(candidates.toDF("node", "cand").join(clusters.toDF("node", "cluster"), "node", "left").select("cand", "node", F.coalesce("cluster", "node").alias("cluster")))
    split = both.groupBy("cand").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").select("cand")
    more = stored(rest_links(both.join(split, "cand", "left_semi"), sets, parts, chunk))
    dropped(sets)
    return clusters if more.isEmpty() else connected_components(linked.union(more))


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, root): one row per input row of docs(doc_id, text); rows of one root are one group."""
    marked = stored(marked_rows(docs, shingle))
    rows = stored(marked.select("doc_id", "text_hash", "node"))
    roots = node_roots(marked, chunk)
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
