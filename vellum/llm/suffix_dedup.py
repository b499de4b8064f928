"""Removal of every byte covered by a 400-byte string that starts elsewhere too, by external induced suffix sorting.

1. Candidates. Each 400-byte window has an anchor, the leftmost least hash among its 24-byte strings; equal windows have
   equal anchors at equal places, so only windows whose anchor occurs elsewhere can repeat. Windows that follow each
   other and share an anchor form a segment (start of the first to end of the last). Segments are counted by (anchor,
   hash): a segment met twice repeats whole, and one copy stands for all. Anchors with one segment only are done.
2. Suffix sorting. The distinct segments of the other anchors are dealt by anchor into tasks. Equal windows have the anchor at
   equal places, and so share a block of bytes round it; windows without a block that another segment of the anchor has are
   left out, which can't lose a repeat. What is left of a task's segments is one
   shard (at most ``SHARD_BYTES``, closed between anchors), sorted by ``induced``: disk-backed priority queues carry suffix
   tuples with common-prefix values through a recursive induction, within ``MEMORY`` bytes; what is beyond goes on in files
   of the shared folder. Neighbours whose common-prefix value reaches 400 repeat. An anchor with over ``MAX_SEGMENTS``
   distinct segments, such as the end of a passage that very many documents hold, would be one task's work whatever its
   memory: its windows' hashes are counted by an aggregation instead, which is exact too.
3. Removal. Repeated windows go back to their documents, are united, and the bytes are cut out.

Strings are judged on the input; matches never cross documents (segments don't). Whole segments are told apart by a 64-bit
hash within an anchor of 64 bits, bytes within a shard by the sort itself.

Defined cases: null is empty; texts of under 400 bytes keep all bytes; a text repeated as a row of its own counts as
elsewhere; repeated (doc_id, text) rows and repeated or null doc_ids stay separate rows; very long texts are cut into
overlapping pieces of ``PIECE`` bytes for hashing, no window is lost; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import induced
from vellum.llm._common import documents, plan_partitions, shared_dir, short_batches, stored

WINDOW, GRAM = 400, 24
PIECE = 1 << 20
SHARD_BYTES = 256 << 20
#: What a shard's sort holds in memory, apart from three numbers a segment and the string of names.
MEMORY = 32 << 20
#: An anchor with more distinct segments than this isn't gathered: its windows are counted one by one.
MAX_SEGMENTS = 20_000
#: Windows whose anchors are at places of the same run of so many bytes have a block of WINDOW - STEP + 1 bytes in common.
STEP = 48
_ODD = 0x9E3779B97F4A7C15
_MASK = np.uint64(0xFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes, modulo 2^64 and mixed, of all strings of one length in a text of up to ``size`` bytes."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_ODD, size), _powers(pow(_ODD, -1, 1 << 64), size)

    def hashes(self, b: np.ndarray, length: int) -> np.ndarray:
        n = len(b)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self.down[:n], out=c[1:])
        x = (c[length:] - c[:-length]) * self.up[length - 1 : n]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def anchored(raw: bytes, rolling: Rolling, window: int = WINDOW, gram: int = GRAM):
    """Yields (anchor hashes, first window starts, last window starts, anchors' places after the first window start) of each
    piece of a text."""
    for base in range(0, max(1, len(raw) - window + 1), PIECE - window + 1):
        b = np.frombuffer(raw, np.uint8)[base : base + PIECE]
        if len(b) < window:
            return
        h = rolling.hashes(b, gram)
        width = window - gram + 1
        key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        blocks = np.concatenate((key, np.full(-len(key) % width, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - width + 1
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n])) - 1
        at = (least[lo] & _MASK).astype(np.int64)
        yield h[at], lo + base, hi + base, at - lo


def segments(raw: bytes, rolling: Rolling, window: int = WINDOW, gram: int = GRAM):
    """The same without the anchors' places."""
    for h, lo, hi, _ in anchored(raw, rolling, window, gram):
        yield h, lo, hi


def possible(held: list[tuple[bytes, int, bool]], window: int = WINDOW, step: int = STEP) -> list[tuple[int, int, int]]:
    """held: distinct segments of one anchor as (bytes, anchor's place, met once). (number, first and last window start) of
    what may repeat in a segment met once, and of what it may repeat: windows with the anchor at places of a run of ``step``
    contain one block, so those that are equal have equal blocks."""
    size = window - step + 1
    met: dict[tuple[int, int], list] = {}
    for k, (raw, at, once) in enumerate(held):
        for run in range((at - len(raw) + window) // step, at // step + 1):
            start = at - run * step
            group = met.setdefault((run, xxhash.xxh3_64_intdigest(raw[start : start + size])), [False])
            group[0] |= once
            group.append((k, run))
    shared: dict[int, list[int]] = {}
    for once, *members in met.values():
        if once and len(members) > 1:
            for k, run in members:
                shared.setdefault(k, []).append(run)
    out = []
    for k in sorted(shared):
        raw, at, _ = held[k]
        out.append((k, max(0, at - max(shared[k]) * step - step + 1), min(len(raw) - window, at - min(shared[k]) * step)))
    return out


# ---------------------------------------------------------------- sorting a shard

#: UTF-8 never uses thirteen byte values, which makes room for the end (0) and the mark between segments (1).
_USED = np.array([c for c in range(256) if c not in (0xC0, 0xC1) and c < 0xF5])
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[_USED] = np.arange(2, 2 + len(_USED))


class Shard:
    """Segments, sorted together; texts, suffixes and hits are kept in a store of bounded memory."""

    def __init__(self, folder: str | None, memory: int = 0, block: int = induced.BLOCK):
        self.store = induced.Store(folder, memory or MEMORY)
        self.text = induced.Pages(self.store, np.uint8, block)
        self.starts: list[int] = []
        self.lengths: list[int] = []

    def add(self, raw: bytes) -> None:
        self.starts.append(len(self.text))
        self.lengths.append(len(raw))
        self.text.append(np.append(_SYMBOL[np.frombuffer(raw, np.uint8)], np.uint8(1)))

    def repeats(self, window: int = WINDOW, base: int = induced.BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts that repeat: segment number, first and last start. A run may come in two."""
        self.text.append(np.zeros(1, np.uint8))
        text = self.text.done()
        starts, lengths = np.array(self.starts), np.array(self.lengths)
        hits: list[list[int]] = [[] for _ in text.keys]
        last = None
        for at, lcp in induced.suffixes(text, self.store, window, base):
            again = lcp >= window
            both = np.concatenate((at[again], at[:-1][again[1:]], [] if last is None or not again[0] else [last])).astype(at.dtype)
            last = at[-1]
            of = both // text.block
            for b in np.unique(of).tolist():
                hits[b].append(self.store.put(both[of == b]))
        out = [np.empty(0, np.int64)] * 3
        for keys in hits:
            if keys:
                at = np.unique(np.concatenate([self.store.drop(k) for k in keys])).astype(np.int64)
                piece = np.searchsorted(starts, at, side="right") - 1
                place = at - starts[piece]
                inside = place <= lengths[piece] - window  # not past the mark between segments
                piece, place = piece[inside], place[inside]
                if len(place):
                    new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)))
                    lo = np.flatnonzero(new)
                    hi = np.concatenate((lo[1:], [len(place)])) - 1
                    out = [np.concatenate(x) for x in zip(out, (piece[lo], place[lo], place[hi]), strict=True)]
        self.store.close()
        return tuple(out)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] - 1


# ---------------------------------------------------------------- over Spark

_SPAN = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _spans(lists: list) -> pa.Array:
    return pa.array([[{"lo": int(a), "hi": int(b)} for a, b in x] for x in lists], _SPAN)


def find_segments(docs: DataFrame) -> DataFrame:
    """(anchor, seg, doc_id, th, lo, hi, place): the segments of docs(doc_id, th, text)."""

    def run(batches):
        rolling = None
        for b in batches:
            ids, ths = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for doc_id, th, text in zip(ids, ths, b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < WINDOW:
                    continue
                rolling = rolling if rolling is not None and len(rolling.up) >= min(len(raw), PIECE) else Rolling(min(PIECE, max(len(raw), 1 << 16)))
                for h, lo, hi, place in anchored(raw, rolling):
                    out[0].append(h)
                    out[1].append(np.array([xxhash.xxh3_64_intdigest(raw[a : z + WINDOW]) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64))
                    out[2] += [doc_id] * len(h)
                    out[3] += [th] * len(h)
                    out[4].append(lo)
                    out[5].append(hi)
                    out[6].append(place)
            if out[0]:
                long = [pa.array(np.concatenate(out[i]).astype(np.uint64).view(np.int64)) for i in (0, 1, 4, 5, 6)]
                yield pa.RecordBatch.from_arrays([long[0], long[1], pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), long[2], long[3], long[4].cast(pa.int32())], names=["anchor", "seg", "doc_id", "th", "lo", "hi", "place"])

    return docs.mapInArrow(run, "anchor bigint, seg bigint, doc_id bigint, th bigint, lo bigint, hi bigint, place int")


def pack(docs: DataFrame) -> DataFrame:
    """docs(doc_id, th, text) with the text as a Zstandard frame ``z``: texts cross the network twice, and so take less room."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            z = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["doc_id", "th", "z"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, z binary")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def counted_runs(pieces: DataFrame) -> DataFrame:
    """(anchor, seg, runs) of the segments of hot anchors, by counting every window's hash: counts are combined before the
    shuffle, so neither a hot anchor nor a hot window gathers in a task."""

    def windows(batches):
        rolling = Rolling(2 * WINDOW)
        for b in batches:
            for anchor, seg, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = rolling.hashes(np.frombuffer(raw, np.uint8), WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), anchor)), pa.array(np.full(len(h), seg)), pa.array(np.arange(len(h))), pa.array(h.view(np.int64))], names=["anchor", "seg", "at", "h"])

    every = stored(pieces.select("anchor", "seg", "bytes").mapInArrow(windows, "anchor bigint, seg bigint, at bigint, h bigint"))
    again = every.groupBy("anchor", "h").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "h")
    found = every.join(again, ["anchor", "h"]).groupBy("anchor", "seg").agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("runs"))
    return found  # single windows; they are united when bytes are removed


def repeated_spans(docs: DataFrame, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(doc_id, th, spans): runs of window starts that repeat, for documents that have any. docs(doc_id, th, text)."""
    spark = docs.sparkSession
    folder, parts = shared_dir(spark), plan_partitions(spark)
    found = stored(find_segments(docs))
    distinct = stored(found.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi", "place")).alias("at")))
    several = stored(distinct.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"))
    hot = several.where(F.col("k") > max_segments).select("anchor")
    wanted = distinct.join(several, "anchor").select("anchor", "seg", "n", "at.*", (F.col("k") > max_segments).alias("hot"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "seg", "n", "lo", "hi", "place", "hot")).alias("segs"))

    def cut(batches):
        for b in batches:
            for z, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = zstandard.decompress(z)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["anchor"] for s in segs], pa.int64()), pa.array([s["seg"] for s in segs], pa.int64()), pa.array([s["n"] for s in segs], pa.int64()), pa.array([s["place"] for s in segs], pa.int32()), pa.array([s["hot"] for s in segs], pa.bool_()), pa.array([raw[s["lo"] : s["hi"] + WINDOW] for s in segs], pa.binary())],
                    names=["anchor", "seg", "n", "place", "hot", "bytes"],
                )

    packed = pack(docs)
    met = packed.join(wanted, _same_doc(packed, wanted)).select("z", "segs")
    pieces = met.mapInArrow(cut, "anchor bigint, seg bigint, n bigint, place int, hot boolean, bytes binary")
    shards = pieces.where("not hot").drop("hot").repartition(parts, "anchor").sortWithinPartitions("anchor", "seg")

    def sort(batches):
        shard, names, size, held, last = Shard(folder), [], 0, [], None

        def judged():
            """Runs of the segments met once; those met more often repeat whole."""
            piece, lo, hi = shard.repeats()
            for i in range(0, len(piece), 1 << 16):
                rows = [(*names[k][:2], names[k][3] + a, names[k][3] + z) for k, a, z in zip(piece[i : i + (1 << 16)].tolist(), lo[i : i + (1 << 16)].tolist(), hi[i : i + (1 << 16)].tolist(), strict=True) if names[k][2] == 1]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[j] for x in rows], pa.int64()) for j in (0, 1)), _spans([[x[2:]] for x in rows])], names=["anchor", "seg", "runs"])

        def close():
            """The held segments of an anchor go to the shard, as far as they may repeat."""
            added = 0
            for k, first, end in possible([(raw, place, n == 1) for _, n, place, raw in held]):
                seg, n, _, raw = held[k]
                shard.add(raw[first : end + WINDOW])
                names.append((last[0], seg, n, first))
                added += end + WINDOW - first
            return added

        for b in batches:
            for anchor, seg, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if last == (anchor, seg):
                    continue  # a repeated row of the table brings its segments again
                if held and anchor != last[0]:
                    size += close()
                    held = []
                    if size >= SHARD_BYTES:
                        yield from judged()
                        shard, names, size = Shard(folder), [], 0
                held.append((seg, *row))
                last = (anchor, seg)
        if held:
            close()
        if names:
            yield from judged()

    runs = stored(shards.mapInArrow(sort, "anchor bigint, seg bigint, runs array<struct<lo:bigint,hi:bigint>>"))
    if not hot.isEmpty():
        runs = runs.union(counted_runs(pieces.where("hot").dropDuplicates(["anchor", "seg"])))
    whole = distinct.where("n > 1").select("anchor", "seg", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("runs"))
    verdict = whole.union(runs)
    back = found.join(verdict, ["anchor", "seg"]).select(
        "doc_id", "th", F.explode(F.coalesce(F.transform("runs", lambda r: F.struct((F.col("lo") + r["lo"]).alias("lo"), (F.col("lo") + r["hi"]).alias("hi"))), F.array(F.struct("lo", "hi")))).alias("s")
    )
    return back.groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the bytes kept."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, max_segments)
    packed = pack(docs)
    joined = packed.join(spans, _same_doc(packed, spans), "left").select(packed["doc_id"], "z", "spans")

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for z, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = zstandard.decompress(z)
                kept, removed, n = raw, 0, 0
                if runs:
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, [r["lo"] for r in runs], 1)
                    np.add.at(change, [r["hi"] + WINDOW for r in runs], -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    removed, n = int(gone.sum()), len(_runs(gone)[0])
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    df = joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return df if with_text else df.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
