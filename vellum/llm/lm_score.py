"""Language-model scores from a log-frequency Bloom filter.

Counts are gathered over all training rows: unigrams of every document, and bigrams within it, keyed by 64-bit hashes.
A count c is stored as q = 1 + floor(log_b c): the filter holds the pairs (n-gram, 1) .. (n-gram, q), so a count is read
back by probing j = 1, 2, ... until a probe fails, and a false positive can only overstate it, with falling odds. The
filter is built by tasks, each of which sets the bits of its own slice of the bit array; the slices are put together
and broadcast. Its size follows the number of stored pairs, with the same bits and probes for each at every size; it is
cut by key slice into parts of at most ``max_filter_bytes``. A task loads one part after another for a bounded run of
tokens, and each key is read from the one part that holds it, so no worker holds two parts.

The model interpolates: P(w | h) = a * min(1, c(hw) / c(h)) + (1 - a) * (c(w) + 1) / (Z + V + 1), all c read from the
filter, Z the sum of what the filter would return for the vocabulary, a = ``weight`` if h was seen, else 0. All
bigrams are stored, also those met once.

The base score needs exact counts: tokens with count >= N / ``head`` (at most ``head`` tokens, whatever the corpus) are
broadcast; the rest leave the scan as (document, token, times) rows and meet their counts in a shuffle join, whose keys
are by construction rare.

Defined cases: a null or empty text has one token, the end; no training rows: N = V = 0, and every probability is 1;
tokens are compared by 64-bit hash; repeated rows are scored alike and each counts in training; a null doc_id is
training (it has no remainder) and is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import documents, plan_partitions, short_batches, stored

FOLDS, HELD_OUT = 7, 2
BASE = 1.5
BITS_PER_PAIR = 10
#: Hash functions at most: at 10 bits a pair, four give a false positive in eighty probes.
PROBES = 4
#: Bytes of a part of the filter.
MAX_FILTER_BYTES = 128 << 20
#: Tokens whose levels are gathered over all parts at once.
RUN_TOKENS = 4_000_000
#: The same for a filter of one part, which stays loaded.
SHORT_RUN_TOKENS = 1 << 20
ROWS_OUT = 512
SLICE_BYTES = 1 << 20
WEIGHT = 0.25
HEAD = 1 << 21
END = np.uint64(0x9AE16A3B2F90404F)
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Distinct n-grams held in a worker before they are handed to Spark.
FLUSH = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: One 64-bit number for each byte of a word (A-Z as a-z), and the ratio of the powers that places are weighted by.
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64, endpoint=True) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RATIO = 0xD1342543DE82EF93
#: Bytes of texts that are hashed at once, and of the longest word that is hashed by its letters' sum.
BLOCK_BYTES, LONG_WORD = 1 << 18, 64
_powers: dict[int, np.ndarray] = {}


def _power_table(ratio: int, n: int) -> np.ndarray:
    """ratio ** 0 .. ratio ** (n - 1), modulo 2 ** 64; the table of a block's length is kept."""
    if ratio in _powers and n <= len(_powers[ratio]):
        return _powers[ratio][:n]
    table = np.full(max(n, BLOCK_BYTES), ratio & 0xFFFFFFFFFFFFFFFF, np.uint64)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if n <= BLOCK_BYTES:
        _powers[ratio] = table
    return table[:n]


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of UTF-8 bytes, words of each text); texts lie between neighbours of ``cuts``. A word's hash mixes the
    sum of its letters' numbers times powers of their places, read as a difference of running sums; long words go through XXH64."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power_table(_RATIO, n), out=sums[1:])
    back = _power_table(pow(_RATIO, -1, 1 << 64), n)
    out = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _GOLD)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return out, np.diff(np.searchsorted(starts, cuts))


def batch_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts one after another, each text's closed by the end token; number of tokens of each text)."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    words, counts, at = [], [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, len(texts))
        found, n = _word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        words.append(found)
        counts.append(n)
        at = to
    words, counts = np.concatenate(words), np.concatenate(counts)
    tokens = np.full(len(words) + len(counts), END)
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return tokens, counts + 1


def token_hashes(text: str | None) -> np.ndarray:
    return batch_tokens(pa.array([text], pa.string()))[0]


def inner_bigrams(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bigrams of texts that lie one after another, without those that span two."""
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    return bigram_hashes(tokens)[inner[:-1]]


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens[:-1] * _GOLD + tokens[1:])


def level(count, base: float = BASE):
    return 1 + np.floor(np.log(count) / math.log(base) + 1e-9).astype(np.int64)


def from_level(q: np.ndarray, base: float = BASE) -> np.ndarray:
    """The middle of the counts that have this level; 0 for 0."""
    low, high = np.ceil(base ** (q - 1.0) - 1e-9), np.ceil(base ** (q + 0.0) - 1e-9) - 1
    return np.where(q > 0, np.maximum(1, (low + np.maximum(low, high)) / 2), 0.0)


def _pair_hash(keys: np.ndarray, j: int) -> np.ndarray:
    return mix(keys + np.uint64(j * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))


def _slot(h: np.ndarray, i: int) -> np.ndarray:
    """Bit position of a pair's probe i within its key's slice."""
    return (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(SLICE_BYTES * 8 - 1)


def read_levels(bitmap: np.ndarray, keys: np.ndarray, probes: int, most: int, part: int = 0, slices: int | None = None, per_part: int | None = None) -> np.ndarray:
    """Repeated membership probes: for each key the largest q such that (key, 1) .. (key, q) are all found; 0 for keys of other parts."""
    slices = slices or len(bitmap) // SLICE_BYTES
    uniq, back = np.unique(keys, return_inverse=True)
    own = ((uniq >> np.uint64(20)) % np.uint64(slices)).astype(np.int64) - part * (per_part or slices)
    q, live = np.zeros(len(uniq), np.uint8), np.flatnonzero((own >= 0) & (own < len(bitmap) // SLICE_BYTES))
    left, first = uniq[live], own[live].astype(np.uint64) * np.uint64(SLICE_BYTES * 8)
    for j in range(1, most + 1):
        h = _pair_hash(left, j)
        ok = np.ones(len(h), bool)
        for i in range(probes):
            at = _slot(h, i) + first
            ok &= (bitmap[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        live, left, first = live[ok], left[ok], first[ok]
        if not len(live):
            break
        q[live] = j
    return q[back]


def _held_out(ids: list) -> list[bool]:
    return [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(kind 1 or 2, key, n) over all training rows of docs(doc_id, text)."""

    def merged(parts):
        keys = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n[order], first)

    def rows(kind, parts):
        keys, n = merged(parts)
        for i in range(0, len(keys), 1 << 17):
            k = keys[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 17)])], names=["kind", "key", "n"])

    def run(batches):
        held = {1: [], 2: []}
        for b in batches:
            tokens, lengths = batch_tokens(b.column(1).filter(pa.array(~np.array(_held_out(b.column(0).to_pylist()), bool))))
            if not len(tokens):
                continue
            for kind, found in ((1, tokens), (2, inner_bigrams(tokens, lengths))):
                held[kind].append(np.unique(found, return_counts=True))
                if sum(len(p[0]) for p in held[kind]) > FLUSH:
                    held[kind] = [merged(held[kind])]
                    if len(held[kind][0][0]) > FLUSH // 2:
                        yield from rows(kind, held[kind])
                        held[kind] = []
        for kind, parts in held.items():
            if parts:
                yield from rows(kind, parts)

    return docs.mapInArrow(run, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def filter_shape(counts: DataFrame) -> tuple[int, int]:
    """(slices, highest level) of the filter over counts(key, n)."""
    total, most = counts.select(_level().alias("q")).agg(F.coalesce(F.sum("q"), F.lit(0)), F.coalesce(F.max("q"), F.lit(0))).first()
    return max(1, -(-total * BITS_PER_PAIR // (SLICE_BYTES * 8))), int(most)


def _level():
    return (F.floor(F.log("n") / math.log(BASE) + 1e-9) + 1).cast("int")


def build_filter(spark: SparkSession, counts: DataFrame, max_filter_bytes: int, part: int = 0, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, int, int]:
    """(bit array of one part, probes, highest level) from counts(kind, key, n). A key's pairs lie in one slice of the bits, so a task builds a slice alone."""
    slices, most = shape or filter_shape(counts)
    per_part = max(1, max_filter_bytes // SLICE_BYTES)
    low, high, probes = part * per_part, min(slices, (part + 1) * per_part), PROBES
    groups = min(high - low, plan_partitions(spark))

    def slice_of(batches):
        """Rows arrive sorted by slice: one slice is held at a time."""
        current, flags = None, None
        for b in batches:
            s, keys, levels = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            for value in np.unique(s):
                if value != current:
                    if current is not None:
                        yield out(current, flags)
                    current, flags = value, np.zeros(SLICE_BYTES * 8, np.uint8)
                own = s == value
                k, n = keys[own], levels[own]
                for j in range(1, int(n.max(initial=0)) + 1):
                    h = _pair_hash(k[n >= j], j)
                    for i in range(probes):
                        flags[_slot(h, i)] = 1
        if current is not None:
            yield out(current, flags)

    def out(current, flags):
        return pa.RecordBatch.from_arrays([pa.array([int(current)], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], names=["slice", "bytes"])

    dealt = counts.select((F.shiftrightunsigned("key", 20) % slices).cast("int").alias("slice"), "key", _level().alias("q")).where(F.col("slice").between(low, high - 1))
    made = dealt.repartition(groups, "slice").sortWithinPartitions("slice").mapInArrow(slice_of, "slice int, bytes binary")
    bitmap = np.zeros((high - low) * SLICE_BYTES, np.uint8)
    for row in made.toLocalIterator():  # at most max_filter_bytes, a slice at a time
        bitmap[(row.slice - low) * SLICE_BYTES : (row.slice - low + 1) * SLICE_BYTES] = np.frombuffer(row.bytes, np.uint8)
    return bitmap, probes, most


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, weight: float = WEIGHT, head: int = HEAD) -> DataFrame:
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    counts = stored(count_ngrams(docs))
    unigrams = counts.where("kind = 1").select("key", "n")
    q = F.floor(F.log("n") / math.log(BASE) + 1e-9) + 1
    low, high = F.ceil(F.pow(F.lit(BASE), q - 1) - 1e-9), F.ceil(F.pow(F.lit(BASE), q) - 1e-9) - 1
    n_all, vocabulary, z = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.greatest(F.lit(1.0), (low + F.greatest(low, high)) / 2)), F.lit(0.0))).first()
    least = max(1, -(-n_all // head))
    common = unigrams.where(F.col("n") >= least).toPandas()  # at most head rows: their counts sum to n_all
    order = np.argsort(head_keys := common["key"].to_numpy(np.int64).view(np.uint64))
    shape = slices, most = filter_shape(counts)
    per_part = max(1, max_filter_bytes // SLICE_BYTES)
    parts = [spark.sparkContext.broadcast(build_filter(spark, counts, max_filter_bytes, i, shape)[0]) for i in range(-(-slices // per_part))]
    sent = spark.sparkContext.broadcast((head_keys[order], common["n"].to_numpy(np.int64)[order]))
    denominator = n_all + vocabulary + 1

    def runs(batches):
        """(ids, tokens, lengths) of batches put together, in runs of about ``RUN_TOKENS``: what a run repeats is probed once."""
        ids, tokens, lengths, size = [], [], [], 0
        for b in batches:
            found, n = batch_tokens(b.column(1))
            if len(n):
                ids.append(b.column(0))
                tokens.append(found)
                lengths.append(n)
                size += len(found)
            if size >= (SHORT_RUN_TOKENS if len(parts) == 1 else RUN_TOKENS):
                yield pa.concat_arrays(ids), np.concatenate(tokens), np.concatenate(lengths)
                ids, tokens, lengths, size = [], [], [], 0
        if ids:
            yield pa.concat_arrays(ids), np.concatenate(tokens), np.concatenate(lengths)

    def run(batches):
        keys, n = sent.value
        middle = from_level(np.arange(most + 2))  # counts by level
        logs = np.append(np.log10((n + 1) / denominator), 0.0)  # of common tokens; last: not one of them
        for ids, tokens, lengths in runs(batches):
            levels = [0, 0]
            for i, sent_part in enumerate(parts):
                bits = sent_part.value
                for k, wanted in enumerate((tokens, bigram_hashes(tokens))):  # those that span two texts aren't used
                    levels[k] = levels[k] + read_levels(bits, wanted, PROBES, most, i, slices, per_part)
                if len(parts) > 1:
                    del bits, sent_part._value  # read again from the worker's disk for the next run
            yield from scored(ids, tokens, lengths, *levels, keys, n, middle, logs)

    def scored(ids, tokens, lengths, q1, q2, keys, n, middle, logs):
        first = np.cumsum(lengths) - lengths
        c1 = middle[q1]
        p = (c1 + 1) / (z + vocabulary + 1)
        follows = np.ones(len(tokens), bool)
        follows[first] = False
        at = np.flatnonzero(follows)
        if len(at):
            before = c1[at - 1]
            p[at] = np.where(before > 0, weight * np.minimum(1, middle[q2[at - 1]] / np.maximum(before, 1)) + (1 - weight) * p[at], p[at])
        total = np.add.reduceat(np.log10(p), first)
        uniq, back = np.unique(tokens, return_inverse=True)
        where = np.searchsorted(keys, uniq)
        where[where == len(keys)] = 0
        where = np.where(keys[where] == uniq, where, len(n)) if len(keys) else np.full(len(uniq), len(n))
        known, base = (where < len(n))[back], logs[where][back]
        at = np.flatnonzero(~known)
        text, token = np.repeat(np.arange(len(lengths)), lengths)[at], tokens[at]
        order = np.lexsort((token, text))
        text, token = text[order], token[order]
        heads = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (token[1:] != token[:-1])))) if len(at) else at
        times = np.diff(np.append(heads, len(at)))
        offsets = np.searchsorted(text[heads], np.arange(len(lengths) + 1)).astype(np.int32)
        tail = pa.StructArray.from_arrays([pa.array(token[heads].view(np.int64)), pa.array(times.astype(np.int32))], names=["key", "k"])
        whole = pa.RecordBatch.from_arrays(
            [ids, pa.array(_held_out(ids.to_pylist())), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), tail)],
            names=["doc_id", "held_out", "n_tokens", "known_head", "base_head", "score", "tail"],
        )
        yield from (whole.slice(i, ROWS_OUT) for i in range(0, len(whole), ROWS_OUT))

    first = stored(docs.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, known_head bigint, base_head double, score double, tail array<struct<key:bigint,k:int>>").withColumn("row", F.monotonically_increasing_id()))
    rare = first.select("row", F.explode("tail").alias("x")).select("row", "x.key", "x.k")
    met = rare.join(unigrams.where(F.col("n") < least), "key").groupBy("row").agg(F.sum("k").alias("known_tail"), F.sum(F.col("k") * F.log10((F.col("n") + 1) / F.lit(float(denominator)))).alias("base_tail"))
    known = F.col("known_head") + F.coalesce("known_tail", F.lit(0))
    unknown = F.col("n_tokens") - known
    return first.drop("tail").join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_tail", F.lit(0.0)) + unknown * math.log10(1 / denominator)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
