"""Sparse text features and linear models, shared by the classifiers of this subpackage.

Features of a text (each present or not): its words (runs of letters, lower-cased), their first three to eight letters (so
inflected forms share features, also ones that training never met), the same for words written with digits or marks for or
between letters (``id1ot``, ``s.t.u.p.i.d``), and for each ASCII mark, capitals and digits the binary logarithm of their
share of the text. All features of all training rows are counted; those whose association with a label stands out at a
false-discovery rate of ``DISCOVERY`` (likelihood ratio, Benjamini-Hochberg) make the model's vocabulary, at most
``VOCABULARY`` of them, which bounds what is broadcast.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._common import short_batches, stored

#: At most so many labelled rows are fitted, those with the least hash of their id.
SAMPLE_ROWS = 20_000
VOCABULARY = 4096
#: Features in fewer training rows than this aren't tested.
LEAST_ROWS = 3
#: The share of chosen features that may be noise.
DISCOVERY = 0.05
#: So many of the strongest features are taken for each label in any case: a few labelled rows prove little.
LEAST_FEATURES = 100
PREFIXES = range(3, 9)

_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_WORD = re.compile(r"[^\W\d_]+")
_AROUND = ".,;:!?|()\"'"
#: Digits and marks that stand for letters.
_FOR_LETTERS = str.maketrans("013457$@!|", "oieastsail")


def forms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def token_words(token: bytes) -> list[str]:
    """The words in a run of bytes that aren't blank, and what it spells with digits and marks read as letters or left out."""
    text = token.decode("utf-8", "replace").lower()
    if text.isalpha():
        return [text]
    core = text.strip(_AROUND)
    if core.isalpha():
        return [core]
    words = _WORD.findall(text)
    whole = "".join(_WORD.findall(core.translate(_FOR_LETTERS)))
    return words if not whole or whole in words else [*words, whole]


def features(text: str | None, known: dict[bytes, list[str]] | None = None) -> set[str]:
    """``known`` keeps what tokens bring, so that a run of texts looks into each once."""
    raw, known = (text or "").encode("utf-8", "surrogatepass"), {} if known is None else known
    out = _shares(raw)
    for t in set(raw.lower().split()):
        found = known.get(t)
        if found is None:
            found = known[t] = [f for w in token_words(t) for f in forms(w)]
        out.update(found)
    return out


def _shares(raw: bytes) -> set[str]:
    if not raw:
        return set()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    shares = [(chr(c), counts[c]) for c in _MARKS if counts[c]] + [("A", counts[0x41:0x5B].sum()), ("0", counts[0x30:0x3A].sum())]
    return {f"#{c}{int(math.log2(k / n))}" for c, k in shares if k}


class Vocabulary:
    """Numbers of the chosen features in a text; what a token brings is kept, so a token is looked into once."""

    KEPT = 400_000

    def __init__(self, words: list[str]):
        self.index = {w: i for i, w in enumerate(words)}
        self.heads = {w[: PREFIXES[0]] for w in words}
        self.known: set[bytes] = set()
        self.hits: dict[bytes, tuple[int, ...]] = {}

    def numbers(self, text: str | None) -> list[int]:
        raw, index, heads = (text or "").encode("utf-8", "surrogatepass"), self.index, self.heads
        found = {index[f] for f in _shares(raw) if f in index}
        tokens = set(raw.lower().split())
        for t in tokens - self.known:
            words = [w for w in token_words(t) if w[: PREFIXES[0]] in heads]
            if words and (own := tuple(index[f] for w in words for f in forms(w) if f in index)):
                self.hits[t] = own
        for t in self.hits.keys() & tokens:
            found.update(self.hits[t])
        self.known |= tokens
        if len(self.known) > self.KEPT:
            self.known, self.hits = set(), {}
        return sorted(found)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def n_words(text: str | None) -> int:
    """Runs of bytes that aren't blank."""
    if not text:
        return 0
    blank = _BLANK[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(not blank[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """(features array, y array) of at most ``rows`` labelled documents; ids without a text, and repeats of an id, are left out."""
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.array(*(F.col(n).cast("double") for n in names)).alias("y"))
    known = known.where(F.col("l_id").isNotNull() & ~F.exists("y", lambda v: v.isNull())).dropDuplicates(["l_id"])
    picked = known.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)

    def run(batches):
        known: dict[bytes, list[str]] = {}
        for b in batches:
            found = [list(features(t, known)) for t in b.column(1).to_pylist()]
            if len(known) > Vocabulary.KEPT:
                known.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), b.column(2)], names=["doc_id", "f", "y"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")
    return stored(texts.mapInArrow(run, "doc_id bigint, f array<string>, y array<double>"))


def choose_vocabulary(sample: DataFrame, n_labels: int, size: int = VOCABULARY, discovery: float = DISCOVERY) -> list[str]:
    """The features more frequent with a label than without that stand out at the false-discovery rate, for each label at
    most its part of ``size``, the strongest first. Of several labels, one that most rows have is told by the lack of the
    others' features."""
    total = sample.agg(F.count("*").alias("n"), *(F.sum(F.col("y")[i]).alias(f"p{i}") for i in range(n_labels))).first()
    if not total["n"]:
        return []
    n, rows = F.col("n"), float(total["n"])
    counts = sample.select(F.explode("f").alias("w"), "y").groupBy("w").agg(F.count("*").cast("double").alias("n"), *(F.sum(F.col("y")[i]).alias(f"p{i}") for i in range(n_labels))).where(n >= LEAST_ROWS)

    def ratio(i: int):
        """Likelihood ratio of the feature's and the label's two by two table; zero if they keep apart."""
        p, all_p = F.col(f"p{i}"), float(total[f"p{i}"] or 0.0)
        cells = ((p, n * all_p / rows), (n - p, n * (rows - all_p) / rows), (all_p - p, (rows - n) * all_p / rows), (rows - all_p - n + p, (rows - n) * (rows - all_p) / rows))
        g = sum((F.when(seen > 0, 2 * seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))
        return F.when(p * rows > n * all_p, g).otherwise(0.0)

    tested = stored(counts.select("w", *(ratio(i).alias(f"g{i}") for i in range(n_labels))))
    rare = [i for i in range(n_labels) if (total[f"p{i}"] or 0.0) <= rows / 2] or list(range(n_labels))
    tests, part = tested.count(), max(1, size // len(rare))
    chosen: dict[str, None] = {}
    for i in rare:
        best = tested.select("w", F.col(f"g{i}").alias("g")).where("g > 0").orderBy(F.desc("g"), "w").limit(part).collect()
        # exp(-g / 2) bounds the odds of a ratio g by chance
        passed = [k for k, r in enumerate(best, 1) if math.exp(-r.g / 2) <= discovery * k / max(1, tests)]
        chosen |= dict.fromkeys(r.w for r in best[: max([LEAST_FEATURES, *passed])])
    return list(chosen)


def matrix(sample: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices end to end, row starts, y) of the sample in doc_id order; bounded by SAMPLE_ROWS and VOCABULARY."""
    words = pa.array(vocabulary, pa.string())

    def run(batches):
        for b in batches:
            at = pc.index_in(b.column(1).flatten(), value_set=words)
            row = pc.list_parent_indices(b.column(1)).to_numpy()
            there = at.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[there], minlength=b.num_rows))))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.filter(at.is_valid()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows, b.column(2)], names=["doc_id", "x", "y"])

    table = sample.mapInArrow(run, "doc_id bigint, x array<int>, y array<double>").toPandas().sort_values("doc_id", kind="stable")
    if not len(table):
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty((0, 1))
    lengths = table["x"].map(len).to_numpy(np.int64)
    flat = np.concatenate(table["x"].tolist()).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum(lengths))), np.array(table["y"].tolist(), dtype=float).reshape(len(table), -1)


def take(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for some rows."""
    n = np.diff(at)[rows]
    start = np.repeat(at[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return flat[start + np.arange(n.sum())], np.concatenate(([0], np.cumsum(n)))


def margins(flat, at, dense, w, v, bias):
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(rows, weights=w[flat], minlength=len(at) - 1) + (dense @ v if dense.shape[1] else 0) + bias


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(flat, at, dense, y, size: int, ridge: float = 0.1, rounds: int = 150):
    """Ridge logistic regression by accelerated gradient steps, scaled by each weight's curvature. Returns (w, v, bias)."""
    n = len(y)
    rows = np.repeat(np.arange(n), np.diff(at))
    prior = (y.sum() + 0.5) / (n + 1)
    bias = math.log(prior / (1 - prior))
    w, v = np.zeros(size), np.zeros(dense.shape[1])
    # an upper bound on curvature: a row with k features couples k weights
    load = np.minimum(np.diff(at) + 1 + dense.shape[1], 64.0)
    step_w = 1 / (0.25 * np.bincount(flat, weights=load[rows], minlength=size) + ridge)
    step_v = 1 / (0.25 * (load[:, None] * dense**2).sum(axis=0) + ridge)
    step_b = 1 / (0.25 * load.sum() + 1e-9)
    last = (w, v, bias)
    for t in range(1, rounds + 1):
        m = (t - 1) / (t + 2)
        yw, yv, yb = (x + m * (x - p) for x, p in zip((w, v, bias), last, strict=True))
        g = sigmoid(margins(flat, at, dense, yw, yv, yb)) - y
        last = (w, v, bias)
        w = yw - step_w * (np.bincount(flat, weights=g[rows], minlength=size) + ridge * yw)
        v = yv - step_v * (dense.T @ g + ridge * yv)
        bias = yb - step_b * g.sum()
    return w, v, bias


def vectorise(texts: list, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(indices end to end, row starts) of some texts."""
    rows = [vocabulary.numbers(t) for t in texts]
    return np.array([i for r in rows for i in r], np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
