"""Mixing sources to target weights by soft membership.

A softmax classifier, fitted on the labelled table, gives each document a posterior over domains. Document i with n_i
tokens and posterior p_i, taken at rate r_i, adds n_i p_i r_i to the expected domain totals. The rates solve

    minimise  d' W d + STAY * sum_i n_i (r_i - 1)^2,   d = sum_i n_i p_i r_i - target,   r_i >= 0

W the inverse of sum n p p', so both terms count tokens; ``STAY`` is small, and its term makes the solution unique and
keeps rates from running off where a target can't be met. A projected-gradient step of length 1 / STAY from any rates gives
r_i = max(0, 1 - p_i . y), y = W d / STAY, so one vector of as many numbers as there are domains describes all rates. Each
round moves y towards the vector that its own rates ask for, in the metric of the documents whose rate is above zero, by the
best of several step lengths, all tried in one pass over (n, p); it ends when no length lowers the objective by a
millionth. No rate column is ever stored or shuffled.

Target weights are shares; the total is set so that the ``keep`` domain keeps the tokens it has, so its documents stay
at a rate near one. A row is written ``floor(r_i + u_i)`` times, u_i a uniform number made from its id: the expected
number of copies is r_i, and the result is the same in every run.

Defined cases: a null or empty text has no tokens, the classifier's prior as posterior and takes part with weight zero;
an empty labelled table gives uniform posteriors; a domain without any tokens can't be matched and doesn't move the
fit (the metric gets a small ridge); where hardly any document belongs to a domain, so that the totals would end farther from
the goal than they were, the ridge is raised tenfold until they don't; a target that rates of zero or more can't meet is met as nearly as the objective says, and
the report and the query's ``misfit`` columns say how nearly; repeated rows have equal rates; an empty table gives no rows;
extra columns of any name are kept by ``mix`` and ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import linear
from vellum.llm._common import documents, dropped, short_batches, stored

DOMAINS = ("high", "low", "toxic")
TARGET = {"high": 0.90, "low": 0.10, "toxic": 0.0}
KEEP = "high"
#: Weight of rates staying near one, against the misfit.
STAY = 1e-3
#: Step lengths tried in a round, and the least share by which the objective must fall.
LENGTHS = (1.0, 0.5, 0.25, 0.125, 2.0, 4.0)
TOLERANCE = 1e-6
#: The fit takes some ten rounds; not to settle in so many is an error, not a result.
MAX_ROUNDS = 200


class Softmax:
    """One weight vector for each domain over a shared vocabulary."""

    def __init__(self, names, vocabulary, models):
        self.names, self.words, self.models = list(names), vocabulary, models
        self.index = linear.Vocabulary(vocabulary)

    def plain(self) -> tuple:
        """What a broadcast carries: no class of this package, which executors needn't have."""
        return self.names, self.words, self.models

    def posteriors(self, texts: list) -> np.ndarray:
        k = len(self.names)
        if not self.models:
            return np.full((len(texts), k), 1 / k)
        flat, at = linear.vectorise(texts, self.index)
        none = np.zeros((len(texts), 0))
        scores = np.column_stack([linear.margins(flat, at, none, *m) for m in self.models])
        scores = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0))
        return scores / scores.sum(axis=1, keepdims=True)


def train_domains(docs: DataFrame, labels: DataFrame, names=DOMAINS, *, rows: int = linear.SAMPLE_ROWS, vocabulary: int = linear.VOCABULARY) -> Softmax:
    """labels has doc_id and ``domain``. One-against-rest models, normalised together."""
    flags = labels.select("doc_id", *((F.col("domain") == n).cast("int").alias(n) for n in names))
    sample = linear.labelled_sample(docs, flags, list(names), rows)
    words = linear.choose_vocabulary(sample, len(names), vocabulary)
    flat, at, y = linear.matrix(sample, words)
    if not len(y):
        return Softmax(names, [], [])
    none = np.zeros((len(y), 0))
    return Softmax(names, words, [linear.fit_logistic(flat, at, none, y[:, k], len(words)) for k in range(len(names))])


def with_posteriors(docs: DataFrame, model: Softmax, text_col: str = "text", into: str = "mix") -> DataFrame:
    """docs plus ``into``: struct of n (words) and p (posteriors)."""
    short_batches(docs.sparkSession)
    held, built = docs.sparkSession.sparkContext.broadcast(model.plain()), {}

    @F.pandas_udf("n bigint, p array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        if not built:
            built["model"] = Softmax(*held.value)
        values = texts.tolist()
        return pd.DataFrame({"n": [linear.n_words(t) for t in values], "p": list(built["model"].posteriors(values))})

    # not marked deterministic: else a filter on the rate would have the texts scored a second time
    return docs.withColumn(into, score.asNondeterministic()(F.col(text_col)))


def rate_of(p: Column, y: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), 1 - sum((p[i] * float(v) for i, v in enumerate(y)), F.lit(0.0)))


def fit_rates(rows: DataFrame, names, target: dict[str, float], keep: str) -> tuple[np.ndarray, dict]:
    """rows(n, p). Returns the vector of ``rate_of`` and a report: domain totals before, goal and after, and rounds."""
    k = len(names)
    p, n = F.col("p"), F.col("n").cast("double")

    def totals(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each vector the domain totals, the metric of documents with rates above zero, and the cost of leaving one."""
        sums = []
        for y in vectors:
            rate = rate_of(p, y)
            free = F.when(rate > 0, n).otherwise(0.0)
            sums += [F.sum(n * p[i] * rate) for i in range(k)] + [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i + 1)] + [F.sum(n * (rate - 1) * (rate - 1))]
        row = np.array([x or 0.0 for x in rows.agg(*sums).first()]).reshape(len(vectors), -1)
        out = []
        for x in row:
            m = np.zeros((k, k))
            m[np.tril_indices(k)] = x[k:-1]
            out.append((x[:k], m + np.tril(m, -1).T, x[-1]))
        return out

    start = totals([np.zeros(k)])[0]
    before = start[0]
    share = np.array([float(target.get(x, 0.0)) for x in names])
    share = share / share.sum()
    at = list(names).index(keep)
    goal = share * (before[at] / share[at] if share[at] > 0 else before.sum())
    off = lambda t: float(np.abs(t - goal).sum() / max(1.0, goal.sum()))

    def settled(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The best vector for the weights w of the misfit, its domain totals, and rounds."""
        cost = lambda found: float((found[0] - goal) @ w @ (found[0] - goal) + STAY * found[2])
        y, now = np.zeros(k), start
        last, rounds = cost(now), 0
        while last > 0:
            wanted = w @ (now[0] - goal) / STAY - y
            step = np.linalg.solve(np.eye(k) + w @ now[1] / STAY, wanted)
            tried = [y + t * step for t in LENGTHS]
            found = totals(tried)
            best = min(range(len(tried)), key=lambda i: cost(found[i]))
            if cost(found[best]) >= last * (1 - TOLERANCE):
                break
            y, now = tried[best], found[best]
            last, rounds = cost(now), rounds + 1
            if rounds > MAX_ROUNDS:
                raise RuntimeError(f"mixing rates did not settle in {MAX_ROUNDS} rounds")
        return y, now[0], rounds

    ridge = max(1e-9, 1e-9 * np.trace(start[1]) / k)
    y, now, rounds = settled(np.linalg.inv(start[1] + np.eye(k) * ridge))
    while rounds and off(now) > off(before):
        ridge *= 10
        y, now, rounds = settled(np.linalg.inv(start[1] + np.eye(k) * ridge))
    return y, {"before": before.tolist(), "goal": goal.tolist(), "after": now.tolist(), "misfit_before": off(before), "misfit": off(now), "rounds": rounds}


def copies_of(rate: Column, id_col: str = "doc_id") -> Column:
    u = F.pmod(F.xxhash64(F.lit("mixing"), F.col(id_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("int")


def domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET, keep: str = KEEP, train_on: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs, each row as often as its rate says. The classifier is fitted on ``train_on`` (docs, if None)."""
    model = train_domains(train_on if train_on is not None else docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"), F.col(id_col).alias("id"))
    scored = with_posteriors(packed, model)
    rows = stored(scored.select("mix.n", "mix.p"))
    y, _ = fit_rates(rows, model.names, target, keep)
    dropped(rows)
    times = copies_of(rate_of(F.col("mix.p"), y), "id")
    kept = scored.withColumn("copies", times).where("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_domains(docs, domain_table(spark, sf_dir))
    rows = stored(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "mix.n", "mix.p"))
    y, report = fit_rates(rows, model.names, TARGET, KEEP)
    rate = rate_of(F.col("p"), y)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        *(F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(model.names)),
        rate.alias("rate"),
        copies_of(rate).alias("copies"),
        F.lit(report["misfit_before"]).alias("misfit_before"),
        F.lit(report["misfit"]).alias("misfit"),
    )
