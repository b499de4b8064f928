"""Toxicity by a chain of linear models.

Categories are predicted one after another. Each model sees the text's features and the log odds that the earlier
models of the chain gave; in training these come out of fold, from models that didn't see the row, so later models learn
how far to trust earlier ones. The query's chain runs over the columns of ``labels``: low quality (1 - quality), then
toxic; ``train_chain`` takes any list of 0/1 columns, in the order wanted.

Each category's threshold comes from the out-of-fold scores: the least that leaves ``CLEAN_SHARE`` of the rows without the
label alone, but not above one half, where the category is the likelier answer, and not below ``LEAST_THRESHOLD``.

Training is bounded: at most ``SAMPLE_ROWS`` labelled rows (by hash of the id), ``VOCABULARY`` features; scoring reads
every text whole, in one pass without a shuffle.

Defined cases: a null or empty text has no features and gets the chain's prior; labels that are null leave the row out
of training; an empty or one-sided labelled table gives constant probabilities (0 if empty), and nothing is rejected
without a positive label; repeated rows are scored alike; extra columns are kept by ``with_toxicity`` and ignored by the
query; columns made within are in one struct with a name that the table doesn't have, and ``prefix`` names the new ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import linear
from vellum.llm._common import documents, free_name, short_batches

FOLDS = 5
CLEAN_SHARE = 0.995
LEAST_THRESHOLD, MOST_THRESHOLD = 0.1, 0.5
CHAIN = ("low_quality", "toxic")


class Chain:
    """names, vocabulary and one (w, v, bias) for each category; v weighs the earlier categories' log odds."""

    def __init__(self, names, vocabulary, models, thresholds=None):
        self.names, self.words, self.models = list(names), vocabulary, models
        self.thresholds = dict(zip(self.names, thresholds or [MOST_THRESHOLD] * len(self.names), strict=True))
        self.index = linear.Vocabulary(vocabulary)

    def plain(self) -> tuple:
        """What a broadcast carries: no class of this package, which executors needn't have."""
        return self.names, self.words, self.models

    def probabilities(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)))
        if not self.models:
            return out
        flat, at = linear.vectorise(texts, self.index)
        odds = np.zeros((len(texts), 0))
        for k, (w, v, bias) in enumerate(self.models):
            m = np.clip(linear.margins(flat, at, odds, w, v, bias), -30, 30)
            out[:, k] = linear.sigmoid(m)
            odds = np.column_stack((odds, m))
        return out


def train_chain(docs: DataFrame, labels: DataFrame, names=CHAIN, *, rows: int = linear.SAMPLE_ROWS, vocabulary: int = linear.VOCABULARY, folds: int = FOLDS) -> Chain:
    """labels has doc_id and one 0/1 column for each name."""
    sample = linear.labelled_sample(docs, labels, list(names), rows)
    words = linear.choose_vocabulary(sample, len(names), vocabulary)
    flat, at, y = linear.matrix(sample, words)
    if not len(y):
        return Chain(names, [], [])
    fold = np.arange(len(y)) % folds
    models, thresholds, out_of_fold = [], [], np.zeros((len(y), 0))
    for k in range(len(names)):
        held = np.zeros(len(y))
        for f in range(folds):
            fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(fit) and len(rest):
                model = linear.fit_logistic(*linear.take(flat, at, fit), out_of_fold[fit], y[fit, k], len(words))
                held[rest] = linear.margins(*linear.take(flat, at, rest), out_of_fold[rest], *model)
        models.append(linear.fit_logistic(flat, at, out_of_fold, y[:, k], len(words)))
        clean = held[y[:, k] == 0]
        thresholds.append(float(np.clip(linear.sigmoid(np.quantile(clean, CLEAN_SHARE)), LEAST_THRESHOLD, MOST_THRESHOLD)) if len(clean) else MOST_THRESHOLD)
        out_of_fold = np.column_stack((out_of_fold, np.clip(held, -30, 30)))
    return Chain(names, words, models, thresholds)


def with_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """docs plus one probability column for each category."""
    short_batches(docs.sparkSession)
    held, built = docs.sparkSession.sparkContext.broadcast(chain.plain()), {}
    names = [f"{prefix}{n}" for n in chain.names]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(texts: pd.Series) -> pd.DataFrame:
        if not built:
            built["chain"] = Chain(*held.value)
        return pd.DataFrame(built["chain"].probabilities(texts.tolist()), columns=names)

    held_name = free_name(docs, "toxicity")
    scored = docs.withColumn(held_name, score(F.col(text_col)))
    return scored.select(*docs.columns, *(F.col(held_name)[n].alias(n) for n in names))


def without_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose probability of the category is under its threshold."""
    prefix = free_name(docs, "p") + "_"
    return with_toxicity(docs, chain, text_col, prefix).where(F.col(prefix + category) < chain.thresholds[category]).select(*docs.columns)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = train_chain(docs, label_table(spark, sf_dir))
    scored = with_toxicity(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.thresholds["toxic"]).alias("toxic"))
