"""The language model's filter in parts."""

import numpy as np
import pandas as pd
import pyarrow as pa

from vellum.llm import lm_score


def test_filter_in_parts_keeps_its_precision(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64)
    counts = spark.createDataFrame(pd.DataFrame({"kind": 1, "key": keys.view(np.int64), "n": rng.integers(1, 3000, len(keys))}))
    unseen, shape = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), lm_score.filter_shape(counts)
    assert shape[0] > 4
    found, read = np.zeros(len(unseen), int), np.zeros(len(keys), int)
    for i in range(-(-shape[0] // 2)):
        bits, probes, most = lm_score.build_filter(spark, counts, 2 << 20, i, shape)
        assert len(bits) <= 2 << 20 and probes == lm_score.PROBES
        found += lm_score.read_levels(bits, unseen, probes, most, i, shape[0], 2)
        read += lm_score.read_levels(bits, keys, probes, most, i, shape[0], 2)
    assert (found == 0).mean() > 0.97 and (read > 0).all()


def test_scores_do_not_depend_on_parts(docs_of, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40_000, 2500)) for _ in range(200)]
    rows = list(enumerate(texts * 2))
    assert lm_score.filter_shape(lm_score.count_ngrams(docs_of(rows)).where("n > 1"))[0] > 1
    monkeypatch.setattr(lm_score, "RUN_TOKENS", 20_000)
    whole, cut = ({r.doc_id: r.score for r in lm_score.score(docs_of(rows), max_filter_bytes=b).collect()} for b in (64 << 20, 1 << 20))
    assert whole == cut


def test_bigrams_met_once_count(docs_of):
    held = next(i for i in range(100) if lm_score._held_out([i])[0])
    words = [f"w{i}" for i in range(400)]
    rows = [(None, " ".join(words)), (held, " ".join(words)), (held, " ".join(words[::-1]))]
    met, unmet = sorted((r.score for r in lm_score.score(docs_of(rows)).where(f"doc_id = {held}").collect()), reverse=True)
    assert met > unmet + 100


def test_tokens_are_words_and_ends(monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 64)
    monkeypatch.setattr(lm_score, "_powers", {})
    rng = np.random.default_rng(3)
    letters = list("abABzé東 \t\n\x0b\r.9")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 300, 200)]
    texts += [None, "", " ", "x", "x" * 65 + " " + "X" * 65, "ab ba", " a "]
    tokens, lengths = lm_score.batch_tokens(pa.array(["cut off", *texts]).slice(1))
    want = [w for t in texts for w in [*(t or "").encode().lower().split(), None]]
    assert lengths.tolist() == [len((t or "").encode().split()) + 1 for t in texts]
    names = dict(zip(want, tokens.tolist(), strict=True))
    assert [names[w] for w in want] == tokens.tolist() and len(set(names.values())) == len(names)
    assert np.concatenate([lm_score.token_hashes(t) for t in texts]).tolist() == tokens.tolist()
