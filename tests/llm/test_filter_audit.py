"""The filter audit against a walk over all orders, row by row."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vellum.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def walk(rows, labels):
    """rows of (doc_id, text, source); each order is run document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)
        good = any(d == i and q == 1 for d, q, _ in labels) and i is not None
        toxic = any(d == i and x == 1 for d, _, x in labels) and i is not None
        fails.append((s or "", {f for f, hit in zip("ABCDE", tests) if hit}, good, toxic))
    out = Counter()
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return dict(out)


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def corpus():
    rng = random.Random(3)
    texts = ["w " * 250, "", None, "A B C " * 90, "x# " + " ".join(f"u{i}" for i in range(220)), " ".join(f"v{i}" for i in range(201)), " ".join(f"V{i}" for i in range(230))]
    rows = [(i, rng.choice(texts), rng.choice(("a", "b", None, "b"))) for i in range(120)]
    return rows + [(None, "", "a"), (None, texts[5], "b"), (7, rows[7][1], "a"), (7, rows[7][1], "a")]


def test_equals_a_walk_over_all_orders(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 120, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, digest string, mask int").repartition(5)
    found = got(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert found == walk(rows, labels) and len(found) == 3 * 600


def test_odd_and_empty(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty, none).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got(filter_audit.audit(odd, none)) == walk(rows, [])


def test_polynomial_by_sampled_masks():
    rng = random.Random(1)
    counts = {m: rng.randrange(50) for m in range(32)}
    p = filter_audit.removal_polynomial(counts)
    for chosen in range(32):
        assert filter_audit.corner(p, chosen) == sum(n for m, n in counts.items() if m & chosen)
    for i in range(5):
        assert filter_audit.shapley(p, i) == sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1)
    assert sum(filter_audit.shapley(p, i) for i in range(5)) == sum(n for m, n in counts.items() if m)


def test_a_text_of_many_rows_is_few_rows_before_the_window(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source")).repartition(8)
    counts = filter_audit.mask_counts(docs, spark.createDataFrame([], LABELS))
    assert {(r.mask, r.n) for r in counts.collect()} == {(1, 1), (17, 19_999)}


@pytest.mark.parametrize("text, mask", [("a " * 200, 2), (" ".join(map(str, range(200))), 0), ("ABCDE" + "x" * 200, 1 | 4), ("a|b", 1 | 8), ("", 1)])
def test_conditions(spark, text, mask):
    assert spark.range(1).select(filter_audit.failures(F.lit(text))).first()[0] == mask
