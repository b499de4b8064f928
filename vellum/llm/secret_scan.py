"""Secrets in texts: three plain patterns, and character Markov models that tell random strings from identifiers.

DataFrame functions only. Each whole text is read for the base patterns (``BASE``) and for runs of ``LEAST_RUN`` or more
characters that a token or an identifier can be made of. Two first-order Markov models over characters, one of random
strings and one of ordinary identifiers, give each pair of neighbours a log-likelihood ratio; a run is a secret of kind
``random`` if some stretch of it has a sum of ``LEAST_RATIO`` or more, that is, is so many times (e to that power) likelier
as a random string. A character that is repeated three times or more is read once, so that rules and padding are no
evidence. A run that lies within a base span adds nothing.

The models are trained from labelled samples (value, secret): ``train`` counts their pairs of neighbours by Spark and
keeps one ratio a pair of characters, whatever the number of samples. ``labelled_samples`` makes samples from a table of
documents: ordinary ones are the runs of about ``SAMPLE_DOCUMENTS`` of them outside base spans, each distinct run once, and
identifiers put together from neighbouring words; random ones are encodings of digests of these documents' ids.

Where a match stands is summed up from the lengths of the pieces between matches, in code points.

Defined cases: a null or empty text has no spans (its base_sha256 is that of an empty string); overlapping base spans
of different kinds all stay; rows that repeat an id or a text are scanned each; a table without words or ids trains from what
there is, and with nothing to train from every ratio is 0, so only base spans are found; an empty table gives no rows; extra columns
are ignored; texts and runs of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import documents

#: Kind: pattern and least length; of ``assign`` the length of the value, group 2, counts.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),  # maximal runs either way, so the short ones need not be listed
}
KINDS = (*BASE, "random")
RUN = "A-Za-z0-9_+/=-"
LEAST_RUN = 16
#: A secret is a million times likelier as a random string: identifiers of words that the samples don't hold come up to some 13.
LEAST_RATIO = math.log(1_000_000)
SAMPLE_DOCUMENTS = 2_000
#: Added to each count of a pair, and how much a model goes by classes of characters (small, capital, digit, mark) alone: pairs that
#: the samples don't hold say little.
SMOOTHING, BY_CLASS = 0.5, 0.1
#: Sums over many lengths go by chunks of so many.
CHUNK = 512

SPAN = "array<struct<start:int,rank:int,stop:int>>"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of characters, at 128 * first + second."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{r:.4f}" for r in self.ratios)), ",").cast("array<double>")


def pairs(value: Column) -> Column:
    """Neighbouring characters of a value."""
    chars = F.split(value, "")
    return F.filter(F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1))), lambda p: F.length(p) == 2)


def _probabilities(counts: dict[str, int], alphabet: list[str]) -> dict[str, float]:
    """P(second | first) of each pair: smoothed counts, mixed with P(class of second | class of first), even within the class."""
    kind = {c: "small" if c.islower() else "capital" if c.isupper() else "digit" if c.isdigit() else "mark" for c in alphabet}
    size, total, classes = Counter(kind.values()), Counter(), Counter()
    for p, n in counts.items():
        total[p[0]] += n
        classes[kind[p[0]], kind[p[1]]] += n
    left = {k: sum(classes[k, other] + SMOOTHING for other in size) for k in size}
    exact = lambda a, b: (counts.get(a + b, 0) + SMOOTHING) / (total[a] + SMOOTHING * len(alphabet))
    rough = lambda a, b: (classes[kind[a], kind[b]] + SMOOTHING) / left[kind[a]] / size[kind[b]]
    return {a + b: (1 - BY_CLASS) * exact(a, b) + BY_CLASS * rough(a, b) for a in alphabet for b in alphabet}


def train(samples: DataFrame) -> Model:
    """samples(value string, secret boolean). Two models, as ratios."""
    counts = samples.select("secret", F.explode(pairs(F.col("value"))).alias("p")).where(F.col("p").rlike(f"^[{RUN}]{{2}}$"))
    found = counts.groupBy("secret", "p").agg(F.count("*").alias("n")).collect()  # two rows a pair of the alphabet at most
    alphabet = [chr(c) for c in range(128) if chr(c).isalnum() or chr(c) in "_+/=-"]
    ratios = [0.0] * (128 * 128)
    by_label = [{r.p: r.n for r in found if r.secret is label} for label in (False, True)]
    if all(by_label):
        ordinary, random = (_probabilities(label, alphabet) for label in by_label)
        for a in alphabet:
            for b in alphabet:
                ratios[128 * ord(a) + ord(b)] = math.log(random[a + b] / ordinary[a + b])
    return Model(tuple(ratios))


def labelled_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(value, secret) from about ``size`` documents, picked by hash of id and text."""
    n = docs.count()
    one = F.struct(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    picked = docs.select(one.alias("d")).select("d.i", "d.t").where(F.pmod(F.xxhash64("i", "t"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, size / max(n, 1))))
    bare = F.col("t")
    for pattern, _ in BASE.values():
        bare = F.regexp_replace(bare, pattern, " ")
    words = picked.select(F.regexp_extract_all(bare, F.lit(f"[{RUN}]{{2,}}"), F.lit(0)).alias("w"))
    letters = words.select(F.filter("w", lambda x: x.rlike("^[A-Za-z]+$")).alias("w"))
    word = lambda k: lambda i: F.lower(F.coalesce(F.get("w", i + k), F.lit("")))
    a, b, c = word(0), word(1), word(2)
    number = lambda i: (i * 7919 % 10_000).cast("string")
    forms = (
        lambda i: F.concat_ws("_", a(i), b(i), c(i)),
        lambda i: F.upper(F.concat_ws("_", a(i), b(i))),
        lambda i: F.concat(a(i), F.initcap(b(i)), F.initcap(c(i))),
        lambda i: F.concat(F.initcap(a(i)), F.initcap(b(i))),
        lambda i: F.concat_ws("-", a(i), b(i), number(i)),
        lambda i: F.concat_ws("/", F.lit(""), a(i), b(i), c(i)),
        lambda i: F.concat(a(i), number(i)),
        lambda i: F.concat_ws("-", F.date_add(F.lit("2000-01-01").cast("date"), i).cast("string"), a(i)),
    )

    def form(_, i):
        made = F.when(i % len(forms) == 0, forms[0](i))
        for k, f in enumerate(forms[1:], 1):
            made = made.when(i % len(forms) == k, f(i))
        return made

    ordinary = words.select(F.explode("w").alias("value")).union(letters.select(F.explode(F.transform("w", form)).alias("value"))).distinct()
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.coalesce("i", F.lit(""))), 256))
    base64 = F.base64(digest)
    plain = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    encoded = (base64, F.translate(F.regexp_replace(base64, "=", ""), "+/", "-_"), plain, F.upper(plain), F.lower(plain), F.lower(F.hex(digest)))
    random = picked.select(F.explode(F.array(*encoded)).alias("value")).distinct()
    return ordinary.withColumn("secret", F.lit(False)).union(random.withColumn("secret", F.lit(True)))


def _sums(lengths: Column) -> Column:
    """Running sums of a short array."""
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(lengths, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))["a"]


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of any length: within chunks, then over the chunks' sums."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: _sums(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<array<int>>").alias("a"))
    placed = F.aggregate(chunks, start, lambda acc, ch: F.struct((acc["s"] + F.element_at(ch, -1)).alias("s"), F.concat(acc["a"], F.array(F.transform(ch, lambda v: v + acc["s"]))).alias("a")))["a"]
    return F.when(F.size(lengths) > 0, F.flatten(placed)).otherwise(F.array().cast("array<int>"))


def gap_lengths(text: Column, pattern: str, matches: Column) -> Column:
    """Lengths of the pieces before each match; empty where nothing matches."""
    return F.when(F.size(matches) > 0, F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(matches))).otherwise(F.array().cast("array<int>"))


def ratio_of(run: Column, ratios: Column) -> Column:
    """The largest sum of ratios over a stretch of the run."""
    start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))
    code = lambda c: F.least(F.ascii(c), F.lit(127))
    step = lambda acc, c: F.greatest(F.lit(0.0), acc["sum"] + F.element_at(ratios, acc["p"] * 128 + code(c) + 1))
    return F.aggregate(F.split(F.regexp_replace(run, r"(.)\1{2,}", "$1"), ""), start, lambda acc, c: F.struct(code(c).alias("p"), step(acc, c).alias("sum"), F.greatest(acc["most"], step(acc, c)).alias("most")))["most"]


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (start, rank, stop) by start, rank the number of the kind in ``KINDS``."""
    patterns = {**{k: p for k, (p, _) in BASE.items()}, "random": f"[{RUN}]{{{LEAST_RUN},}}"}
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    matched = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()))
    # only what was found is kept from here on
    lengths = matched.select("doc_id", *(f"m_{k}" for k in patterns), *(gap_lengths(F.col("text"), p, F.col(f"m_{k}")).alias(f"g_{k}") for k, p in patterns.items()))
    stops = lengths.select("doc_id", *(f"m_{k}" for k in patterns), *(running_sums(F.zip_with(f"g_{k}", f"m_{k}", lambda g, m: g + F.length(m))).alias(f"e_{k}") for k in patterns))
    ratios = model.column()

    def holds(kind: str, m: Column) -> Column:
        if kind == "random":
            return ratio_of(m, ratios) >= LEAST_RATIO
        return F.length(F.regexp_extract(m, BASE[kind][0], 2) if kind == "assign" else m) >= BASE[kind][1]

    def spans(kind: str) -> Column:
        each = F.zip_with(f"m_{kind}", f"e_{kind}", lambda m, e: F.when(holds(kind, m), F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("stop"))))
        return F.filter(each, lambda s: s.isNotNull()).cast(SPAN)

    found = stops.select("doc_id", F.array_sort(F.concat(*(spans(k) for k in BASE))).alias("base"), spans("random").alias("runs"))
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["stop"] <= b["stop"])))
    return found.select("doc_id", "base", apart.alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, model: Model, **columns) -> DataFrame:
    """One row a document: base counts, the base spans' digest, all spans."""
    found = scan(docs, model, **columns)
    number = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("bigint")
    counts = (number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_secrets(docs, train(labelled_samples(docs)))
