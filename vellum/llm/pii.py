"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The base patterns (email, ip, card, phone) are searched in the whole text and always stand. The network adds spans that
the patterns miss: addresses with ``(at)``, cards with other separators, phones without ``+``, defanged numbers. It is
trained in numpy on labelled spans that ``training_lines`` composes (a fixed seed, invented filler words, known spans and
look-alikes without a label), by back-propagation through both directions and the CRF's forward and backward sums.

Decoding: text is read in windows of ``WIDTH`` characters that overlap by half. A span of any kind must hold a digit or
an at sign (``@``, ``(at)``, ``[at]``), a hard constraint of the decoder; a window without either has one legal path, all
outside, and needs no arithmetic. Windows are decoded in batches; each character takes its tag from the window in
whose middle it lies deepest, runs of a tag over the whole text make spans, so a span cut by one window's edge is
whole. Spans that touch a base span, or that fail the kind's own check (digits, Luhn, parts up to 255), are dropped.

Defined cases: null is empty; offsets are code points, end exclusive; texts of any length are scanned whole; repeated
rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import documents, short_batches

KINDS = ("email", "ip", "card", "phone")
WIDTH, HIDDEN, EMBED, TAGS = 96, 16, 12, 1 + len(KINDS)
STEPS, BATCH, RATE, SEED = 260, 48, 0.02, 7
VOCAB = 130

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Texts with neither hold no span of any kind.
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# ---------------------------------------------------------------- labelled spans


def training_lines(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented lines with the places of what they hold: (text, [(kind, start, end)])."""
    rng = random.Random(seed)
    word = lambda k=0: "".join(rng.choice("etaoinshrdlucmfwygpbvk") for _ in range(k or rng.randint(1, 9)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def email() -> str:
        name = word(rng.randint(3, 8)) + rng.choice(("", "." + digits(2), "_" + word(3), digits(2)))
        host, end = word(rng.randint(3, 8)) + rng.choice(("", digits(1))), rng.choice(("com", "org", "net", "example.com", "co.uk", "de"))
        at = rng.choice(("@", "@", "@", " (at) ", " [at] ", "(at)", "[at]", " @ "))
        return name + at + host + rng.choice((".", ".", ".", " (dot) ", "[dot]", "[.]") if at != "@" else (".", ".", "[.]")) + end

    def card() -> str:
        body = rng.choice("345") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", "", " ", "-", ".", "_", "/"))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        return rng.choice((".", ".", "[.]", " . ", "(.)")).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c, e = digits(3), digits(3), digits(4), str(rng.randint(1, 99))
        return rng.choice((f"+{e} ({a}) {b}-{c}", f"+{e} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{e} {a} {b} {c}", f"+{e}-{a}-{b}-{c}"))

    def plain() -> str:
        return rng.choice((digits(rng.randint(1, 6)), digits(rng.randint(12, 18)), f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 24))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"token = \"{digits(3)}a{digits(4)}f{digits(3)}\"", "@" + word(4), f"{digits(3)},{digits(3)}"))

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH - 12:
            kind = rng.choices(range(6), (1, 1, 1, 1, 1.2, 8))[0]
            item = word() + rng.choice(("", "", "", "", ",", ".")) if kind == 5 else plain() if kind == 4 else (email, ip, card, phone)[kind]()
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + rng.choice((" ", " ", " ", " ", "\n", ", " if kind < 5 else " "))
        cut = rng.randint(0, 24)
        text, spans = text[cut : cut + WIDTH], [(k, max(0, a - cut), min(WIDTH, b - cut)) for k, a, b in spans if b > cut and a < cut + WIDTH]
        out.append((text, spans))
    return out


def codes(text: str) -> np.ndarray:
    """Class of each character: ASCII as it is, other letters 128; 129 is padding."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(x, 128).astype(np.int16)


# ---------------------------------------------------------------- the network


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _run(weights, x):
    """One direction over x (time, batch) of classes. Returns hidden states and what the backward pass needs."""
    emb, wx, wh, b = weights
    table = emb @ wx + b
    steps, n = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = table[x[t]] + h @ wh
        ifo = _sig(g[:, : 3 * HIDDEN])
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, i, f, o = c, ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        c = f * c + i * u
        tc = np.tanh(c)
        kept.append((h, before, i, f, o, u, tc))
        h = o * tc
        hs[t] = h
    return hs, kept


def _back(weights, x, kept, dhs):
    emb, wx, wh, b = weights
    d_table, d_wh = np.zeros((VOCAB, 4 * HIDDEN), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for t in range(len(kept) - 1, -1, -1):
        h, before, i, f, o, u, tc = kept[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        g = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)), axis=1)
        np.add.at(d_table, x[t], g)
        d_wh += h.T @ g
        dh, dc = g @ wh.T, dc * f
    return [d_table @ wx.T, emb.T @ d_table, d_wh, d_table.sum(axis=0)]


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """emissions = [forward state, backward state] W + b; a CRF with a transition for each pair of tags."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * (s[0] ** -0.5)).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        one = lambda: [rng.standard_normal((VOCAB, EMBED)).astype(np.float32) * 0.5, make(EMBED, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN), bias.copy()]
        self.params = [*one(), *one(), make(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x (time, batch) to scores (time, batch, tag)."""
        p = self.params
        ahead, _ = _run(p[:4], x)
        back, _ = _run(p[4:8], x[::-1])
        return np.concatenate((ahead, back[::-1]), axis=2) @ p[8] + p[9]

    def gradients(self, x: np.ndarray, y: np.ndarray):
        p = self.params
        ahead, kept_a = _run(p[:4], x)
        back, kept_b = _run(p[4:8], x[::-1])
        states = np.concatenate((ahead, back[::-1]), axis=2)
        e, tr = states @ p[8] + p[9], p[10]
        steps, n, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + tr[None], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        d_tr = np.zeros_like(tr)
        gold = e[np.arange(steps)[:, None], rows[None], y].sum()
        for t in range(1, steps):
            d_tr += np.exp(alpha[t - 1][:, :, None] + tr[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(d_tr, (y[:-1].ravel(), y[1:].ravel()), -1)
        gold += tr[y[:-1], y[1:]].sum()
        de[np.arange(steps)[:, None], rows[None], y] -= 1
        ds = de @ p[8].T
        grads = [*_back(p[:4], x, kept_a, ds[:, :, :HIDDEN]), *_back(p[4:8], x[::-1], kept_b, ds[::-1, :, HIDDEN:])]
        grads += [np.einsum("tbh,tbk->hk", states, de), de.sum(axis=(0, 1)), d_tr]
        return (z.sum() - gold) / n, [g / n for g in grads]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (time, batch)."""
        e, tr = self.emissions(x), self.params[10]
        steps, n, _ = e.shape
        best, came = e[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            score = best[:, :, None] + tr[None]
            came[t] = score.argmax(axis=1)
            best = e[t] + score.max(axis=1)
        out = np.empty((steps, n), np.int8)
        out[-1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t][rows, out[t]]
        return out


def encode_lines(lines) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((len(lines), WIDTH), 129, np.int64), np.zeros((len(lines), WIDTH), np.int64)
    for i, (text, spans) in enumerate(lines):
        x[i, : len(text)] = codes(text)
        for k, a, b in spans:
            y[i, a:b] = k + 1
    return x, y


@functools.lru_cache(maxsize=1)
def train(steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Adam over composed lines; the same result in every process."""
    x, y = encode_lines(training_lines(steps * BATCH // 4, seed))
    model, rng = Tagger(seed), np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in model.params]
    v = [np.zeros_like(p) for p in model.params]
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(x), BATCH)
        _, grads = model.gradients(x[rows].T, y[rows].T)
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in enumerate(grads):
            g = np.clip(g, -5, 5)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            model.params[k] = (model.params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


# ---------------------------------------------------------------- decoding whole texts

STRIDE = WIDTH // 2


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a trigger; every trigger is in each window that covers its place."""
    found: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found.update(((k - 1) * STRIDE, k * STRIDE) if k else (0,))
        k = (m.end() - 1) // STRIDE
        found.update(((k - 1) * STRIDE, k * STRIDE) if k else (0,))
    return sorted(found)


def accepts(kind: int, span: str) -> bool:
    """The kind's own check of an added span."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(@|[(\[]at[)\]])\s?[\w-]+(\s?(\.|[(\[](dot|\.)[)\]])\s?[\w-]+)+", span))
    if kind == 1:
        parts = re.split(r"\s?[(\[]?\.[)\]]?\s?", span)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ._/-]*[0-9]", span)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"(\+|00)?[0-9(][0-9 ().-]*[0-9]", span)) and 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", span))


def added_spans(text: str, starts: list[int], tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans from decoded windows (one row of tags a window), united over the text."""
    near: dict[int, tuple[int, int]] = {}
    for s, row in zip(starts, tags, strict=True):
        for i in np.flatnonzero(row):
            near.setdefault(s + int(i), (-1, 0))
    # tags of inside characters by the window whose edge is farthest; edges at the text's ends count as far
    n, covered = len(text), {s: row for s, row in zip(starts, tags, strict=True)}
    tag_at: dict[int, int] = {}
    for p in near:
        best, tag = -1, 0
        k = p // STRIDE
        for s in ((k - 1) * STRIDE, k * STRIDE):
            if s in covered:
                left = p - s if s > 0 else WIDTH
                right = s + WIDTH - 1 - p if s + WIDTH < n else WIDTH
                if min(left, right) > best:
                    best, tag = min(left, right), int(covered[s][p - s])
        if tag and p < n:
            tag_at[p] = tag
    out, run = [], []
    for p in [*sorted(tag_at), None]:
        if run and (p is None or p != run[-1] + 1 or tag_at[p] != tag_at[run[0]]):
            a, b, kind = run[0], run[-1] + 1, tag_at[run[0]] - 1
            while a < b and text[a] in " \t\r\n,;:":
                a += 1
            while b > a and text[b - 1] in " \t\r\n,;:.":
                b -= 1
            whole = (a == 0 or not text[a - 1].isalnum()) and (b == n or not text[b].isalnum())
            if whole and b > a and accepts(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                out.append((kind, a, b))
            run = []
        if p is not None:
            run.append(p)
    return out


def find(texts: list, model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t or "") for t in texts]
    starts = [windows_of(t) if t and TRIGGER.search(t) else [] for t in texts]
    jobs = [(i, s) for i, own in enumerate(starts) for s in own]
    tags: dict[int, list] = {}
    for k in range(0, len(jobs), 1024):
        part = jobs[k : k + 1024]
        x = np.full((len(part), WIDTH), 129, np.int64)
        for j, (i, s) in enumerate(part):
            c = codes(texts[i][max(0, s) : s + WIDTH])
            x[j, : len(c)] = c
        for (i, _), row in zip(part, model.decode(x.T).T, strict=True):
            tags.setdefault(i, []).append(row)
    out = []
    for i, t in enumerate(texts):
        more = added_spans(t, starts[i], np.array(tags[i]), base[i]) if i in tags else []
        out.append((base[i], sorted(set(base[i]) | set(more))))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    spark = docs.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast((model or train()).params)

    def run(batches):
        tagger = Tagger()
        tagger.params = held.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for base, spans in find(b.column(1).to_pylist(), tagger):
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[5].append(written(spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
