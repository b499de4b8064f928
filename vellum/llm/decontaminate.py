"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanning each text once.

Normal form: ASCII letters lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, joined and framed by single
spaces, so a pattern ``" w1 ... w8 "`` can only match whole words. A window is ``window`` consecutive words of an item;
an item of fewer words, but not none, is one window. The automaton holds each distinct window once with the items it
comes from; it is built on the driver from the test table, whose size is checked against ``max_items_bytes``, and is
broadcast.

Defined cases: a null or empty text has no words and no hits; an item with a null text or without words has no window;
repeated items count by item id; an empty test table hits nothing; extra columns are ignored; repeated documents are
scanned like any other row.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import documents, short_batches

WINDOW = 8
#: An item table beyond this is refused rather than broadcast.
MAX_ITEMS_BYTES = 64 << 20
MIN_ITEMS = 2

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
#: A word in the original text, for mapping word numbers back to offsets.
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:int,end:int>>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def build_automaton(items: list[tuple[int, str | None]], window: int = WINDOW):
    """None if no item has a word. Values: (pattern length, its words, the items' ids as strings)."""
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for pattern in windows_of(text, window):
            owners.setdefault(pattern, set()).add(str(item_id))
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, ids in owners.items():
        key = pattern.decode("latin-1")
        automaton.add_word(key, (len(key), key.count(" ") - 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, which words are hit, items that occur."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), np.zeros(len(words), bool), set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(automaton.iter(line))
    hit, items = np.zeros(len(words), bool), set()
    if found:
        starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])])
        for end, (length, n, ids) in found:
            first = int(np.searchsorted(starts, end - length + 2))
            hit[first : first + n] = True
            items.update(ids)
    return len(words), hit, items


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point offsets of the original text."""
    if not hit.any():
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def hold_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_items_bytes: int = MAX_ITEMS_BYTES):
    """The test table as a broadcast, if it is within the bound."""
    items = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total > max_items_bytes:
        raise ValueError(f"the test items hold {total} bytes; max_items_bytes is {max_items_bytes}")
    return items.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in items.collect()])


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = WINDOW, min_items: int = 1, max_items_bytes: int = MAX_ITEMS_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold windows of fewer than ``min_items`` test items."""
    short_batches(docs.sparkSession)
    held = hold_items(items, max_items_bytes=max_items_bytes)
    cache: dict[str, object] = {}

    @F.pandas_udf("int")
    def items_in(texts: pd.Series) -> pd.Series:
        if "a" not in cache:
            cache["a"] = build_automaton(held.value, window)
        return pd.Series([len(scan(t, cache["a"])[2]) for t in texts.tolist()], dtype="int32")

    return docs.where(items_in(F.col(text_col)) < min_items)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_items: int = MIN_ITEMS,
    max_items_bytes: int = MAX_ITEMS_BYTES,
) -> DataFrame:
    """One row per document: words, hit words, items, their digest, whether contaminated, and hit spans in the original."""
    held = hold_items(items, item_id_col, item_text_col, max_items_bytes)
    short_batches(docs.sparkSession)
    cache: dict[str, object] = {}

    def run(batches):
        if "a" not in cache:
            cache["a"] = build_automaton(held.value, window)
        automaton = cache["a"]
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                n, hit, found = scan(text, automaton)
                row = (n, int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= min_items, spans_of(text, hit) if found else [])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, t) for x, t in zip(out, _TYPES, strict=True))], names=_NAMES
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce({}, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.replace("coalesce({}", "coalesce(text")} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS.replace("coalesce({}", "coalesce(text")} AS ws FROM benchmark
), bn AS (
  SELECT item_id, ws, least({WINDOW}, len(ws)) AS n FROM b WHERE len(ws) > 0
), bi AS (
  SELECT item_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM bn
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS w FROM bi
), lengths AS (
  SELECT DISTINCT n FROM bw
), dn AS (
  SELECT d.r, d.ws, l.n FROM d JOIN lengths l ON len(d.ws) >= l.n
), di AS (
  SELECT r, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM dn
), dw AS (
  SELECT r, n, i, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS w FROM di
), hits AS (
  SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(i.n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN places p ON d.r = p.r LEFT JOIN items i ON d.r = i.r
"""
