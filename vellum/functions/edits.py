"""Edits that keep track of offsets, and sequence similarity. No built-in form: Arrow batches go through Python."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CODE = re.compile(r"\b[A-Za-z_][\w.]*\s*=\s*(?:\[[^\]]*\]|[\w.+-]+)")
_PLACEHOLDER = re.compile(r"\{\{[A-Z_0-9]+\}\}")
_CJK = re.compile("[一-鿿㐀-䶿]")
_KEPT = re.compile(r"https?://\S+|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+|\[[0-9,\s–-]+\]|\{\{[A-Z_0-9]+\}\}")


def code_ranges(text: str | None) -> list[tuple[int, int]]:
    """Assignments such as ``lr = 0.1``, left to right, none over another."""
    return [m.span() for m in _CODE.finditer(text or "")]


def style_ranges(text: str | None, phrases: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Places of styled phrases (phrase, style), blanks flexible, each found from the end of the one before."""
    out, at = [], 0
    for phrase, style in phrases:
        pattern = r"\s+".join(map(re.escape, phrase.split()))
        if pattern and (m := re.compile(pattern).search(text or "", at)):
            out.append((*m.span(), style))
            at = m.end()
    return out


def markup(text: str | None, styles: list[tuple[int, int, str]], code: list[tuple[int, int]]) -> str:
    """Ranges to numbered marks, applied from the right: code whole, styles as pairs; a style that cuts into code is left out."""
    out = text or ""
    edits = [(a, b, "CODE") for a, b in code]
    edits += [(a, b, s) for a, b, s in styles if not any(a < y and x < b for x, y in code)]
    numbered, counts = [], {}
    for a, b, s in sorted(edits):
        counts[s] = counts.get(s, 0) + 1
        numbered.append((a, b, s, counts[s]))
    for a, b, s, n in reversed(numbered):
        out = out[:a] + (f"{{{{CODE_{n}}}}}" if s == "CODE" else f"{{{{{s}_{n}}}}}{out[a:b]}{{{{END_{s}_{n}}}}}") + out[b:]
    return out


def split_at(text: str | None, shares: list[float], reach: int = 24) -> list[str]:
    """A text over fragments by their shares, each cut moved to the nearest end of a clause within ``reach``, never into a placeholder."""
    text, out, at, done = text or "", [], 0, 0.0
    held = [m.span() for m in _PLACEHOLDER.finditer(text)]
    total = sum(shares) or 1.0
    for share in shares[:-1]:
        done += share
        goal = round(len(text) * done / total)
        marks = [m.end() for m in re.finditer(r"[。！？；，.!?;,]\s?", text) if abs(m.end() - goal) <= reach and m.end() > at]
        cut = min(marks, key=lambda m: abs(m - goal)) if marks else goal
        for a, b in held:
            if a < cut < b:
                cut = b
        cut = max(at, cut)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def script_gaps(text: str | None) -> list[int]:
    """Offsets where East Asian text meets a run of two or more Latin letters or digits, outside addresses, citations and placeholders."""
    text = text or ""
    kept = [m.span() for m in _KEPT.finditer(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9]{2,}", text):
        for at, other in ((m.start(), m.start() - 1), (m.end(), m.end())):
            if 0 <= other < len(text) and _CJK.match(text[other]) and not any(a < at < b for a, b in kept):
                out.append(at)
    return sorted(set(out))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks, 0 to 1; two empty texts are equal."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)


def template_markup(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([markup(t, [], code_ranges(t)) for t in x])

    return run(text)


def gap_offsets(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([script_gaps(t) for t in x])

    return run(text)


def split_fragments(text: Column, shares: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([split_at(t, list(v)) for t, v in zip(x, s, strict=True)])

    return run(text, shares)
