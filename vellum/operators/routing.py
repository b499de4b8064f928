"""Density profiles of paragraphs and their routes; protected-token templates and their validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per line of a document's text, with its number from 0."""
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "src"))


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def density_profile(df: DataFrame, src: str = "src") -> DataFrame:
    """df plus the counts and ratios that tell mathematics from prose. Tokens: single letters but a and i, names of
    functions, capitals and mixed forms count as mathematics; hint words and lower-case words as prose."""
    raw = T.strip_placeholders(T.strip_protected(F.col(src)))
    out = df.withColumn("raw_", raw).withColumn("tokens_", F.regexp_extract_all("raw_", F.lit(T.TOKEN), F.lit(0)))
    prose = f"(lower(t) in ('a', 'i') or (length(t) > 1 and lower(t) not in ({_in(T.FUNCTION_WORDS)}) and (lower(t) in ({_in(T.PROSE_WORDS)}) or t = lower(t))))"
    function = f"(length(t) > 1 and lower(t) in ({_in(T.FUNCTION_WORDS)}))"
    # most texts hold no such character at all; a few ranges tell
    some = F.col("raw_").rlike(T.MAY_BE_MATH)
    marks = {k: F.when(some, T.count_of(F.col("raw_"), v)).otherwise(0) for k, v in (("math_symbol_count", T.MATH_SYMBOLS), ("relation_operator_count", T.COUNTED_RELATIONS), ("greek_count", T.GREEK))}
    placeholders = [F.regexp_extract_all(F.col(src), F.lit(p), F.lit(0)) for p in (T.FORMULA, T.PROTECTED)]
    chars = lambda a: F.length(F.array_join(a, ""))
    out = out.withColumns(
        {
            "prose_": F.expr(f"filter(tokens_, t -> {prose})"),
            "functions_": F.expr(f"filter(tokens_, t -> {function})"),
            **marks,
            "digits_": F.regexp_count("raw_", F.lit("[0-9]")),
            "formula_placeholder_count": F.size(placeholders[0]),
            "placeholder_chars_": chars(placeholders[0]) + chars(placeholders[1]),
        }
    )
    source = F.greatest(F.length(src), F.lit(1))
    out = out.withColumns(
        {
            "source_char_count": source,
            "prose_char_count": chars(F.col("prose_")),
            "math_char_count": chars(F.col("tokens_")) - chars(F.col("prose_")) + F.col("math_symbol_count") + F.col("greek_count") + F.col("digits_") + F.col("placeholder_chars_"),
            "latin_identifier_count": F.size("tokens_") - F.size("prose_") - F.size("functions_"),
            "numeric_token_count": F.regexp_count("raw_", F.lit(T.NUMBER)),
            "has_equation_reference": F.col("raw_").rlike(r"\([0-9]{1,3}\)|(?i)eq\.?\s*\(?[0-9]"),
        }
    )
    return out.withColumns({"prose_ratio": F.col("prose_char_count") / source, "math_ratio": F.col("math_char_count") / source}).drop("raw_", "tokens_", "prose_", "functions_", "digits_", "placeholder_chars_")


def has_math() -> Column:
    return (F.col("formula_placeholder_count") > 0) | (F.col("math_symbol_count") > 0) | (F.col("relation_operator_count") > 0) | (F.col("latin_identifier_count") > 0) | (F.col("greek_count") > 0)


def route(dense_ratio: float = 0.30) -> Column:
    """Of a profile: nothing to translate, ordinary, protected or dense."""
    return (
        F.when((F.col("prose_char_count") == 0) & has_math(), "NON_TRANSLATABLE_MATH")
        .when(~has_math(), "NORMAL")
        .when(F.col("math_ratio") < dense_ratio, "MATH_PROTECTED")
        .otherwise("MATH_DENSE")
    )


def action(route_col: Column) -> Column:
    """What the plan does with a route."""
    return F.when(route_col == "NON_TRANSLATABLE_MATH", "keep").when(route_col == "NORMAL", "translate").otherwise("protect_and_translate")


def classify_paragraphs(docs: DataFrame) -> DataFrame:
    return density_profile(paragraphs(docs)).withColumn("route", route())


def route_distribution(docs: DataFrame) -> DataFrame:
    """Paragraphs and characters by source and route."""
    return classify_paragraphs(docs).groupBy("source", "route").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("src")).cast("bigint").alias("n_chars"))


# ------------------------------------------------------------- templates

#: Atoms that must not be translated: functions and letters before a bracket, Greek, sub- and superscripted names, relations with their sides.
_ATOM = re.compile(
    r"\{\{[A-Z_0-9]+\}\}"
    r"|(?<![A-Za-z])(?:" + "|".join(sorted(T.FUNCTION_WORDS, key=len, reverse=True)) + r")(?=\()"
    r"|(?<![A-Za-z])[A-Za-zα-ωΑ-Ω](?:_[\w]+)(?=\(|\b)"
    r"|(?<![A-Za-z])[a-z](?=\()"
    r"|(?<![A-Za-z])[A-Z](?=[\s();,=]|$)"
    r"|[α-ωΑ-Ω]"
)


def protect(text: str | None) -> tuple[str, dict[str, str]]:
    """(template, token to original). Tokens are numbered from 001; placeholders already there stay as they are."""
    mapping: dict[str, str] = {}

    def token(m: re.Match) -> str:
        if m.group().startswith("{{"):
            return m.group()
        name = f"{{{{MATH_TOKEN_{len(mapping) + 1:03d}}}}}"
        mapping[name] = m.group()
        return name

    return _ATOM.sub(token, text or ""), mapping


def with_template(df: DataFrame, src: str = "src") -> DataFrame:
    """df plus ``template`` and ``mapping``. Numbered replacement has no built-in form, so Arrow batches go through Python."""

    @F.pandas_udf("template string, mapping map<string,string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([protect(t) for t in texts], columns=["template", "mapping"])

    return df.withColumn("t_", run(F.col(src))).select("*", "t_.template", "t_.mapping").drop("t_")


def restore(template: Column, mapping: Column) -> Column:
    """Tokens back to what they stood for."""
    return F.aggregate(F.map_entries(mapping), template, lambda s, e: F.replace(s, e["key"], e["value"]))


def validate(df: DataFrame, source: str = "source_text", mapping: str = "mapping", output: str = "protected_output", restored: str = "restored") -> DataFrame:
    """df plus ``valid``: every token of the mapping is in the output once, in order, none is left after restoring, and
    the target script is there."""
    tokens = F.array_sort(F.map_keys(mapping))
    found = F.regexp_extract_all(F.col(output), F.lit(r"\{\{MATH_TOKEN_[0-9]+\}\}"), F.lit(0))
    left = F.col(restored).rlike(r"\{\{MATH_TOKEN_[0-9]+\}\}")
    kept = F.forall(F.map_values(mapping), lambda v: F.contains(F.col(restored), v))
    return df.withColumn("valid", (found == tokens) & ~left & kept & T.has_cjk(F.col(restored)))
