"""Small measures on strings, maps and JSON: brackets, styles, numbers with units, paths, content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bracket_balance(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.regexp_count(text, F.lit(r"[(\[{]")) - F.regexp_count(text, F.lit(r"[)\]}]"))


def parse_style(style: Column) -> Column:
    """CSS declarations to a map; the last of equal names stands, blanks around names and values go."""
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";"), F.trim), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def points(text: Column) -> Column:
    """The first number of a string; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def path(json: Column, dotted: str) -> Column:
    """A value by dotted path; null where any step is missing."""
    return F.get_json_object(json, "$." + dotted)


def content_id(prefix: str, *fields: Column) -> Column:
    """``prefix`` and 20 hex digits of SHA-256 over the fields, each with its length, so no two lists run together."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))), 256), 1, 20))


def first_present(*values: Column) -> Column:
    """The first that isn't null: absent and zero stay apart."""
    return F.coalesce(*values)


def is_blocked(value: Column) -> Column:
    """Of a layer given as a JSON value: false, a status that blocks, or an object whose flags say so."""
    text = F.lower(F.trim(value))
    flags = [F.get_json_object(value, f"$.{k}") for k in ("blocked", "error")]
    status = F.coalesce(F.get_json_object(value, "$.status"), F.regexp_replace(text, '^"|"$', ""))
    return (text == "false") | F.lower(status).isin("blocked", "fail", "error", "not_run", "missing") | F.coalesce(*(F.when(f == "true", True) for f in flags), F.lit(False)) | (F.get_json_object(value, "$.passed") == "false").eqNullSafe(True)
