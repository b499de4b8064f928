"""Queries over texts: routes, roles, scripts, status, cache, templates, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import routing, sequence, stats, translation


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if k == "int" else F.col(c) for c, k in df.dtypes))


PARAGRAPHS = """parts AS (
  SELECT doc_id, source, lang, string_split(text, chr(10)) AS ps FROM documents
), numbered AS (
  SELECT doc_id, source, lang, unnest(range(len(ps))) AS pos, ps FROM parts
), paragraphs AS (
  SELECT doc_id, source, lang, pos, ps[pos + 1] AS src FROM numbered
)"""
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
PROSE_SQL = f"(lower(t) IN ('a', 'i') OR (length(t) > 1 AND lower(t) NOT IN ({_quoted(T.FUNCTION_WORDS)}) AND (lower(t) IN ({_quoted(T.PROSE_WORDS)}) OR t = lower(t))))"
PROFILE = f"""{PARAGRAPHS}, raw AS (
  SELECT *, regexp_replace(src, '\\{{\\{{[A-Z_0-9]+\\}}\\}}', ' ', 'g') AS raw FROM paragraphs
), tokens AS (
  SELECT *, regexp_extract_all(raw, '[A-Za-z][A-Za-z0-9_.\\-]*') AS toks FROM raw
), counted AS (
  SELECT doc_id, source, pos, src, greatest(length(src), 1) AS source_char_count,
    length(array_to_string(list_filter(toks, lambda t: {PROSE_SQL}), '')) AS prose_char_count,
    length(array_to_string(list_filter(toks, lambda t: NOT {PROSE_SQL}), '')) + len(regexp_extract_all(raw, '[{T.MATH_SYMBOLS}{T.GREEK}0-9]')) AS math_char_count,
    len(list_filter(toks, lambda t: NOT {PROSE_SQL} AND NOT (length(t) > 1 AND lower(t) IN ({_quoted(T.FUNCTION_WORDS)})))) AS latin_identifier_count,
    len(regexp_extract_all(raw, '[{T.MATH_SYMBOLS}]')) AS math_symbol_count,
    len(regexp_extract_all(raw, '[{T.COUNTED_RELATIONS}]')) AS relation_operator_count,
    len(regexp_extract_all(raw, '[{T.GREEK}]')) AS greek_count,
    len(regexp_extract_all(raw, '[0-9]+(?:\\.[0-9]+)?(?:e[+-]?[0-9]+)?')) AS numeric_token_count
  FROM tokens
), routed AS (
  SELECT *, CASE
    WHEN prose_char_count = 0 AND math_symbol_count + relation_operator_count + latin_identifier_count + greek_count > 0 THEN 'NON_TRANSLATABLE_MATH'
    WHEN math_symbol_count + relation_operator_count + latin_identifier_count + greek_count = 0 THEN 'NORMAL'
    WHEN math_char_count / CAST(source_char_count AS DOUBLE) < 0.30 THEN 'MATH_PROTECTED' ELSE 'MATH_DENSE' END AS route
  FROM counted
)"""


def route_distribution(spark, sf_dir):
    return routing.route_distribution(_t(spark, sf_dir, "documents"))


def density_profile(spark, sf_dir):
    p = routing.classify_paragraphs(_t(spark, sf_dir, "documents"))
    return _long(p.select("doc_id", "pos", "source_char_count", "prose_char_count", "math_char_count", "latin_identifier_count", "math_symbol_count", "relation_operator_count", "greek_count", "numeric_token_count", "route"))


def route_plan(spark, sf_dir):
    p = routing.classify_paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy(routing.action(F.col("route")).alias("action")).agg(F.count("*").alias("n"), F.sum("prose_char_count").cast("bigint").alias("prose_chars"))


def script_profile(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy("source", T.script_of(F.col("src")).alias("script")).agg(F.count("*").alias("n"))


def style_roles(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    role = T.style_role(F.col("src"), F.when(F.col("pos") == 0, 12.0).otherwise(10.0), F.lit(10.0), F.lit(False))
    return p.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("src")).cast("bigint").alias("n_chars"))


def heading_numbers(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents")).where(F.col("src").rlike(r"^\s*([A-Z]|[0-9]+)(\.[0-9]+)*\.?\s"))
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.heading_level(F.col("src")).cast("bigint").alias("level"), T.heading_prefix(F.col("src")).alias("prefix"))


def content_kinds(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "[ \n]")).alias("w"))
    return words.groupBy("source", T.content_kind(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


def residual_text(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy("source").agg(F.count_if(T.residual_english(F.col("src"))).alias("residual"), F.count("*").alias("paragraphs"))


def text_extent(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy("doc_id").agg(F.round(F.sum(T.text_width_em(F.col("src"))), 4).alias("width_em"), F.round(F.sum(T.paragraph_height(F.col("src"), F.lit(10.0), F.lit(218.0))), 4).alias("height"))


def reference_items(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    return p.groupBy("source").agg(F.count_if(translation.is_reference(F.col("src"))).alias("references"), F.count("*").alias("paragraphs"))


def unchanged_items(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count_if(translation.unchanged_allowed(F.lit("paragraph"), F.col("text"))).alias("allowed"), F.count("*").alias("items"))


def _items(spark, sf_dir):
    """All paragraphs as items; the cache holds, in capitals, those that occur in two documents or more, and prose that ends in a question mark verbatim."""
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    items = p.select("doc_id", "pos", "source", F.lit("paragraph").alias("kind"), F.col("src").alias("source_text"), F.sha2("src", 256).alias("key"))
    shared = items.groupBy("key", "source_text").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 2")
    return items, shared.select("key", F.when(F.length("source_text") % 2 == 0, F.col("source_text")).otherwise(F.concat(F.lit("T: "), F.upper("source_text"))).alias("translation"))


def translation_cache(spark, sf_dir):
    items, cache = _items(spark, sf_dir)
    return translation.cache_audit(translation.lookup(items, cache), ["source"])


def translation_status(spark, sf_dir):
    items, cache = _items(spark, sf_dir)
    looked = translation.lookup(items, cache)
    done = looked.withColumn("status", translation.status(F.col("kind"), F.col("source_text"), F.col("cached"), F.lit(False))).withColumn("is_reference", F.lit(False))
    return translation.coverage(done, ["source"]).select("source", F.col("translatable_chars").cast("bigint").alias("translatable_chars"), "body_items", "n_translated", "n_unchanged_allowed", "n_unchanged_rejected", "n_fallback_source", F.col("covered_chars").cast("bigint").alias("covered_chars"), "coverage", "gate_passed")


def templates(spark, sf_dir):
    p = routing.with_template(routing.paragraphs(_t(spark, sf_dir, "documents")))
    back = routing.restore(F.col("template"), F.col("mapping"))
    return p.groupBy("source").agg(F.sum(F.size("mapping")).cast("bigint").alias("tokens"), F.count_if(back == F.col("src")).alias("restored"), F.count("*").alias("paragraphs"))


def word_recall(spark, sf_dir):
    word = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    r = stats.multiset_recall(word(_t(spark, sf_dir, "benchmark")), word(_t(spark, sf_dir, "documents")), "w")
    return r.select(F.col("expected").cast("bigint").alias("expected"), F.col("matched").cast("bigint").alias("matched"), "recall")


def repeated_words(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.repeated_words(F.col("text")), ",").alias("words"))


def stitched_units(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents")).withColumn("before", F.expr("lag(src) over (partition by doc_id order by pos)"))
    linked = ~F.col("before").rlike("[.!?]$") & F.col("src").rlike("^[a-z]")
    s = sequence.stitch(p, ["doc_id"], ["pos"], linked)
    return s.groupBy("doc_id").agg(F.max("unit").cast("bigint").alias("units"), F.count("*").alias("paragraphs"))


def joined_lines(spark, sf_dir):
    p = routing.paragraphs(_t(spark, sf_dir, "documents")).withColumn("after", F.expr("lead(src) over (partition by doc_id order by pos)")).where("after is not null")
    return p.groupBy("doc_id").agg(F.sum(F.length(T.join_lines(F.col("src"), F.col("after")))).cast("bigint").alias("joined_chars"))


def html_structure(spark, sf_dir):
    tags = {k: rf"<{k}[ >]" for k in ("h1", "p", "li", "a", "script", "div", "nav", "article")}
    return _t(spark, sf_dir, "pages").select("page_id", *(F.regexp_count("html", F.lit(p)).cast("bigint").alias(f"n_{k}") for k, p in tags.items()))


def conversation_states(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    pages = c.select("conv_id", "turn", F.when(F.col("role") == "system", "Appendix A").otherwise("").alias("heading"), (F.col("role") == "user").alias("numbered_section"), F.when(F.length("text") > 200, 0.7).otherwise(0.1).alias("reference_density"))
    return sequence.document_states(pages, "conv_id", "turn").groupBy("state", "inherited").agg(F.count("*").alias("n"))


def reference_density(spark, sf_dir):
    """Document states with the density as the share of long words, so every event kind but headings occurs."""
    p = routing.paragraphs(_t(spark, sf_dir, "documents"))
    words = F.regexp_count("src", F.lit("[^ ]+"))
    pages = p.select("doc_id", "pos", F.lit("").alias("heading"), F.col("src").rlike("^[0-9]+[.] ").alias("numbered_section"), F.when(words > 0, F.regexp_count("src", F.lit("[^ ]{7,}")) / words).otherwise(0.0).alias("reference_density"))
    return sequence.document_states(pages, "doc_id", "pos").groupBy("doc_id").agg(F.count_if(F.col("state") == "references").alias("in_references"), F.count_if("inherited").alias("n_inherited"))


def reference_sql(column: str) -> str:
    """The rule of ``translation.is_reference`` in SQL."""
    quoted = lambda p: p.replace("'", "''")
    text = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    opening = f"CASE WHEN regexp_extract({text}, '{quoted(translation.AUTHORS)}') <> '' THEN regexp_extract({text}, '{quoted(translation.AUTHORS)}') ELSE regexp_extract({text}, '{quoted(translation.AUTHOR_LINE)}') END"
    rest = f"regexp_replace(substring({text}, length({opening}) + 1), '^\\s+', '')"
    window = f"array_to_string(list_slice(regexp_split_to_array({rest}, '\\s+'), 1, 30), ' ')"
    return f"({opening} <> '' AND (regexp_matches({window}, '{translation.YEAR}') OR regexp_matches({rest}, '^[A-Za-z]+\\.\\s') OR regexp_matches({window}, '{translation.REFERENCE_WORDS}')))"


QUERIES = {f.__name__: f for f in (route_distribution, density_profile, route_plan, script_profile, style_roles, heading_numbers, content_kinds, residual_text, text_extent, reference_items, unchanged_items, translation_cache, translation_status, templates, word_recall, repeated_words, stitched_units, joined_lines, html_structure, conversation_states, reference_density)}

_ITEMS = f"""{PARAGRAPHS}, items AS (
  SELECT doc_id, source, src FROM paragraphs
), cache AS (
  SELECT src AS k, CASE WHEN length(src) % 2 = 0 THEN src ELSE 'T: ' || upper(src) END AS translation
  FROM items GROUP BY src HAVING count(DISTINCT doc_id) >= 2
), tested AS (
  SELECT *, regexp_extract_all(src, '[A-Za-z][A-Za-z0-9_.\\-]*|[0-9]+') AS toks,
    trim(src) AS s FROM items
), judged AS (
  SELECT *, (s = '' OR (len(toks) > 0 AND len(toks) <= 4 AND len(list_filter(toks, lambda t: NOT (regexp_matches(t, '^[0-9]+$') OR (t = upper(t) AND regexp_matches(t, '[A-Z]')) OR regexp_matches(t, '[a-z][A-Z]|[0-9_.\\-]')))) = 0)
    OR regexp_matches(s, '[一-鿿㐀-䶿]') OR regexp_matches(s, '(?i)^https?://\\S+$') OR regexp_matches(s, '(?i)^doi:\\s*\\S+$') OR regexp_matches(s, '^[0-9]+(?:[.,][0-9]+)*$')
    OR regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR regexp_matches(s, '^[A-Za-z][A-Za-z0-9_.\\-]+$') OR regexp_matches(s, '^[A-Z][A-Za-z''’.\\-]*(?:\\s+[A-Z][A-Za-z''’.\\-]*)+$')
    OR regexp_matches(s, '^[A-Za-z]+(?:,[A-Za-z]+)*\\s+et\\s+al\\.$') OR regexp_matches(s, '^[A-Za-z][A-Za-z0-9\\-]*\\s*=\\s*[0-9]+(?:[.,][0-9]+)?$')) AS allowed FROM tested
), looked AS (
  SELECT j.*, c.translation, c.k IS NOT NULL AS hit,
    lower(regexp_replace(regexp_replace(j.src, '\\{{\\{{[A-Z_0-9]+\\}}\\}}', ' ', 'g'), '\\s+', '', 'g')) = lower(regexp_replace(regexp_replace(c.translation, '\\{{\\{{[A-Z_0-9]+\\}}\\}}', ' ', 'g'), '\\s+', '', 'g')) AS same
  FROM judged j LEFT JOIN cache c ON j.src = c.k
)"""

ORACLE_SQL = {
    "reference_items": f"WITH {PARAGRAPHS} SELECT source, count(*) FILTER (WHERE {reference_sql('src')}) AS \"references\", count(*) AS paragraphs FROM paragraphs GROUP BY 1",
    "route_distribution": f"WITH {PROFILE} SELECT source, route, count(*) AS n_paragraphs, CAST(sum(length(src)) AS BIGINT) AS n_chars FROM routed GROUP BY 1, 2",
    "density_profile": f"WITH {PROFILE} SELECT doc_id, pos, source_char_count, prose_char_count, math_char_count, latin_identifier_count, math_symbol_count, relation_operator_count, greek_count, numeric_token_count, route FROM routed",
    "route_plan": f"WITH {PROFILE} SELECT CASE route WHEN 'NON_TRANSLATABLE_MATH' THEN 'keep' WHEN 'NORMAL' THEN 'translate' ELSE 'protect_and_translate' END AS action, count(*) AS n, CAST(sum(prose_char_count) AS BIGINT) AS prose_chars FROM routed GROUP BY 1",
    "script_profile": f"WITH {PARAGRAPHS} SELECT source, CASE WHEN regexp_matches(src, '[一-鿿㐀-䶿]') AND regexp_matches(src, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(src, '[一-鿿㐀-䶿]') THEN 'cjk' WHEN regexp_matches(src, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(src, '[0-9]') THEN 'number' ELSE 'other' END AS script, count(*) AS n FROM paragraphs GROUP BY 1, 2",
    "style_roles": f"""WITH {PARAGRAPHS} SELECT CASE WHEN regexp_matches(trim(src), '^(?:[•‣▪◦*-]\\s|\\(?[0-9]{{1,2}}[.)]\\s)') THEN 'list_item' WHEN regexp_matches(trim(src), '^(?:Figure|Fig\\.|Table)\\s*[0-9]+') THEN 'caption'
        WHEN regexp_matches(trim(src), '^(?:[0-9]+|[A-Z])(?:\\.[0-9]+)*\\.?\\s+[A-Z]') AND length(trim(src)) <= 90 THEN 'heading' WHEN pos = 0 THEN 'heading' ELSE 'body' END AS role, count(*) AS n, CAST(sum(length(src)) AS BIGINT) AS n_chars FROM paragraphs GROUP BY 1""",
    "heading_numbers": f"""WITH {PARAGRAPHS} SELECT doc_id, pos, least(3, 1 + length(regexp_extract(src, '^\\s*((?:[A-Z]|[0-9]+)(?:\\.[0-9]+)*)\\.?\\s', 1)) - length(replace(regexp_extract(src, '^\\s*((?:[A-Z]|[0-9]+)(?:\\.[0-9]+)*)\\.?\\s', 1), '.', ''))) AS level,
        regexp_extract(src, '^\\s*((?:[A-Z]\\.)?[0-9]+(?:\\.[0-9]+)*|[A-Z]\\.[0-9]+)', 1) AS prefix FROM paragraphs WHERE regexp_matches(src, '^\\s*([A-Z]|[0-9]+)(\\.[0-9]+)*\\.?\\s')""",
    "content_kinds": """WITH w AS (SELECT source, unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) SELECT source, CASE WHEN trim(w) = '' THEN 'empty' WHEN regexp_matches(trim(w), '^[+-]?[0-9]+(?:[.,][0-9]+)*\\s*%$') THEN 'percent' WHEN regexp_matches(trim(w), '^[+-]?[0-9]+(?:[.,][0-9]+)*$') THEN 'numeric' ELSE 'text' END AS kind, count(*) AS n FROM w GROUP BY 1, 2""",
    "residual_text": f"WITH {PARAGRAPHS} SELECT source, count(*) FILTER (WHERE regexp_matches(src, '[A-Za-z]{{20,}}|(?:[A-Za-z]+\\s+){{3,}}[A-Za-z]+')) AS residual, count(*) AS paragraphs FROM paragraphs GROUP BY 1",
    "text_extent": f"""WITH {PARAGRAPHS}, m AS (SELECT doc_id, len(regexp_extract_all(src, '\\s')) AS b, len(regexp_extract_all(src, '[⺀-￿]')) AS w, length(src) AS n FROM paragraphs), e AS (SELECT doc_id, b * 0.25::DOUBLE + w * 1.0::DOUBLE + (n - b - w) * 0.55::DOUBLE AS em FROM m),
        l AS (SELECT doc_id, em, greatest(1, ceil(em / greatest(1.0::DOUBLE, 218.0::DOUBLE / 10.0::DOUBLE))) AS lines FROM e) SELECT doc_id, round(sum(em), 4) AS width_em, round(sum((lines + CASE WHEN lines >= 4 THEN 1 ELSE 0 END) * 15.0::DOUBLE), 4) AS height FROM l GROUP BY 1""",
    "translation_cache": f"""WITH {_ITEMS}, a AS (SELECT source, count(*) AS items, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit AND same AND length(src) >= 8 AND NOT allowed) AS invalidated FROM looked GROUP BY 1)
        SELECT source, items, hits, misses, invalidated, hits - invalidated AS usable, hits + misses = items AS closes, misses / CAST(items AS DOUBLE) > 0.2 AS large_miss_warning FROM a""",
    "translation_status": f"""WITH {_ITEMS}, st AS (SELECT source, length(src) AS n, CASE WHEN coalesce(translation, '') = '' THEN CASE WHEN allowed THEN 'unchanged_allowed' ELSE 'fallback_source' END WHEN same THEN CASE WHEN allowed THEN 'unchanged_allowed' ELSE 'unchanged_rejected' END ELSE 'translated' END AS status FROM looked)
        SELECT source, CAST(sum(n) AS BIGINT) AS translatable_chars, count(*) AS body_items, count(*) FILTER (WHERE status = 'translated') AS n_translated, count(*) FILTER (WHERE status = 'unchanged_allowed') AS n_unchanged_allowed,
        count(*) FILTER (WHERE status = 'unchanged_rejected') AS n_unchanged_rejected, count(*) FILTER (WHERE status = 'fallback_source') AS n_fallback_source,
        CAST(coalesce(sum(n) FILTER (WHERE status IN ('translated', 'unchanged_allowed')), 0) AS BIGINT) AS covered_chars, coalesce(sum(n) FILTER (WHERE status IN ('translated', 'unchanged_allowed')), 0) / CAST(sum(n) AS DOUBLE) AS coverage,
        count(*) FILTER (WHERE status IN ('unchanged_rejected', 'fallback_source')) = 0 AS gate_passed FROM st GROUP BY 1""",
    "word_recall": """WITH e AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY 1), f AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1)
        SELECT CAST(sum(e.n) AS BIGINT) AS expected, CAST(sum(least(e.n, coalesce(f.n, 0))) AS BIGINT) AS matched, CAST(sum(least(e.n, coalesce(f.n, 0))) AS DOUBLE) / CAST(sum(e.n) AS DOUBLE) AS recall FROM e LEFT JOIN f ON e.w = f.w""",
    "repeated_words": """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark), r AS (SELECT item_id, w FROM w GROUP BY 1, 2 HAVING count(*) >= 2), g AS (SELECT item_id, string_agg(w, ',' ORDER BY w) AS words FROM r GROUP BY 1)
        SELECT b.item_id, coalesce(g.words, '') AS words FROM benchmark b LEFT JOIN g ON b.item_id = g.item_id""",
    "stitched_units": f"""WITH {PARAGRAPHS}, l AS (SELECT doc_id, pos, src, lag(src) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM paragraphs) SELECT doc_id, count(*) FILTER (WHERE before IS NULL OR NOT (NOT regexp_matches(before, '[.!?]$') AND regexp_matches(src, '^[a-z]'))) AS units, count(*) AS paragraphs FROM l GROUP BY 1""",
    "joined_lines": f"""WITH {PARAGRAPHS}, l AS (SELECT doc_id, src, lead(src) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM paragraphs) SELECT doc_id, CAST(sum(CASE WHEN src = '' OR after = '' THEN length(src) + length(after) WHEN regexp_matches(src, '[a-z]{{2}}-$') AND regexp_matches(after, '^[a-z]') THEN length(src) - 1 + length(after)
        WHEN regexp_matches(src, '[A-Za-z0-9]-$') THEN length(src) + length(after) ELSE length(src) + 1 + length(after) END) AS BIGINT) AS joined_chars FROM l WHERE after IS NOT NULL GROUP BY 1""",
    "html_structure": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{k}[ >]')) AS n_{k}" for k in ("h1", "p", "li", "a", "script", "div", "nav", "article")) + " FROM pages",
    "conversation_states": """WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'appendix' WHEN role = 'user' THEN 'normal_body' WHEN length(text) > 200 THEN 'references' END AS ev FROM conversations),
        s AS (SELECT coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal_body') AS state, ev IS NULL AS inherited FROM e) SELECT state, inherited, count(*) AS n FROM s GROUP BY 1, 2""",
    "unchanged_items": """WITH t AS (SELECT role, trim(text) AS s, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.\\-]*|[0-9]+') AS toks FROM conversations) SELECT role, count(*) FILTER (WHERE s = '' OR (len(toks) > 0 AND len(toks) <= 4 AND len(list_filter(toks, lambda t: NOT (regexp_matches(t, '^[0-9]+$') OR (t = upper(t) AND regexp_matches(t, '[A-Z]')) OR regexp_matches(t, '[a-z][A-Z]|[0-9_.\\-]')))) = 0)
        OR regexp_matches(s, '(?i)^https?://\\S+$') OR regexp_matches(s, '^[0-9]+(?:[.,][0-9]+)*$') OR regexp_matches(s, '^[A-Za-z][A-Za-z0-9_.\\-]+$') OR regexp_matches(s, '^[A-Z][A-Za-z''’.\\-]*(?:\\s+[A-Z][A-Za-z''’.\\-]*)+$')) AS allowed, count(*) AS items FROM t GROUP BY 1""",
    "reference_density": f"""WITH {PARAGRAPHS}, d AS (SELECT doc_id, pos, regexp_matches(src, '^[0-9]+[.] ') AS num, len(regexp_extract_all(src, '[^ ]+')) AS w, len(regexp_extract_all(src, '[^ ]{{7,}}')) AS l FROM paragraphs), e AS (SELECT doc_id, pos, CASE WHEN num THEN 'normal_body' WHEN w > 0 AND l / CAST(w AS DOUBLE) >= 0.6 THEN 'references' END AS ev FROM d),
        s AS (SELECT doc_id, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal_body') AS state, ev IS NULL AS inherited FROM e) SELECT doc_id, count(*) FILTER (WHERE state = 'references') AS in_references, count(*) FILTER (WHERE inherited) AS n_inherited FROM s GROUP BY 1""",
}
