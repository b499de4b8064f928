"""Queries over regions of synthetic pages (classes, modes, evidence, sections) and over lives of formulas made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import flow, layout, lifecycle, semantics, synth
from vellum.operators.translation import is_reference
from vellum.plans.text_queries import _long, _t, reference_sql

PAGE = ["doc_id", "page"]


def _regions(spark, sf_dir):
    return synth.regions(_t(spark, sf_dir, "documents"))


def _pages(regions):
    """Pages of 612 by 792; their grids have two columns and a gutter where a right region is."""
    p = regions.groupBy(*PAGE).agg((F.max("column") + 1).alias("grid_columns"), F.bool_or(F.col("column") == 1).alias("has_gutter"))
    return p.select(*PAGE, F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "grid_columns", "has_gutter")


def page_classes(spark, sf_dir):
    r = _regions(spark, sf_dir)
    front = semantics.front_matter(r, _pages(r))
    t = layout.page_class(layout.page_traits(r, _pages(r).join(front, PAGE)))
    return _long(t.groupBy("page_class").agg(F.count("*").alias("n"), F.sum("paragraphs").alias("paragraphs"), F.sum("tables").alias("tables"), F.sum("full_width_tables").alias("full_width_tables"), F.count_if("front_matter").alias("front_matter")))


def density_classes(spark, sf_dir):
    r = _regions(spark, sf_dir).withColumn("semantic_role", F.when(F.col("semantic_role").isNotNull() & (F.col("region") % 11 == 0), "references"))
    return layout.density_class(r).groupBy("density_class").agg(F.count("*").alias("n"))


def semantic_modes(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return semantics.semantic_mode(r, _pages(r)).groupBy("mode").agg(F.count("*").alias("n"))


def grid_evidence(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return semantics.grid_evidence(r, _pages(r))


def grid_modes(spark, sf_dir):
    r = _regions(spark, sf_dir)
    n = r.groupBy(*PAGE).agg(F.count_if((F.col("kind") == "text") & (F.col("column") == 0)).alias("l"), F.count_if((F.col("kind") == "text") & (F.col("column") == 1)).alias("r"))
    mode = semantics.grid_mode(F.lit(0), F.lit(False), F.lit(False), F.col("l"), F.col("r"))
    return n.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def front_matter_pages(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return semantics.front_matter(r, _pages(r)).where("front_matter").select(*PAGE)


def grid_sanity(spark, sf_dir):
    """Tracks from the widest text region of each column; the profile is the document's medians."""
    r = _regions(spark, sf_dir).where("kind = 'text' and column >= 0")
    side = r.groupBy(*PAGE, "column").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    tracks = side.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("tracks"))
    resolved = tracks.select(*PAGE, F.when(F.col("page") % 5 == 4, "invalid").otherwise("valid").alias("local_status"), F.when(F.col("page") % 5 != 4, F.col("tracks")).alias("tracks"))
    width = lambda c: F.median(F.when(F.col("column") == c, F.col("x1") - F.col("x0")))
    profile = side.groupBy("doc_id").agg(width(0).alias("left_width"), width(1).alias("right_width"), F.lit(0.8).alias("ratio_p10"))
    return _long(semantics.grid_sanity(resolved, profile))


def page_evidence(spark, sf_dir):
    r = _regions(spark, sf_dir)
    e = semantics.page_evidence(r, F.col("text").rlike("[0-9]{4}"))
    return e.select(*PAGE, "texts", "headings", "first_heading", F.round("reference_density", 6).alias("reference_density"), F.round("citation_density", 6).alias("citation_density"))


def section_audit(spark, sf_dir):
    """References begin on the third page, at its first region's height."""
    r = _regions(spark, sf_dir)
    states = r.groupBy(*PAGE).agg(F.min("y0").alias("y_")).select(*PAGE, F.when(F.col("page") >= 2, "references").otherwise("normal_body").alias("state"), (F.col("page") > 2).alias("inherited"), F.when(F.col("page") == 2, F.col("y_") + 100).alias("reference_y"))
    return _long(semantics.section_audit(semantics.section_roles(r, states)))


def _lives(spark, sf_dir):
    """Order lines as formulas: counts from their keys."""
    k = F.col("l_partkey")
    n = {"core": k % 7, "owned": k % 5, "segments": k % 4, "assets": k % 3, "placements": k % 2, "source_ink": k % 11, "svg_ink": k % 9, "renderer_one_ink": k % 8, "renderer_two_ink": k % 6, "blank_placements": k % 13 % 2, "crop_placements": k % 17 % 2}
    n |= {"viewbox_crops": (k % 19 == 0).cast("int"), "equation_orphans": (k % 23 == 0).cast("int"), "condition_orphans": 2 * (k % 29 == 0).cast("int"), "embed_missing": (k % 3 == 0).cast("int"), "duplicate_embed": (k % 31 == 0).cast("int"), "renderer_disagreement": (k % 37 == 0).cast("int"), "double_render": (k % 41 == 0).cast("int")}
    n |= {"double_owned": (k % 43 == 0).cast("int"), "svg_missing": (k % 2 == 0).cast("int"), "reattachable": k % 2 == 0, "model_exists": k % 5 != 0, "all_ink": k % 4 != 0}
    l = _t(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ("complete", "orphan", "ownership_error", "incomplete", "incomplete", "incomplete", "incomplete"))), F.col("l_linenumber").cast("int"))
    stage = F.element_at(F.array(*map(F.lit, ("none", "detection", "model", "svg_generation", "embedding", "final_pdf", "svg_generation"))), F.col("l_linenumber").cast("int"))
    return l.select("l_returnflag", *(v.alias(c) for c, v in n.items()), status.alias("status"), stage.alias("stage"))


def model_completeness(spark, sf_dir):
    return lifecycle.completeness(_lives(spark, sf_dir), ["l_returnflag"])


def trace_completeness(spark, sf_dir):
    return lifecycle.trace_completeness(_lives(spark, sf_dir), ["l_returnflag"])


def recovery_policies(spark, sf_dir):
    return lifecycle.recovery_report(_lives(spark, sf_dir), ["l_returnflag"])


def duplicate_causes(spark, sf_dir):
    """Suppliers of an order as formulas that its comment-like key places: expected once, found as often as lines have it."""
    g = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("actual"), F.countDistinct("l_linenumber").alias("lines"))
    r = g.select("l_returnflag", (F.col("l_suppkey") % 2 == 0).alias("inline"), F.col("lines").alias("occurrences"), (F.col("actual") > F.col("lines")).alias("segment_placed_twice"), F.lit(1).alias("expected"), "actual")
    return lifecycle.duplicate_causes(r, ["l_returnflag"])


def adopted_prose(spark, sf_dir):
    words = _t(spark, sf_dir, "conversations").select("role", F.explode(F.split("text", " ")).alias("text"))
    return lifecycle.adopted_prose(words, ["role"])


def text_roles(spark, sf_dir):
    r = _regions(spark, sf_dir).where("kind = 'text'")
    role = T.text_role(F.col("role"), F.col("text"), F.col("text"), F.col("text").rlike("^[A-Z]{3}"), F.lit(None).cast("string"))
    return r.groupBy(role.alias("text_role")).agg(F.count("*").alias("n"), F.sum(F.length(T.model_text(F.col("text")))).cast("bigint").alias("chars"))


def span_scripts(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w")).where("w <> ''")
    return words.groupBy(T.span_script(F.col("w")).alias("script")).agg(F.count("*").alias("n"))


def connective_words(spark, sf_dir):
    c = _t(spark, sf_dir, "documents").select("lang", F.explode(T.connective_tokens(F.col("text"))).alias("word"))
    return c.groupBy("lang", "word").agg(F.count("*").alias("documents"))


def capacity_levels(spark, sf_dir):
    """Lines as paragraphs of their page; a page's columns are free over 300 points each."""
    r = _regions(spark, sf_dir).where("kind = 'text'")
    p = r.select(*PAGE, F.col("region").cast("bigint").alias("ordinal"), F.greatest("column", F.lit(0)).cast("int").alias("column"), T.text_width_em(F.col("text")).alias("em"), F.lit(218.0).alias("width"), F.lit(False).alias("movable"), F.col("semantic_role").isNotNull().alias("reference"))
    i = p.select(*PAGE).distinct().withColumn("column", F.explode(F.array(F.lit(0), F.lit(1)))).select(*PAGE, "column", F.lit(72.0).alias("a"), F.lit(372.0).alias("b"))
    c = flow.resolve_capacity(p, i)
    return c.groupBy("level", "font_scale", "spill_required").agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (page_classes, density_classes, semantic_modes, grid_evidence, grid_modes, front_matter_pages, grid_sanity, page_evidence, section_audit, model_completeness, trace_completeness, recovery_policies, duplicate_causes, adopted_prose, text_roles, span_scripts, connective_words, capacity_levels)}

R = synth.REGIONS_SQL.replace("\\\\", "\\")
_BODY = "(kind = 'text' AND col IN (0, 1) AND role IN ('body', 'list_item'))"
_OWN = "(kind = 'text' AND col IN (0, 1) AND coalesce(semantic_role, role) IN ('body', 'list_item', 'reference_item'))"
_FRONT = f"""bodies AS (SELECT doc_id, page, median(size) AS body_size FROM regions WHERE {_BODY} GROUP BY 1, 2), fronts AS (
  SELECT r.doc_id, r.page, count(*) FILTER (WHERE role = 'heading' AND size >= 1.2 * body_size AND n >= 20) AS titles, count(*) FILTER (WHERE size >= 0.65 * body_size AND n >= 8) AS others
  FROM regions r JOIN bodies b ON r.doc_id = b.doc_id AND r.page = b.page WHERE kind = 'text' AND col = -1 AND y0 < 0.36 * 792 GROUP BY 1, 2
), front AS (SELECT doc_id, page FROM fronts WHERE titles > 0 AND others >= 2)"""
_LIVES = """lives AS (SELECT l_returnflag, l_linenumber AS ln, l_partkey % 7 AS core, l_partkey % 5 AS owned, l_partkey % 4 AS segments, l_partkey % 3 AS assets, l_partkey % 2 AS placements, l_partkey % 11 AS source_ink, l_partkey % 9 AS svg_ink,
  l_partkey % 8 AS one, l_partkey % 6 AS two, l_partkey % 13 % 2 AS blank, l_partkey % 17 % 2 AS crop, l_partkey % 19 = 0 AS viewbox, l_partkey % 23 = 0 AS eq, l_partkey % 29 = 0 AS cond, l_partkey % 3 = 0 AS missing, l_partkey % 31 = 0 AS doubled,
  l_partkey % 37 = 0 AS disagree, l_partkey % 41 = 0 AS twice, l_partkey % 43 = 0 AS owners, l_partkey % 2 = 0 AS even FROM lineitem)"""
_CONNECTIVES = ", ".join(f"'{w}'" for w in T.CONNECTIVES)

_VISIBLE = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{T.STYLE_MARK}', '', 'g'), '{T.OBJECT_MARK}', '□', 'g'), '\\s+', ' ', 'g'))"
_LEVEL = "regexp_extract(v, '^((?:[A-Z]|\\d+)(?:\\.\\d+){0,3})(?:\\s|[㐀-鿿])', 1)"

ORACLE_SQL = {
    "page_classes": f"""WITH {R}, {_FRONT}, t AS (SELECT r.doc_id, r.page, any_value(f.page) IS NOT NULL AS front, count(*) FILTER (WHERE kind = 'text') AS p, count(*) FILTER (WHERE kind = 'text' AND {reference_sql("text")}) AS refs,
        count(*) FILTER (WHERE kind = 'text' AND role = 'heading' AND regexp_matches(text, '{layout.APPENDIX_HEADING}')) AS app, count(*) FILTER (WHERE kind = 'table') AS tb, count(*) FILTER (WHERE kind = 'figure') AS fg, count(*) FILTER (WHERE kind = 'formula') AS fm,
        count(*) FILTER (WHERE kind = 'table' AND width / 612 >= 0.64) AS ft, count(*) FILTER (WHERE kind = 'figure' AND width / 612 >= 0.64) AS ff, count(*) FILTER (WHERE kind = 'text' AND n >= 40 AND col = 0) AS s0, count(*) FILTER (WHERE kind = 'text' AND n >= 40 AND col = 1) AS s1, max(col) + 1 AS gc, bool_or(col = 1) AS gutter
        FROM regions r LEFT JOIN front f ON r.doc_id = f.doc_id AND r.page = f.page GROUP BY 1, 2), c AS (SELECT *, CASE WHEN front THEN 'front_matter_two_column' WHEN refs >= 3 AND (refs / greatest(p, 1) >= 0.48 OR refs >= 7) THEN 'reference_dense' WHEN fg > 0 AND tb + fm + app = 0 AND p <= greatest(4, 2 * fg) THEN 'single_column'
        WHEN ft > 0 THEN 'full_width_table_plus_two_column' WHEN app > 0 THEN 'appendix_dense' WHEN s0 > 0 AND s1 > 0 AND (ff > 0 OR (fg > 0 AND fm > 0)) THEN 'mixed_layout' WHEN (s0 > 0 AND s1 > 0) OR (gutter AND gc = 2) THEN 'standard_two_column' ELSE 'single_column' END AS page_class FROM t)
        SELECT page_class, count(*) AS n, CAST(sum(p) AS BIGINT) AS paragraphs, CAST(sum(tb) AS BIGINT) AS tables, CAST(sum(ft) AS BIGINT) AS full_width_tables, count(*) FILTER (WHERE front) AS front_matter FROM c GROUP BY 1""",
    "text_roles": f"""WITH {R}, v AS (SELECT role, text, {_VISIBLE} AS v FROM regions WHERE kind = 'text'), l AS (SELECT *, {_LEVEL} AS num FROM v)
        SELECT CASE WHEN regexp_matches(v, '{T.REFERENCE_ENTRY.replace("'", "''")}') THEN 'reference' WHEN role = 'caption' THEN 'caption' WHEN role = 'list_item' THEN 'list_item' WHEN role = 'heading' AND v IN ('摘要', 'Abstract') THEN 'abstract_heading'
        WHEN role = 'heading' AND num <> '' AND length(num) - length(replace(num, '.', '')) = 0 THEN 'section_heading' WHEN role = 'heading' AND length(num) - length(replace(num, '.', '')) >= 2 THEN 'subsubsection_heading' WHEN role = 'heading' THEN 'subsection_heading'
        WHEN regexp_matches(text, '^[A-Z]{{3}}') THEN 'body_bold_lead' ELSE 'body' END AS text_role, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars FROM l GROUP BY 1""",
    "density_classes": f"""WITH {R}, c AS (SELECT doc_id, page, count(*) FILTER (WHERE kind = 'formula') AS f, count(*) FILTER (WHERE kind = 'table') AS t, count(*) FILTER (WHERE kind = 'figure') AS g, count(*) FILTER (WHERE semantic_role IS NOT NULL AND region % 11 = 0) AS refs FROM regions GROUP BY 1, 2)
        SELECT CASE WHEN refs > 0 THEN 'reference_dense' WHEN (g > 0 AND f > 0) OR (t > 0 AND f > 0) OR (g > 0 AND t > 0) THEN 'mixed_content' WHEN f >= 8 THEN 'formula_dense' WHEN t >= 2 THEN 'table_dense' WHEN g >= 2 THEN 'figure_dense' WHEN t >= 1 THEN 'table_dense' WHEN f >= 1 THEN 'formula_dense' WHEN g >= 1 THEN 'figure_dense' ELSE 'text_only' END AS density_class, count(*) AS n FROM c GROUP BY 1""",
    "semantic_modes": f"""WITH {R}, m AS (SELECT *, kind = 'text' AND NOT (coalesce(semantic_role, role) = 'heading' AND regexp_matches(text, '^[0-9]+$')) AS meaning FROM regions), c AS (
        SELECT doc_id, page, count(*) FILTER (WHERE meaning) AS nt, count(*) FILTER (WHERE kind IN ('table', 'figure')) AS np, count(*) FILTER (WHERE meaning AND continues) AS na, count(*) FILTER (WHERE meaning AND role <> 'caption' AND n >= 120) AS nl,
          count(*) FILTER (WHERE {_BODY} AND col = 0) AS l, count(*) FILTER (WHERE {_BODY} AND col = 1) AS r, count(*) FILTER (WHERE {_BODY} AND continues) AS ba, median(col_width) FILTER (WHERE {_BODY}) AS track FROM m GROUP BY 1, 2)
        SELECT CASE WHEN np > 0 AND nt <= greatest(4, 2 * np) AND na = 0 AND nl = 0 THEN 'mixed_non_dominant' WHEN l > 0 AND r > 0 THEN 'two_column' WHEN l + r = 0 THEN 'unknown' WHEN ba > 0 OR track <= 0.46 * 612 THEN 'two_column_sparse' ELSE 'single_column' END AS mode, count(*) AS n FROM c GROUP BY 1""",
    "grid_evidence": f"""WITH {R} SELECT doc_id, page, count(*) FILTER (WHERE {_OWN}) AS body_records, CAST(coalesce(sum(n) FILTER (WHERE {_OWN}), 0) AS BIGINT) AS body_characters,
        coalesce(array_to_string(list_sort(list(DISTINCT col) FILTER (WHERE {_OWN})), ','), '') AS body_columns, count(*) FILTER (WHERE kind = 'text' AND NOT {_OWN}) AS excluded_records,
        round(least(1.0::DOUBLE, coalesce(sum(width * 60.0::DOUBLE) FILTER (WHERE kind IN ('table', 'figure', 'display_formula')), 0.0::DOUBLE) / (612.0::DOUBLE * 792.0::DOUBLE)), 4) AS hard_ratio,
        round(least(1.0::DOUBLE, count(*) FILTER (WHERE {_OWN}) / 6.0::DOUBLE) * least(1.0::DOUBLE, coalesce(sum(n) FILTER (WHERE {_OWN}), 0) / 500.0::DOUBLE), 4) AS body_support FROM regions GROUP BY 1, 2""",
    "grid_modes": f"WITH {R}, c AS (SELECT doc_id, page, count(*) FILTER (WHERE kind = 'text' AND col = 0) AS l, count(*) FILTER (WHERE kind = 'text' AND col = 1) AS r FROM regions GROUP BY 1, 2) SELECT CASE WHEN l > 0 AND r > 0 THEN 'two_column' ELSE 'unknown' END AS mode, count(*) AS n FROM c GROUP BY 1",
    "front_matter_pages": f"WITH {R}, {_FRONT} SELECT doc_id, page FROM front",
    "grid_sanity": f"""WITH {R}, side AS (SELECT doc_id, page, col, min(x0) AS a, max(x0 + width) AS b FROM regions WHERE kind = 'text' AND col >= 0 GROUP BY 1, 2, 3), prof AS (SELECT doc_id, coalesce(least(coalesce(median(b - a) FILTER (WHERE col = 0), 0), coalesce(median(b - a) FILTER (WHERE col = 1), 0)), 0) AS e FROM side GROUP BY 1),
        pg AS (SELECT doc_id, page, count(*) AS k, min(b - a) AS lo, max(b - a) AS hi FROM side GROUP BY 1, 2), o AS (SELECT pg.doc_id, count(*) FILTER (WHERE page % 5 <> 4 AND lo <= 0) AS invalid_tracks, count(*) FILTER (WHERE page % 5 <> 4 AND k = 2 AND e > 0 AND lo < 0.55 * e) AS narrow_tracks,
        count(*) FILTER (WHERE page % 5 <> 4 AND k = 2 AND lo / hi < greatest(0.45::DOUBLE, 0.65::DOUBLE * 0.8)) AS asymmetric_pages, count(*) FILTER (WHERE page % 5 = 4) AS unresolved FROM pg JOIN prof ON pg.doc_id = prof.doc_id GROUP BY 1) SELECT *, invalid_tracks + narrow_tracks + asymmetric_pages + unresolved = 0 AS passed FROM o""",
    "page_evidence": f"""WITH {R} SELECT doc_id, page, count(*) AS texts, count(*) FILTER (WHERE role = 'heading') AS headings, arg_min(text, region) FILTER (WHERE role = 'heading') AS first_heading,
        round(count(*) FILTER (WHERE regexp_matches(text, '[0-9]{{4}}')) / count(*), 6) AS reference_density, round(count(*) FILTER (WHERE regexp_matches(text, '^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+')) / count(*), 6) AS citation_density FROM regions WHERE kind = 'text' GROUP BY 1, 2""",
    "section_audit": f"""WITH {R}, tops AS (SELECT doc_id, page, min(y0) + 100 AS y FROM regions GROUP BY 1, 2), s AS (SELECT r.doc_id, r.page, role, semantic_role IS NOT NULL AS written, r.page >= 2 AND (r.page > 2 OR y0 + 30 >= y) AS item FROM regions r JOIN tops t ON r.doc_id = t.doc_id AND r.page = t.page WHERE kind = 'text'),
        f AS (SELECT doc_id, min(page) AS first FROM s WHERE page >= 2 GROUP BY 1) SELECT s.doc_id, max(first) AS reference_start, coalesce(bool_or(page > 2 AND page > first), false) AS goes_on, count(*) FILTER (WHERE item AND NOT written AND role <> 'caption') AS role_gaps, count(*) FILTER (WHERE written AND NOT item) AS orphans,
        CASE WHEN count(*) FILTER (WHERE item AND NOT written AND role <> 'caption') = 0 AND count(*) FILTER (WHERE written AND NOT item) = 0 THEN 'pass' ELSE 'fail' END AS decision FROM s LEFT JOIN f ON s.doc_id = f.doc_id GROUP BY 1""",
    "model_completeness": f"""WITH {_LIVES}, c AS (SELECT l_returnflag, core > 0 AND owned > 0 AND segments > 0 AND assets > 0 AND placements > 0 AS ok, core > 0 AND owned > 0 AND segments > 0 AND (assets = 0 OR placements = 0) AS un FROM lives)
        SELECT l_returnflag, count(*) AS models, count(*) FILTER (WHERE ok) AS complete, count(*) FILTER (WHERE un) AS unrendered, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS decision FROM c GROUP BY 1""",
    "trace_completeness": f"""WITH {_LIVES}, t AS (SELECT l_returnflag, count(*) AS traces, count(*) FILTER (WHERE blank > 0) AS n_blank, count(*) FILTER (WHERE missing) AS n_orphan, count(*) FILTER (WHERE doubled) AS n_duplicate, count(*) FILTER (WHERE disagree) AS n_renderer_disagreement, count(*) FILTER (WHERE twice) AS n_double_render,
        count(*) FILTER (WHERE crop > 0 OR viewbox) AS n_cropped, count(*) FILTER (WHERE missing OR blank > 0) AS n_unrendered, count(*) FILTER (WHERE eq) AS n_equation_orphans, 2 * count(*) FILTER (WHERE cond) AS n_condition_orphans, count(*) FILTER (WHERE source_ink > 0 AND svg_ink = 0) AS n_source_to_svg,
        count(*) FILTER (WHERE svg_ink > 0 AND (blank > 0 OR one = 0 OR two = 0)) AS n_svg_to_page FROM lives GROUP BY 1)
        SELECT *, round((traces - n_unrendered) / traces, 4) AS success_rate, round((traces - n_source_to_svg - n_svg_to_page) / traces, 4) AS ink_recovery, CASE WHEN n_blank + n_orphan + n_duplicate + n_renderer_disagreement + n_double_render + n_cropped + n_unrendered + n_equation_orphans + n_condition_orphans + n_source_to_svg + n_svg_to_page = 0 THEN 'pass' ELSE 'fail' END AS decision FROM t""",
    "recovery_policies": f"""WITH {_LIVES}, p AS (SELECT l_returnflag, CASE WHEN ln = 1 THEN 'none' WHEN owners THEN 'block' WHEN ln IN (2, 3) THEN CASE WHEN even THEN 'readopt' ELSE 'block' END WHEN doubled THEN 'block' WHEN missing AND even THEN 'block' WHEN ln IN (4, 7) AND viewbox THEN 'rebuild'
        WHEN ln IN (4, 7) AND owned <> 0 THEN 'regenerate' WHEN ln IN (5, 6) AND segments <> 0 THEN 'reembed' ELSE 'block' END AS p FROM lives)
        SELECT l_returnflag, count(*) AS traces, count(*) FILTER (WHERE p NOT IN ('none', 'block')) AS automatic, count(*) FILTER (WHERE p = 'block') AS blocked, count(*) FILTER (WHERE p = 'regenerate') AS regenerated, count(*) FILTER (WHERE p = 'reembed') AS reembedded, count(*) FILTER (WHERE p = 'rebuild') AS rebuilt, count(*) FILTER (WHERE p = 'readopt') AS readopted,
        CASE WHEN count(*) FILTER (WHERE p = 'block') > 0 THEN 'blocked' ELSE 'pass' END AS decision FROM p GROUP BY 1""",
    "duplicate_causes": """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS actual, count(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1, 2), c AS (SELECT l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN lines > 1 THEN 'F' ELSE 'A' END WHEN actual > lines THEN 'A' ELSE 'B' END AS c FROM g WHERE actual > 1)
        SELECT l_returnflag, count(*) AS duplicates, count(*) FILTER (WHERE c = 'A') AS cause_a, count(*) FILTER (WHERE c = 'B') AS cause_b, 0 AS cause_c, 0 AS cause_d, 0 AS cause_e, count(*) FILTER (WHERE c = 'F') AS cause_f FROM c GROUP BY 1""",
    "adopted_prose": r"""WITH w AS (SELECT role, unnest(string_split(text, ' ')) AS t FROM conversations), k AS (SELECT role, regexp_matches(trim(t), '^\(\s*\d{1,3}\s*\)$') OR trim(lower(t), ' ,.;:' || chr(10)) IN ('if', 'otherwise', 'where') AS ok FROM w)
        SELECT role, count(*) AS adopted, count(*) FILTER (WHERE ok) AS allowed, count(*) FILTER (WHERE NOT ok) AS prose, bool_and(ok) AS passed FROM k GROUP BY 1""",
    "span_scripts": "WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) SELECT CASE WHEN regexp_matches(w, '[一-鿿㐀-䶿]') THEN CASE WHEN regexp_matches(w, '[A-Za-z0-9]') THEN 'mixed' ELSE 'cjk' END WHEN regexp_matches(w, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(w, '[0-9]') THEN 'number' ELSE 'punct' END AS script, count(*) AS n FROM w WHERE w <> '' GROUP BY 1",
    "connective_words": f"WITH w AS (SELECT lang, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9_\\s''’.-]', ' ', 'g')), '\\s+'), lambda x: x IN ({_CONNECTIVES}))) AS ws FROM documents), e AS (SELECT lang, unnest(ws) AS word FROM w) SELECT lang, word, count(*) AS documents FROM e GROUP BY 1, 2",
}
