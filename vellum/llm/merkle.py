"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections. DataFrame functions only.

A paragraph is a line; its hash is SHA-256 of its exact text. A section is a run of paragraphs that ends with a blank
line or with a paragraph whose hash begins with ``4``: a boundary set by content, so an insertion moves no boundary but
its own. A section's hash covers its paragraphs' hashes, the root the sections' hashes: equal texts have
equal roots, and unlike texts unlike ones but for a collision of SHA-256. Below the paragraphs lie phrases, up to
``PHRASE_WORDS`` words of one line that don't go past the end of a sentence, with ``LEAF`` hex digits of their XXH64;
they locate an edit within a long paragraph.

fingerprint = root (32 hex digits), then ``|`` and for each section its 8 hex digits, ``:`` and its leaves end to end.
Likeness of two fingerprints: 1 if equal, else the shared share of leaves, counted as sets, 2|A n B| / (|A| + |B|), 0 if
neither has leaves. ``differing_sections`` gives the branches that differ.

The successor of a document is the next doc_id, after the last the first. Documents are cut into ranges of ids by
quantiles; the first of each range is also sent to the range before it, so each range reads its successors alone and no
task sees all ids.

Defined cases: null text is empty (a root over one empty paragraph, no leaves); equal doc_ids order by text; a null
doc_id comes first; a table of one row is its own successor; an empty table gives no rows; extra columns are ignored;
texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm._common import documents, plan_partitions

PHRASE_WORDS = 8
LEAF = 6
#: Up to seven words that don't end a sentence, then one of any kind, within a line.
PHRASE = r"(?:[^\s]*[^\s.!?][^\S\n]+){0,7}[^\s]+"
ROOT_DIGITS = 32


def _section_ends(paragraph_hash: Column, paragraph: Column) -> Column:
    return (F.trim(paragraph) == "") | paragraph_hash.startswith("4")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a non-null text."""
    leaves = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0)), lambda w: F.substring(F.lpad(F.hex(F.xxhash64(w)), 16, "0"), -LEAF, LEAF)), "")
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.struct(F.sha2(p, 256).alias("h"), p.alias("p")))
    # "hash:LEAVES" and a mark for each paragraph, the leaves in capitals; sections are cut at "/"
    lines = F.array_join(F.transform(hashed, lambda x: F.concat(x["h"], F.lit(":"), leaves(x["p"]), F.when(_section_ends(x["h"], x["p"]), F.lit("/")).otherwise(F.lit(" ")))), "")
    sections = F.filter(F.split(lines, "/"), lambda s: s != "")
    body = F.transform(sections, lambda s: F.struct(F.sha2(F.regexp_replace(s, r":[0-9A-F]*", ""), 256).alias("h"), F.lower(F.regexp_replace(s, r"[0-9a-f]+:| ", "")).alias("l")))
    return F.concat(
        F.substring(F.sha2(F.array_join(F.transform(body, lambda x: x["h"]), ""), 256), 1, ROOT_DIGITS),
        F.array_join(F.transform(body, lambda x: F.concat(F.lit("|"), F.substring(x["h"], 1, 8), F.lit(":"), x["l"])), ""),
    )


def leaf_set(mark: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(mark, r"^[0-9a-f]{32}|\|[0-9a-f]{8}:", ""), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0)))


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """0 to 1, from two fingerprints and their leaf sets."""
    total = F.size(leaves_a) + F.size(leaves_b)
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / total)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of a that b doesn't have: where an edit lies."""
    parts = lambda m: F.slice(F.split(m, r"\|"), 2, F.greatest(F.lit(1), F.size(F.split(m, r"\|"))))
    return F.filter(F.transform(parts(a), lambda s, i: F.when(~F.array_contains(parts(b), s), i)), lambda i: i.isNotNull())


def with_successor(docs: DataFrame, order: list[str], carried: list[str], ranges: int) -> DataFrame:
    """docs plus ``next_<c>`` for each carried column: its value in the next row by ``order`` (the first key a long), after the last the first."""
    key = F.coalesce(F.col(order[0]), F.lit(-(1 << 63)))
    cuts = sorted(set(docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    spark = docs.sparkSession
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    ranged = docs.withColumn("range_", F.size(F.filter(bounds, lambda c: c <= key.cast("double"))))
    firsts = sorted((r["range_"], r["k"]) for r in ranged.groupBy("range_").agg(F.min(key).alias("k")).collect())  # one row a range
    rows = ", ".join(f"({r}, {k}L, {firsts[i - 1][0]})" if k > -(1 << 63) else f"({r}, cast('{k}' as bigint), {firsts[i - 1][0]})" for i, (r, k) in enumerate(firsts)) or "(0, 0L, 0)"
    begins = spark.sql(f"select * from values {rows} as t(of_, first_, before_)")
    own = F.struct(F.col("range_").alias("r"), F.lit(0).alias("guest"))
    placed = ranged.join(F.broadcast(begins), (F.col("range_") == F.col("of_")) & (key == F.col("first_")), "left")
    places = F.when(F.col("before_").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before_").alias("r"), F.lit(1).alias("guest"))))
    sent = placed.withColumn("x_", F.explode(places)).select("*", "x_.r", "x_.guest").drop("x_", "range_", "of_", "first_", "before_")
    w = Window.partitionBy("r").orderBy("guest", *(F.col(c).asc_nulls_first() for c in order))
    return sent.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("guest = 0").drop("r", "guest")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how near they are to each other and to the next document's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("fingerprint", fingerprint(F.col("text")))
    ranges = 2 * plan_partitions(docs.sparkSession)
    following = with_successor(marked, ["doc_id", "text"], ["text", "fingerprint"], ranges)
    edited = following.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) as int)), substring(next_text, 1, cast(floor(n_chars / 4) as int)))")).select(
        "doc_id", "n_chars", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint")
    )
    leaves = edited.select("*", leaf_set(F.col("fingerprint")).alias("a"), leaf_set(F.col("edited_fingerprint")).alias("b"), leaf_set(F.col("next_fingerprint")).alias("c"))
    return leaves.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("a"), F.col("c")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
