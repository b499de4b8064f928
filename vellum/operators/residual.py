"""What is left of the source language in rendered text: rendered spans given back to regions, by place and then by content, and
the words of a source that survive in runs without East Asian characters."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import rounds, sweep

PAGE = ["doc_id", "page"]

# Names that may stay in the source language, identifiers of models, addresses, citations.
PROTECTED_NAMES = (
    r"(?i)\b(?:LLM|LLMs|AutoSurvey|SurveyEval|DeepSeek-R1|DeepSeek|GPT|RAG|NLP|BERT|Transformer|arXiv|DOI|Wang|Liu|Zhang|Li|Chen|He|Zhou|Bai|Min|Fu|Ren|Shi|Gu|Hu|Jiang|Lu|Shao|Wu|Xu|Yu|Zhao|Zhu|Krishna|"
    r"SurveyEval|IB|CLAIM|SOURCE|Test-Time|Table|Figure|Fig\.?|Eq\.?|Section|Appendix|References|Limitations|Conclusion|Introduction|Abstract|Algorithm|Model|Dataset|Density|Faithfulness|Relevance|"
    r"Language|Criticism|Structure|Content|Coverage|InfoDensity|self_refine|top_k|nomic|best_of|convolution|entropy|digest|AutoSurvey|overview|Qwen|Qwen2\.5|Mistral|Llama|Gemma|T5|BART|"
    r"Pegasus|Long-form|long-to-long|short-to-long|Test-time|time|Instruct|AWQ|YARN)\b"
)
MODEL_NAMES = r"\b[A-Za-z0-9]+(?:[-+][A-Za-z0-9]+){2,}\b|\bVanilla\+Skeleton\b"
ADDRESSES = r"https?://\S+|www\.\S+|doi\.org/\S+|\b\d{4}\.\d{4,}\b"
CITATION_GROUP = r"\([^()]*?(?:et\s+al\.?|,\s*(?:19|20)\d{2}[a-z]?\s*)[^()]*?\)"
YEAR_LIST = r"(?:19|20)\d{2}[a-z]?[\s;,]+"
STOPWORDS = (
    "the", "of", "and", "or", "to", "in", "for", "on", "with", "as", "by", "is", "are", "was", "were", "be", "been", "it", "its", "at", "from", "that", "this",
    "these", "those", "we", "our", "a", "an", "each", "their", "they", "using", "which", "while", "such",
)
#: A word of a source, as prefixes are made of.
WORD = r"[A-Za-z][A-Za-z'’.\-]{2,}"
PREFIX_WORDS, PROBE_WORDS, LEAST_PROBE = 12, 6, 12
#: Different texts of a page that its probes are compared with one by one; pages with more go by the index of pieces.
FEW_TEXTS = 64


def _atoms(pattern: str) -> list[str]:
    """Characters of a plain pattern, escapes and question marks with what they belong to."""
    return re.findall(r"\\?.\??", pattern)


def _branches(ways: list[list[str]]) -> str:
    """Alternatives with equal beginnings as one branch each, so that a position is tried by its letters and not by the whole list. The
    first of several that match stays the first: those that differ in a letter exclude each other, and nothing moves past one
    that ends or may leave a character out."""
    out, i = [], 0
    while i < len(ways):
        if not ways[i] or ways[i][0].endswith("?"):
            out.append("".join(ways[i]))
            i += 1
            continue
        j = next((k for k in range(i, len(ways)) if not ways[k] or ways[k][0].endswith("?")), len(ways))
        groups: dict[str, list[list[str]]] = {}
        for way in ways[i:j]:
            groups.setdefault(way[0].lower(), []).append(way)
        out += ["".join(g[0]) if len(g) == 1 else g[0][0] + _branches([way[1:] for way in g]) for g in groups.values()]
        i = j
    return f"(?:{'|'.join(out)})"


#: The same names in the same order of preference.
_NAMES = rf"(?i)\b{_branches([_atoms(n) for n in PROTECTED_NAMES.removeprefix(r'(?i)\b(?:').removesuffix(r')\b').split('|')])}\b"
#: What a text has to hold for a pattern to match at all: a search of plain pieces is a fraction of the pattern's own.
_YEARS = ("19", "20")
_NEEDS = {MODEL_NAMES: ("-", "+"), ADDRESSES: ("://", "www.", "doi.org/", "."), T.PLACEHOLDER: ("{{",), CITATION_GROUP: ("(",), YEAR_LIST: _YEARS}
_NEEDS |= {r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)": ("(",), r"et al\.?": ("et al",), r"\bal\.?,?\s*(?:19|20)\d{2}[a-z]?[\s;,]*": _YEARS}
#: A second, plainer pattern that matches somewhere in every text that the first does.
_HINTS = {MODEL_NAMES: r"[-+][A-Za-z0-9]+[-+]|a\+S", ADDRESSES: r"(?U)://|www\.|doi\.org/|\d\.\d"}


def _cleaned(text: Column, patterns: tuple[str, ...]) -> Column:
    """Word boundaries go by letters of all alphabets. The text is a variable between steps, so that each is made once."""
    steps = [(p, f"(?U){_NAMES if p == PROTECTED_NAMES else p}") for p in patterns]
    steps += [(None, r"[0-9]+[.,]?[0-9]*"), (None, r"[^\p{L}\p{N}_\s'’.-]")]
    out = F.array(F.coalesce(text, F.lit("")))
    for step in steps:
        out = F.transform(out, _replacing(*step))
    return F.get(F.transform(out, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), F.lit(0))


def _replacing(pattern: str | None, said: str) -> Callable[[Column], Column]:
    """Blanks for what ``said`` matches; texts that lack what the pattern needs are handed on."""

    def each(text: Column) -> Column:
        out = F.regexp_replace(text, said, " ")
        if pattern not in _NEEDS:
            return out
        may = reduce(Column.__or__, (F.contains(text, F.lit(n)) for n in _NEEDS[pattern]))
        if pattern in _HINTS:
            may = may & text.rlike(_HINTS[pattern])
        return F.when(may, out).otherwise(text)

    return each


def english_form(text: Column) -> Column:
    """A text without names, addresses, citations, numbers and placeholders: what would have to be translated."""
    return _cleaned(text, (MODEL_NAMES, PROTECTED_NAMES, ADDRESSES, T.PLACEHOLDER, r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)", CITATION_GROUP, r"et al\.?", r"\bal\.?,?\s*(?:19|20)\d{2}[a-z]?[\s;,]*", YEAR_LIST))


def details(text: Column) -> Column:
    """Residue of a text: runs of twenty letters or more, then, if four words or more are left, the first sixteen."""

    def found(clean: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(clean, F.lit("[A-Za-z]{20,}"), F.lit(0)), lambda r: F.struct(F.lit("long_run").alias("type"), r.alias("text")))
        words = F.filter(F.split(clean, " ", 17), lambda w: w != "")
        sentence = F.when(F.size(words) >= 4, F.array(F.struct(F.lit("english_sentence").alias("type"), F.array_join(F.slice(words, 1, 16), " ").alias("text"))))
        return F.concat(runs, F.coalesce(sentence, F.array().cast("array<struct<type:string,text:string>>")))

    # the cleaned text as a variable, so that it is made once, not at each place that it is used
    return F.flatten(F.transform(F.array(english_form(text)), found))


def surviving_words(source: Column, rendered: Column, scoped: bool = True) -> Column:
    """Words of the source, sorted, each once, that stand in a run of the rendered text without East Asian characters, not within
    a longer word. ``scoped``: the rendered text is the paragraph's own, so joining words count too."""
    runs = F.filter(F.split(F.coalesce(rendered, F.lit("")), f"{T.CJK}+"), lambda r: F.length(F.regexp_replace(r, r"^[ \t\r\n。，：；、！？（）()\"'‘’“”·•∙▪●]+|[ \t\r\n。，：；、！？（）()\"'‘’“”·•∙▪●]+$", "")) >= 2)
    low = F.lower(F.array_join(runs, " "))
    clean = _cleaned(source, (MODEL_NAMES, PROTECTED_NAMES, ADDRESSES, T.PLACEHOLDER, CITATION_GROUP, YEAR_LIST))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w.rlike(r"^[A-Za-z'’.-]{2,}$") & (F.lit(True) if scoped else ~F.lower(w).isin(*STOPWORDS)))
    # a mark on either side of every character that may bound a word: a word stands where it is found with marks at its ends, so no
    # pattern is made for each word
    marked = lambda t: F.regexp_replace(t, "[^a-z0-9+]", "\u0001$0\u0001")
    stands = lambda t, w: F.contains(t["low"], w) & F.contains(t["marked"], F.concat(F.lit("\u0001"), marked(w), F.lit("\u0001")))
    # the text as a variable, so that it is made once, not for each word
    texts = F.transform(F.array(low), lambda t: F.struct(t.alias("low"), F.concat(F.lit("\u0001"), marked(t), F.lit("\u0001")).alias("marked")))
    return F.array_sort(F.flatten(F.transform(texts, lambda t: F.filter(F.array_distinct(words), lambda w: stands(t, w)))))


def without_joining(words: Column) -> Column:
    """Words of a paragraph's own text as they count on a page: those that join others are left out."""
    return F.filter(words, lambda w: ~F.lower(w).isin(*STOPWORDS))


def prefix_of(source: Column) -> Column:
    """The first words of a source, in lower case."""
    words = F.regexp_extract_all(F.regexp_replace(F.coalesce(source, F.lit("")), T.PLACEHOLDER, ""), F.lit(WORD), F.lit(0))
    return F.lower(F.array_join(F.slice(words, 1, PREFIX_WORDS), " "))


def probe_of(text: Column) -> Column:
    """The first words of a rendered span that a prefix is searched for; null if they are too short to tell."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z'’.\- ]", ""), " +"), lambda w: F.length(w) >= 3)
    probe = F.array_join(F.slice(words, 1, PROBE_WORDS), " ")
    return F.when(F.length(probe) >= LEAST_PROBE, probe)


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= LEAST_PROBE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - LEAST_PROBE + 1), lambda i: F.substring(text, i, F.lit(LEAST_PROBE)))))


def first_containing(probes: DataFrame, texts: DataFrame, order: str, value: str) -> DataFrame:
    """probes(doc_id, page, probe), texts(doc_id, page, text, order, value): for each probe that a text of its page holds, the
    value of the first such text. Equal probes and equal texts are one each; both are dealt by page. Where a page has
    ``FEW_TEXTS`` or less, they come to the probe as an array. Of other pages, pieces of ``LEAST_PROBE`` characters are indexed; a
    probe looks up its rarest piece alone, and not at all if one of its pieces is nowhere, so texts that begin alike
    aren't paired with all probes that do."""
    own = texts.where(F.length("text") >= LEAST_PROBE).select(*PAGE, F.lit(None).cast("string").alias("probe"), "text", F.struct(order, value).alias("f_"))
    rows = own.unionByName(probes.where("probe is not null").select(*PAGE, "probe"), allowMissingColumns=True).dropna(subset=PAGE)
    single = rows.repartition(*PAGE).groupBy(*PAGE, "probe", "text").agg(F.min("f_").alias("first_"))
    page = Window.partitionBy(*PAGE)
    counted = single.withColumn("known_", F.count("text").over(page))
    text, few = F.col("text").isNotNull(), F.col("known_") <= FEW_TEXTS
    listed = counted.withColumn("texts_", F.array_sort(F.collect_list(F.when(text & few, F.struct("first_", "text"))).over(page)))
    holding = listed.where(~text & few).select(*PAGE, "probe", F.get(F.filter("texts_", lambda t: F.contains(t["text"], F.col("probe"))), F.lit(0))["first_"].alias("f_"))
    many, asked = counted.where(text & ~few), counted.where(~text & ~few)
    index = many.select(*PAGE, "first_", F.explode(_grams(F.col("text"))).alias("gram_"))
    often = index.groupBy(*PAGE, "gram_").agg(F.count("*").alias("n_"))
    broken = asked.withColumn("grams_", _grams(F.col("probe")))
    pieces = broken.select(*PAGE, "probe", F.size("grams_").alias("all_"), F.explode("grams_").alias("gram_")).join(often, [*PAGE, "gram_"])
    rarest = pieces.groupBy(*PAGE, "probe").agg(F.count("*").alias("found_"), F.first("all_").alias("all_"), F.min(F.struct("n_", "gram_")).alias("r_")).where("found_ = all_").select(*PAGE, "probe", F.col("r_.gram_").alias("gram_"))
    hit = rarest.join(index, [*PAGE, "gram_"]).join(many.select(*PAGE, "first_", "text"), [*PAGE, "first_"]).where(F.contains(F.col("text"), F.col("probe")))
    found = holding.where("f_ is not null").union(hit.groupBy(*PAGE, "probe").agg(F.min("first_").alias("f_")))
    return found.select(*PAGE, "probe", F.col(f"f_.{order}").alias(order), F.col(f"f_.{value}").alias(value))


def spans_to_regions(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """spans(doc_id, page, span_id, text, box), regions(doc_id, page, region, kind, role, owner, source, box) in the order of
    ``region``. Each span with the role and owner (paragraph or formula) of the region of the largest common area, the first of
    equals, ``unmapped`` without one; a span whose owner is unknown or has no words is given to the first paragraph whose
    prefix holds the span's first words, and keeps its role. Prefixes and probes are stored, so that each is made once."""
    text = rounds.cut(regions.where("kind = 'text'").select(*PAGE, "region", "owner", prefix_of(F.col("source")).alias("text")))
    placed = sweep.best_overlap(spans.select(*PAGE, "span_id", "x0", "y0", "x1", "y1"), regions.select(*PAGE, "region", "x0", "y0", "x1", "y1"), PAGE, "span_id", "region").select(*PAGE, "span_id", F.col("match").alias("region"))
    named = regions.select(*PAGE, "region", "role", "owner").join(text.select(*PAGE, "region", (F.col("text") != "").alias("worded_")), [*PAGE, "region"], "left")
    j = spans.join(placed, [*PAGE, "span_id"], "left").join(named, [*PAGE, "region"], "left")
    probe = F.when(F.col("owner").isNull() | ~F.coalesce("worded_", F.lit(False)), probe_of(F.col("text")))
    j = rounds.cut(j.select(*spans.columns, "role", "owner", probe.alias("probe")))
    found = first_containing(j, text, "region", "owner").select(*PAGE, "probe", F.col("owner").alias("by_content_"))
    out = j.join(found, [*PAGE, "probe"], "left")
    return out.select(*spans.columns, F.coalesce("role", F.lit("unmapped")).alias("role"), F.coalesce("by_content_", "owner").alias("owner"), F.col("by_content_").isNotNull().alias("by_content"))
