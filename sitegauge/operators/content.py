"""How readily content can be extracted: headings, sections, regions, text measures.

Headings and sections of a page stay in one array in its row; a page is compared with itself
only, so none of this shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import markup
from sitegauge.functions.rows import keep_where, posexplode_rows
from sitegauge.functions.sqltext import lit, struct
from sitegauge.operators import issues

SEMANTIC = ("article", "section", "main", "nav", "header", "footer", "aside")
STRUCTURE = ("ul", "ol", "li", "table")
WORD = r"[\p{L}\p{N}]+"
LONG_WORD = r"[\p{L}\p{N}]{7,}"
SENTENCE_END = r"[.!?]+(?:\s|\z)"

# Texts are cut before each heading; a heading ends at its closing tag or where the next one starts.
_BEFORE_HEADING = r"(?i)(?=<h[1-6][\s>])"
_OPENS = r"(?is)^<h[1-6](?:\s[^>]*+)?+>"
_HEADING_START = r"(?is)^<h[1-6][^>]*+>(.*?)(?:</h[1-6]\s*+>|\z)"
_HEAD = r"(?is)<head(?:\s[^>]*+)?+(?:>(?:.*?</head\s*+>|(.*+))|\z)"


def pieces_sql(html: str) -> str:
    """The text cut before each heading; only the parts that begin with one."""
    return f"filter(split({html}, {lit(_BEFORE_HEADING)}), p -> p RLIKE {lit(_OPENS)})"


def count_sql(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {lit(pattern)})"


def words_sql(text: str) -> str:
    return count_sql(text, WORD)


def with_clean(df: DataFrame) -> DataFrame:
    return df.withColumn("clean", markup.clean_html("html"))


def headings_sql(clean: str = "clean") -> str:
    """``array<struct<level, text, skip>>``; skip = more than one level deeper than the one before."""
    text = markup.visible_text_sql(f"regexp_extract(h, {lit(_HEADING_START)}, 1)")
    return f"transform({pieces_sql(clean)}, h -> {struct(level='CAST(substring(h, 3, 1) AS INT)', text=text)})"


def with_headings(df: DataFrame) -> DataFrame:
    df = df.withColumn("_h", F.expr(headings_sql()))
    skip = "i > 0 AND h.level - element_at(_h, greatest(i, 1)).level > 1"
    out = struct(level="h.level", text="h.text", skip=skip)
    return df.withColumn("headings", F.expr(f"transform(_h, (h, i) -> {out})")).drop("_h")


def heading_outline(df: DataFrame) -> DataFrame:
    rows = posexplode_rows(with_headings(with_clean(df)), ["page_id"], "headings", "pos", "h")
    return rows.select("page_id", "pos", "h.level", "h.text", "h.skip")


def h1_check(df: DataFrame) -> DataFrame:
    """Pages without exactly one main heading. A heading counts from its opening tag, closed or not."""
    n_h1 = F.expr("size(filter(headings, h -> h.level = 1))").alias("n_h1")
    found = keep_where(with_headings(with_clean(df)), ["page_id", n_h1], "n_h1 <> 1")
    return found.select("page_id", "n_h1", F.when(F.col("n_h1") == 0, "missing").otherwise("multiple").alias("finding"))


def _counts(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    els = with_clean(df).select("page_id", markup.element_names("clean").alias("els"))
    return els.select("page_id", *[F.expr(f"size(filter(els, e -> e = '{n}'))").alias(f"n_{n}") for n in names])


def semantic_tags(df: DataFrame) -> DataFrame:
    return _counts(df, SEMANTIC)


def list_table_usage(df: DataFrame) -> DataFrame:
    return _counts(df, STRUCTURE)


def with_body(df: DataFrame) -> DataFrame:
    """``clean`` without the head element."""
    return df.withColumn("body", F.regexp_replace("clean", _HEAD, " $1"))


def content_html_sql(clean: str = "clean") -> str:
    """Inner html of the first ``main`` or, if that holds nothing, of all ``article`` elements, nested ones to their right end."""
    return f"coalesce(nullif({markup.outermost_sql(clean, 'main', first=True)}, ''), {markup.outermost_sql(clean, 'article')})"


def with_text(df: DataFrame) -> DataFrame:
    """Adds ``body_text`` and ``content_text``."""
    df = with_body(df)
    return df.withColumns(
        {
            "body_text": F.expr(markup.visible_text_sql("body")),
            "content_text": F.expr(markup.visible_text_sql(content_html_sql())),
        }
    )


def content_ratio(df: DataFrame) -> DataFrame:
    """Characters of main content against all visible characters."""
    t = with_text(with_clean(df)).select(
        "page_id", F.length("content_text").alias("content_chars"), F.length("body_text").alias("body_chars")
    )
    return t.withColumn("ratio", F.expr("if(body_chars = 0, 0.0D, content_chars / body_chars)"))


def with_sections(df: DataFrame, fields: tuple[str, ...] = ("level", "heading", "text")) -> DataFrame:
    """Adds ``sections``: heading level, heading, text up to the next heading (or some of these)."""
    made = {
        "level": "CAST(substring(p, 3, 1) AS INT)",
        "heading": markup.visible_text_sql(f"regexp_extract(p, {lit(_HEADING_START)}, 1)"),
        "text": markup.visible_text_sql(f"regexp_replace(p, {lit(_HEADING_START)}, '')"),
    }
    one = struct(**{f: made[f] for f in fields})
    return df.withColumn("sections", F.expr(f"transform({pieces_sql('body')}, p -> {one})"))


def section_blocks(df: DataFrame) -> DataFrame:
    rows = posexplode_rows(with_sections(with_body(with_clean(df))), ["page_id"], "sections", "pos", "s")
    return rows.select("page_id", "pos", "s.level", "s.heading", "s.text")


def section_depth(df: DataFrame) -> DataFrame:
    """Words per section: fewest, mean, most."""
    w = F.expr(f"transform(sections, s -> {words_sql('s.text')})").alias("w")
    return keep_where(with_sections(with_body(with_clean(df)), ("text",)), ["page_id", w], "size(w) > 0").select(
        "page_id", F.size("w").alias("n_sections"), F.array_min("w").alias("min_words"),
        F.expr("aggregate(w, 0, (a, x) -> a + x) / size(w)").alias("avg_words"), F.array_max("w").alias("max_words"),
    )


def ready_sql(text: str) -> str:
    """A section answers readily if its first sentence has 5 to 40 words and ends in a full stop."""
    first = f"regexp_extract({text}, '^[^.!?]*[.!?]', 0)"
    return f"endswith({first}, '.') AND {words_sql(first)} BETWEEN 5 AND 40"


def answer_ready(df: DataFrame) -> DataFrame:
    s = with_sections(with_body(with_clean(df)), ("text",))
    n = s.select(
        "page_id", F.size("sections").alias("n_sections"),
        F.expr(f"size(filter(sections, s -> {ready_sql('s.text')}))").alias("n_ready"),
    )
    return n.withColumn("share", F.expr("if(n_sections = 0, 0.0D, n_ready / n_sections)"))


def language() -> Column:
    """Primary subtag of ``html[lang]``; null if there is none."""
    tag = markup.project_tags_sql("html", "html", ["lang"])
    return F.expr(f"nullif(lower(split_part(trim(get({tag}, 0).lang), '-', 1)), '')")


def page_language(df: DataFrame) -> DataFrame:
    return df.select("page_id", language().alias("lang"))


def readability(df: DataFrame) -> DataFrame:
    """LIX: words per sentence plus the percentage of words over six letters."""
    t = with_text(with_clean(df)).select(
        "page_id", F.expr(words_sql("content_text")).alias("n_words"),
        F.expr(f"greatest(1, {count_sql('content_text', SENTENCE_END)})").alias("n_sentences"),
        F.expr(count_sql("content_text", LONG_WORD)).alias("n_long"),
    )
    return t.withColumn("lix", F.expr("if(n_words = 0, 0.0D, n_words / n_sentences + 100 * n_long / n_words)"))


def language_summary(df: DataFrame) -> DataFrame:
    """Pages and mean text measures by language; sums combine before the only, tiny, shuffle."""
    t = with_text(with_clean(df.withColumn("lang", language())))
    n = t.select(
        "lang", F.expr(words_sql("content_text")).alias("w"),
        F.expr(f"greatest(1, {count_sql('content_text', SENTENCE_END)})").alias("s"),
        F.expr(count_sql("content_text", LONG_WORD)).alias("l"),
    )
    sums = n.groupBy("lang").agg(
        F.count("*").alias("n_pages"), F.sum("w").alias("n_words"), F.sum("s").alias("n_sentences"), F.sum("l").alias("n_long")
    )
    return sums.withColumn("lix", F.expr("if(n_words = 0, 0.0D, n_words / n_sentences + 100 * n_long / n_words)"))


def content_facts(df: DataFrame) -> DataFrame:
    """Adds ``ex``: everything the extractability score and issues need."""
    df = with_sections(with_text(with_headings(with_clean(df))), ("text",))
    ex = struct(
        n_h1="size(filter(headings, h -> h.level = 1))",
        n_skips="size(filter(headings, h -> h.skip))",
        has_region="content_text <> ''",
        content_chars="length(content_text)", body_chars="length(body_text)",
        n_sections="size(sections)", n_ready=f"size(filter(sections, s -> {ready_sql('s.text')}))",
    )
    return df.withColumn("ex", F.expr(ex)).drop("headings", "sections", "content_text", "body_text", "body", "clean")


def content_score() -> Column:
    """25 one main heading, 15 no skipped level, 20 a content region, 20 content share, 20 ready sections."""
    return F.expr(
        "if(ex.n_h1 = 1, 25, 0) + if(ex.n_skips = 0, 15, 0) + if(ex.has_region, 20, 0)"
        " + if(ex.body_chars = 0, 0, CAST(bround(20 * least(1, ex.content_chars / ex.body_chars), 0) AS INT))"
        " + if(ex.n_sections = 0, 0, CAST(bround(20 * ex.n_ready / ex.n_sections, 0) AS INT))"
    )


def content_issues(brief: bool = False) -> Column:
    s = issues.seed
    seeds = ", ".join(
        [
            s("ex_h1_missing", "301", when="ex.n_h1 = 0", brief=brief),
            s("ex_h1_multiple", "302", when="ex.n_h1 > 1", args={"n": "ex.n_h1"}, brief=brief),
            s("ex_heading_skip", "303", when="ex.n_skips > 0", args={"n": "ex.n_skips"}, brief=brief),
            s("ex_no_region", "304", when="NOT ex.has_region", brief=brief),
        ]
    )
    return F.expr(issues.render(f"array_compact(array({seeds}))", brief))
