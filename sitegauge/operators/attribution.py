"""Signals that let a page be cited: author, dates, links, canonical address, contact, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import markup
from sitegauge.functions import url as U
from sitegauge.functions.sqltext import lit, struct
from sitegauge.operators import issues
from sitegauge.operators.content import with_clean
from sitegauge.operators.signals import with_head
from sitegauge.operators.structured import with_jsonld

# Our own word lists.
CREDENTIALS = ("PhD", "Ph.D.", "Dr.", "Prof.", "M.D.", "MSc", "MBA", "Dipl.-Ing.", "Docteur", "Conf. univ.")
PRIVACY = "(?i)privacy|datenschutz|confidentialit"
TERMS = "(?i)terms|agb|conditions"
CONTACT = "(?i)contact|kontakt|impressum"
SOCIAL = ("og:title", "og:description", "og:image", "og:url", "twitter:card")
_TAG_AND_TEXT = r"(?is)(<[a-z][^>]*+(?:>|\z))([^<]*+)"
_AUTHOR_TAG = r"""(?i)\sitemprop\s*=\s*["']?author["']?[\s>/]"""
_LINK_TEXT = r"(?is)<a\s[^>]*+(?:>(?:(.*?)</a\s*+>|.*+)|\z)"
_CREDENTIAL = r"(?<![\p{L}\p{N}])(" + "|".join(w.replace(".", r"\.") for w in CREDENTIALS) + r")(?![\p{L}\p{N}])"


def with_tags(df: DataFrame) -> DataFrame:
    """Adds the tag columns the operators below share: head, anchors, marked."""
    df = df if "head" in df.columns else with_head(df)
    return df.withColumns(
        {
            "anchors": markup.project_tags("html", "a", ["href", "rel"], r"(?i)\shref\s*="),
            "marked": markup.project_tags(
                "html", markup.ANY_TAG, ["itemprop", "datetime"], r"(?i)\s(?:itemprop|datetime)\s*="
            ),
        }
    )


def _named(kind: str, name: str) -> str:
    """Content of the first non-empty meta tag with that name or property."""
    return f"get(filter(head, t -> t.el = 'meta' AND lower(t.{kind}) = {lit(name)} AND trim(t.content) <> ''), 0).content"


_HAS = {
    "meta_author": f"{_named('name', 'author')} IS NOT NULL",
    "rel_author": (
        f"exists(anchors, t -> {markup.has_token_sql('coalesce(t.rel, ' + lit('') + ')', 'author')}) OR "
        f"exists(head, t -> t.el = 'link' AND {markup.has_token_sql('coalesce(t.rel, ' + lit('') + ')', 'author')})"
    ),
    "itemprop_author": f"exists(marked, t -> {markup.has_token_sql('coalesce(t.itemprop, ' + lit('') + ')', 'author')})",
    "jsonld_author": "exists(items, i -> array_contains(i.keys, 'author'))",
}


def author_markup(df: DataFrame) -> DataFrame:
    tags = with_jsonld(with_tags(df))
    return tags.select("page_id", *[F.expr(sql).alias(name) for name, sql in _HAS.items()])


def _first_date(*texts: str) -> str:
    return "coalesce(" + ", ".join(f"try_cast({t} AS TIMESTAMP)" for t in texts) + ")"


_JSON_DATE = "get(filter(transform(items, i -> i.{0}), d -> d IS NOT NULL), 0)"
_DATES = {
    "published": _first_date(_named("property", "article:published_time"), _JSON_DATE.format("datePublished")),
    "modified": _first_date(_named("property", "article:modified_time"), _JSON_DATE.format("dateModified")),
    "shown": _first_date("get(filter(marked, t -> t.el = 'time' AND t.datetime IS NOT NULL), 0).datetime"),
}


def date_signals(df: DataFrame, as_of: str) -> DataFrame:
    """Dates a page states and its age in days on ``as_of`` (yyyy-mm-dd)."""
    d = with_jsonld(with_tags(df)).select(
        "page_id", *[F.expr(sql).cast("date").alias(n) for n, sql in _DATES.items()]
    )
    latest = F.coalesce("modified", "published", "shown")
    return d.select("page_id", "published", "modified", "shown", F.datediff(F.lit(as_of).cast("date"), latest).alias("age_days"))


def with_links(df: DataFrame) -> DataFrame:
    """Adds ``links``: host of every web link, resolved against the page."""
    host = r"lower(regexp_extract({0}, '(?i)^https?://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
    absolute = (
        "CASE WHEN startswith(t.href, '//') THEN concat('https:', t.href) "
        "WHEN t.href RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN t.href ELSE NULL END"
    )
    scheme_only = "t.href RLIKE '(?i)^(?!https?:)[a-z][a-z0-9+.-]*:'"
    web = f"filter(anchors, t -> t.href IS NOT NULL AND NOT ({scheme_only}))"
    df = df.withColumn("own_host", U.host(F.col("url")))
    return df.withColumn("links", F.expr(f"transform({web}, t -> coalesce({host.format(absolute)}, own_host))"))


def outbound_links(df: DataFrame) -> DataFrame:
    links = with_links(with_tags(df)).select("page_id", "own_host", "links")
    return links.select(
        "page_id",
        F.expr("size(filter(links, h -> h = own_host))").alias("n_internal"),
        F.expr("size(filter(links, h -> h <> own_host))").alias("n_external"),
        F.expr("size(array_distinct(filter(links, h -> h <> own_host)))").alias("n_external_hosts"),
    )


def author_text() -> Column:
    """Author named in a meta tag or marked in the text; reads ``head`` and ``clean``."""
    tags, texts = (f"regexp_extract_all(clean, {lit(_TAG_AND_TEXT)}, {i})" for i in (1, 2))
    pairs = f"filter(zip_with({tags}, {texts}, (t, x) -> struct(t AS t, x AS x)), p -> p.t RLIKE {lit(_AUTHOR_TAG)} AND endswith(p.t, '>'))"
    marked = f"if(clean RLIKE '(?i)itemprop', array_join(transform({pairs}, p -> p.x), ' '), '')"
    return F.expr(f"concat_ws(' ', {_named('name', 'author')}, {marked})")


def eeat_markers(df: DataFrame) -> DataFrame:
    """Credentials named next to an author."""
    t = with_clean(with_head(df)).select("page_id", author_text().alias("author"))
    found = f"array_sort(array_distinct(regexp_extract_all(author, {lit(_CREDENTIAL)}, 1)))"
    return t.select("page_id", "author", F.expr(f"array_join({found}, ',')").alias("credentials"))


def with_canonical(df: DataFrame) -> DataFrame:
    """Adds ``canonical``: the address the page names as its own, in normal form."""
    df = df.withColumn("_href", F.expr(f"trim({markup.link_first_sql('canonical')}.href)"))
    full = F.when(F.col("_href") != "", U.resolve("_href", "url"))
    return df.withColumn("canonical", full).drop("_href")


def canonical_status() -> Column:
    """Whether a page names itself; spelling of scheme, host, port and dot segments aside."""
    return (
        F.when(F.col("canonical").isNull(), "missing")
        .when(F.substring_index("canonical", "#", 1) == U.address("url"), "self")
        .otherwise("other")
    )


def canonical_check(df: DataFrame) -> DataFrame:
    return with_canonical(with_head(df)).select("page_id", "canonical", canonical_status().alias("status"))


def _social(name: str) -> str:
    return f"coalesce({_named('property', name)}, {_named('name', name)}) IS NOT NULL"


def social_meta(df: DataFrame) -> DataFrame:
    return with_head(df).select("page_id", *[F.expr(_social(n)).alias(n.replace(":", "_")) for n in SOCIAL])


def _links_to(pattern: str) -> str:
    return f"exists(anchors, t -> t.href RLIKE {lit(pattern)}) OR exists(texts, t -> t RLIKE {lit(pattern)})"


def with_link_texts(df: DataFrame) -> DataFrame:
    """Adds ``texts``, what links outside comments and scripts say."""
    clean = "clean" if "clean" in df.columns else "_clean"
    df = df if clean == "clean" else df.withColumn("_clean", markup.clean_html("html"))
    texts = f"transform(regexp_extract_all({clean}, {lit(_LINK_TEXT)}, 1), t -> {markup.visible_text_sql('t')})"
    return df.withColumn("texts", F.expr(texts)).drop("_clean")


def contact_info(df: DataFrame) -> DataFrame:
    t = with_link_texts(with_tags(df))
    return t.select(
        "page_id",
        F.expr("size(filter(anchors, t -> lower(t.href) LIKE 'mailto:%'))").alias("n_mailto"),
        F.expr("size(filter(anchors, t -> lower(t.href) LIKE 'tel:%'))").alias("n_tel"),
        F.expr(f"exists(texts, t -> t RLIKE {lit(CONTACT)})").alias("has_contact_link"),
    )


def trust_signals(df: DataFrame) -> DataFrame:
    t = with_link_texts(with_tags(df))
    return t.select(
        "page_id", (U.scheme(F.col("url")) == "https").alias("https"),
        F.expr(_links_to(PRIVACY)).alias("privacy"), F.expr(_links_to(TERMS)).alias("terms"),
    )


def attribution_facts(df: DataFrame) -> DataFrame:
    """Adds ``at``: everything the attribution score and issues need."""
    had = set(df.columns)
    df = with_link_texts(with_tags(df if "items" in had else with_jsonld(df)))
    df = with_canonical(df).withColumn("_status", canonical_status()).withColumn("_scheme", U.scheme(F.col("url")))
    dated = " OR ".join(f"({sql}) IS NOT NULL" for sql in _DATES.values())
    social = " + ".join(f"if({_social(n)}, 1, 0)" for n in SOCIAL)
    at = struct(
        has_author=" OR ".join(f"({sql})" for sql in _HAS.values()), has_date=dated, canonical="_status",
        n_social=social,
        has_contact=f"exists(anchors, t -> t.href RLIKE '(?i)^(?:mailto|tel):') OR exists(texts, t -> t RLIKE {lit(CONTACT)})",
        https="_scheme = 'https'", privacy=_links_to(PRIVACY), terms=_links_to(TERMS),
    )
    return df.withColumn("at", F.expr(at)).drop("anchors", "marked", "texts", "canonical", "_status", "_scheme")


def attribution_score() -> Column:
    """25 author, 20 date, 15 own canonical address, 3 per social tag, 10 contact, 5 each: https, privacy, terms."""
    return F.expr(
        "if(at.has_author, 25, 0) + if(at.has_date, 20, 0) + if(at.canonical = 'self', 15, 0) + 3 * at.n_social"
        " + if(at.has_contact, 10, 0) + if(at.https, 5, 0) + if(at.privacy, 5, 0) + if(at.terms, 5, 0)"
    )


def attribution_issues(brief: bool = False) -> Column:
    s = issues.seed
    seeds = ", ".join(
        [
            s("at_no_author", "401", when="NOT at.has_author", brief=brief),
            s("at_no_date", "402", when="NOT at.has_date", brief=brief),
            s("at_canonical_other", "403", when="at.canonical = 'other'", brief=brief),
            s("at_no_social", "404", when="at.n_social = 0", brief=brief),
            s("at_no_https", "405", when="NOT at.https", brief=brief),
        ]
    )
    return F.expr(issues.render(f"array_compact(array({seeds}))", brief))
