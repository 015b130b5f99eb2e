"""Registered queries for structured data, content and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.operators import attribution, canonical, content, entities, items, structured
from sitegauge.sources.overlay import overlay_chains, overlay_items, overlay_references
from verify.queries_core import audited, pages

AS_OF = "2026-01-01"


def _widen(df):
    """Counts as bigint, dates as text: the types the other engine reports."""
    out = []
    for name, kind in df.dtypes:
        out.append(F.col(name).cast({"int": "bigint", "date": "string"}.get(kind, kind)).alias(name))
    return df.select(*out)


def _on_pages(operator, **kwargs):
    return lambda s, d: _widen(operator(pages(s, d), **kwargs))


def _score(name):
    def run(s, d):
        a = audited(s, d, name, brief=True)
        rules = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["rule"], i["key"], i["severity"])), ",")
        return a.select("page_id", F.get("scores", F.lit(0))["value"].alias("value"), rules.alias("issues"))

    return run


def content_queries():
    named = {
        structured: "jsonld_blocks jsonld_types microdata_items rdfa_items missing_schemas schema_completeness schema_nesting",
        content: (
            "heading_outline h1_check content_ratio semantic_tags section_blocks answer_ready "
            "list_table_usage section_depth readability page_language language_summary"
        ),
        entities: "entity_density",
        attribution: (
            "author_markup outbound_links eeat_markers canonical_check social_meta contact_info trust_signals"
        ),
    }
    out = {n: _on_pages(getattr(module, n)) for module, names in named.items() for n in names.split()}
    out["jsonld_valid"] = lambda s, d: _widen(structured.jsonld_valid(structured.jsonld_blocks(pages(s, d))))
    out["date_signals"] = _on_pages(attribution.date_signals, as_of=AS_OF)
    chained = lambda s, d: overlay_chains(s.read.parquet(f"{d}/pages.parquet"))
    out["canonical_chains"] = lambda s, d: canonical.page_canonicals(chained(s, d))
    out["canonical_clusters"] = lambda s, d: canonical.canonical_clusters(chained(s, d))
    referring = lambda s, d: overlay_references(s.read.parquet(f"{d}/pages.parquet"))
    out["schema_references"] = lambda s, d: _widen(structured.schema_references(referring(s, d)))
    out["schema_nesting_by_id"] = lambda s, d: _widen(structured.schema_nesting(referring(s, d)))
    marked = lambda s, d: overlay_items(s.read.parquet(f"{d}/pages.parquet"))
    out["microdata_properties"] = lambda s, d: _widen(items.microdata_properties(marked(s, d)))
    out["rdfa_properties"] = lambda s, d: _widen(items.rdfa_properties(marked(s, d)))
    out["structured_score"] = _score("structured-data")
    out["extractability_score"] = _score("extractability")
    out["attribution_score"] = _score("attribution")
    out["all_dimensions"] = lambda s, d: audited(s, d, None, brief=True).select(
        "page_id", "overall_score", F.col("issue_count").cast("long").alias("issue_count"),
        F.size("scores").cast("long").alias("n_scores"),
    )
    return out
