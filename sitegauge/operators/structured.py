"""Structured data on pages: JSON-LD, Microdata, RDFa.

JSON-LD is parsed with the built-in VARIANT type. Everything is row-local: blocks, items and
property checks are array expressions, exploded only where a table of them is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import markup
from sitegauge.functions.rows import explode_rows, inline_rows, keep_where, posexplode_rows
from sitegauge.functions.sqltext import lit, struct
from sitegauge.operators import issues

# Schema types that answer engines look for.
CRITICAL_TYPES = ("FAQPage", "HowTo", "Article", "Organization")
# Our own requirement table: type -> level -> properties.
REQUIREMENTS = {
    "Article": {
        "required": ("headline", "author", "datePublished"),
        "optional": ("image", "dateModified", "publisher"),
        "ai_critical": ("author", "datePublished", "dateModified"),
    },
    "FAQPage": {"required": ("mainEntity",), "optional": ("name",), "ai_critical": ("mainEntity",)},
    "HowTo": {"required": ("name", "step"), "optional": ("image", "totalTime"), "ai_critical": ("step",)},
    "Organization": {"required": ("name", "url"), "optional": ("logo", "sameAs"), "ai_critical": ("sameAs", "description")},
}


# Types are compared without the address of the vocabulary.
_SCHEMA_PREFIX = "^(?:https?://schema[.]org/|schema:)"
_IS_OBJECT = "schema_of_variant(c.v) LIKE 'OBJECT%'"


def _children(v: str, prefix: str, e: str = "e") -> str:
    """SQL: ``array<struct<at, v>>``, the properties of object ``v``; the members of a list stand for the list."""
    entries = f"map_entries(coalesce(try_variant_get({v}, '$', 'map<string,variant>'), CAST(map() AS MAP<STRING, VARIANT>)))"
    one = f"transform(coalesce(try_variant_get({e}.value, '$', 'array<variant>'), array({e}.value)), x -> struct(concat({prefix}, {e}.key) AS at, x AS v))"
    return f"flatten(transform({entries}, {e} -> {one}))"


# A block is valid if it is one JSON value. VARIANT also turns down repeated keys, which are odd but valid.
VALID_JSON = "coalesce(size(from_json(concat('[', {0}, ']'), 'array<string>', map('allowSingleQuotes', 'false'))) = 1, false)"


_TYPE = "try_variant_get({}, '$[\"@type\"]', 'variant')"
_ID = "try_variant_get({}, '$[\"@id\"]', 'string')"


def _types(v: str) -> str:
    """SQL: type names of a node."""
    raw = f"coalesce(try_variant_get({v}, '$[\"@type\"]', 'array<string>'), array(try_variant_get({v}, '$[\"@type\"]', 'string')))"
    return f"transform(filter({raw}, t -> t IS NOT NULL), t -> regexp_replace(t, {lit(_SCHEMA_PREFIX)}, ''))"


def _nested(v: str) -> str:
    """SQL: what item ``v`` holds, two levels deep, with the path of properties."""
    first = _children(v, "''")
    second = f"flatten(transform(filter({first}, c -> {_IS_OBJECT}), c -> {_children('c.v', 'concat(c.at, ' + lit('.') + ')', 'd')}))"
    return f"concat({first}, {second})"


def _typed_nodes() -> str:
    """SQL: ``array<struct<id, types>>``, the nodes of a page's items that have both an ``@id`` and a type."""
    whole = f"concat(array(struct('' AS at, i AS v)), {_nested('i')})"
    node = struct(id=_ID.format("c.v"), types=_types("c.v"))
    found = f"transform(filter({whole}, c -> {_IS_OBJECT} AND {_TYPE.format('c.v')} IS NOT NULL AND {_ID.format('c.v')} IS NOT NULL), c -> {node})"
    some = f"flatten(transform(_v, i -> {found}))"
    return f"if(exists(jsonld, b -> contains(b, '@id')), {some}, CAST(array() AS ARRAY<STRUCT<id: STRING, types: ARRAY<STRING>>>))"


def _with_values(df: DataFrame) -> DataFrame:
    """Adds ``jsonld`` (array of block texts) and ``_v`` (the items as variants)."""
    graph = "try_variant_get(v, '$[\"@graph\"]', 'array<variant>')"
    members = f"coalesce({graph}, try_variant_get(v, '$', 'array<variant>'), array(v))"
    parsed = "filter(transform(jsonld, b -> try_parse_json(b)), v -> v IS NOT NULL)"
    df = df.withColumn("jsonld", markup.jsonld_blocks("html"))
    return df.withColumn("_v", F.expr(f"flatten(transform({parsed}, v -> {members}))"))


def with_jsonld(df: DataFrame) -> DataFrame:
    """Adds ``jsonld`` (array of block texts) and ``items`` (array of struct) to rows with html.

    Items are the top-level objects, the members of a top-level array or those of ``@graph``. A nested object without a type is untyped
    unless its ``@id`` is that of a typed node of the page, in whatever block that is.
    """
    known = f"coalesce(array_contains(ids, {_ID.format('c.v')}), false)"
    untyped = f"array_distinct(transform(filter({_nested('i')}, c -> {_IS_OBJECT} AND {_TYPE.format('c.v')} IS NULL AND NOT {known}), c -> c.at))"
    text = {k: f"try_variant_get(i, '$.{k}', 'string')" for k in ("datePublished", "dateModified")}
    item = struct(types=_types("i"), keys="coalesce(json_object_keys(to_json(i)), array())", untyped=untyped, **text)
    # ids are bound by a lambda: as a column they would be merged into the items and gathered for each of them
    items = f"get(transform(array(transform({_typed_nodes()}, n -> n.id)), ids -> transform(_v, i -> {item})), 0)"
    return _with_values(df).withColumn("items", F.expr(items)).drop("_v")


def schema_references(df: DataFrame) -> DataFrame:
    """(page_id, item, property, id, resolved, types): nested objects that stand for another node by its ``@id``.

    ``resolved`` says whether the page has a typed node of that ``@id``; ``types`` are those of all such nodes, sorted. References
    are followed for one step, so nodes that refer to each other or to themselves are no trouble.
    """
    refs = f"filter({_nested('i')}, c -> {_IS_OBJECT} AND {_TYPE.format('c.v')} IS NULL AND {_ID.format('c.v')} IS NOT NULL)"
    hits = f"filter(nodes, n -> n.id = {_ID.format('c.v')})"
    types = "array_join(array_sort(array_distinct(flatten(transform(h, n -> n.types)))), ',')"
    one = f"get(transform(array({hits}), h -> {struct(item='k', property='c.at', id=_ID.format('c.v'), resolved='size(h) > 0', types=types)}), 0)"
    rows = f"get(transform(array({_typed_nodes()}), nodes -> flatten(transform(_v, (i, k) -> transform({refs}, c -> {one})))), 0)"
    return inline_rows(_with_values(df), ["page_id"], F.expr(rows), "item")


def jsonld_blocks(df: DataFrame) -> DataFrame:
    return posexplode_rows(df.withColumn("b", markup.jsonld_blocks("html")), ["page_id"], "b", "pos", "block")


def jsonld_valid(blocks: DataFrame) -> DataFrame:
    return blocks.select("page_id", "pos", F.expr(VALID_JSON.format("block")).alias("valid"))


def jsonld_types(df: DataFrame) -> DataFrame:
    """(page_id, item, type), one row per type of an item."""
    rows = posexplode_rows(with_jsonld(df), ["page_id"], "items", "item", "i")
    return explode_rows(rows, ["page_id", "item"], "i.types", "type")


def _tagged(names: tuple[str, ...]) -> Column:
    where = r"(?i)\s(?:" + "|".join(names) + r")[\s=/>]"
    return markup.project_tags("html", markup.ANY_TAG, names, where)


def microdata_items(df: DataFrame) -> DataFrame:
    """Counts of item scopes and properties, and the item types of pages that use Microdata."""
    tags = keep_where(df, ["page_id", _tagged(("itemscope", "itemtype", "itemprop")).alias("t")], "size(t) > 0")
    return tags.select(
        "page_id",
        F.expr("size(filter(t, x -> x.itemscope IS NOT NULL))").alias("n_scopes"),
        F.expr("size(filter(t, x -> x.itemprop IS NOT NULL))").alias("n_props"),
        F.expr("array_join(array_sort(array_distinct(filter(transform(t, x -> x.itemtype), x -> x IS NOT NULL))), ',')").alias("types"),
    )


def rdfa_items(df: DataFrame) -> DataFrame:
    """The same for RDFa: ``typeof`` and ``property``."""
    tags = keep_where(df, ["page_id", _tagged(("typeof", "property")).alias("t")], "size(t) > 0")
    names = "filter(flatten(transform(t, x -> split(trim(coalesce(x.typeof, '')), '\\\\s+'))), x -> x <> '')"
    return tags.select(
        "page_id",
        F.expr("size(filter(t, x -> x.typeof IS NOT NULL))").alias("n_typeof"),
        F.expr("size(filter(t, x -> x.property IS NOT NULL))").alias("n_property"),
        F.expr(f"array_join(array_sort(array_distinct({names})), ',')").alias("types"),
    )


_CRITICAL = "array(" + ", ".join(lit(t) for t in CRITICAL_TYPES) + ")"
_PAGE_TYPES = "array_distinct(flatten(transform(items, i -> i.types)))"
_MISSING = f"array_except({_CRITICAL}, {_PAGE_TYPES})"


def missing_schemas(df: DataFrame) -> DataFrame:
    """Critical types a page does not carry."""
    return explode_rows(with_jsonld(df), ["page_id"], F.expr(_MISSING), "schema")


def schema_completeness(df: DataFrame) -> DataFrame:
    """Present against expected properties per item, type and level."""
    table = ", ".join(
        struct(type=lit(t), level=lit(level), expected="array(" + ", ".join(lit(p) for p in props) + ")")
        for t, levels in REQUIREMENTS.items()
        for level, props in levels.items()
    )
    rows = posexplode_rows(with_jsonld(df), ["page_id"], "items", "item", "i")
    out = struct(type="r.type", level="r.level", n_present="size(array_intersect(r.expected, i.keys))", n_expected="size(r.expected)")
    checks = f"transform(filter(array({table}), r -> array_contains(i.types, r.type)), r -> {out})"
    found = inline_rows(rows, ["page_id", "item"], F.expr(checks), "type")
    return found.withColumn("ratio", F.col("n_present") / F.col("n_expected"))


def schema_nesting(df: DataFrame) -> DataFrame:
    """Nested objects without a type, by the property that holds them."""
    rows = posexplode_rows(with_jsonld(df), ["page_id"], "items", "item", "i")
    return explode_rows(rows, ["page_id", "item"], "i.untyped", "property")


def structured_facts(df: DataFrame) -> DataFrame:
    """Adds ``sd``: everything the structured-data score and issues need."""
    invalid = f"size(filter(jsonld, b -> NOT {VALID_JSON.format('b')}))"
    other = markup.raw_tags_sql("html", markup.ANY_TAG, r"(?i)\s(?:itemscope|typeof)[\s=/>]")
    sd = struct(
        n_blocks="size(jsonld)", n_invalid=invalid, n_items="size(items)", missing=_MISSING,
        n_untyped="size(flatten(transform(items, i -> i.untyped)))", n_other=f"size({other})",
    )
    had = set(df.columns)
    return (df if "items" in had else with_jsonld(df)).withColumn("sd", F.expr(sd))


def structured_score() -> Column:
    """40 for items (20 for Microdata or RDFa only), 10 per critical type, 20 when all is in order."""
    return F.expr(
        "CASE WHEN sd.n_items > 0 THEN 40 WHEN sd.n_other > 0 THEN 20 ELSE 0 END"
        f" + 10 * ({len(CRITICAL_TYPES)} - size(sd.missing))"
        " + if(sd.n_items > 0 AND sd.n_invalid = 0 AND sd.n_untyped = 0, 20, 0)"
    )


def structured_issues(brief: bool = False) -> Column:
    s = issues.seed
    none = s("sd_none", "201", when="sd.n_items = 0 AND sd.n_other = 0", brief=brief)
    invalid = s("sd_jsonld_invalid", "202", when="sd.n_invalid > 0", args={"n": "sd.n_invalid"}, brief=brief)
    missing = s("sd_missing", "203", severity="if(x = 'FAQPage', 'high', 'medium')", key="x", args={"type": "x"}, brief=brief)
    nesting = s("sd_nesting", "204", when="sd.n_untyped > 0", args={"n": "sd.n_untyped"}, brief=brief)
    seeds = f"array_compact(concat(array({none}, {invalid}), transform(sd.missing, x -> {missing}), array({nesting})))"
    return F.expr(issues.render(seeds, brief))
