"""Items of Microdata and RDFa with their properties, values and parents.

One walk over a page gives its opening and closing tags; a stack of open elements, folded over them, says which item an element
belongs to and where it ends. Everything stays in the page's row, so there is no shuffle and it runs on a stream as well.

Definitions. Only elements of the names that carry markup are followed, so unclosed paragraphs or cells do no harm. A closing tag ends
the last open element of its name and all that were opened in it; without such an element it is passed over; what is never closed ends
with the page; elements are nested 512 deep at most, deeper ones stand beside each other. An item is an element with ``itemscope`` (``typeof``); items are numbered in document order. A property belongs to the
nearest item around its element, several names in one attribute are several properties. An item that is a property's value is a ``child``
there and has that item as ``parent``; otherwise it has none. Microdata properties outside of any item are passed over, those
of RDFa describe the page itself (``item`` null). ``itemref`` and prefixes are not followed, addresses are left as written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import markup
from sitegauge.functions.rows import inline_rows
from sitegauge.functions.sqltext import lit, struct

# Elements without an end, and the attribute that holds a property's value instead of the text.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
VALUE_ATTRIBUTES = {
    "content": ("meta",),
    "src": ("audio", "embed", "iframe", "img", "source", "track", "video"),
    "href": ("a", "area", "link"),
    "data": ("object",),
    "value": ("data", "meter"),
}


class Syntax(NamedTuple):
    scope: str
    type: str
    property: str
    fields: tuple[str, ...]
    value: str
    outside: bool


def _microdata_value() -> str:
    cases = " ".join(
        f"WHEN e.el IN ({', '.join(map(lit, names))}) THEN coalesce(e.{field}, '')" for field, names in VALUE_ATTRIBUTES.items()
    )
    return f"CASE {cases} WHEN e.el = 'time' THEN e.datetime END"


MICRODATA = Syntax("itemscope", "itemtype", "itemprop", ("itemscope", "itemtype", "itemprop", *VALUE_ATTRIBUTES, "datetime"), _microdata_value(), False)
RDFA = Syntax(
    "typeof", "typeof", "property", ("typeof", "property", "content", "datetime", "resource", "href", "src"),
    "coalesce(e.content, if(e.el = 'time', e.datetime, NULL), e.resource, e.href, e.src)", True,
)

_BLOCK = 256
DEPTH = 512  # as deep as browsers nest elements
_STACK = "CAST(array() AS ARRAY<STRUCT<el: STRING, item: INT, at: INT>>)"
_EVENTS = "CAST(array() AS ARRAY<STRUCT<at: INT, closing: BOOLEAN, owner: INT, item: INT, stop: INT>>)"
_VOID = "array(" + ", ".join(map(lit, VOID)) + ")"


def _words(text: str) -> str:
    return f"array_distinct(filter(split(trim(regexp_replace(coalesce({text}, ''), '\\\\s+', ' ')), ' '), x -> x <> ''))"


def _fold() -> str:
    """SQL: events of the marked elements in ``k``, one where an element opens and one where it ends, by a stack of open elements."""
    last = "(size(a.stack) + 1 - array_position(reverse(transform(a.stack, s -> s.el)), e.el))"
    none = "CAST(NULL AS INT)"
    ended = "transform(filter({0}, s -> s.at >= 0), s -> " + struct(at="s.at", closing="true", owner=none, item=none, stop="e.i") + ")"
    closing = struct(stack=f"slice(a.stack, 1, {last} - 1)", n="a.n", out=f"concat(a.out, {ended.format(f'slice(a.stack, {last}, size(a.stack))')})")
    # beyond the greatest depth an element takes the place of the innermost one
    room = f"slice(a.stack, 1, {DEPTH - 1})"
    full = ended.format(f"slice(a.stack, {DEPTH}, 1)")
    inner = f"try_element_at({room}, -1).item"
    entry = struct(el="e.el", item=f"if(e.scope, a.n, {inner})", at="if(e.marked, e.i, -1)")
    event = struct(at="e.i", closing="false", owner=inner, item=f"if(e.scope, a.n, {none})", stop=f"if(e.void, e.i, {none})")
    opening = struct(
        stack=f"if(e.void, a.stack, concat({room}, array({entry})))", n="a.n + if(e.scope, 1, 0)",
        out=f"concat(a.out, if(e.void, {_EVENTS}, {full}), if(e.marked, array({event}), {_EVENTS}))",
    )
    step = f"get(transform(array(k[i]), e -> if(e.way < 0, {closing}, {opening})), 0)"
    start = struct(stack="q.stack", n="q.n", out=_EVENTS)
    block = f"aggregate(sequence(b * {_BLOCK}, least(b * {_BLOCK} + {_BLOCK - 1}, size(k) - 1)), {start}, (a, i) -> {step})"
    added = struct(stack="r.stack", n="r.n", out="concat(q.out, array(r.out))")
    zero = struct(stack=_STACK, n="0", out="CAST(array() AS ARRAY<" + _EVENTS.split(" AS ")[1][:-1] + ">)")
    return f"aggregate(sequence(0, (size(k) - 1) div {_BLOCK}), {zero}, (q, b) -> get(transform(array({block}), r -> {added}), 0), q -> flatten(q.out))"


def with_items(df: DataFrame, syntax: Syntax) -> DataFrame:
    """(page_id, e, items) of pages that use the syntax: marked elements in order, with owner, own item, names and value; items with type and parent."""
    where = rf"(?i)\s(?:{syntax.scope}|{syntax.property})[\s=/>]"
    token = lit(rf"(?s)<(?:{markup._SKIP}|/?+(?i:{markup.ANY_TAG})(?:[\s/]{markup._INNER})?+(?:>|\z))")
    pages = df.filter(F.col("html").rlike(where))
    cut = pages.select("page_id", F.expr(f"regexp_extract_all(html, {token}, 0)").alias("t"), F.expr(f"split(html, {token}, -1)").alias("p"))
    junk = f"startswith(x, '<!') OR x RLIKE {lit(r'(?i)^<(?:script|style)[' + chr(92) + 's/>]')} OR NOT endswith(x, '>')"
    way = f"CASE WHEN {junk} THEN 0 WHEN startswith(x, '</') THEN -1 ELSE 1 END"
    tags = struct(i="i", way=way, el=r"lower(regexp_extract(x, '^</?([^\\s/>]+)', 1))", raw="x")
    cut = cut.withColumn("m", F.expr(f"filter(transform(t, (x, i) -> {tags}), x -> x.way <> 0)"))
    has = lambda name: f"(x.way > 0 AND x.raw RLIKE {lit(rf'(?i)\s(?:{name})[\s=/>]')})"
    marked = struct(
        i="x.i", way="x.way", el="x.el", raw="x.raw", void=f"array_contains({_VOID}, x.el)", marked=has(f"{syntax.scope}|{syntax.property}"),
    )
    cut = cut.withColumn("m", F.expr(f"transform(m, x -> {marked})"))
    names = "array_distinct(transform(filter(m, x -> x.marked AND NOT x.void), x -> x.el))"
    # bound by a lambda: a column of its own would be merged into the filter and worked out for every tag
    cut = cut.withColumn("m", F.expr(f"get(transform(array({names}), names -> filter(m, x -> x.marked OR array_contains(names, x.el))), 0)"))
    fields = struct(el="t.el", **{f: markup.attr_sql("t", f) for f in syntax.fields})
    read = f"transform({markup.parsed_tags_sql('transform(m, x -> if(x.marked, x.raw, ' + lit('<x>') + '))')}, t -> {fields})"
    cut = cut.withColumn("f", F.expr(read))
    # quoted values may hold what looks like an attribute: only the parsed attributes make an item
    k = struct(i="x.i", way="x.way", el="x.el", void="x.void", marked="x.marked", scope=f"x.marked AND f.{syntax.scope} IS NOT NULL")
    cut = cut.withColumn("k", F.expr(f"zip_with(m, f, (x, f) -> {k})"))
    cut = cut.withColumn("f", F.expr("transform(filter(zip_with(k, f, (x, f) -> struct(x.marked AS marked, f AS f)), x -> x.marked), x -> x.f)"))
    cut = cut.withColumn("ev", F.expr(f"array_sort({_fold()})"))
    stop = "if(get(ev, i + 1).closing AND get(ev, i + 1).at = v.at, get(ev, i + 1).stop, coalesce(v.stop, size(t)))"
    opened = struct(at="v.at", owner="v.owner", item="v.item", stop=stop, closing="v.closing")
    cut = cut.withColumn("ev", F.expr(f"filter(transform(ev, (v, i) -> {opened}), v -> NOT v.closing)"))
    text = f"trim(regexp_replace({markup.unescape_sql('x')}, {lit(markup._SPACES)}, ' '))"
    text = f"get(transform(array(array_join(slice(p, e.at + 2, greatest(e.stop - e.at, 0)), ' ')), x -> {text}), 0)"
    value = f"CASE WHEN e.item IS NOT NULL OR e.{syntax.property} IS NULL THEN NULL ELSE coalesce({syntax.value}, {text}) END"
    both = struct(at="v.at", owner="v.owner", item="v.item", stop="v.stop", **{f: f"f.{f}" for f in ("el", *syntax.fields)})
    full = struct(
        at="e.at", owner="e.owner", item="e.item", props=_words(f"e.{syntax.property}"),
        type=f"nullif(array_join({_words('e.' + syntax.type)}, ' '), '')", value=value,
    )
    cut = cut.withColumn("e", F.expr(f"transform(zip_with(ev, f, (v, f) -> {both}), e -> {full})"))
    item = struct(type="x.type", parent="if(size(x.props) > 0, x.owner, NULL)")
    return cut.select("page_id", "e", F.expr(f"transform(filter(e, x -> x.item IS NOT NULL), x -> {item})").alias("items"))


def item_properties(df: DataFrame, syntax: Syntax) -> DataFrame:
    """(page_id, item, type, parent, pos, property, value, child): one row per property, and one with a null property per item without any.

    ``pos`` numbers the properties of a page in document order; ``value`` is null where the value is the item ``child``.
    """
    kept = "true" if syntax.outside else "x.owner IS NOT NULL"
    flat = "flatten(transform(filter(e, x -> {0}), x -> transform(x.props, n -> {1})))".format(
        kept, struct(item="x.owner", property="n", value="x.value", child="x.item")
    )
    found = with_items(df, syntax).withColumn("r", F.expr(flat))
    out = struct(item="x.item", type="get(items, x.item).type", parent="get(items, x.item).parent", pos="i", property="x.property", value="x.value", child="x.child")
    bare = struct(item="i", type="get(items, i).type", parent="get(items, i).parent", pos="CAST(NULL AS INT)", property="CAST(NULL AS STRING)", value="CAST(NULL AS STRING)", child="CAST(NULL AS INT)")
    all_items = "if(size(items) = 0, CAST(array() AS ARRAY<INT>), sequence(0, size(items) - 1))"
    empty = f"transform(array_except({all_items}, transform(r, x -> x.item)), i -> {bare})"
    rows = F.expr(f"transform(concat(transform(r, (x, i) -> {out}), {empty}), x -> named_struct('row', true, 'x', x))")
    return inline_rows(found, ["page_id"], rows, "row").select("page_id", "x.*")


def microdata_properties(df: DataFrame) -> DataFrame:
    return item_properties(df, MICRODATA)


def rdfa_properties(df: DataFrame) -> DataFrame:
    return item_properties(df, RDFA)
