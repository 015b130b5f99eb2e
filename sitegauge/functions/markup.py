"""Tags and attributes from html as array columns, without a tree and without a shuffle.

One regex walks the html once. Comments, scripts and style sheets are tokens of their own,
so nothing inside them is taken for a tag. All repeated groups are possessive: a page of any
size is matched without recursion. Every pattern starts with a literal ``<``, which lets the
matcher skip text quickly, and ends at the end of the page as well: what is never closed is walked
over once, as one token, and dropped afterwards, so work grows in proportion to the page.

Arguments named ``html``, ``clean`` and ``head`` are column names or SQL expressions. A null page
counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit, struct
from sitegauge.functions.text import strip_sql, unescape_sql

_SKIP = (
    r"!--.*?(?:-->|\z)"
    r"|(?i:script)(?=[\s/>])[^>]*+(?:>.*?(?:</(?i:script)\s*+>|\z)|\z)"
    r"|(?i:style)(?=[\s/>])[^>]*+(?:>.*?(?:</(?i:style)\s*+>|\z)|\z)"
)
# Inside a tag a quote opens a value only right after an equals sign.
_INNER = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
_ATTR = r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
NOT_CONTENT = rf"(?s)<(?:{_SKIP})"
_JSONLD = r"""(?is)^<script\s[^>]*type\s*=\s*["']?application/ld\+json[\s"'>/]"""
_SPACES = r"[\s\x{a0}]+"
ANY_TAG = "[a-z][a-z0-9:-]*+"
HEAD_FIELDS = ("name", "property", "content", "rel", "href")
HEAD_TYPE = "array<struct<el:string," + ",".join(f"{f}:string" for f in HEAD_FIELDS) + ">>"


def raw_tags_sql(html: str, names: str = ANY_TAG, where: str | None = None) -> str:
    pattern = rf"(?s)<(?:{_SKIP}|(?i:{names})(?:[\s/]{_INNER})?+(?:>|\z))"
    keep = f"endswith(t, '>') AND NOT (startswith(t, '<!') OR t RLIKE {lit('(?i)^<(?:script|style)[' + chr(92) + 's/>]')})"
    found = f"filter(regexp_extract_all(coalesce({html}, ''), {lit(pattern)}, 0), t -> {keep})"
    if not where:
        return found
    # A page without the attribute anywhere needs no walk over its tags.
    found = f"filter({found}, t -> t RLIKE {lit(where)})"
    return f"CASE WHEN {html} RLIKE {lit(where)} THEN {found} ELSE CAST(array() AS ARRAY<STRING>) END"


def raw_tags(html: str, names: str = ANY_TAG) -> Column:
    """Opening tags with these names (a regex alternation), as written, in document order."""
    return F.expr(raw_tags_sql(html, names))


def parsed_tags_sql(raw: str) -> str:
    """``array<struct<el, attrs: array<struct<k, v>>>>``; names in lower case, values unquoted."""
    value = "p.v"
    unquoted = f"CASE WHEN left({value}, 1) IN ('\"', '\\'') THEN substring({value}, 2, length({value}) - 2) ELSE {value} END"
    cut = struct(el=r"lower(regexp_extract(t, '^<([^\\s/>]+)', 1))", inner=r"regexp_extract(t, '(?s)^<[^\\s/>]+(.*)>$', 1)")
    parts = struct(el="t.el", k=f"regexp_extract_all(t.inner, {lit(_ATTR)}, 1)", v=f"regexp_extract_all(t.inner, {lit(_ATTR)}, 2)")
    pairs = f"zip_with(t.k, t.v, (k, v) -> {struct(k='lower(k)', v='v')})"
    plain = f"transform({pairs}, p -> {struct(k='p.k', v=unquoted)})"
    attrs = f"transform({plain}, p -> {struct(k='p.k', v=unescape_sql('p.v'))})"
    return (
        f"transform(transform(transform({raw}, t -> {cut}), t -> {parts}), t -> {struct(el='t.el', attrs=attrs)})"
    )


def attr_sql(tag: str, name: str) -> str:
    """Value of an attribute of a parsed tag; the last one counts, null if there is none."""
    return f"try_element_at(filter({tag}.attrs, a -> a.k = {lit(name)}), -1).v"


def project_tags_sql(html: str, names: str, fields: tuple | list, where: str | None = None) -> str:
    """Tags as ``array<struct<el, field...>>``: the narrow form that operators work on.

    ``where`` is an unanchored regex a raw tag must match before its attributes are read at all.
    """
    columns = {f.replace("-", "_"): attr_sql("t", f) for f in fields}
    return f"transform({parsed_tags_sql(raw_tags_sql(html, names, where))}, t -> {struct(el='t.el', **columns)})"


def project_tags(html: str, names: str, fields: tuple | list, where: str | None = None) -> Column:
    return F.expr(project_tags_sql(html, names, fields, where))


def head_tags(html: str = "html") -> Column:
    """``meta`` and ``link`` tags with the attributes the audits read."""
    return project_tags(html, "meta|link", HEAD_FIELDS)


def meta_first_sql(name: str, head: str = "head") -> str:
    """First ``meta`` tag of that name, ignoring case; null if there is none. ``name`` is SQL."""
    return f"get(filter({head}, t -> t.el = 'meta' AND lower(t.name) = {name}), 0)"


def has_token_sql(value: str, token: str) -> str:
    """Whether a blank-separated list such as ``rel`` holds a token exactly."""
    return f"array_contains(split({strip_sql(value)}, '\\\\s+'), {lit(token)})"


def link_first_sql(rel: str, head: str = "head") -> str:
    """First ``link`` tag with that exact token in ``rel``."""
    return f"get(filter({head}, t -> t.el = 'link' AND {has_token_sql('t.rel', rel)}), 0)"


def clean_html(html: str = "html") -> Column:
    """Html without comments, scripts and style sheets."""
    return F.regexp_replace(F.coalesce(F.expr(html), F.lit("")), NOT_CONTENT, " ")


def outermost_sql(clean: str, name: str, first: bool = False) -> str:
    """What the elements of that name hold, nested ones included; of the first one only if ``first``, else joined by blanks.

    A running balance of opening and closing tags says where an outermost element ends; a closing tag without an opening one
    is passed over. If the balance does not come back, the element ends at the page's last closing tag; elements behind that are never
    closed and hold nothing. Tags are taken in blocks, so that a page of very many costs no more than its share.
    """
    token = lit(rf"(?is)<{name}(?:\s[^>]*+)?+(?:>|\z)|</{name}\s*+>")
    closing = rf"(?i)</{name}\s*+>"
    last = "size(t) + 1 - array_position(reverse(transform(t, x -> startswith(x, '</'))), true)"
    depth = "CASE WHEN startswith(w.t[i], '</') THEN greatest(a.depth - 1, 0) WHEN endswith(w.t[i], '>') THEN a.depth + 1 ELSE a.depth END"
    text = "if(a.depth > 0 AND d > 0, concat(w.t[i], w.p[i + 1]), if(d > 0, concat(' ', w.p[i + 1]), ''))"
    wanted = "i < w.n - 1 AND a.closed = 0" if first else "i < w.n - 1"
    step = f"get(transform(array({depth}), d -> {struct(depth='d', closed='a.closed + if(a.depth > 0 AND d = 0, 1, 0)', parts=f'if({wanted}, concat(a.parts, array({text})), a.parts)')}), 0)"
    none = "CAST(array() AS ARRAY<STRING>)"
    block = f"aggregate(sequence(b * 256, least(b * 256 + 255, w.n - 1)), {struct(depth='q.depth', closed='q.closed', parts=none)}, (a, i) -> {step})"
    joined = struct(depth="r.depth", closed="r.closed", out="concat(q.out, array(array_join(r.parts, '')))")
    added = f"get(transform(array({block}), r -> {joined}), 0)"
    whole = f"aggregate(sequence(0, (w.n - 1) div 256), {struct(depth='0', closed='0', out=none)}, (q, b) -> {added}, q -> array_join(q.out, ''))"
    tags = f"get(transform(array(regexp_extract_all({clean}, {token}, 0)), t -> {struct(t='t', n=f'CAST({last} AS INT)', p=f'split({clean}, {token}, -1)')}), 0)"
    return f"if({clean} RLIKE {lit(closing)}, get(transform(array({tags}), w -> {whole}), 0), '')"


def element_names(clean: str = "clean") -> Column:
    """Lower-cased names of all opening tags, in order."""
    return F.expr(f"transform(regexp_extract_all({clean}, '<([A-Za-z][A-Za-z0-9]*+)', 1), t -> lower(t))")


def visible_text_sql(clean: str) -> str:
    """Text between tags, white space collapsed. A tag that is never closed takes the rest with it."""
    text = f"regexp_replace({clean}, {lit('</?[A-Za-z!][^>]*+(?:>|' + chr(92) + 'z)')}, ' ')"
    collapsed = f"trim(regexp_replace({unescape_sql('x')}, {lit(_SPACES)}, ' '))"
    return f"get(transform(array({text}), x -> {collapsed}), 0)"


def jsonld_blocks(html: str = "html") -> Column:
    """Bodies of JSON-LD scripts that are not commented out."""
    tokens = f"filter(regexp_extract_all(coalesce({html}, ''), {lit(NOT_CONTENT)}, 0), t -> t RLIKE {lit(_JSONLD)})"
    body = "regexp_replace(t, " + lit(r"(?is)^<script[^>]*+>|</script\s*+>$") + ", '')"
    return F.expr(f"transform({tokens}, t -> {strip_sql(body)})")
