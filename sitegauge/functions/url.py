"""URL parts by regex: never null or failing on odd input, unlike the strict URL parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit, struct

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
_EDGE = "".join(chr(i) for i in range(0x21))


def _clean(url: Column) -> Column:
    return F.translate(F.ltrim(url, F.lit(_EDGE)), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _PARTS, 1))


def netloc(url: Column) -> Column:
    """Authority part as written: user info and port stay."""
    return F.regexp_extract(_clean(url), _PARTS, 2)


def written_origin(url: Column) -> Column:
    """``scheme://netloc`` with the authority as written."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def origin(url: Column) -> Column:
    """The key under which site files are kept: lower-cased authority, without a default port.

    Pages and site files are both keyed by it, so spellings of one server meet.
    """
    plain = F.regexp_replace(F.lower(written_origin(url)), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.regexp_replace(plain, r":$", "")


def host(url: Column) -> Column:
    """Lower-cased host without user info and port."""
    return F.regexp_extract(F.lower(netloc(url)), r"^(?:[^@]*@)?([^:]*)", 1)


def path(url: Column) -> Column:
    """Path plus query, ``/`` when there is none: what a robots rule is held against."""
    whole = F.concat(F.regexp_extract(_clean(url), _PARTS, 3), F.regexp_extract(_clean(url), _PARTS, 4))
    return F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))


# A reference in its parts: scheme, authority with its slashes, authority, path, query, fragment.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_DOT, _DOTS = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
_FOLDABLE = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _split(text: str) -> str:
    trimmed = f"translate(trim(BOTH {lit(_EDGE)} FROM {text}), '\\t\\r\\n', '')"
    fields = zip(("scheme", "slashes", "authority", "path", "query", "fragment"), range(1, 7), strict=True)
    return _let("w", trimmed, struct(**{f: f"regexp_extract(w, {lit(_REFERENCE)}, {i})" for f, i in fields}))


def fold_dots_sql(path: str) -> str:
    """SQL: a rooted path with its dot segments folded over a stack of the parts before them; ``%2e`` is a dot."""
    push = f"CASE WHEN s RLIKE {lit(_DOT)} THEN q WHEN s RLIKE {lit(_DOTS)} THEN slice(q, 1, greatest(size(q) - 1, 0)) ELSE concat(q, array(s)) END"
    ends_in_dots = rf"(?i)/(?:\.|%2e){{1,2}}$"
    written = f"concat('/', array_join(q, '/'), if(size(q) > 0 AND {path} RLIKE {lit(ends_in_dots)}, '/', ''))"
    folded = f"aggregate(split(substring({path}, 2), '/'), CAST(array() AS ARRAY<STRING>), (q, s) -> {push}, q -> {written})"
    return f"if(startswith({path}, '/') AND {path} RLIKE {lit(_FOLDABLE)}, {folded}, {path})"


def _authority(scheme: str, written: str) -> str:
    """SQL: user info as written, host in lower case, without a default port or an empty one."""
    lower = f"concat(regexp_extract({written}, '^(.*@)?', 0), lower(regexp_replace({written}, '^.*@', '')))"
    port = f"CASE {scheme} WHEN 'http' THEN ':(?:80)?$' WHEN 'https' THEN ':(?:443)?$' ELSE ':$' END"
    return f"regexp_replace({lower}, {port}, '')"


def resolve_sql(reference: str, base: str) -> str:
    """SQL: the absolute, normal form of ``reference`` found on the page at ``base``; null if the reference is null.

    The public rules for relative references: an empty one is the page itself, ``?q`` keeps its path,
    a relative path replaces what follows the page's last slash, dot segments are folded. Scheme and host come out in lower
    case, default ports go, an empty path after a host is ``/``. A missing base counts as empty.
    References with a scheme but neither host nor rooted path (mail addresses) stay as they are.
    """
    r, b = "x.r", "x.b"
    own = f"{r}.scheme <> '' OR {r}.slashes <> ''"
    merged = f"if({b}.slashes <> '' AND {b}.path = '', concat('/', {r}.path), concat(regexp_extract({b}.path, '(?s)^(.*/)?', 0), {r}.path))"
    path = f"CASE WHEN {own} THEN {r}.path WHEN {r}.path = '' THEN {b}.path WHEN startswith({r}.path, '/') THEN {r}.path ELSE {merged} END"
    query = f"if(NOT ({own}) AND {r}.path = '' AND {r}.query = '', {b}.query, {r}.query)"
    target = struct(
        scheme=f"lower(if({r}.scheme <> '', {r}.scheme, {b}.scheme))", slashes=f"if({own}, {r}.slashes, {b}.slashes)",
        authority=f"if({own}, {r}.authority, {b}.authority)", path=path, rest=f"concat({query}, {r}.fragment)",
    )
    rooted = "if(t.slashes <> '' AND t.path = '', '/', t.path)"
    written = (
        f"concat(if(t.scheme <> '', concat(t.scheme, ':'), ''), if(t.slashes <> '', concat('//', {_authority('t.scheme', 't.authority')}), ''), "
        f"{_let('p', rooted, fold_dots_sql('p'))}, t.rest)"
    )
    both = struct(r=_split(reference), b=_split(f"coalesce({base}, '')"))
    return f"if({reference} IS NULL, NULL, {_let('x', both, _let('t', target, written))})"


def resolve(reference: str, base: str) -> Column:
    """``resolve_sql`` of two columns."""
    return F.expr(resolve_sql(reference, base))


def address(url: str) -> Column:
    """The key under which a page is known: the normal form of its address, without the fragment."""
    return F.expr(f"substring_index({resolve_sql(url, lit(''))}, '#', 1)")
