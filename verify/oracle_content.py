"""DuckDB statements for structured data, content and attribution."""

from __future__ import annotations

import re

from sitegauge.sources import overlay as ov
from verify.oracle_core import ATTR, BARE, INNER, SKIP, strip, tag_pattern, unescape, unquote
from verify.sqlkit import PARTS, oracle, part

# The library's own tables, stated here once more so that a slip there shows.
CRITICAL_TYPES = ('FAQPage', 'HowTo', 'Article', 'Organization')
REQUIREMENTS = {'Article': {'required': ('headline', 'author', 'datePublished'),
             'optional': ('image', 'dateModified', 'publisher'),
             'ai_critical': ('author', 'datePublished', 'dateModified')},
 'FAQPage': {'required': ('mainEntity',), 'optional': ('name',), 'ai_critical': ('mainEntity',)},
 'HowTo': {'required': ('name', 'step'), 'optional': ('image', 'totalTime'), 'ai_critical': ('step',)},
 'Organization': {'required': ('name', 'url'),
                  'optional': ('logo', 'sameAs'),
                  'ai_critical': ('sameAs', 'description')}}
CREDENTIALS = ('PhD', 'Ph.D.', 'Dr.', 'Prof.', 'M.D.', 'MSc', 'MBA', 'Dipl.-Ing.', 'Docteur', 'Conf. univ.')
SOCIAL = ('og:title', 'og:description', 'og:image', 'og:url', 'twitter:card')
PRIVACY, TERMS, CONTACT = '(?i)privacy|datenschutz|confidentialit', '(?i)terms|agb|conditions', '(?i)contact|kontakt|impressum'


def vis(x: str) -> str:
    plain = f"regexp_replace({x}, '</?[A-Za-z!][^>]*(?:>|\\z)', ' ', 'g')"
    return f"trim(regexp_replace({unescape(plain)}, '[\\s\\x{{a0}}]+', ' ', 'g'), ' ')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


WORD = r"[\p{L}\p{N}]+"


def words(text: str) -> str:
    return count(text, WORD)


def tag_parts(prefix: str, names: str, where: str, fields: str) -> None:
    """Parts <prefix>: page_id, tpos, el and one column per attribute."""
    part(f"{prefix}raw", f"""SELECT page_id, tpos, tag FROM (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS tpos
 FROM (SELECT page_id, list_filter(regexp_extract_all(html, '{tag_pattern(names)}'),
  lambda t: ends_with(t, '>') AND NOT starts_with(t, '<!') AND NOT regexp_matches(t, '(?i)^<(?:script|style)[\\s/>]')
   AND regexp_matches(t, '{where}')) AS l FROM pg))""")
    part(f"{prefix}attr", f"""SELECT page_id, tpos, lower(k) AS k, arg_max({unescape(unquote(BARE))}, apos) AS v FROM
 (SELECT page_id, tpos, unnest(regexp_extract_all(body, '{ATTR}', 1)) AS k, unnest(regexp_extract_all(body, '{ATTR}', 2)) AS v,
  generate_subscripts(regexp_extract_all(body, '{ATTR}', 1), 1) AS apos FROM
  (SELECT page_id, tpos, regexp_extract(tag, '(?s)^<[^\\s/>]+(.*)>$', 1) AS body FROM {prefix}raw)) GROUP BY 1, 2, 3""")
    cols = ", ".join(f"max(v) FILTER (WHERE k = '{f}') AS {f}" for f in fields.split())
    part(prefix, f"""SELECT t.page_id, t.tpos, lower(regexp_extract(any_value(t.tag), '^<([^\\s/>]+)', 1)) AS el, {cols}
 FROM {prefix}raw t LEFT JOIN {prefix}attr a ON a.page_id = t.page_id AND a.tpos = t.tpos GROUP BY 1, 2""")


ANY = "[a-z][a-z0-9:-]*"
tag_parts("mdtags", ANY, r"(?i)\s(?:itemscope|itemtype|itemprop)[\s=/>]", "itemscope itemtype itemprop")
tag_parts("rdtags", ANY, r"(?i)\s(?:typeof|property)[\s=/>]", "typeof property")
tag_parts("anchors", "a", r"(?i)\shref\s*=", "href rel")
tag_parts("marked", ANY, r"(?i)\s(?:itemprop|datetime)\s*=", "itemprop datetime")
tag_parts("htmltags", "html", "", "lang")

# ---- JSON-LD ------------------------------------------------------------------------------
part("blocks", f"""SELECT page_id, pos, {strip("regexp_replace(t, '(?is)^<script[^>]*>|</script\\s*>$', '', 'g')")} AS block
 FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, list_filter(
  regexp_extract_all(html, '(?s)<(?:{SKIP})'),
  lambda t: regexp_matches(t, '(?is)^<script\\s[^>]*type\\s*=\\s*["'']?application/ld\\+json[\\s"''>/]')) AS l FROM pg))""")
part("parsedblocks", "SELECT page_id, pos, block::JSON AS j FROM blocks WHERE json_valid(block)")
part("ldraw", """SELECT page_id, pos, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
  WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') ELSE [j] END) AS i,
 generate_subscripts(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
  WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') ELSE [j] END, 1) AS sub FROM parsedblocks""")
part("lditems", "SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY pos, sub) - 1 AS item FROM ldraw")
part("ldtypes", """SELECT page_id, item, i, regexp_replace(type, '^(?:https?://schema[.]org/|schema:)', '') AS type FROM (SELECT page_id, item, i, unnest(CASE WHEN json_type(i, '$."@type"') = 'ARRAY'
 THEN json_extract_string(i, '$."@type"[*]') ELSE [json_extract_string(i, '$."@type"')] END) AS type FROM lditems) WHERE type IS NOT NULL""")
part("ldkeys", "SELECT page_id, item, i, unnest(json_keys(i)) AS k FROM lditems WHERE json_type(i) = 'OBJECT'")
part("critical", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {n})" for n, t in enumerate(CRITICAL_TYPES)) + ") t(schema, sord)")
part("missing", """SELECT p.page_id, c.schema, c.sord FROM pg p CROSS JOIN critical c
 ANTI JOIN ldtypes t ON t.page_id = p.page_id AND t.type = c.schema""")
part("wanted", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{level}', '{p}')" for t, levels in REQUIREMENTS.items() for level, props in levels.items() for p in props
) + ") t(type, level, prop)")
part("nested1", """SELECT page_id, item, k AS property, unnest(CASE WHEN json_type(i, '$."' || k || '"') = 'ARRAY' THEN CAST(json_extract(i, '$."' || k || '"') AS JSON[])
 ELSE [json_extract(i, '$."' || k || '"')] END) AS v FROM ldkeys""")
part("keys2", """SELECT page_id, item, property, v, unnest(json_keys(v)) AS k FROM nested1 WHERE json_type(v) = 'OBJECT'""")
part("nested2", """SELECT page_id, item, property || '.' || k AS property, unnest(CASE WHEN json_type(v, '$."' || k || '"') = 'ARRAY'
 THEN CAST(json_extract(v, '$."' || k || '"') AS JSON[]) ELSE [json_extract(v, '$."' || k || '"')] END) AS v FROM keys2""")
part("ldnodes", """SELECT page_id, item, '' AS property, i AS v FROM lditems UNION ALL SELECT * FROM nested1 UNION ALL SELECT * FROM nested2""")
part("ldobjects", """SELECT page_id, item, property, v, json_extract_string(v, '$."@id"') AS id, json_type(v, '$."@type"') AS typed FROM ldnodes WHERE json_type(v) = 'OBJECT'""")
part("ldknown", """SELECT page_id, id, unnest(CASE WHEN typed = 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [json_extract_string(v, '$."@type"')] END) AS type
 FROM ldobjects WHERE id IS NOT NULL AND typed IS NOT NULL""")
part("untyped", """SELECT DISTINCT o.page_id, item, property FROM ldobjects o ANTI JOIN ldknown k ON k.page_id = o.page_id AND k.id = o.id
 WHERE property <> '' AND typed IS NULL""")
part("ldrefs", """SELECT o.page_id, item, property, o.id, count(k.id) > 0 AS resolved,
 coalesce(string_agg(DISTINCT regexp_replace(k.type, '^(?:https?://schema[.]org/|schema:)', ''), ','
  ORDER BY regexp_replace(k.type, '^(?:https?://schema[.]org/|schema:)', '')), '') AS types
 FROM (SELECT *, row_number() OVER () AS n FROM ldobjects WHERE property <> '' AND typed IS NULL AND id IS NOT NULL) o
 LEFT JOIN ldknown k ON k.page_id = o.page_id AND k.id = o.id GROUP BY o.n, o.page_id, item, property, o.id""")
# the same over pages whose nodes refer to each other
part("refpg", f"SELECT page_id, concat({ov.REFERENCES}, coalesce(html, '')) AS html FROM pages")
LD_PARTS = "blocks parsedblocks ldraw lditems ldkeys nested1 keys2 nested2 ldnodes ldobjects ldknown untyped ldrefs".split()
for _name in LD_PARTS:
    part("ref" + _name, re.sub(r"\b(FROM|JOIN) (pg|" + "|".join(LD_PARTS) + r")\b", r"\1 ref\2", PARTS[_name]))

# ---- content --------------------------------------------------------------------------------
part("cl", f"SELECT page_id, url, html, regexp_replace(html, '(?s)<(?:{SKIP})', ' ', 'g') AS clean FROM pg")
# Cut before every heading at a character that no text holds.
CUT = "chr(57344) || chr(57345)"
HS = "(?is)^<h[1-6][^>]*>(.*?)(?:</h[1-6]\\s*>|\\z)"


def headed(source: str, column: str) -> str:
    """Pieces (page_id, pos, p) of a text that begin with a heading."""
    return f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, p FROM (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS n
 FROM (SELECT page_id, string_split(regexp_replace({column}, '(?i)<(h[1-6][\\s>])', {CUT} || '<\\1', 'g'), {CUT}) AS l FROM {source}))
 WHERE regexp_matches(p, '(?is)^<h[1-6](?:\\s[^>]*)?>')"""


part("hd", f"""SELECT page_id, pos, CAST(substr(p, 3, 1) AS INTEGER) AS level, {vis(f"regexp_extract(p, '{HS}', 1)")} AS text
 FROM ({headed('cl', 'clean')})""")
part("outline", """SELECT *, coalesce(level - lag(level) OVER (PARTITION BY page_id ORDER BY pos) > 1, false) AS skip FROM hd""")
part("els", "SELECT page_id, lower(unnest(regexp_extract_all(clean, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS el FROM cl")
part("bodies", "SELECT *, regexp_replace(clean, '(?is)<head(?:\\s[^>]*)?(?:>(?:.*?</head\\s*>|(.*))|\\z)', ' \\1', 'g') AS body FROM cl")


def regions(name: str) -> None:
    """Part ``{name}s`` (page_id, element, inside): what outermost elements hold, from rows of tags and heights that stop at zero."""
    token = rf"(?is)<{name}(?:\s[^>]*)?(?:>|\z)|</{name}\s*>"
    part(name + "tags", f"""SELECT page_id, unnest(t) AS tag, unnest(p[2:]) AS behind, generate_subscripts(t, 1) AS i FROM
 (SELECT page_id, regexp_extract_all(clean, '{token}') AS t, regexp_split_to_array(clean, '{token}') AS p FROM cl)""")
    part(name + "ways", f"""SELECT *, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '>') THEN 1 ELSE 0 END AS way,
 max(i) FILTER (WHERE starts_with(tag, '</')) OVER (PARTITION BY page_id) AS last_close FROM {name}tags""")
    part(name + "sums", f"SELECT *, sum(way) OVER (PARTITION BY page_id ORDER BY i) AS total FROM {name}ways")
    part(name + "tops", f"SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY i)) AS height FROM {name}sums")
    part(name + "befores", f"SELECT *, coalesce(lag(height) OVER (PARTITION BY page_id ORDER BY i), 0) AS was FROM {name}tops")
    part(name + "parts", f"""SELECT *, coalesce(sum(CASE WHEN was > 0 AND height = 0 THEN 1 ELSE 0 END)
 OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS element FROM {name}befores""")
    part(name + "s", f"""SELECT page_id, element, string_agg(CASE WHEN was > 0 THEN tag ELSE '' END || behind, '' ORDER BY i) AS inside
 FROM {name}parts WHERE height > 0 AND i < last_close GROUP BY 1, 2""")


regions("main")
regions("article")
part("texts", f"""SELECT page_id, {vis('body')} AS body_text, {vis("coalesce(inner_html, '')")} AS content_text FROM
 (SELECT b.page_id, body, coalesce(nullif(m.inside, ''), a.inside) AS inner_html FROM bodies b
 LEFT JOIN mains m ON m.page_id = b.page_id AND m.element = 0
 LEFT JOIN (SELECT page_id, string_agg(inside, ' ' ORDER BY element) AS inside FROM articles GROUP BY 1) a ON a.page_id = b.page_id)""")
part("secs", f"""SELECT page_id, pos, CAST(substr(p, 3, 1) AS INTEGER) AS level, {vis(f"regexp_extract(p, '{HS}', 1)")} AS heading,
 {vis(f"regexp_replace(p, '{HS}', '')")} AS text FROM ({headed('bodies', 'body')})""")
FIRST = "regexp_extract(text, '^[^.!?]*[.!?]')"
part("ready", f"SELECT *, ends_with({FIRST}, '.') AND {words(FIRST)} BETWEEN 5 AND 40 AS is_ready, {words('text')} AS n_words FROM secs")
part("langs", """SELECT page_id, nullif(lower(split_part(trim(arg_min(lang, tpos)), '-', 1)), '') AS lang FROM htmltags
 WHERE el = 'html' GROUP BY 1""")
SENT, LONG = r"[.!?]+(?:\s|\z)", r"[\p{L}\p{N}]{7,}"
part("measures", f"""SELECT page_id, {words('content_text')} AS n_words, greatest(1, {count('content_text', SENT)}) AS n_sentences,
 {count('content_text', LONG)} AS n_long FROM texts""")
part("entwords", rf"""SELECT *, lower(w) AS word, regexp_matches(w, '^\p{{Lu}}') AS cap,
 row_number() OVER (PARTITION BY page_id, snr ORDER BY pnr, wnr) = 1 AS starts FROM
 (SELECT page_id, snr, pnr, unnest(regexp_extract_all(piece, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(piece, '{WORD}'), 1) AS wnr FROM
  (SELECT page_id, snr, unnest(regexp_split_to_array(sentence, '[^\p{{L}}\p{{N}}\s]+')) AS piece,
   generate_subscripts(regexp_split_to_array(sentence, '[^\p{{L}}\p{{N}}\s]+'), 1) AS pnr FROM
   (SELECT page_id, unnest(l) AS sentence, generate_subscripts(l, 1) AS snr FROM
    (SELECT page_id, string_split(regexp_replace(content_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM texts))))""")
part("entplaces", """SELECT e.*, lang, NOT starts AND (coalesce(lag(cap AND NOT starts) OVER beside, false) OR coalesce(lead(cap) OVER beside, false)) AS run
 FROM entwords e LEFT JOIN langs l ON l.page_id = e.page_id WINDOW beside AS (PARTITION BY e.page_id, snr, pnr ORDER BY wnr)""")
part("entcases", """SELECT lang, word, avg(CAST(cap AS INT)) AS share, count(*) AS n FROM entplaces WHERE NOT starts GROUP BY 1, 2""")
part("entlangs", """SELECT lang, avg(CAST(cap AS INT)) >= 0.25 AS nouns FROM entplaces WHERE NOT starts GROUP BY 1""")
part("entities", """SELECT p.page_id, count(*) AS n_entities FROM entplaces p JOIN entcases c ON c.word = p.word AND c.lang IS NOT DISTINCT FROM p.lang
 JOIN entlangs g ON g.lang IS NOT DISTINCT FROM p.lang WHERE cap AND share >= 0.8 AND length(p.word) > 1 AND (run OR NOT nouns) GROUP BY 1""")
LIX = "CASE WHEN n_words = 0 THEN 0.0 ELSE n_words / n_sentences + 100 * n_long / n_words END"


def tally(names: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE el = '{n}') AS n_{n}" for n in names.split())
    return f"SELECT p.page_id, {cols} FROM pg p LEFT JOIN els e ON e.page_id = p.page_id GROUP BY 1"


# ---- attribution ----------------------------------------------------------------------------
part("metas", """SELECT page_id, kind, lower(n) AS name, arg_min(content, tpos) AS content FROM
 (SELECT page_id, tpos, 'name' AS kind, name AS n, content FROM tags WHERE el = 'meta'
  UNION ALL SELECT page_id, tpos, 'property', property, content FROM tags WHERE el = 'meta')
 WHERE n IS NOT NULL AND trim(content) <> '' GROUP BY ALL""")


def token(value: str, word: str) -> str:
    return f"list_contains(string_split_regex({strip(value)}, '\\s+'), '{word}')"


part("authors", f"""SELECT p.page_id, EXISTS (FROM metas m WHERE m.page_id = p.page_id AND kind = 'name' AND name = 'author') AS meta_author,
 EXISTS (FROM anchors a WHERE a.page_id = p.page_id AND {token("coalesce(a.rel, '')", 'author')})
  OR EXISTS (FROM tags t WHERE t.page_id = p.page_id AND t.el = 'link' AND {token("coalesce(t.rel, '')", 'author')}) AS rel_author,
 EXISTS (FROM marked k WHERE k.page_id = p.page_id AND {token("coalesce(k.itemprop, '')", 'author')}) AS itemprop_author,
 EXISTS (FROM ldkeys l WHERE l.page_id = p.page_id AND k = 'author') AS jsonld_author FROM pg p""")
part("lddates", """SELECT page_id, arg_min(json_extract_string(i, '$.datePublished'), item) FILTER (WHERE json_extract_string(i, '$.datePublished') IS NOT NULL) AS pub,
 arg_min(json_extract_string(i, '$.dateModified'), item) FILTER (WHERE json_extract_string(i, '$.dateModified') IS NOT NULL) AS mod FROM lditems GROUP BY 1""")
part("shown", "SELECT page_id, arg_min(datetime, tpos) AS dt FROM marked WHERE el = 'time' AND datetime IS NOT NULL GROUP BY 1")
part("dates", """SELECT p.page_id, CAST(coalesce(try_cast(a.content AS TIMESTAMP), try_cast(l.pub AS TIMESTAMP)) AS DATE) AS published,
 CAST(coalesce(try_cast(b.content AS TIMESTAMP), try_cast(l.mod AS TIMESTAMP)) AS DATE) AS modified,
 CAST(try_cast(s.dt AS TIMESTAMP) AS DATE) AS shown FROM pg p
 LEFT JOIN metas a ON a.page_id = p.page_id AND a.kind = 'property' AND a.name = 'article:published_time'
 LEFT JOIN metas b ON b.page_id = p.page_id AND b.kind = 'property' AND b.name = 'article:modified_time'
 LEFT JOIN lddates l ON l.page_id = p.page_id LEFT JOIN shown s ON s.page_id = p.page_id""")
part("linkhosts", """SELECT a.page_id, lower(split_part(p.netloc, ':', 1)) AS own, CASE WHEN starts_with(a.href, '//')
  THEN lower(regexp_extract('https:' || a.href, '(?i)^https?://(?:[^@/?#]*@)?([^:/?#]*)', 1))
  WHEN regexp_matches(a.href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(regexp_extract(a.href, '(?i)^https?://(?:[^@/?#]*@)?([^:/?#]*)', 1))
  ELSE lower(split_part(p.netloc, ':', 1)) END AS host FROM anchors a JOIN pg p ON p.page_id = a.page_id
 WHERE a.href IS NOT NULL AND (regexp_matches(a.href, '(?i)^https?:') OR NOT regexp_matches(a.href, '(?i)^[a-z][a-z0-9+.-]*:'))""")
CREDENTIAL = ", ".join(f"'{w}'" for w in CREDENTIALS)
part("authortags", r"""SELECT page_id, string_agg(x, ' ' ORDER BY n) AS named FROM (SELECT page_id,
 unnest(regexp_extract_all(clean, '(?is)<[a-z][^>]*>[^<]*', 0)) AS t, generate_subscripts(regexp_extract_all(clean, '(?is)<[a-z][^>]*>[^<]*', 0), 1) AS n,
 regexp_extract(t, '(?s)>([^<]*)$', 1) AS x FROM cl) WHERE regexp_matches(split_part(t, '>', 1) || '>', '(?i)\sitemprop\s*=\s*["'']?author["'']?[\s>/]') GROUP BY 1""")
part("authortexts", """SELECT p.page_id, concat_ws(' ', m.content, coalesce(a.named, '')) AS author
 FROM pg p LEFT JOIN metas m ON m.page_id = p.page_id AND m.kind = 'name' AND m.name = 'author'
 LEFT JOIN authortags a ON a.page_id = p.page_id""")
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def resolved(name: str, sql: str) -> None:
    """Part ``name`` (id, whole, bare) from rows (id, ref, base): references resolved by rows of path parts, not over a stack.

    Heights of the stack after each part are running sums that stop at zero; a part stays if no later height is lower.
    """
    fields = ", ".join(f"regexp_extract(x, '{REFERENCE}', {i}) AS {f}" for i, f in enumerate(("scheme", "slashes", "host", "path", "query", "frag"), 1))
    clean = "trim(regexp_replace({}, '[\\t\\r\\n]', '', 'g'), '" + "".join(map(chr, range(1, 33))) + "')"
    part(name + "ref", f"SELECT id, {fields} FROM (SELECT id, {clean.format('ref')} AS x FROM ({sql}) WHERE ref IS NOT NULL)")
    part(name + "base", f"SELECT id, {fields} FROM (SELECT id, {clean.format("coalesce(base, '')")} AS x FROM ({sql}))")
    part(name + "to", f"""SELECT id, scheme, slashes, query, frag, CASE WHEN slashes <> '' AND path = '' THEN '/' ELSE path END AS path,
 regexp_replace(coalesce(regexp_extract(host, '^(.*@)', 1), '') || lower(regexp_replace(host, '^.*@', '')),
  CASE scheme WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, '') AS host FROM
 (SELECT r.id, lower(r.scheme) AS scheme, r.slashes, r.host, r.path, r.query, r.frag FROM {name}ref r WHERE r.scheme <> ''
 UNION ALL SELECT r.id, lower(b.scheme), r.slashes, r.host, r.path, r.query, r.frag FROM {name}ref r JOIN {name}base b USING (id) WHERE r.scheme = '' AND r.slashes <> ''
 UNION ALL SELECT r.id, lower(b.scheme), b.slashes, b.host, CASE WHEN starts_with(r.path, '/') THEN r.path WHEN r.path = '' THEN b.path
   WHEN b.slashes <> '' AND b.path = '' THEN '/' || r.path ELSE left(b.path, length(b.path) - length(string_split(b.path, '/')[-1])) || r.path END,
  CASE WHEN r.path = '' AND r.query = '' THEN b.query ELSE r.query END, r.frag FROM {name}ref r JOIN {name}base b USING (id) WHERE r.scheme = '' AND r.slashes = '')""")
    part(name + "segs", f"""SELECT id, seg, i, CASE WHEN lower(replace(lower(seg), '%2e', '.')) = '.' THEN 0 WHEN replace(lower(seg), '%2e', '.') = '..' THEN -1 ELSE 1 END AS way
 FROM (SELECT id, unnest(string_split(substr(path, 2), '/')) AS seg, generate_subscripts(string_split(substr(path, 2), '/'), 1) AS i FROM {name}to WHERE starts_with(path, '/'))""")
    part(name + "sums", f"SELECT *, sum(way) OVER (PARTITION BY id ORDER BY i) AS total FROM {name}segs")
    part(name + "tops", f"SELECT *, total - least(0, min(total) OVER (PARTITION BY id ORDER BY i)) AS height FROM {name}sums")
    part(name + "stay", f"""SELECT *, way = 1 AND coalesce(min(height) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), height) >= height AS stays FROM {name}tops""")
    part(name + "paths", f"""SELECT id, '/' || coalesce(string_agg(seg, '/' ORDER BY i) FILTER (WHERE stays), '')
 || CASE WHEN arg_max(way, i) < 1 AND bool_or(stays) THEN '/' ELSE '' END AS folded FROM {name}stay GROUP BY id""")
    part(name, f"""SELECT *, split_part(whole, '#', 1) AS bare FROM (SELECT t.id, CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
 || CASE WHEN slashes <> '' THEN '//' || host ELSE '' END || coalesce(folded, path) || query || frag AS whole FROM {name}to t LEFT JOIN {name}paths p ON p.id = t.id)""")


part("canon", f"""SELECT page_id, trim(arg_min(href, tpos)) AS href FROM tags WHERE el = 'link' AND {token('rel', 'canonical')} GROUP BY 1""")
resolved("named", "SELECT p.page_id AS id, nullif(c.href, '') AS ref, p.url AS base FROM pg p LEFT JOIN canon c ON c.page_id = p.page_id")
resolved("ownurl", "SELECT page_id AS id, url AS ref, NULL AS base FROM pg")
part("canonicals", """SELECT o.id AS page_id, n.whole AS canonical, CASE WHEN n.whole IS NULL THEN 'missing' WHEN n.bare = o.bare THEN 'self' ELSE 'other' END AS status
 FROM ownurl o LEFT JOIN named n ON n.id = o.id""")
# canonical chains: one step at a time, with the addresses met so far
part("nexts", f"""SELECT page_id, {ov.URL} AS url, CASE WHEN page_id % 40 = 29 THEN 'https://outside.example/x' ELSE next_url END AS href
 FROM pages LEFT JOIN (SELECT page_id AS next_page, url AS next_url FROM pages) q ON q.next_page = {ov.NEXT_PAGE}""")
resolved("nextat", "SELECT page_id AS id, url AS ref, NULL AS base FROM nexts")
resolved("nextto", "SELECT page_id AS id, href AS ref, url AS base FROM nexts")
part("chainlinks", "SELECT o.id AS page_id, o.bare AS address, n.bare AS target FROM nextat o LEFT JOIN nextto n ON n.id = o.id")
part("chainnodes", "SELECT address, min(target) FILTER (WHERE target <> address) AS target FROM chainlinks GROUP BY 1")
part("walks", """WITH RECURSIVE w AS (SELECT address AS start, address AS here, [address] AS met FROM chainnodes
 UNION ALL SELECT start, target, list_append(met, target) FROM w JOIN chainnodes n ON n.address = w.here WHERE target IS NOT NULL AND NOT list_contains(met, target))
SELECT start, arg_max(here, len(met)) AS here, arg_max(met, len(met)) AS met FROM w GROUP BY start""")
part("ends", """SELECT start, n.address IS NULL AS outside, n.target IS NOT NULL AS in_cycle, met,
 CASE WHEN n.target IS NULL THEN here ELSE list_min(met[list_position(met, n.target):]) END AS final FROM walks w LEFT JOIN chainnodes n ON n.address = w.here""")
part("chainends", """SELECT page_id, address, final, CAST(list_position(met, final) - 1 AS BIGINT) AS hops, in_cycle, outside
 FROM chainlinks l LEFT JOIN ends e ON e.start = l.address""")
part("social", "SELECT p.page_id, " + ", ".join(
    f"coalesce(bool_or(m.name = '{n}'), false) AS {n.replace(':', '_')}" for n in SOCIAL
) + " FROM pg p LEFT JOIN metas m ON m.page_id = p.page_id GROUP BY 1")
part("linktexts", f"""SELECT page_id, {vis('t')} AS t FROM (SELECT page_id,
 unnest(regexp_extract_all(clean, '(?is)<a\\s[^>]*>(.*?)</a\\s*>', 1)) AS t FROM cl)""")
part("contacts", f"""SELECT p.page_id, (SELECT count(*) FROM anchors a WHERE a.page_id = p.page_id AND lower(a.href) LIKE 'mailto:%') AS n_mailto,
 (SELECT count(*) FROM anchors a WHERE a.page_id = p.page_id AND lower(a.href) LIKE 'tel:%') AS n_tel,
 EXISTS (FROM linktexts x WHERE x.page_id = p.page_id AND regexp_matches(t, '{CONTACT}')) AS has_contact_link FROM pg p""")


def linked(pattern: str) -> str:
    return (
        f"(EXISTS (FROM anchors a WHERE a.page_id = p.page_id AND regexp_matches(a.href, '{pattern}')) "
        f"OR EXISTS (FROM linktexts x WHERE x.page_id = p.page_id AND regexp_matches(t, '{pattern}')))"
    )


part("trust", f"SELECT page_id, scheme = 'https' AS https, {linked(PRIVACY)} AS privacy, {linked(TERMS)} AS terms FROM pg p")

# ---- scores of the three ------------------------------------------------------------------------
part("sdsum", f"""SELECT p.page_id, (SELECT count(*) FROM lditems x WHERE x.page_id = p.page_id) AS n_items,
 (SELECT count(*) FROM blocks b WHERE b.page_id = p.page_id AND NOT json_valid(b.block)) AS n_invalid,
 (SELECT count(*) FROM untyped u WHERE u.page_id = p.page_id) AS n_untyped,
 (SELECT count(*) FROM mdtags m WHERE m.page_id = p.page_id AND m.itemscope IS NOT NULL)
  + (SELECT count(*) FROM rdtags r WHERE r.page_id = p.page_id AND r.typeof IS NOT NULL) AS n_other,
 (SELECT count(*) FROM missing m WHERE m.page_id = p.page_id) AS n_missing FROM pg p""")
part("sdscore", f"""SELECT page_id, CAST(CASE WHEN n_items > 0 THEN 40 WHEN n_other > 0 THEN 20 ELSE 0 END + 10 * ({len(CRITICAL_TYPES)} - n_missing)
 + CASE WHEN n_items > 0 AND n_invalid = 0 AND n_untyped = 0 THEN 20 ELSE 0 END AS INTEGER) AS value FROM sdsum""")
part("sdissues", """SELECT page_id, 1 AS o, 'sd_none::medium' AS x FROM sdsum WHERE n_items = 0 AND n_other = 0
 UNION ALL SELECT page_id, 2, 'sd_jsonld_invalid::medium' FROM sdsum WHERE n_invalid > 0
 UNION ALL SELECT page_id, 3 + sord, 'sd_missing:' || schema || ':' || CASE WHEN schema = 'FAQPage' THEN 'high' ELSE 'medium' END FROM missing
 UNION ALL SELECT page_id, 9, 'sd_nesting::low' FROM sdsum WHERE n_untyped > 0""")
part("exsum", """SELECT p.page_id, (SELECT count(*) FROM hd h WHERE h.page_id = p.page_id AND level = 1) AS n_h1,
 (SELECT count(*) FROM outline h WHERE h.page_id = p.page_id AND skip) AS n_skips,
 (SELECT count(*) FROM ready r WHERE r.page_id = p.page_id) AS n_sections,
 (SELECT count(*) FROM ready r WHERE r.page_id = p.page_id AND is_ready) AS n_ready,
 length(content_text) AS c, length(body_text) AS b FROM pg p JOIN texts t ON t.page_id = p.page_id""")
part("exscore", """SELECT page_id, CAST(CASE WHEN n_h1 = 1 THEN 25 ELSE 0 END + CASE WHEN n_skips = 0 THEN 15 ELSE 0 END + CASE WHEN c > 0 THEN 20 ELSE 0 END
 + CASE WHEN b = 0 THEN 0 ELSE round_even(20 * least(1, c / b), 0) END
 + CASE WHEN n_sections = 0 THEN 0 ELSE round_even(20 * n_ready / n_sections, 0) END AS INTEGER) AS value FROM exsum""")
part("exissues", """SELECT page_id, 1 AS o, 'ex_h1_missing::medium' AS x FROM exsum WHERE n_h1 = 0
 UNION ALL SELECT page_id, 2, 'ex_h1_multiple::low' FROM exsum WHERE n_h1 > 1
 UNION ALL SELECT page_id, 3, 'ex_heading_skip::low' FROM exsum WHERE n_skips > 0
 UNION ALL SELECT page_id, 4, 'ex_no_region::medium' FROM exsum WHERE c = 0""")
part("atsum", """SELECT p.page_id, meta_author OR rel_author OR itemprop_author OR jsonld_author AS has_author,
 coalesce(published, modified, shown) IS NOT NULL AS has_date, status,
 og_title::INT + og_description::INT + og_image::INT + og_url::INT + twitter_card::INT AS n_social,
 n_mailto + n_tel > 0 OR has_contact_link AS has_contact, https, privacy, terms FROM pg p JOIN authors USING (page_id)
 JOIN dates USING (page_id) JOIN canonicals USING (page_id) JOIN social USING (page_id) JOIN contacts USING (page_id) JOIN trust USING (page_id)""")
part("atscore", """SELECT page_id, CAST(25 * has_author::INT + 20 * has_date::INT + CASE WHEN status = 'self' THEN 15 ELSE 0 END + 3 * n_social
 + 10 * has_contact::INT + 5 * (https::INT + privacy::INT + terms::INT) AS INTEGER) AS value FROM atsum""")
part("atissues", """SELECT page_id, 1 AS o, 'at_no_author::low' AS x FROM atsum WHERE NOT has_author
 UNION ALL SELECT page_id, 2, 'at_no_date::low' FROM atsum WHERE NOT has_date
 UNION ALL SELECT page_id, 3, 'at_canonical_other::info' FROM atsum WHERE status = 'other'
 UNION ALL SELECT page_id, 4, 'at_no_social::info' FROM atsum WHERE n_social = 0
 UNION ALL SELECT page_id, 5, 'at_no_https::medium' FROM atsum WHERE NOT https""")


def scored(prefix: str) -> str:
    return (
        f"SELECT s.page_id, any_value(s.value) AS value, coalesce(string_agg(x, ',' ORDER BY o), '') AS issues "
        f"FROM {prefix}score s LEFT JOIN {prefix}issues i ON i.page_id = s.page_id GROUP BY 1"
    )


# ---- items: elements by the heights of their tags, owners by the span around them ----------
part("itpg", f"SELECT page_id, concat({ov.ITEMS}, coalesce(html, '')) AS html FROM pages")
ITEM_TOKEN = rf"(?s)<(?:{SKIP}|/?(?i:{ANY})(?:[\s/]{INNER})?(?:>|\z))"
part("ittokens", f"""SELECT page_id, unnest(t) AS tag, unnest(p[2:]) AS behind, generate_subscripts(t, 1) AS i, len(t) + 1 AS ends FROM
 (SELECT page_id, regexp_extract_all(html, '{ITEM_TOKEN}') AS t, regexp_split_to_array(html, '{ITEM_TOKEN}') AS p FROM itpg)""")
part("ittags", """SELECT page_id, tag, i, ends, lower(regexp_extract(tag, '^</?([^\\s/>]+)', 1)) AS el, CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS way
 FROM ittokens WHERE ends_with(tag, '>') AND NOT starts_with(tag, '<!') AND NOT regexp_matches(tag, '(?i)^<(?:script|style)[\\s/>]')""")
VOID_SQL = "('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr')"


def item_parts(prefix: str, scope: str, kind: str, prop: str, fields: str, value: str, outside: bool) -> str:
    """Parts of one syntax; gives the statement of its table of properties."""
    x = prefix
    part(x + "attr", f"""SELECT page_id, i, lower(k) AS k, arg_max({unescape(unquote(BARE))}, apos) AS v FROM
 (SELECT page_id, i, unnest(regexp_extract_all(body, '{ATTR}', 1)) AS k, unnest(regexp_extract_all(body, '{ATTR}', 2)) AS v,
  generate_subscripts(regexp_extract_all(body, '{ATTR}', 1), 1) AS apos FROM
  (SELECT page_id, i, regexp_extract(tag, '(?s)^<[^\\s/>]+(.*)>$', 1) AS body FROM ittags WHERE way = 1
   AND regexp_matches(tag, '(?i)\\s(?:{scope}|{prop})[\\s=/>]'))) GROUP BY 1, 2, 3""")
    cols = ", ".join(f"max(v) FILTER (WHERE k = '{f}') AS a_{f}" for f in fields.split())
    part(x + "marked", f"SELECT t.page_id, t.i, any_value(t.el) AS el, any_value(t.ends) AS ends, {cols} FROM ittags t JOIN {x}attr a ON a.page_id = t.page_id AND a.i = t.i GROUP BY 1, 2")
    part(x + "names", f"SELECT DISTINCT page_id, el FROM {x}marked WHERE el NOT IN {VOID_SQL}")
    part(x + "sums", f"SELECT t.*, sum(way) OVER (PARTITION BY t.page_id, t.el ORDER BY i) AS total FROM ittags t JOIN {x}names n ON n.page_id = t.page_id AND n.el = t.el")
    part(x + "tops", f"SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id, el ORDER BY i)) AS height FROM {x}sums")
    part(x + "steps", f"SELECT *, coalesce(lag(height) OVER (PARTITION BY page_id, el ORDER BY i), 0) AS was FROM {x}tops")
    part(x + "stops", f"SELECT page_id, i, way, lead(i) OVER (PARTITION BY page_id, el, greatest(height, was) ORDER BY i) AS stop FROM {x}steps WHERE height <> was")
    part(x + "spans", f"""SELECT m.*, CASE WHEN m.el IN {VOID_SQL} THEN m.i ELSE coalesce(s.stop, m.ends) END AS stop
 FROM {x}marked m LEFT JOIN {x}stops s ON s.page_id = m.page_id AND s.i = m.i AND s.way = 1""")
    part(x + "items", f"SELECT page_id, i, stop, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS item, a_{kind} AS kind FROM {x}spans WHERE a_{scope} IS NOT NULL")
    part(x + "owned", f"""SELECT s.page_id, s.i, arg_max(o.item, o.i) AS owner FROM {x}spans s
 LEFT JOIN {x}items o ON o.page_id = s.page_id AND o.i < s.i AND o.stop > s.i GROUP BY 1, 2""")
    part(x + "texts", f"""SELECT s.page_id, s.i, string_agg(t.behind, ' ' ORDER BY t.i) AS inside FROM {x}spans s
 JOIN ittokens t ON t.page_id = s.page_id AND t.i >= s.i AND t.i < s.stop GROUP BY 1, 2""")

    def words_of(source: str, column: str) -> str:
        return f"""SELECT page_id, i, w, min(n) AS n FROM (SELECT page_id, i, unnest(string_split_regex({column}, '\\s+')) AS w,
 generate_subscripts(string_split_regex({column}, '\\s+'), 1) AS n FROM {source} WHERE {column} IS NOT NULL) WHERE w <> '' GROUP BY 1, 2, 3"""

    part(x + "words", words_of(x + "spans", f"a_{prop}"))
    part(x + "kindwords", words_of(x + "items", "kind"))
    part(x + "kinds", f"SELECT page_id, i, string_agg(w, ' ' ORDER BY n) AS type FROM {x}kindwords GROUP BY 1, 2")
    part(x + "full", f"""SELECT o.page_id, o.item, k.type, CASE WHEN w.i IS NOT NULL THEN b.owner END AS parent FROM {x}items o
 LEFT JOIN {x}kinds k ON k.page_id = o.page_id AND k.i = o.i LEFT JOIN (SELECT DISTINCT page_id, i FROM {x}words) w ON w.page_id = o.page_id AND w.i = o.i
 JOIN {x}owned b ON b.page_id = o.page_id AND b.i = o.i""")
    part(x + "props", f"""SELECT s.page_id, b.owner AS item, row_number() OVER (PARTITION BY s.page_id ORDER BY s.i, w.n) - 1 AS pos, w.w AS property,
 CASE WHEN o.item IS NULL THEN coalesce({value}, trim(regexp_replace({unescape("coalesce(t.inside, '')")}, '[\\s\\x{{a0}}]+', ' ', 'g'), ' ')) END AS value, o.item AS child
 FROM {x}spans s JOIN {x}words w ON w.page_id = s.page_id AND w.i = s.i JOIN {x}owned b ON b.page_id = s.page_id AND b.i = s.i
 LEFT JOIN {x}items o ON o.page_id = s.page_id AND o.i = s.i LEFT JOIN {x}texts t ON t.page_id = s.page_id AND t.i = s.i
 {"" if outside else "WHERE b.owner IS NOT NULL"}""")
    return f"""SELECT p.page_id, p.item, f.type, f.parent, p.pos, p.property, p.value, p.child FROM {x}props p
 LEFT JOIN {x}full f ON f.page_id = p.page_id AND f.item = p.item UNION ALL
 SELECT f.page_id, f.item, f.type, f.parent, NULL, NULL, NULL, NULL FROM {x}full f ANTI JOIN {x}props p ON p.page_id = f.page_id AND p.item = f.item"""


MICRODATA_SQL = item_parts(
    "mi", "itemscope", "itemtype", "itemprop", "itemscope itemtype itemprop content src href data value datetime",
    """CASE WHEN s.el = 'meta' THEN coalesce(a_content, '') WHEN s.el IN ('audio', 'embed', 'iframe', 'img', 'source', 'track', 'video') THEN coalesce(a_src, '')
 WHEN s.el IN ('a', 'area', 'link') THEN coalesce(a_href, '') WHEN s.el = 'object' THEN coalesce(a_data, '')
 WHEN s.el IN ('data', 'meter') THEN coalesce(a_value, '') WHEN s.el = 'time' THEN a_datetime END""", False,
)
RDFA_SQL = item_parts(
    "rf", "typeof", "typeof", "property", "typeof property content datetime resource href src",
    "coalesce(a_content, CASE WHEN s.el = 'time' THEN a_datetime END, a_resource, a_href, a_src)", True,
)


SQL: dict[str, str] = {
    "jsonld_blocks": "SELECT page_id, pos, block FROM blocks",
    "jsonld_valid": "SELECT page_id, pos, json_valid(block) AS valid FROM blocks",
    "jsonld_types": "SELECT page_id, item, type FROM ldtypes",
    "microdata_items": """SELECT page_id, count(itemscope) AS n_scopes, count(itemprop) AS n_props,
 coalesce(string_agg(DISTINCT itemtype, ',' ORDER BY itemtype), '') AS types FROM mdtags GROUP BY 1""",
    "rdfa_items": """SELECT r.page_id, count(typeof) AS n_typeof, count(property) AS n_property, coalesce(any_value(types), '') AS types
 FROM rdtags r LEFT JOIN (SELECT page_id, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (SELECT page_id,
 unnest(string_split_regex(trim(typeof), '\\s+')) AS t FROM rdtags WHERE typeof IS NOT NULL) WHERE t <> '' GROUP BY 1) n
 ON n.page_id = r.page_id GROUP BY 1""",
    "schema_references": "SELECT page_id, item, property, id, resolved, types FROM refldrefs",
    "schema_nesting_by_id": "SELECT page_id, item, property FROM refuntyped",
    "microdata_properties": MICRODATA_SQL,
    "rdfa_properties": RDFA_SQL,
    "missing_schemas": "SELECT page_id, schema FROM missing",
    "schema_completeness": """SELECT t.page_id, t.item, t.type, w.level, count(k.k) AS n_present, count(*) AS n_expected,
 count(k.k) / count(*) AS ratio FROM ldtypes t JOIN wanted w ON w.type = t.type
 LEFT JOIN ldkeys k ON k.page_id = t.page_id AND k.item = t.item AND k.k = w.prop GROUP BY ALL""",
    "schema_nesting": "SELECT page_id, item, property FROM untyped",
    "heading_outline": "SELECT page_id, pos, CAST(level AS BIGINT) AS level, text, skip FROM outline",
    "h1_check": """SELECT page_id, n AS n_h1, CASE WHEN n = 0 THEN 'missing' ELSE 'multiple' END AS finding FROM (SELECT p.page_id,
 count(h.pos) AS n FROM pg p LEFT JOIN hd h ON h.page_id = p.page_id AND h.level = 1 GROUP BY 1) WHERE n <> 1""",
    "content_ratio": """SELECT page_id, length(content_text) AS content_chars, length(body_text) AS body_chars,
 CASE WHEN length(body_text) = 0 THEN 0.0 ELSE length(content_text) / length(body_text) END AS ratio FROM texts""",
    "semantic_tags": tally("article section main nav header footer aside"),
    "list_table_usage": tally("ul ol li table"),
    "section_blocks": "SELECT page_id, pos, CAST(level AS BIGINT) AS level, heading, text FROM secs",
    "section_depth": """SELECT page_id, count(*) AS n_sections, min(n_words) AS min_words, CAST(sum(n_words) AS BIGINT) / count(*) AS avg_words,
 max(n_words) AS max_words FROM ready GROUP BY 1""",
    "answer_ready": """SELECT p.page_id, count(r.pos) AS n_sections, count(*) FILTER (WHERE is_ready) AS n_ready,
 CASE WHEN count(r.pos) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE is_ready) / count(r.pos) END AS share
 FROM pg p LEFT JOIN ready r ON r.page_id = p.page_id GROUP BY 1""",
    "entity_density": """SELECT m.page_id, lang, n_words, coalesce(n_entities, 0) AS n_entities,
 CASE WHEN n_words = 0 THEN 0.0 ELSE coalesce(n_entities, 0) / n_words END AS density
 FROM measures m LEFT JOIN langs l ON l.page_id = m.page_id LEFT JOIN entities e ON e.page_id = m.page_id""",
    "readability": f"SELECT page_id, n_words, n_sentences, n_long, {LIX} AS lix FROM measures",
    "page_language": "SELECT p.page_id, lang FROM pg p LEFT JOIN langs l ON l.page_id = p.page_id",
    "language_summary": f"""SELECT *, {LIX} AS lix FROM (SELECT lang, count(*) AS n_pages, CAST(sum(n_words) AS BIGINT) AS n_words,
 CAST(sum(n_sentences) AS BIGINT) AS n_sentences, CAST(sum(n_long) AS BIGINT) AS n_long FROM measures m
 LEFT JOIN langs l ON l.page_id = m.page_id GROUP BY 1)""",
    "author_markup": "SELECT * FROM authors",
    "date_signals": """SELECT page_id, CAST(published AS VARCHAR) AS published, CAST(modified AS VARCHAR) AS modified, CAST(shown AS VARCHAR) AS shown,
 DATE '2026-01-01' - coalesce(modified, published, shown) AS age_days FROM dates""",
    "outbound_links": """SELECT p.page_id, count(*) FILTER (WHERE host = own) AS n_internal, count(*) FILTER (WHERE host <> own) AS n_external,
 count(DISTINCT host) FILTER (WHERE host <> own) AS n_external_hosts FROM pg p LEFT JOIN linkhosts l ON l.page_id = p.page_id GROUP BY 1""",
    "eeat_markers": f"""SELECT page_id, author, array_to_string(list_sort(list_filter([{CREDENTIAL}],
 lambda c: regexp_matches(author, '(?:^|[^\\p{{L}}\\p{{N}}])' || replace(c, '.', '[.]') || '(?:[^\\p{{L}}\\p{{N}}]|$)'))), ',') AS credentials FROM authortexts""",
    "canonical_check": "SELECT page_id, canonical, status FROM canonicals",
    "canonical_chains": "SELECT * FROM chainends",
    "canonical_clusters": """SELECT final, count(*) AS n_pages, count(DISTINCT address) AS n_addresses, max(hops) AS max_hops, bool_or(in_cycle) AS in_cycle
 FROM chainends WHERE final IS NOT NULL GROUP BY 1""",
    "social_meta": "SELECT * FROM social",
    "contact_info": "SELECT * FROM contacts",
    "trust_signals": "SELECT * FROM trust",
    "structured_score": scored("sd"),
    "extractability_score": scored("ex"),
    "attribution_score": scored("at"),
    "all_dimensions": """SELECT page_id, CAST(round_even((a.value + b.value + c.value + d.value + e.value) / 5, 0) AS INTEGER) AS overall_score,
 issue_count + (SELECT count(*) FROM sdissues i WHERE i.page_id = a.page_id) + (SELECT count(*) FROM exissues i WHERE i.page_id = a.page_id)
 + (SELECT count(*) FROM atissues i WHERE i.page_id = a.page_id) AS issue_count, CAST(5 AS BIGINT) AS n_scores
 FROM crawlscores a JOIN tdmscores b USING (page_id) JOIN sdscore c USING (page_id) JOIN exscore d USING (page_id)
 JOIN atscore e USING (page_id) JOIN issuecounts USING (page_id)""",
}


def content_oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in SQL.items()}
