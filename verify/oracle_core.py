"""DuckDB statements for access, signals, issues and scores.

Written relationally (rows, joins, windows) where the library works on arrays in place, so
that the two agree only if both are right. Patterns are in RE2 syntax.
"""

from __future__ import annotations

from sitegauge.sources import overlay as ov
from verify.sqlkit import oracle, part

# Fixed values, stated here once more so that a slip in the library shows.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BOTS = (
    (1, 'GPTBot', 'OpenAI (ChatGPT training data)', 12, True),
    (2, 'ChatGPT-User', 'OpenAI (ChatGPT live browsing)', 10, True),
    (3, 'Google-Extended', 'Google (Gemini training data)', 12, True),
    (4, 'GoogleOther', 'Google (AI Overviews, other AI)', 10, True),
    (5, 'CCBot', 'Common Crawl (used by many AI models)', 10, False),
    (6, 'anthropic-ai', 'Anthropic (Claude training data)', 8, False),
    (7, 'ClaudeBot', 'Anthropic (Claude web search)', 8, False),
    (8, 'PerplexityBot', 'Perplexity AI', 8, False),
    (9, 'Bytespider', 'ByteDance (TikTok AI)', 5, False),
    (10, 'Amazonbot', 'Amazon (Alexa, AI services)', 5, False),
    (11, 'meta-externalagent', 'Meta (Facebook AI, LLaMA)', 7, False),
    (12, 'cohere-ai', 'Cohere', 5, False),
)
# The references that the inputs hold; an ampersand last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&#49;": "1", "&apos;": "'", "&nbsp;": "\xa0",
    "&eacute;": "é", "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
WS = "'" + WHITESPACE + "'"
INNER = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*''|[^\s>]*))*"""
ATTR = r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*))?"""
SKIP = (
    r"!--.*?(?:-->|\z)|(?i:script)(?:[\s/][^>]*)?(?:>.*?(?:</(?i:script)\s*>|\z)|\z)"
    r"|(?i:style)(?:[\s/][^>]*)?(?:>.*?(?:</(?i:style)\s*>|\z)|\z)"
)


def tag_pattern(names: str) -> str:
    return rf"(?s)<(?:{SKIP}|(?i:{names})(?:[\s/]{INNER})?(?:>|\z))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def unescape(x: str) -> str:
    for name, char in ENTITIES.items():
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{quoted}')"
    return x


def unquote(x: str) -> str:
    return f"CASE WHEN ({x})[1] IN ('\"', '''') THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"


# An attribute without a value is an empty one; this engine reports an unmatched group as null.
BARE = "coalesce(v, '')"
part("bots", "SELECT * FROM (VALUES " + ", ".join(
    f"({o}, '{b}', '{op}', {w}, {str(h).lower()})" for o, b, op, w, h in BOTS
) + ") t(ord, bot, operator, weight, high_impact)")
part("pgx", """SELECT *, regexp_replace(lower(written), CASE scheme WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, '')
 AS netloc FROM (SELECT page_id, {url} AS url, html, lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
 regexp_extract({url}, '^[^:]*://([^/?#]*)', 1) AS written FROM pages)""".replace("{url}", ov.URL))


def pages_sql(shift: int = 0) -> str:
    n = f"(page_id + {shift})"
    return (
        f"SELECT page_id, url, scheme, netloc, written, scheme || '://' || netloc AS origin, coalesce({ov.html_sql(n)}, '') AS html, "
        f"{ov.XRT_NAME.format(n=n)} AS xrt_name, {ov.XRT_VALUE.format(n=n)} AS xrt_raw, "
        f"{ov.TDM_VALUE.format(n=n)} AS tdm_raw FROM pgx"
    )


def files_sql(shift: int = 0) -> str:
    s = f"(site_no + {shift})"
    return (
        f"SELECT origin, '/robots.txt' AS path, {ov.ROBOTS_STATUS.format(s=s)} AS status, 'text/plain' AS content_type, "
        f"{ov.ROBOTS_BODY.format(s=s)} AS body FROM sitenos "
        f"UNION ALL SELECT origin, '/tdmrep.json', {ov.TDMREP_STATUS.format(s=s)}, {ov.TDMREP_TYPE.format(s=s)}, "
        f"{ov.TDMREP_BODY.format(s=s)} FROM sitenos WHERE {ov.HAS_TDMREP.format(s=s)} "
        f"UNION ALL SELECT origin, '/ai.txt', 200, 'text/plain', 'ok' FROM sitenos WHERE {ov.HAS_AI_TXT.format(s=s)}"
    )


part("pg", pages_sql())
part("sitenos", "SELECT scheme || '://' || netloc AS origin, min(page_id) AS site_no FROM pgx GROUP BY 1")
part("files", files_sql())
part("robots", "SELECT origin, body FROM files WHERE path = '/robots.txt' AND status = 200")
part("tdmreps", f"""SELECT origin, origin || '/tdmrep.json' AS raw_value FROM files WHERE path = '/tdmrep.json'
 AND status = 200 AND (contains(content_type, 'json') OR starts_with({strip('body')}, chr(123)))""")
part("aitxts", "SELECT origin FROM files WHERE path = '/ai.txt' AND status = 200")
NL = r"\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
part("rawlines", f"""SELECT origin, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos
 FROM (SELECT origin, regexp_split_to_array(body, '{NL}') AS l FROM robots)""")
part("rlines", f"""SELECT origin, pos, lower({strip("substr(line, 1, strpos(line, ':') - 1)")}) AS directive,
 {strip("substr(line, strpos(line, ':') + 1)")} AS value
 FROM (SELECT origin, pos, {strip("split_part(raw, '#', 1)")} AS line FROM rawlines) WHERE contains(line, ':')""")
part("kinds", """SELECT *, CASE WHEN directive = 'user-agent' THEN 'agent'
 WHEN directive = 'allow' OR (directive = 'disallow' AND value <> '') THEN 'rule' END AS kind FROM rlines""")
part("marks", """SELECT *, CASE WHEN kind = 'agent' AND coalesce(last_value(kind IGNORE NULLS) OVER
 (PARTITION BY origin ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'rule') = 'rule'
 THEN 1 ELSE 0 END AS opens FROM kinds""")
part("rstate", """SELECT origin, pos, directive, value, kind, CAST(sum(opens) OVER (PARTITION BY origin ORDER BY pos
 ROWS UNBOUNDED PRECEDING) AS INTEGER) AS group_id FROM marks""")
NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"
part("delays", f"""SELECT origin, group_id, arg_max(v, pos) AS crawl_delay FROM (SELECT origin, group_id, pos,
 CASE WHEN regexp_matches(value, '{NUMBER}') THEN try_cast(value AS DOUBLE) END AS v FROM rstate
 WHERE directive = 'crawl-delay' AND group_id > 0) WHERE v IS NOT NULL GROUP BY 1, 2""")
part("rgroups", """SELECT s.origin, s.group_id, string_agg(CASE WHEN kind = 'agent' THEN value END, ',' ORDER BY pos) AS user_agents,
 count(*) FILTER (WHERE kind = 'rule') AS n_rules, any_value(d.crawl_delay) AS crawl_delay
 FROM rstate s LEFT JOIN delays d USING (origin, group_id) WHERE s.group_id > 0 GROUP BY 1, 2""")
part("rrules", """SELECT origin, group_id, pos, value AS path, directive = 'allow' AS allow FROM rstate
 WHERE kind = 'rule' AND group_id > 0""")
part("agents", "SELECT origin, group_id, lower(value) AS agent FROM rstate WHERE kind = 'agent'")
part("asks", """SELECT ord, bot, operator, weight, high_impact FROM bots
 UNION ALL SELECT 0, '*', '*', 0, false UNION ALL SELECT 99, 'UnknownBot', 'UnknownBot', 0, false""")
part("gmatch", """SELECT n.origin, q.ord, q.bot, q.operator, q.weight, q.high_impact,
 max(a.group_id) FILTER (WHERE a.agent = lower(q.bot)) AS specific_id,
 max(a.group_id) FILTER (WHERE a.agent = '*') AS wildcard_id
 FROM sitenos n CROSS JOIN asks q LEFT JOIN agents a ON a.origin = n.origin AND a.agent IN (lower(q.bot), '*')
 GROUP BY ALL""")


def directive_sql(source: str, path: str, keys: str) -> str:
    """Access rows for ``source`` (gmatch columns plus ``path``)."""
    return f"""SELECT {keys}, ord, bot, operator, weight, high_impact,
 coalesce(allow, true) AS allowed,
 CASE WHEN kind IS NULL THEN 'no matching rule (default allow)'
  WHEN allow IS NULL THEN kind || ' group, no matching path rule (default allow)'
  WHEN allow THEN kind || ' allow (path: ' || rule_path || ')' ELSE kind || ' block (path: ' || rule_path || ')' END AS reason,
 CASE WHEN allow THEN 'Allow: ' || rule_path WHEN NOT allow THEN 'Disallow: ' || rule_path END AS matching_rule
 FROM (SELECT g.*, CASE WHEN specific_id IS NOT NULL THEN 'specific' WHEN wildcard_id IS NOT NULL THEN 'wildcard' END AS kind,
   r.allow, r.path AS rule_path,
   row_number() OVER (PARTITION BY {", ".join("g." + k.strip() for k in keys.split(","))}, g.bot ORDER BY length(r.path) DESC NULLS LAST, r.pos) AS rn
  FROM {source} g LEFT JOIN rrules r ON r.origin = g.origin AND r.group_id = coalesce(g.specific_id, g.wildcard_id)
   AND (starts_with({path}, r.path) OR r.path IN ('/', ''))) WHERE rn = 1"""


part("access", directive_sql("gmatch", "'/'", "origin"))
PATH = ("CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END")
part("ppaths", f"""SELECT page_id, origin, {PATH} AS path FROM
 (SELECT page_id, origin, regexp_replace(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '#.*$', '') AS x FROM pg)""")
part("pgmatch", "SELECT p.page_id, p.path AS page_path, g.* FROM ppaths p JOIN gmatch g USING (origin)")
part("paccess", directive_sql("pgmatch", "g.page_path", "page_id, page_path"))
part("sitefacts", """SELECT n.origin, r.origin IS NOT NULL AS robots_found, t.origin IS NOT NULL AS tdmrep,
 x.origin IS NOT NULL AS ai_txt, a.allowed_weight, a.star_allowed
 FROM sitenos n LEFT JOIN robots r USING (origin) LEFT JOIN tdmreps t USING (origin) LEFT JOIN aitxts x USING (origin)
 JOIN (SELECT origin, CAST(round_even(100.0 * sum(weight) FILTER (WHERE allowed AND ord BETWEEN 1 AND 12)
   / sum(weight), 0) AS INTEGER) AS w, coalesce(w, 0) AS allowed_weight,
   bool_or(allowed) FILTER (WHERE bot = '*') AS star_allowed FROM access GROUP BY 1) a USING (origin)""")

# ---- tags -----------------------------------------------------------------------------
part("rawtags", f"""SELECT page_id, tpos, tag FROM (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) AS tpos
 FROM (SELECT page_id, list_filter(regexp_extract_all(html, '{tag_pattern("meta|link")}'),
  lambda t: ends_with(t, '>') AND NOT starts_with(t, '<!') AND NOT regexp_matches(t, '(?i)^<(?:script|style)[\\s/>]')) AS l FROM pg))""")
part("tagattrs", f"""SELECT page_id, tpos, lower(k) AS k, arg_max({unescape(unquote(BARE))}, apos) AS v FROM
 (SELECT page_id, tpos, unnest(regexp_extract_all(body, '{ATTR}', 1)) AS k, unnest(regexp_extract_all(body, '{ATTR}', 2)) AS v,
  generate_subscripts(regexp_extract_all(body, '{ATTR}', 1), 1) AS apos FROM
  (SELECT page_id, tpos, regexp_extract(tag, '(?s)^<[^\\s/>]+(.*)>$', 1) AS body FROM rawtags)) GROUP BY 1, 2, 3""")
part("tags", """SELECT t.page_id, t.tpos, lower(regexp_extract(any_value(t.tag), '^<([^\\s/>]+)', 1)) AS el,
 max(v) FILTER (WHERE k = 'name') AS name, max(v) FILTER (WHERE k = 'property') AS property,
 max(v) FILTER (WHERE k = 'content') AS content, max(v) FILTER (WHERE k = 'rel') AS rel, max(v) FILTER (WHERE k = 'href') AS href
 FROM rawtags t LEFT JOIN tagattrs a ON a.page_id = t.page_id AND a.tpos = t.tpos GROUP BY 1, 2""")
part("metafirst", """SELECT page_id, lower(name) AS meta_name, arg_min(coalesce(content, ''), tpos) AS content
 FROM tags WHERE el = 'meta' AND name IS NOT NULL GROUP BY 1, 2""")
part("mnames", "SELECT * FROM (VALUES (0, 'robots'), (1, 'googlebot'), (2, 'googlebot-news'), (3, 'bingbot')) t(mord, meta_name)")
part("mrobots", f"""SELECT page_id, mord, meta_name, lower(content) AS content, list_contains(d, 'noindex') AS noindex,
 list_contains(d, 'nofollow') AS nofollow,
 CASE WHEN list_contains(d, 'noai') THEN 'noai' WHEN list_contains(d, 'noimageai') THEN 'noimageai' END AS ai_word
 FROM (SELECT *, list_transform(string_split(lower(content), ','), lambda x: {strip('x')}) AS d
  FROM metafirst JOIN mnames USING (meta_name))""")
part("xrt", f"""SELECT page_id, value, list_contains(d, 'noindex') AS noindex,
 CASE WHEN list_contains(d, 'noai') THEN 'noai' WHEN list_contains(d, 'noimageai') THEN 'noimageai' END AS ai_word
 FROM (SELECT page_id, xrt_raw AS value, list_transform(string_split(xrt_raw, ','), lambda x: lower({strip('x')})) AS d
  FROM pg WHERE lower(xrt_name) = 'x-robots-tag' AND xrt_raw IS NOT NULL)""")
POLICY = "CASE v WHEN '1' THEN 'reserved' WHEN '0' THEN 'not_reserved' ELSE 'not_declared' END"
part("sighead", f"SELECT page_id, 1 AS ord, 'http_header' AS source, {POLICY} AS policy, v AS raw_value FROM "
     f"(SELECT page_id, {strip('tdm_raw')} AS v FROM pg WHERE tdm_raw IS NOT NULL)")
part("sigmeta", f"SELECT page_id, 2 AS ord, 'meta_tag' AS source, {POLICY} AS policy, v AS raw_value FROM "
     f"(SELECT page_id, {strip('content')} AS v FROM metafirst WHERE meta_name = 'tdm-reservation')")
part("siglink", f"""SELECT page_id, 3 AS ord, 'link_tag' AS source, 'reserved' AS policy, v AS raw_value FROM
 (SELECT page_id, {strip("arg_min(coalesce(href, ''), tpos)")} AS v FROM tags WHERE el = 'link'
  AND list_contains(string_split_regex({strip('rel')}, '\\s+'), 'tdm-policy') GROUP BY 1) WHERE v <> ''""")
part("sigrep", """SELECT page_id, 4 AS ord, 'tdmrep_json' AS source, 'reserved' AS policy, scheme || '://' || written || '/tdmrep.json' AS raw_value
 FROM pg JOIN tdmreps USING (origin)""")
part("sigs", "SELECT * FROM sighead UNION ALL SELECT * FROM sigmeta UNION ALL SELECT * FROM siglink UNION ALL SELECT * FROM sigrep")
part("sigsum", """SELECT p.page_id, count(s.ord) AS n_signals, count(*) FILTER (WHERE policy <> 'not_declared') AS n_valid,
 count(*) FILTER (WHERE policy = 'not_declared') AS n_invalid,
 coalesce(bool_or(policy = 'reserved'), false) AND coalesce(bool_or(policy = 'not_reserved'), false) AS conflict,
 coalesce(bool_or(policy = 'reserved'), false) AS any_reserved,
 arg_min(policy, s.ord) FILTER (WHERE policy <> 'not_declared') AS first_policy,
 string_agg(source, ', ' ORDER BY s.ord) FILTER (WHERE policy <> 'not_declared') AS valid_sources,
 string_agg(source, ', ' ORDER BY s.ord) FILTER (WHERE policy = 'reserved') AS reserved_by,
 string_agg(source, ', ' ORDER BY s.ord) FILTER (WHERE policy = 'not_reserved') AS allowed_by
 FROM pg p LEFT JOIN sigs s ON s.page_id = p.page_id GROUP BY 1""")

# ---- issues and scores ------------------------------------------------------------------
part("exceptions", """SELECT a.origin, string_agg(a.bot, ', ' ORDER BY a.ord) AS bots FROM access a JOIN sitefacts f USING (origin)
 WHERE NOT f.star_allowed AND a.ord BETWEEN 1 AND 12 AND a.allowed AND starts_with(a.reason, 'specific') GROUP BY 1""")
part("siteissues", """SELECT origin, 1 AS ord, 'low' AS severity, 'robots_missing' AS rule, '' AS key,
  'robots.txt not found or inaccessible' AS title FROM sitefacts WHERE NOT robots_found
 UNION ALL SELECT origin, ord + 1, CASE WHEN high_impact THEN 'high' ELSE 'medium' END, 'bot_blocked', bot,
  bot || ' blocked — ' || operator FROM access WHERE NOT allowed AND ord BETWEEN 1 AND 12
 UNION ALL SELECT origin, 14, 'medium', 'robots_conflict', '',
  'Conflicting directives: wildcard block with specific allows' FROM exceptions""")
part("crawlissues", """SELECT page_id, ord, severity, rule, key, title FROM pg JOIN siteissues USING (origin)
 UNION ALL SELECT page_id, 15 + 3 * mord, 'high', 'meta_noindex', meta_name, 'meta ' || meta_name || ': noindex directive found'
  FROM mrobots WHERE noindex
 UNION ALL SELECT page_id, 16 + 3 * mord, 'medium', 'meta_nofollow', meta_name, 'meta ' || meta_name || ': nofollow directive found'
  FROM mrobots WHERE nofollow
 UNION ALL SELECT page_id, 17 + 3 * mord, 'medium', 'meta_noai', meta_name, 'meta ' || meta_name || ': ' || ai_word || ' directive found'
  FROM mrobots WHERE ai_word IS NOT NULL
 UNION ALL SELECT page_id, 27, 'high', 'xrt_noindex', '', 'X-Robots-Tag: noindex header found' FROM xrt WHERE noindex
 UNION ALL SELECT page_id, 28, 'medium', 'xrt_noai', '', 'X-Robots-Tag: ' || ai_word || ' header found' FROM xrt
  WHERE ai_word IS NOT NULL""")
LABEL = "CASE WHEN first_policy = 'reserved' THEN 'reserved (opt-out)' ELSE 'not reserved (opt-in)' END"
part("tdmissues", f"""SELECT page_id, 101 AS ord, 'medium' AS severity, 'tdm_header_invalid' AS rule, '' AS key,
  'Invalid TDM-Reservation header value' AS title FROM sighead WHERE policy = 'not_declared'
 UNION ALL SELECT page_id, 102, 'medium', 'tdm_meta_invalid', '', 'Invalid TDM meta tag value' FROM sigmeta WHERE policy = 'not_declared'
 UNION ALL SELECT page_id, 103, 'high', 'tdm_conflict', '', 'Conflicting TDM signals — reservation status unclear' FROM sigsum WHERE conflict
 UNION ALL SELECT page_id, 104, 'medium', 'tdm_none', '', 'No TDM policy declared' FROM sigsum WHERE n_signals = 0
 UNION ALL SELECT page_id, 105, 'info', 'tdm_declared', first_policy, 'TDM policy declared: ' || {LABEL} FROM sigsum
  WHERE n_valid > 0 AND NOT conflict""")
part("issues", """SELECT page_id, ord, severity, 'crawlability' AS category, rule, key, title FROM crawlissues
 UNION ALL SELECT page_id, ord, severity, 'tdm', rule, key, title FROM tdmissues""")
part("penalties", """SELECT p.page_id, CAST(coalesce(sum(CASE rule WHEN 'meta_noindex' THEN 10 WHEN 'meta_nofollow' THEN 5
  WHEN 'meta_noai' THEN 5 WHEN 'xrt_noindex' THEN 5 WHEN 'xrt_noai' THEN 3 ELSE 0 END), 0) AS INTEGER) AS penalty
 FROM pg p LEFT JOIN crawlissues i ON i.page_id = p.page_id GROUP BY 1""")
part("crawlscores", """SELECT page_id, CAST(greatest(0, least(100, allowed_weight - penalty)) AS INTEGER) AS value
 FROM pg JOIN sitefacts USING (origin) JOIN penalties USING (page_id)""")
part("tdmscores", """SELECT page_id, CAST(CASE WHEN n_signals = 0 THEN 30 ELSE greatest(0, least(100,
  CASE n_valid WHEN 0 THEN 20 WHEN 1 THEN 70 WHEN 2 THEN 90 ELSE 100 END - 15 * n_invalid
  - CASE WHEN conflict THEN 30 ELSE 0 END)) END AS INTEGER) AS value FROM sigsum""")
part("scores", """SELECT page_id, 'crawlability' AS category, value FROM crawlscores
 UNION ALL SELECT page_id, 'tdm', value FROM tdmscores""")
part("overall", "SELECT page_id, CAST(round_even(avg(value), 0) AS INTEGER) AS overall_score FROM scores GROUP BY 1")
part("issuecounts", """SELECT p.page_id, count(i.ord) AS issue_count, count(i.ord) FILTER (WHERE i.category = 'crawlability') AS n_crawl,
 count(i.ord) FILTER (WHERE i.category = 'tdm') AS n_tdm FROM pg p LEFT JOIN issues i ON i.page_id = p.page_id GROUP BY 1""")

TEXT = "(?s)</?[A-Za-z!][^>]*>"

SQL: dict[str, str] = {
    "crawl_readiness": "SELECT p.page_id, p.origin, CAST(b.n AS BIGINT) AS blocked_bots, s.value AS crawl_score FROM pg p "
    "JOIN crawlscores s USING (page_id) JOIN (SELECT origin, count(*) FILTER (WHERE NOT allowed AND ord BETWEEN 1 AND 12) AS n "
    "FROM access GROUP BY 1) b USING (origin)",
    "pages_scan": "SELECT page_id, url, origin, CAST(length(html) AS BIGINT) AS n_html, CAST(1 + CASE WHEN xrt_name IS NOT NULL "
    "AND xrt_raw IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tdm_raw IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_headers FROM pg",
    "robots_scan": "SELECT origin, body FROM robots",
    "tdmrep_scan": "SELECT origin, raw_value FROM tdmreps",
    "url_origin": "SELECT p.page_id, p.scheme, p.origin, lower(split_part(p.netloc, ':', 1)) AS host, x.path FROM pg p JOIN ppaths x USING (page_id)",
    "robots_lines": "SELECT origin, CAST(pos AS BIGINT) AS pos, directive, value FROM rlines",
    "robots_state": "SELECT origin, CAST(pos AS BIGINT) AS pos, kind, CAST(group_id AS BIGINT) AS group_id FROM rstate",
    "robots_groups": "SELECT origin, CAST(group_id AS BIGINT) AS group_id, user_agents, CAST(n_rules AS BIGINT) AS n_rules, crawl_delay FROM rgroups",
    "robots_rules": "SELECT origin, CAST(group_id AS BIGINT) AS group_id, CAST(pos AS BIGINT) AS pos, path, allow FROM rrules",
    "robots_crawl_delay": "SELECT origin, CAST(group_id AS BIGINT) AS group_id, crawl_delay FROM delays",
    "robots_tdm_fields": "SELECT origin, CAST(pos AS BIGINT) AS pos, directive, value FROM rlines WHERE directive LIKE 'tdm-%'",
    "bot_group_match": "SELECT g.origin, bot, CAST(specific_id AS BIGINT) AS specific_id, CAST(wildcard_id AS BIGINT) AS wildcard_id "
    "FROM gmatch g WHERE ord BETWEEN 1 AND 12",
    "longest_path_rule": "SELECT page_id, page_path AS path, allowed, matching_rule FROM paccess WHERE bot = '*'",
    "bot_directive": "SELECT a.origin, bot, operator, allowed, reason, matching_rule FROM access a",
    "bot_access_matrix": "SELECT a.origin, bot, operator, CAST(weight AS BIGINT) AS weight, allowed FROM access a WHERE ord BETWEEN 1 AND 12",
    "bot_access_path": "SELECT page_id, page_path AS path, bot, allowed, reason FROM paccess WHERE ord BETWEEN 1 AND 12",
    "wildcard_access": "SELECT a.origin, allowed, reason, matching_rule FROM access a WHERE bot = '*'",
    "page_site_join": "SELECT page_id, origin, robots_found, tdmrep, ai_txt, CAST(allowed_weight AS BIGINT) AS allowed_weight FROM pg JOIN sitefacts USING (origin)",
    "html_tags": "SELECT page_id, CAST(tpos - 1 AS BIGINT) AS pos, el, name, property, content, rel, href FROM tags",
    "meta_first": "SELECT page_id, meta_name, content FROM metafirst WHERE meta_name IN ('robots', 'author', 'tdm-reservation')",
    "meta_robots": "SELECT page_id, meta_name, content, noindex, nofollow, ai_word FROM mrobots",
    "tdm_meta_signal": "SELECT page_id, source, policy, raw_value FROM sigmeta",
    "tdm_link_signal": "SELECT page_id, source, policy, raw_value FROM siglink",
    "tdm_header_signal": "SELECT page_id, source, policy, raw_value FROM sighead",
    "header_lookup": "SELECT page_id, CASE WHEN xrt_name IS NOT NULL THEN xrt_raw END AS x_robots_tag, tdm_raw AS tdm_reservation, "
    "'text/html' AS content_type FROM pg",
    "x_robots_tag": "SELECT page_id, value, noindex, ai_word FROM xrt",
    "select_dimensions": "SELECT p.page_id, value AS overall_score, CAST(n_tdm AS BIGINT) AS issue_count, 'tdm' AS categories "
    "FROM pg p JOIN tdmscores USING (page_id) JOIN issuecounts USING (page_id)",
    "blank_html_guard": "SELECT p.page_id, (SELECT count(*) FROM tags t WHERE t.page_id = p.page_id) AS n_tags, "
    "(SELECT count(*) FROM mrobots m WHERE m.page_id = p.page_id) AS n_meta_robots, (SELECT count(*) FROM sighead s WHERE s.page_id = p.page_id) "
    "+ (SELECT count(*) FROM sigmeta s WHERE s.page_id = p.page_id) + (SELECT count(*) FROM siglink s WHERE s.page_id = p.page_id) AS n_signals FROM pg p",
    "valid_signals": "SELECT page_id, source, policy, raw_value FROM sigs WHERE policy <> 'not_declared'",
    "invalid_signals": "SELECT page_id, source, policy, raw_value FROM sigs WHERE policy = 'not_declared'",
    "high_issues": "SELECT page_id, CAST(ord AS BIGINT) AS ord, rule, title FROM issues WHERE severity = 'high'",
    "tdm_signals_union": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, source, policy, raw_value FROM sigs",
    "issues_union": "SELECT page_id, CAST(ord AS BIGINT) AS ord, severity, category, rule, key, title FROM issues",
    "policy_set": "SELECT p.page_id, coalesce(string_agg(policy, ',' ORDER BY policy), '') AS policies FROM pg p LEFT JOIN "
    "(SELECT DISTINCT page_id, policy FROM sigs WHERE policy <> 'not_declared') s ON s.page_id = p.page_id GROUP BY 1",
    "issue_robots_missing": "SELECT page_id, severity, title FROM crawlissues WHERE rule = 'robots_missing'",
    "issue_bot_blocked": "SELECT page_id, severity, title, bot, operator, reason, matching_rule FROM pg JOIN siteissues i USING (origin) "
    "JOIN access a ON a.origin = pg.origin AND a.bot = i.key WHERE rule = 'bot_blocked'",
    "issue_robots_conflict": "SELECT page_id, severity, title, bots AS specifically_allowed FROM pg JOIN siteissues i USING (origin) "
    "JOIN exceptions e ON e.origin = pg.origin WHERE rule = 'robots_conflict'",
    **{
        f"issue_{r}": f"SELECT i.page_id, severity, title, m.meta_name, m.content FROM crawlissues i JOIN mrobots m "
        f"ON m.page_id = i.page_id AND m.meta_name = i.key WHERE rule = '{r}'"
        for r in ("meta_noindex", "meta_nofollow", "meta_noai")
    },
    **{
        f"issue_{r}": f"SELECT i.page_id, severity, title, x.value AS header_value FROM crawlissues i JOIN xrt x ON x.page_id = i.page_id "
        f"WHERE rule = '{r}'"
        for r in ("xrt_noindex", "xrt_noai")
    },
    "issue_tdm_header_invalid": "SELECT i.page_id, severity, title, s.raw_value FROM tdmissues i JOIN sighead s ON s.page_id = i.page_id "
    "WHERE rule = 'tdm_header_invalid'",
    "issue_tdm_meta_invalid": "SELECT i.page_id, severity, title, s.raw_value FROM tdmissues i JOIN sigmeta s ON s.page_id = i.page_id "
    "WHERE rule = 'tdm_meta_invalid'",
    "issue_tdm_conflict": "SELECT i.page_id, severity, title, reserved_by, allowed_by FROM tdmissues i JOIN sigsum s ON s.page_id = i.page_id "
    "WHERE rule = 'tdm_conflict'",
    "issue_tdm_none": "SELECT page_id, severity, title FROM tdmissues WHERE rule = 'tdm_none'",
    "issue_tdm_declared": "SELECT i.page_id, severity, title, first_policy AS policy, valid_sources AS sources FROM tdmissues i "
    "JOIN sigsum s ON s.page_id = i.page_id WHERE rule = 'tdm_declared'",
    "allowed_weight": "SELECT f.origin, CAST(allowed_weight AS BIGINT) AS allowed_weight FROM sitefacts f",
    "crawl_penalty": "SELECT page_id, CAST(penalty AS BIGINT) AS penalty FROM penalties",
    "crawl_score": "SELECT page_id, value FROM crawlscores",
    "tdm_score": "SELECT page_id, value FROM tdmscores",
    "overall_score": "SELECT page_id, overall_score FROM overall",
    "issue_count": "SELECT page_id, CAST(issue_count AS BIGINT) AS issue_count, CAST(n_crawl AS BIGINT) AS n_crawl, CAST(n_tdm AS BIGINT) AS n_tdm FROM issuecounts",
    "score_percentage": "SELECT page_id, category, value / 100.0 * 100 AS percentage FROM scores",
    "score_summary": "SELECT page_id, CASE category WHEN 'tdm' THEN 'Tdm' ELSE 'Crawlability' END AS label, "
    "repeat('█', CAST(round_even(value / 10.0, 0) AS INTEGER)) || repeat('░', 10 - CAST(round_even(value / 10.0, 0) AS INTEGER)) "
    "AS bar, value || '/100' AS score, CAST(CASE category WHEN 'tdm' THEN n_tdm ELSE n_crawl END AS BIGINT) AS issues "
    "FROM scores JOIN issuecounts USING (page_id)",
    "group_concat": "SELECT page_id, coalesce(valid_sources, '') AS sources, coalesce(reserved_by, '') AS reserved_by, "
    "coalesce(allowed_by, '') AS allowed_by FROM sigsum",
    "first_by_position": "SELECT page_id, arg_min(coalesce(content, ''), tpos) AS first_meta_content, min(tpos) - 1 AS first_pos FROM tags "
    "WHERE el = 'meta' AND name IS NOT NULL GROUP BY 1",
    "last_group_wins": "SELECT origin, agent, CAST(max(group_id) AS BIGINT) AS group_id FROM agents GROUP BY 1, 2",
    "issue_order": "SELECT p.page_id, coalesce(string_agg(rule, '>' ORDER BY ord), '') AS rules FROM pg p LEFT JOIN issues i ON i.page_id = p.page_id GROUP BY 1",
    "tdm_status": "SELECT page_id, CASE WHEN n_signals = 0 THEN 'undeclared' WHEN conflict THEN 'conflicting' WHEN n_valid = 0 THEN 'invalid' "
    "WHEN any_reserved THEN 'reserved' ELSE 'open' END AS status FROM sigsum",
    "scalar_functions": f"""SELECT p.page_id, len(regexp_split_to_array(html, '{NL}')) AS n_lines, x.path AS stripped,
 split_part(url, '#', 1) AS before_hash, 'a|b|' || p.page_id AS parts,
 CASE p.page_id % 9 WHEN 0 THEN CAST('-' || p.page_id AS DOUBLE) WHEN 1 THEN p.page_id + CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(p.page_id AS DOUBLE) * 100
  WHEN 3 THEN CAST('1' || p.page_id AS DOUBLE) WHEN 4 THEN CAST('inf' AS DOUBLE) WHEN 7 THEN CAST('0.' || p.page_id AS DOUBLE)
  WHEN 8 THEN CAST(p.page_id AS DOUBLE) END AS number,
 CAST(round_even(p.page_id / 2, 0) AS BIGINT) AS half_even, greatest(0, least(100, p.page_id - 50)) AS clamped,
 CASE p.page_id % 2 WHEN 0 THEN 'Structured Data' ELSE 'Page ' || p.page_id END AS label,
 '<' || p.page_id || '&gt;' || chr(CAST(65 + p.page_id % 26 AS INTEGER)) || chr(CAST(97 + p.page_id % 26 AS INTEGER)) || 'é&zz;&' AS unescaped
 FROM pg p JOIN ppaths x USING (page_id)""",
    "issue_ai_txt": "SELECT page_id, 'info' AS severity, 'ai_txt' AS rule, 'ai.txt found' AS title FROM pg JOIN aitxts USING (origin)",
    "ai_txt": "SELECT page_id, p.origin, a.origin IS NOT NULL AS ai_txt FROM pg p LEFT JOIN aitxts a ON a.origin = p.origin",
    "over_restrictive": "SELECT f.origin, CAST(allowed_weight AS BIGINT) AS allowed_weight, CAST(n AS BIGINT) AS n_blocked FROM sitefacts f "
    "JOIN (SELECT origin, count(*) FILTER (WHERE NOT allowed AND ord BETWEEN 1 AND 12) AS n FROM access GROUP BY 1) USING (origin) "
    "WHERE allowed_weight <= 50",
    "vendor_conflict": f"SELECT origin, vendor, string_agg(bot, ', ' ORDER BY ord) FILTER (WHERE allowed) AS allowed_bots, "
    "string_agg(bot, ', ' ORDER BY ord) FILTER (WHERE NOT allowed) AS blocked_bots FROM "
    f"(SELECT *, {strip(chr(34) + 'v' + chr(34))} AS vendor FROM (SELECT *, split_part(operator, '(', 1) AS v FROM access WHERE ord BETWEEN 1 AND 12)) "
    "GROUP BY 1, 2 HAVING count(DISTINCT allowed) = 2",
    "tdmrep_reference": r"""SELECT page_id, CAST(count(*) AS BIGINT) AS n_references FROM (SELECT page_id, unnest(regexp_extract_all(html,
 '(?i)<(?:a|link|area)\s[^>]*href\s*=\s*["'']?[^"''>\s]*tdmrep\.json')) FROM pg) GROUP BY 1""",
}


def core_oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in SQL.items()}
