"""DuckDB statements for the operators that SQL can express.

They go by the definitions, not by the method: patterns as they are given and rows instead of
arrays; every window that shares a shingle with an item instead of fingerprints; every line and
every phrase counted as text; every entry of a codebook compared.
"""

from __future__ import annotations

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) "
    f"ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) - CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_IP = "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INTEGER), 0) <= 255))"
_TURNED = "substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4)"
_MOD97 = (
    f"list_reduce(list_prepend(0, list_transform(range(1, length({_TURNED}) + 1), "
    f"lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({_TURNED}, i, 1)) - 1)), "
    "lambda s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
)
_RUN = "[0-9]([\\x20-]?[0-9])+"
# kind, order, pattern, what confirms a match, what lets it stand
_KINDS = (
    ("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    ("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _IP, "true"),
    ("card", 3, _RUN, f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", "true"),
    ("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", "true"),
    ("iban", 5, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _MOD97, "true"),
    (
        "card_short", 6, _RUN, f"length({_DIGITS}) BETWEEN 13 AND 15 AND {_LUHN}",
        r"regexp_matches(right(g, 40) || ' ' || left(a, 20), '(?i)\b(card|visa|amex|credit|payment)\b')",
    ),
)


def _spans(kind: str, number: int, pattern: str, valid: str, stands: str) -> str:
    return f"""SELECT rid, {number} AS o, '{kind}' AS kind, b AS s, b + length(v) AS e FROM
 (SELECT *, CAST(sum(length(g)) OVER w + sum(length(v)) OVER w - length(v) AS BIGINT) AS b FROM
  (SELECT rid, unnest(m) AS v, unnest(p[1:len(m)]) AS g, unnest(p[2:len(m) + 1]) AS a, generate_subscripts(m, 1) AS i FROM
   (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {valid} AND {stands}"""


PII = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans(*k) for k in _KINDS)}),
j AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o <= 4) AS base,
 {", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in _KINDS[:4])} FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _KINDS[:4])},
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""

DECONTAMINATION = r"""WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, sh, count(*) AS ci FROM
 (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh FROM items) GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM items),
dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
dsh AS (SELECT rid, len(w) AS ln, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh,
 unnest(range(0, len(w) - k + 1)) AS pos FROM dw CROSS JOIN ks WHERE len(w) >= k),
hits AS (SELECT d.rid, d.ln, d.pos, i.item_id, i.n, i.k, i.sh, i.ci, least(i.n, d.ln) AS size FROM dsh d JOIN ish i ON d.sh = i.sh AND d.k = i.k),
wins AS (SELECT DISTINCT rid, item_id, unnest(range(greatest(0, pos - size + k), least(pos, ln - size) + 1)) AS x FROM hits),
counted AS (SELECT h.rid, h.item_id, h.n, h.k, h.size, w.x, h.sh, any_value(h.ci) AS ci, count(*) AS cw FROM wins w
 JOIN hits h ON h.rid = w.rid AND h.item_id = w.item_id AND h.pos BETWEEN w.x AND w.x + h.size - h.k GROUP BY ALL),
scored AS (SELECT rid, item_id, n, x, CAST(sum(least(ci, cw)) AS BIGINT) AS c, any_value(n + size - 2 * k + 2) AS both_sizes FROM counted GROUP BY rid, item_id, n, x)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_words, max(c / (both_sizes - c)) AS similarity FROM scored JOIN dw USING (rid)
 GROUP BY rid, doc_id, item_id, n HAVING max(c / (both_sizes - c)) >= 0.8 - 1e-12"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(x) AS word, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)),
win AS (SELECT rid, i, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s, i + 7 <= n AS whole FROM w),
twice AS (SELECT rid, i, whole AND count(*) OVER (PARTITION BY rid, whole, s) > 1 AS again FROM win),
spread AS (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM twice),
rep AS (SELECT rid, count(*) FILTER (WHERE covered) AS n_repeat_words FROM spread GROUP BY rid),
cnt AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT rid, source, t, line, trim(regexp_replace(regexp_replace(translate(line, {_AZ}), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x
 FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY rid),
over_limit AS (SELECT source, x FROM n GROUP BY source, x HAVING count(DISTINCT t) > 10),
gone AS (SELECT n.rid, CAST(sum(len(string_split(n.x, ' '))) AS BIGINT) AS removed_words, count(*) AS removed_lines
 FROM n JOIN over_limit o ON n.x = o.x AND n.source IS NOT DISTINCT FROM o.source GROUP BY n.rid),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words, coalesce(removed_lines, 0) AS removed_lines
 FROM d LEFT JOIN cnt USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * removed_words > n_words) AS kept FROM f"""


def _codes(rounds: int = 6) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""t{i} AS MATERIALIZED (SELECT rid, p, x, min_by(e, (d, e)) AS e, min(d) AS d FROM (
 SELECT q.rid, q.p, q.x, b.e, CAST(list_sum(list_transform(list_zip(q.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
 FROM parts q JOIN b{i} b ON q.p = b.p) GROUP BY rid, p, x)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{i} b LEFT JOIN (SELECT p, e, list(v ORDER BY o) AS y FROM (
 SELECT p, e, o, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
 FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS o FROM t{i}) GROUP BY p, e, o) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
            )
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
 list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS y FROM parts WHERE rid <= 16),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, o)) AS codebooks_sha256 FROM (SELECT p, e, unnest(y) AS v, generate_subscripts(y, 1) AS o FROM b{rounds})),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM t{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid) CROSS JOIN book"""


PHRASES = rf"""WITH w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
 SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (
 SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(w) >= k)
 GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS b FROM c, range(2, 4) r(s), range(1, 4) q(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 80 * a),
cuts AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (l.a + r.a) AS BIGINT) AS score
 FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c
 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
 FROM weakest JOIN n USING (lang) QUALIFY rank <= 2000"""

ORACLES = {"op4_pii": PII, "op6_decontamination": DECONTAMINATION, "op11_quality_rules": QUALITY, "op12_vector_codes": _codes(), "op13_collocations": PHRASES}
