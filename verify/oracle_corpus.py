"""DuckDB statements for reports, roll-ups, comparisons and the stream."""

from __future__ import annotations

import re

from verify.oracle_core import files_sql, pages_sql
from verify.sqlkit import PARTS, oracle, part

part("sitemeans", """SELECT origin, count(*) AS n_pages, CAST(sum(overall_score) AS DOUBLE) / count(*) AS mean_score
 FROM pg JOIN overall USING (page_id) GROUP BY 1""")
part("peers", """SELECT *, regexp_extract(lower(regexp_extract(origin, '://([^:/]*)', 1)), '([^.]+)$', 1) AS peer FROM sitemeans""")

# The second snapshot: every part that depends on the overlay, rebuilt on shifted numbers.
_SHIFTED = ("pg files robots tdmreps aitxts rawlines rlines kinds marks rstate delays rrules agents gmatch access sitefacts "
            "rawtags tagattrs tags metafirst mrobots xrt sighead sigmeta siglink sigrep sigs sigsum exceptions siteissues "
            "crawlissues tdmissues issues").split()
for _name in _SHIFTED:
    _sql = {"pg": pages_sql(1), "files": files_sql(1)}.get(_name, PARTS[_name])
    part(f"{_name}_b", re.sub(
        r"(FROM|JOIN)(\s+)(" + "|".join(_SHIFTED) + r")\b", lambda m: f"{m[1]}{m[2]}{m[3]}_b", _sql
    ).replace("sighead.", "sighead_b."))

_REPORT = """SELECT p.page_id, p.url, CAST(o.overall_score AS VARCHAR) AS overall_score,
 'crawlability:' || w.value || ':100;tdm:' || t.value || ':100' AS scores, coalesce(f.issues, '') AS issues, coalesce(f.bots, '') AS bots,
 CAST(0 AS BIGINT) AS n_bad_texts {extra}
 FROM pg p JOIN overall o USING (page_id) JOIN crawlscores w USING (page_id) JOIN tdmscores t USING (page_id) JOIN issuecounts c USING (page_id)
 LEFT JOIN (SELECT page_id, string_agg(severity || '|' || category || '|' || title, ';' ORDER BY ord) AS issues,
  string_agg(CASE WHEN rule = 'bot_blocked' THEN key ELSE '-' END, ',' ORDER BY ord) AS bots FROM issues GROUP BY 1) f ON f.page_id = p.page_id"""

SQL: dict[str, str] = {
    "report_json": _REPORT.format(extra=""),
    "report_json_full": _REPORT.format(
        extra=", '0.1.0' AS version, '2026-01-01T00:00:00+00:00' AS generated_at, CAST(n_crawl AS VARCHAR) AS crawl_issues, '{}' AS metadata"
    ),
    "report_tables": """SELECT r.page_id, report, category, what, overall_score, issue_count FROM
 (SELECT page_id, 'scores' AS report, category, CAST(value AS VARCHAR) AS what FROM scores
  UNION ALL SELECT page_id, 'issues', category, rule || ':' || key FROM issues) r
 JOIN overall o ON o.page_id = r.page_id JOIN issuecounts c ON c.page_id = r.page_id""",
    "issue_rollup": "SELECT category, severity, rule, count(*) AS n_issues, count(DISTINCT page_id) AS n_pages FROM issues "
    "GROUP BY ROLLUP (category, severity, rule)",
    "site_ranking": "SELECT origin, n_pages, mean_score, dense_rank() OVER (ORDER BY mean_score DESC) AS site_rank FROM sitemeans",
    "site_ranking_worst": "SELECT origin, n_pages, mean_score FROM sitemeans ORDER BY mean_score, origin LIMIT 10",
    "site_ranking_best": "SELECT origin, n_pages, mean_score FROM sitemeans ORDER BY mean_score DESC, origin LIMIT 10",
    "bot_block_rate": """SELECT bot, n_sites, n_sites_blocking, n_pages, n_pages_blocking,
 n_sites_blocking / n_sites AS site_rate, n_pages_blocking / n_pages AS page_rate FROM
 (SELECT bot, count(*) AS n_sites, count(*) FILTER (WHERE NOT allowed) AS n_sites_blocking, CAST(sum(n) AS BIGINT) AS n_pages,
  CAST(coalesce(sum(n) FILTER (WHERE NOT allowed), 0) AS BIGINT) AS n_pages_blocking
  FROM access JOIN (SELECT origin, count(*) AS n FROM pg GROUP BY 1) USING (origin) WHERE ord BETWEEN 1 AND 12 GROUP BY 1)""",
    "policy_mix": """SELECT CASE WHEN n_signals = 0 THEN 'undeclared' WHEN conflict THEN 'conflicting' WHEN n_valid = 0 THEN 'invalid'
 WHEN any_reserved THEN 'reserved' ELSE 'open' END AS status, coalesce(replace(valid_sources, ', ', '+'), '') AS channels,
 count(*) AS n_pages FROM sigsum GROUP BY 1, 2""",
    "peer_compare": """SELECT origin, peer, count(*) OVER w AS n_peers, mean_score,
 round(mean_score - avg(mean_score) OVER w, 6) AS gap,
 percent_rank() OVER (PARTITION BY peer ORDER BY mean_score) AS percent_rank FROM peers WINDOW w AS (PARTITION BY peer)""",
    "audit_diff": """SELECT url, rule, key, CASE WHEN max(o) = 0 THEN 'new' WHEN max(n) = 0 THEN 'fixed' ELSE 'kept' END AS status FROM
 (SELECT p.url, i.rule, i.key, 1 AS o, 0 AS n FROM pg p JOIN issues i ON i.page_id = p.page_id
  UNION ALL SELECT p.url, i.rule, i.key, 0, 1 FROM pg_b p JOIN issues_b i ON i.page_id = p.page_id) GROUP BY 1, 2, 3""",
    "audit_stream": "SELECT page_id, overall_score, issue_count FROM overall JOIN issuecounts USING (page_id)",
}
SQL |= {"live_audit": SQL["audit_stream"], "live_rollup": SQL["issue_rollup"], "live_site_ranking": SQL["site_ranking"], "audit_diff_stored": SQL["audit_diff"]}


def corpus_oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in SQL.items()}
