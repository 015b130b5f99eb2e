"""Issue rules: each is a condition over the page row that yields an issue struct.

All rules of a page are evaluated in one projection; the result is one array per page, in the
order in which issues are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.rows import inline_rows
from sitegauge.functions.sqltext import lit, string_map, struct
from sitegauge.operators import signals as sig

SEVERITIES = ("high", "medium", "low", "info")

# Rule -> (severity, title format). The severity of bot_blocked depends on the bot.
TITLES = {
    "robots_missing": ("low", "robots.txt not found or inaccessible"),
    "bot_blocked": (None, "{bot} blocked — {operator}"),
    "robots_conflict": ("medium", "Conflicting directives: wildcard block with specific allows"),
    "meta_noindex": ("high", "meta {meta_name}: noindex directive found"),
    "meta_nofollow": ("medium", "meta {meta_name}: nofollow directive found"),
    "meta_noai": ("medium", "meta {meta_name}: {_word} directive found"),
    "xrt_noindex": ("high", "X-Robots-Tag: noindex header found"),
    "xrt_noai": ("medium", "X-Robots-Tag: {_word} header found"),
    "tdm_header_invalid": ("medium", "Invalid TDM-Reservation header value"),
    "tdm_meta_invalid": ("medium", "Invalid TDM meta tag value"),
    "tdm_conflict": ("high", "Conflicting TDM signals — reservation status unclear"),
    "tdm_none": ("medium", "No TDM policy declared"),
    "tdm_declared": ("info", "TDM policy declared: {_label}"),
}
# Our own rules for the parts that have no fixed results.
TITLES |= {
    "sd_none": ("medium", "No structured data"),
    "sd_jsonld_invalid": ("medium", "JSON-LD does not parse: {n} block(s)"),
    "sd_missing": (None, "No {type} markup"),
    "sd_nesting": ("low", "Nested objects without a type: {n}"),
    "ex_h1_missing": ("medium", "No main heading"),
    "ex_h1_multiple": ("low", "More than one main heading: {n}"),
    "ex_heading_skip": ("low", "Heading levels skipped: {n}"),
    "ex_no_region": ("medium", "No main or article region"),
    "at_no_author": ("low", "No author markup"),
    "at_no_date": ("low", "No readable date"),
    "at_canonical_other": ("info", "Canonical address points elsewhere"),
    "at_no_social": ("info", "No social preview tags"),
    "at_no_https": ("medium", "Not served over https"),
}
# Our own wording: rule -> (what was seen, what to do about it).
ADVICE = {
    "robots_missing": (
        "The site serves no robots.txt, so every crawler acts as if it had full access.",
        "Publish a robots.txt that says which AI crawlers are welcome.",
    ),
    "bot_blocked": (
        "{bot} is kept out by robots.txt ({reason}), so {_vendor} cannot use this site.",
        "Add a group for {bot} with \"Allow: /\" if it should be let in.",
    ),
    "robots_conflict": (
        "All crawlers are shut out by the * group while these have their own way in: {_bots}.",
        "Valid as it stands; check that the list of exceptions is the intended one.",
    ),
    "meta_noindex": (
        "The meta tag {meta_name} asks engines to leave this page out of their index.",
        "Drop noindex from the tag if the page should be found.",
    ),
    "meta_nofollow": (
        "The meta tag {meta_name} asks crawlers to ignore the links of this page.",
        "Drop nofollow from the tag if linked pages should be found from here.",
    ),
    "meta_noai": (
        "The meta tag {meta_name} carries {_word}: no use for AI is wanted.",
        "Keep it to opt out; not every engine honours it.",
    ),
    "xrt_noindex": (
        "The response header asks engines to leave this page out of their index.",
        "Drop noindex from the header if the page should be found.",
    ),
    "xrt_noai": (
        "The response header carries {_word}: no use for AI is wanted.",
        "Keep it to opt out; not every provider honours it.",
    ),
    "tdm_header_invalid": (
        "The TDM-Reservation header holds \"{raw_value}\", which is neither 0 nor 1.",
        "Send 1 to reserve mining rights or 0 to permit mining.",
    ),
    "tdm_meta_invalid": (
        "The tdm-reservation meta tag holds \"{raw_value}\", which is neither 0 nor 1.",
        "Set its content to 1 to reserve mining rights or 0 to permit mining.",
    ),
    "tdm_conflict": (
        "Mining rights are reserved by {_reserved} and at the same time given up by {_allowed}.",
        "Make every channel say the same.",
    ),
    "tdm_none": (
        "Neither header, markup nor policy file says whether mining is permitted.",
        "Declare a policy, first of all with the TDM-Reservation header.",
    ),
    "tdm_declared": (
        "The mining policy \"{_label}\" is stated by: {_sources}.",
        "{_advice}",
    ),
}
ADVICE |= {
    "sd_none": ("The page carries neither JSON-LD nor Microdata nor RDFa.", "Describe the page with schema.org markup."),
    "sd_jsonld_invalid": ("{n} JSON-LD block(s) are not valid JSON.", "Check the blocks with a JSON parser."),
    "sd_missing": ("Nothing on the page is marked up as {type}.", "Add {type} markup where the content fits it."),
    "sd_nesting": ("{n} nested object(s) do not say what they are.", "Give every nested object an @type."),
    "ex_h1_missing": ("No h1 was found.", "Give the page one h1 that names its subject."),
    "ex_h1_multiple": ("{n} h1 headings compete.", "Keep one h1 and turn the others into h2."),
    "ex_heading_skip": ("{n} heading(s) jump by more than one level.", "Step through heading levels one by one."),
    "ex_no_region": ("No main or article element holds the content.", "Wrap the content in main or article."),
    "at_no_author": ("No author is named in markup.", "Name the author in a meta tag or in JSON-LD."),
    "at_no_date": ("No publication or change date can be read.", "State the dates in markup."),
    "at_canonical_other": ("The canonical link names another address.", "Check that the other address is meant."),
    "at_no_social": ("Neither OpenGraph nor card tags are set.", "Add og:title, og:description and og:image."),
    "at_no_https": ("The page address is not https.", "Serve the page over https."),
}
ADVICE_MANY = "Nothing to do: the policy is stated in more than one place."
ADVICE_ONE = "State the policy in a second channel as well, such as header and meta tag."
_PREFIXES = {"tdm": "tdm", "sd": "structured_data", "ex": "extractability", "at": "attribution"}
CATEGORY = {rule: _PREFIXES.get(rule.split("_")[0], "crawlability") for rule in TITLES}

FIELDS = ("ord", "severity", "category", "rule", "key", "title", "description", "recommendation", "details")


def issue(
    severity: str, category: str, title: str, description: str, recommendation: str,
    *, rule: str = "custom", ord: int = 0, key: str = "", **details: Column,
) -> Column:
    """An issue struct for rules of one's own."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity: {severity}")
    texts = dict(
        severity=severity, category=category, rule=rule, key=key, title=title, description=description,
        recommendation=recommendation,
    )
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    cols = {"ord": F.lit(ord), **{k: F.lit(v) for k, v in texts.items()}}
    cols["details"] = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(*[cols[f].alias(f) for f in FIELDS])


def seed(rule: str, ord: str, *, when: str | None = None, severity: str | None = None, key: str = "''",
         args: dict[str, str] | None = None, brief: bool = False) -> str:
    """SQL for the codes of an issue plus the values its texts need.

    Values whose name starts with an underscore go into texts only, not into the details.
    ``brief`` leaves the values out: counts and roll-ups need only the codes.
    """
    fields = dict(
        ord=f"CAST({ord} AS INT)", severity=severity or lit(TITLES[rule][0]), category=lit(CATEGORY[rule]),
        rule=lit(rule), key=key,
    )
    if not brief:
        fields["args"] = string_map(args or {})
    made = struct(**fields)
    return f"CASE WHEN {when} THEN {made} END" if when else made


def render(seeds: str, brief: bool = False) -> str:
    """Fill in the texts of an array of seeds, all rules at once."""
    if brief:
        return seeds

    def text(position: int) -> str:
        texts = {r: (TITLES[r][1], *ADVICE[r])[position] for r in TITLES}
        templates = "map(" + ", ".join(f"{lit(r)}, {lit(t)}" for r, t in texts.items()) + ")"
        fill = "replace(acc, concat('{', e.key, '}'), coalesce(e.value, ''))"
        return f"aggregate(map_entries(i.args), element_at({templates}, i.rule), (acc, e) -> {fill})"

    out = struct(
        **{f: f"i.{f}" for f in FIELDS[:5]}, title=text(0), description=text(1), recommendation=text(2),
        details="map_filter(i.args, (k, v) -> NOT startswith(k, '_'))",
    )
    return f"transform({seeds}, i -> {out})"


def site_seeds(brief: bool = False) -> str:
    """Issues every page inherits from its site: missing file, blocked bots, odd exceptions."""
    missing = seed("robots_missing", "1", when="NOT coalesce(robots_found, false)", brief=brief)
    blocked = seed(
        "bot_blocked", "b.ord + 1", severity="if(b.high_impact, 'high', 'medium')", key="b.bot", brief=brief,
        args={
            **{n: f"b.{n}" for n in ("bot", "operator", "reason", "matching_rule")},
            "_vendor": "trim(substring_index(b.operator, '(', 1))",
        },
    )
    conflict = seed(
        "robots_conflict", "14", when="size(coalesce(specifically_allowed, array())) > 0", brief=brief,
        args={"specifically_allowed": "to_json(specifically_allowed)", "_bots": "array_join(specifically_allowed, ', ')"},
    )
    return f"concat(array({missing}), transform(coalesce(blocked, array()), b -> {blocked}), array({conflict}))"


def page_crawl_seeds(brief: bool = False) -> str:
    """Issues from robots directives in the page's markup and headers."""

    def tag(rule: str, step: int, when: str) -> str:
        args = {"meta_name": "m.meta_name", "content": "m.content", "_word": "coalesce(m.ai_word, '')"}
        return seed(rule, f"m.ord * 3 + {15 + step}", when=when, key="m.meta_name", args=args, brief=brief)

    per_tag = ", ".join(
        [tag("meta_noindex", 0, "m.noindex"), tag("meta_nofollow", 1, "m.nofollow"), tag("meta_noai", 2, "m.ai_word IS NOT NULL")]
    )
    args = {"header_value": "x_robots.value", "_word": "coalesce(x_robots.ai_word, '')"}
    header = ", ".join(
        [
            seed("xrt_noindex", "27", when="x_robots.noindex", args=args, brief=brief),
            seed("xrt_noai", "28", when="x_robots.ai_word IS NOT NULL", args=args, brief=brief),
        ]
    )
    return f"concat(flatten(transform(meta_robots, m -> array({per_tag}))), array({header}))"


def crawl_issues(brief: bool = False) -> Column:
    return F.expr(render(f"array_compact(concat({site_seeds(brief)}, {page_crawl_seeds(brief)}))", brief))


def tdm_issues(brief: bool = False) -> Column:
    """Issues from the ``signals`` array of the row."""

    def bad(rule: str, ord: int, source: str) -> str:
        hits = f"filter(signals, s -> s.source = '{source}' AND s.policy = '{sig.NOT_DECLARED}')"
        made = seed(rule, str(ord), args={"raw_value": "s.raw_value"}, brief=brief)
        return f"get(transform({hits}, s -> {made}), 0)"

    first = f"get({sig.VALID}, 0).policy"
    sources = f"transform({sig.VALID}, s -> s.source)"
    reserved, allowed = sig.sources_sql(sig.RESERVED), sig.sources_sql(sig.NOT_RESERVED)
    shown = f"transform({sig.VALID}, s -> {struct(source='s.source', value='s.raw_value', details='s.details')})"
    declared = seed(
        "tdm_declared", "105", when=f"size({sig.VALID}) > 0 AND NOT {sig.CONFLICT}", key=f"coalesce({first}, '')", brief=brief,
        args={
            "policy": first, "sources": f"to_json({sources})", "signals": f"to_json({shown})",
            # The two policy labels.
            "_label": f"if({first} = '{sig.RESERVED}', 'reserved (opt-out)', 'not reserved (opt-in)')",
            "_sources": f"array_join({sources}, ', ')",
            "_advice": f"if(size({sig.VALID}) > 1, {lit(ADVICE_MANY)}, {lit(ADVICE_ONE)})",
        },
    )
    clash = seed(
        "tdm_conflict", "103", when=sig.CONFLICT, brief=brief,
        args={
            "reserved_by": f"to_json({reserved})", "allowed_by": f"to_json({allowed})",
            "_reserved": f"array_join({reserved}, ', ')", "_allowed": f"array_join({allowed}, ', ')",
        },
    )
    none = seed("tdm_none", "104", when="size(signals) = 0", brief=brief)
    header, meta = bad("tdm_header_invalid", 101, sig.HTTP_HEADER), bad("tdm_meta_invalid", 102, sig.META_TAG)
    return F.expr(render(f"array_compact(array({header}, {meta}, {clash}, {none}, {declared}))", brief))


def ai_txt_issues(pages_with_site: DataFrame) -> DataFrame:
    """An info issue for pages of sites with an ai.txt; not part of the audit, whose rules are fixed.

    Reads ``page_id`` and the flag ``ai_txt`` of the site.
    """
    made = issue(
        "info", "crawlability", "ai.txt found", "The site serves an ai.txt, a proposed file that few crawlers read so far.",
        "Keep it in line with robots.txt, which crawlers do read.", rule="ai_txt", ord=29,
    )
    return inline_rows(pages_with_site.withColumn("i", F.when(F.col("ai_txt"), F.array(made))), ["page_id"], "i", "rule")
