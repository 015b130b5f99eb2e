"""Which crawler may read what: group choice, longest rule, reason.

Groups are nested in the origin's row, so every bot is resolved in place by array functions:
no bots-times-sites join and no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.rows import keep_where
from sitegauge.functions.sqltext import struct
from sitegauge.operators.robots import GROUP_TYPE
from sitegauge.sources.bots import bot_array_sql


def group_match_sql(requests: str, groups: str = "groups") -> str:
    """Adds the number of the group that speaks for each bot.

    An exact agent beats ``*``; within each class the last group in the file wins.
    ``requests`` is an array of structs with a ``bot`` field.
    """

    def last_group(agent: str) -> str:
        return f"array_max(transform(filter({groups}, g -> array_contains(g.agents, {agent})), g -> g.group_id))"

    matched = struct(request="r", specific_id=last_group("lower(r.bot)"), wildcard_id=last_group("'*'"))
    return f"transform({requests}, r -> {matched})"


def group_match(requests: str | None = None, groups: str = "groups") -> Column:
    return F.expr(group_match_sql(requests or bot_array_sql(), groups))


def resolve_sql(requests: str, path: str = "'/'", groups: str = "groups") -> str:
    """``array<struct<ord, bot, operator, weight, high_impact, allowed, reason, matching_rule>>``."""
    rules = f"get(filter({groups}, g -> g.group_id = coalesce(m.specific_id, m.wildcard_id)), 0).rules"
    hits = f"filter({rules}, r -> startswith({path}, r.path) OR r.path IN ('/', ''))"
    # longest path first, then the earliest line
    best = f"array_max(transform({hits}, r -> {struct(len='length(r.path)', neg_pos='-r.pos', allow='r.allow', path='r.path')}))"
    kind = "CASE WHEN m.specific_id IS NOT NULL THEN 'specific' WHEN m.wildcard_id IS NOT NULL THEN 'wildcard' END"
    ruled = f"transform({group_match_sql(requests, groups)}, m -> {struct(q='m.request', kind=kind, rule=best)})"
    # Fixed formats: the reasons and rules as they are reported.
    reason = (
        "CASE WHEN d.kind IS NULL THEN 'no matching rule (default allow)' "
        "WHEN d.rule IS NULL THEN concat(d.kind, ' group, no matching path rule (default allow)') "
        "ELSE concat(d.kind, if(d.rule.allow, ' allow (path: ', ' block (path: '), d.rule.path, ')') END"
    )
    matching = "concat(if(d.rule.allow, 'Allow: ', 'Disallow: '), d.rule.path)"
    out = struct(
        **{f: f"d.q.{f}" for f in ("ord", "bot", "operator", "weight", "high_impact")},
        allowed="coalesce(d.rule.allow, true)", reason=reason, matching_rule=matching,
    )
    return f"transform({ruled}, d -> {out})"


STAR = "named_struct('ord', 0, 'bot', '*', 'operator', '*', 'weight', 0, 'high_impact', false)"


def named_requests_sql(bots: str) -> str:
    """Requests for any bot names (array of string); an unknown bot is its own operator."""
    known = f"get(filter({bot_array_sql()}, b -> b.bot = n.bot), 0)"
    found = f"transform(transform({bots}, x -> named_struct('bot', x)), n -> named_struct('bot', n.bot, 'k', {known}))"
    out = struct(
        ord="coalesce(f.k.ord, 99)", bot="f.bot", operator="coalesce(f.k.operator, f.bot)",
        weight="coalesce(f.k.weight, 0)", high_impact="coalesce(f.k.high_impact, false)",
    )
    return f"transform({found}, f -> {out})"


def site_facts(policies: DataFrame) -> DataFrame:
    """One narrow row per origin: everything the page audit needs to know about its site.

    ``bots`` holds the twelve registry bots at path ``/``.
    """
    requests = f"concat(array({STAR}), {bot_array_sql()})"
    flags = ["origin", "robots_found", "tdmrep", "ai_txt"]
    seen = policies.select(*flags, F.expr(resolve_sql(requests)).alias("resolved"))
    bots = seen.select(
        *flags,
        F.expr("resolved[0].allowed").alias("star_allowed"),
        F.expr("slice(resolved, 2, size(resolved) - 1)").alias("bots"),
    )
    weight = (
        "aggregate(bots, named_struct('ok', 0, 'total', 0), (a, b) -> named_struct("
        "'ok', a.ok + if(b.allowed, b.weight, 0), 'total', a.total + b.weight), "
        "a -> if(a.total = 0, 100, CAST(bround(a.ok * 100 / a.total, 0) AS INT)))"
    )
    specific = "transform(filter(bots, b -> b.allowed AND startswith(b.reason, 'specific')), b -> b.bot)"
    return bots.select(
        "*",
        F.expr(weight).alias("allowed_weight"),
        F.expr(f"if(star_allowed, CAST(array() AS ARRAY<STRING>), {specific})").alias("specifically_allowed"),
    )


def bot_access(facts: DataFrame) -> DataFrame:
    """The access matrix at path ``/``: twelve rows per origin."""
    return facts.select("origin", F.inline_outer("bots"))


def wildcard_access(policies: DataFrame) -> DataFrame:
    """What the site says to ``*`` itself."""
    return policies.select("origin", F.inline_outer(F.expr(resolve_sql(f"array({STAR})")))).select(
        "origin", "bot", "allowed", "reason", "matching_rule"
    )


def _requests(bots: str | None) -> str:
    return bot_array_sql() if bots is None else named_requests_sql(bots)


def needed_groups(policies: DataFrame, bots: str | None = None) -> DataFrame:
    """(origin, groups) with only the groups that one of the bots is held to, chosen once per origin."""
    ids = f"transform({group_match_sql(_requests(bots))}, m -> coalesce(m.specific_id, m.wildcard_id))"
    chosen = policies.select("origin", "groups", F.expr(ids).alias("_ids"))
    return chosen.select("origin", F.expr("filter(groups, g -> array_contains(_ids, g.group_id))").alias("groups"))


def access_for(df: DataFrame, bots: str | None = None, path: str = "'/'", nested: bool = False) -> DataFrame:
    """Access for any bots and any path over rows that carry ``groups``.

    ``bots`` (array of string) and ``path`` are SQL; without ``bots`` the registry is asked. With
    ``nested`` the answers stay in one array column, ``access``.
    """
    keep = [c for c in df.columns if c != "groups"]
    ready = df.withColumn("groups", F.expr(f"coalesce(groups, CAST(array() AS {GROUP_TYPE}))"))
    answered = ready.select(*keep, F.expr(resolve_sql(_requests(bots), path)).alias("access"))
    return answered if nested else answered.select(*keep, F.inline_outer("access"))


def over_restrictive(facts: DataFrame, allowed_at_most: int = 50) -> DataFrame:
    """Sites that shut out at least half of the crawler weight."""
    blocked = F.expr("size(filter(bots, b -> NOT b.allowed))").alias("n_blocked")
    return keep_where(facts, ["origin", "allowed_weight", blocked], f"allowed_weight <= {allowed_at_most}")


def vendor_conflict(facts: DataFrame) -> DataFrame:
    """Operators with one crawler let in and another kept out by the same site."""
    pair = struct(vendor="trim(substring_index(b.operator, '(', 1))", allowed="b.allowed", bot="b.bot")
    pairs = facts.select("origin", F.expr(f"transform(bots, b -> {pair})").alias("pairs"))
    names = pairs.select("origin", "pairs", F.explode_outer(F.expr("array_distinct(pairs.vendor)")).alias("vendor"))

    def bots_with(condition: str) -> Column:
        return F.expr(f"array_join(transform(filter(pairs, p -> p.vendor = vendor AND {condition}), p -> p.bot), ', ')")

    return names.select(
        "origin", "vendor", bots_with("p.allowed").alias("allowed_bots"), bots_with("NOT p.allowed").alias("blocked_bots")
    ).filter("allowed_bots <> '' AND blocked_bots <> ''")
