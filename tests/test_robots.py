"""robots.txt parsing and access resolution: literal cases, seeded random files, invariants."""

from __future__ import annotations

import random

import pytest

from sitegauge.operators import access, robots
from sitegauge.sources import tables
from sitegauge.sources.bots import BOTS, HIGH_IMPACT, bot_registry
from tests.helpers import crawl


def groups_of(spark, bodies):
    _, files = crawl(spark, [{"robots": b} for b in bodies])
    rows = robots.site_policies(tables.site_scan(files)).collect()
    by_case = {int(r.origin.split("case")[1].split(".")[0]): r for r in rows}
    return [sorted(by_case[i].groups, key=lambda g: g.group_id) for i in range(len(bodies))]


# body -> per group: (agents lower-cased, rules as (path, allow), crawl delay)
PARSE = [
    ("", []),
    ("# only notes here\n  # and here\n", []),
    ("User-agent: Bytespider\nDisallow: /shop\nAllow: /shop/open\nDisallow: /tmp\n",
     [(["bytespider"], [("/shop", False), ("/shop/open", True), ("/tmp", False)], None)]),
    ("User-agent: *\nAllow: /\n\n\nUser-agent: cohere-ai\n\nDisallow: /\nUser-agent: CCBot\nDisallow: /en\n",
     [(["*"], [("/", True)], None), (["cohere-ai"], [("/", False)], None), (["ccbot"], [("/en", False)], None)]),
    ("User-agent: One\nuser-AGENT: two\nUSER-agent: THREE\nDisallow: /a\n", [(["one", "two", "three"], [("/a", False)], None)]),
    ("User-agent: q\nDisallow: /1\nCrawl-delay: 2.5\nCrawl-delay: never\n", [(["q"], [("/1", False)], 2.5)]),
    ("User-agent: q\nCrawl-delay: 3\nCrawl-delay: 7\nAllow: /", [(["q"], [("/", True)], 7.0)]),
    ("User-agent: q\nCrawl-delay: 1_5\nDisallow: /", [(["q"], [("/", False)], 15.0)]),
    ("User-agent: r # robot\nDisallow: /x # not there\n", [(["r"], [("/x", False)], None)]),
    ("User-agent: r\nDisallow:\nDisallow: \n", [(["r"], [], None)]),
    ("hello there\nUser-agent: r\n???\nAllow: /ok\n", [(["r"], [("/ok", True)], None)]),
    ("User-agent: a\r\nDisallow: /x\r\nUser-agent: b\rAllow: /y", [(["a"], [("/x", False)], None), (["b"], [("/y", True)], None)]),
    ("Disallow: /early\nUser-agent: a\nAllow:", [(["a"], [("", True)], None)]),
    ("User-agent: a\nDisallow:\nUser-agent: b\nDisallow: /", [(["a", "b"], [("/", False)], None)]),
    ("User-agent: a\nAllow:\nUser-agent: b\nDisallow: /", [(["a"], [("", True)], None), (["b"], [("/", False)], None)]),
    ("User-agent: a\x0cDisallow: /x:y ", [(["a"], [("/x:y", False)], None)]),
]


def test_parse(spark):
    got = groups_of(spark, [b for b, _ in PARSE])
    for (body, want), groups in zip(PARSE, got):
        seen = [
            (list(g.agents), [(r.path, r.allow) for r in sorted(g.rules, key=lambda r: r.pos)], g.crawl_delay) for g in groups
        ]
        assert [(sorted(a), r, d) for a, r, d in seen] == [(sorted(a), r, d) for a, r, d in want], body


# body, bot, path -> allowed, part of the reason, matching rule
ACCESS = [
    ("# empty", "CCBot", "/any", True, "default allow", None),
    ("User-agent: ccbot\nDisallow: /any", "CCBot", "/any/where", False, "specific", "Disallow: /any"),
    ("User-agent: *\nDisallow: /any", "CCBot", "/any", False, "wildcard block (path: /any)", "Disallow: /any"),
    ("User-agent: *\nDisallow: /any", "CCBot", "/an", True, "wildcard group, no matching path rule (default allow)", None),
    ("User-agent: *\nDisallow: /\nAllow: /a\nDisallow: /a/b", "Bytespider", "/a/c", True, "wildcard", "Allow: /a"),
    ("User-agent: *\nDisallow: /\nAllow: /a\nDisallow: /a/b", "Bytespider", "/a/b/c", False, "wildcard", "Disallow: /a/b"),
    ("User-agent: *\nAllow: /\nUser-agent: Bytespider\nDisallow: /", "Bytespider", "/", False, "specific block (path: /)", "Disallow: /"),
    ("User-agent: Bytespider\nAllow: /\nUser-agent: *\nDisallow: /", "Bytespider", "/", True, "specific allow (path: /)", "Allow: /"),
    ("User-agent: *\nDisallow: /q", "NobodyBot", "/q?x=1", False, "wildcard", "Disallow: /q"),
    ("User-agent: cohere-ai\nUser-agent: *\nDisallow:", "cohere-ai", "/", True, "specific group, no matching", None),
    ("User-agent: CCBot\nDisallow: /\nUser-agent: CCBot\nAllow: /", "CCBot", "/", True, "specific", "Allow: /"),
    ("User-agent: *\nDisallow: /\nAllow: /", "CCBot", "/", False, "wildcard", "Disallow: /"),
    ("User-agent: *\nAllow: /\nDisallow: /", "CCBot", "/", True, "wildcard", "Allow: /"),
    ("User-agent: *\nDisallow: /A", "CCBot", "/a", True, "no matching path", None),
    ("User-agent: *\nDisallow: /", "*", "/", False, "specific", "Disallow: /"),
    ("User-agent: CCBot-Images\nDisallow: /", "CCBot", "/", True, "no matching rule (default allow)", None),
]


def test_access(spark):
    _, files = crawl(spark, [{"robots": a[0]} for a in ACCESS])
    asks = spark.createDataFrame([(f"https://case{i}.example", a[1], a[2]) for i, a in enumerate(ACCESS)], "origin string, b string, p string")
    rows = asks.join(robots.site_policies(tables.site_scan(files)).select("origin", "groups"), "origin", "left")
    got = {r.origin: r for r in access.access_for(rows, "array(b)", "p").collect()}
    for i, (body, bot, path, allowed, reason, rule) in enumerate(ACCESS):
        r = got[f"https://case{i}.example"]
        assert (r.bot, r.allowed, r.matching_rule) == (bot, allowed, rule), body
        assert reason in r.reason, (body, r.reason)
        assert r.operator == dict((b, o) for b, o, _ in BOTS).get(bot, bot)


def random_file(rng):
    """A robots file made from random groups, and the groups that it was made from."""
    lines, groups = [rng.choice(["Disallow: /too-early", "# top", "no colon", ""]) for _ in range(rng.randint(0, 3))], []
    for _ in range(rng.randint(0, 5)):
        agents = [rng.choice("abc*") for _ in range(rng.randint(1, 3))]
        rules = [(rng.choice(["/", "/x", "/y:z", "/a/b"]), rng.random() < 0.5) for _ in range(rng.randint(1, 4))]
        lines += [rng.choice(["User-agent: ", "USER-AGENT : ", "\tuser-agent:"]) + a.upper() for a in agents]
        for path, allow in rules:
            lines.append(rng.choice(["Allow: ", "allow :"] if allow else ["Disallow: ", "DISALLOW:\t"]) + path + rng.choice(["", " # why", "  "]))
            lines += rng.choice([[], ["Disallow:"], ["Crawl-delay: 3"], ["# note"], ["Sitemap: https://s"], [""]])
        groups.append((sorted(agents), rules))
    return "".join(line + rng.choice(["\n", "\r\n", "\r", "\x0c", "\x85"]) for line in lines), groups


def test_random_files(spark):
    rng = random.Random(7)
    made = [random_file(rng) for _ in range(150)]
    for (body, want), groups in zip(made, groups_of(spark, [body for body, _ in made])):
        got = [(sorted(g.agents), [(r.path, r.allow) for r in sorted(g.rules, key=lambda r: r.pos)]) for g in groups]
        assert got == want, repr(body)


def test_registry(spark):
    rows = bot_registry(spark).collect()
    assert len(rows) == 12 and sum(r.weight for r in rows) == 100
    assert {r.bot for r in rows if r.high_impact} == set(HIGH_IMPACT) and len(HIGH_IMPACT) == 4
    assert [r.ord for r in rows] == list(range(1, 13))


def test_twelve_rows_per_origin_and_one_shuffle(spark):
    _, files = crawl(spark, [{"robots": b} for b, _ in PARSE])
    matrix = access.bot_access(access.site_facts(robots.site_policies(tables.site_scan(files))))
    assert {r["count"] for r in matrix.groupBy("origin").count().collect()} == {12}
    assert matrix._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [20_000])
def test_long_file(spark, n):
    """One very long file: every line counts, the last group wins."""
    body = "\n".join(f"User-agent: bot{i}\nDisallow: /{i}" for i in range(n)) + "\nUser-agent: GPTBot\nDisallow: /"
    (groups,) = groups_of(spark, [body])
    assert len(groups) == n + 1 and groups[-1].agents == ["gptbot"]
