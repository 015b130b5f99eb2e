"""Reference resolution by literal cases, and canonical chains against a walk from page to page."""

from __future__ import annotations

import random

import pytest

from sitegauge.functions import url as U
from sitegauge.operators import canonical
from sitegauge.plans import skew
from tests.helpers import crawl

BASE = "http://a/b/c/d;p?q"
# The examples that the public rules for relative references give, then cases of our own.
CASES = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g/"),
    ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"),
    ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"),
    ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"),
    ("http://a/./b/%2E%2e/c", "http://a/c"), ("HTTP://U:P@EXAMPLE.com:80", "http://U:P@example.com/"), ("//X:443/a", "http://x:443/a"), ("https://X:443?q", "https://x/?q"),
    ("https://x:8443/", "https://x:8443/"), ("mailto:A@b.c", "mailto:A@b.c"), (" \n/g\t ", "http://a/g"), ("/a\n/b", "http://a/a/b"), ("a//../b", "http://a/b/c/a/b"),
    ("/" + "x/" * 50 + "../" * 49, "http://a/x/"), ("?", "http://a/b/c/d;p?"), ("a:80/x", "a:80/x"),
]


def test_references(spark):
    df = spark.createDataFrame([(r, BASE, want) for r, want in CASES], "r string, b string, want string")
    wrong = [(x.r, x.got, x.want) for x in df.select("r", "want", U.resolve("r", "b").alias("got")).collect() if x.got != x.want]
    assert not wrong


def test_references_without_a_base_or_reference(spark):
    df = spark.createDataFrame([(None, BASE), ("g", None), ("http://h", None), ("../g", ""), ("/g", "not an address")], "r string, b string")
    assert [x.got for x in df.select(U.resolve("r", "b").alias("got")).collect()] == [None, "g", "http://h/", "../g", "/g"]


def test_own_address_by_any_spelling_is_self(spark):
    links = ["https://CASE0.example:443/p/page", "?", "#x", "../p/./page", "//case4.example/p/page", "page", "/p/page?x=1", "?q=1", "./", "HTTPS://Case9.example/p/page#s"]
    pages, _ = crawl(spark, [{"path": "/p/page", "html": f'<link rel="canonical" href="{h}">'} for h in links])
    got = {r["page_id"]: r["status"] for r in canonical.with_canonical(canonical.with_head(pages)).select("page_id", canonical_status().alias("status")).collect()}
    assert [got[i] for i in range(len(links))] == ["self", "other", "self", "self", "self", "self", "other", "other", "other", "self"]


def canonical_status():
    from sitegauge.operators.attribution import canonical_status as status

    return status()


def walk(nodes):
    out = {}
    for start in nodes:
        met, here = [start], start
        while True:
            to = nodes.get(here)
            if here not in nodes or to is None:
                out[start] = (here, len(met) - 1, False, here not in nodes)
                break
            if to in met:
                final = min(met[met.index(to) :])
                out[start] = (final, met.index(final), True, False)
                break
            met.append(to)
            here = to
    return out


def graphs():
    rng = random.Random(3)
    yield "none", {}
    yield "alone", {"a": None, "b": None}
    yield "two in a circle", {"a": "b", "b": "a"}
    yield "tail into a circle", {"t1": "t2", "t2": "c", "c": "d", "d": "b", "b": "c", "x": "t1"}
    yield "long chain", {f"n{i:03}": f"n{i + 1:03}" for i in range(200)}
    yield "long circle", {f"n{i:03}": f"n{(i + 1) % 130:03}" for i in range(130)} | {"tail": "n077"}
    yield "star", {f"s{i}": "hub" for i in range(300)} | {"hub": "last", "last": None}
    for n in (5, 40, 150):
        names = [f"v{i}" for i in range(n)]
        yield f"random {n}", {v: rng.choice([*names, *names, *names, None, "outside"]) for v in names}


@pytest.mark.parametrize("name, nodes", list(graphs()), ids=[n for n, _ in graphs()])
def test_chains_equal_a_walk(spark, name, nodes):
    nodes = {v: None if t == v else t for v, t in nodes.items()}
    links = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(nodes.items())] + [(1000, None, "a"), (1001, None, None)], "page_id long, address string, target string")
    got = {r["address"]: (r["final"], r["hops"], r["in_cycle"], r["outside"]) for r in canonical.canonical_chains(links).collect()}
    assert got == walk(nodes)


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    real = canonical.store
    monkeypatch.setattr(canonical, "store", lambda df, path: (rounds.append(path), real(df, path))[1])
    links = spark.createDataFrame([(i, f"n{i:04}", f"n{i + 1:04}") for i in range(1000)], "page_id long, address string, target string")
    found = canonical.canonical_chains(links).agg({"hops": "max", "address": "count"}).first()
    assert (found["max(hops)"], found["count(address)"]) == (1000, 1000)
    assert len(rounds) <= 2 + 10


def test_hot_target_and_repeated_pages(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(skew.join_one_per_key, "__defaults__", (None, 20))
    html = '<link rel="canonical" href="{}">'
    rows = [(i, f"https://h.example/{i}#f", html.format("/hub")) for i in range(100)]
    rows += [(200, "https://h.example/hub", html.format("https://H.example:443/end#x")), (201, "https://h.example/end", None), (202, None, html.format("/hub"))]
    rows += [(300 + i, "https://h.example/twice", html.format(f"/{i}")) for i in (7, 3)] + [(400, "https://h.example/0", html.format("/hub"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in canonical.page_canonicals(pages).collect()}
    end = "https://h.example/end"
    assert got[5] == ("https://h.example/5", end, 2, False, False) and got[201] == (end, end, 0, False, False)
    assert got[200] == ("https://h.example/hub", end, 1, False, False) and got[202][1:] == (None, None, None, None)
    # two pages of one address that name different ones: the smaller counts
    assert got[307][1:3] == (end, 3) and got[303] == got[307]
    clusters = {r["final"]: tuple(r)[1:] for r in canonical.canonical_clusters(pages).collect()}
    assert clusters == {end: (105, 103, 3, False)}
