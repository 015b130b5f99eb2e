"""Items and their properties against a plain stack, and nodes that refer to each other."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from sitegauge.operators import items, structured


def table(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Stack(HTMLParser):
    """(item, parent, property, value, child) of Microdata, by a list of all open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.items, self.found = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        owner = next((e["item"] for e in reversed(self.open) if e["item"] is not None), None)
        names = list(dict.fromkeys((a.get("itemprop") or "").split()))
        item = None
        if "itemscope" in a:
            item = len(self.items)
            self.items.append(owner if names else None)
        value = {"meta": "content", "a": "href"}.get(tag)
        entry = {"el": tag, "item": item, "text": []}
        for n in names:
            if owner is not None:
                self.found.append([owner, n, a.get(value) or "" if value and item is None else entry, item])
        if tag != "meta":
            self.open.append(entry)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["el"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for e in self.open:
            e["text"].append(data)

    def rows(self):
        out = []
        for owner, name, value, child in self.found:
            text = None if child is not None else value if isinstance(value, str) else " ".join(" ".join(value["text"]).split())
            out.append((owner, self.items[owner], name, text, child))
        used = {r[0] for r in out}
        return out + [(i, parent, None, None, None) for i, parent in enumerate(self.items) if i not in used]


def made(rng):
    """Random markup in which every element carries something, closed or not."""
    out = []
    for _ in range(rng.randrange(1, 30)):
        tag = rng.choice(["div", "span", "b", "a", "meta"])
        if rng.random() < 0.35:
            out.append(f"</{tag}>" if tag != "meta" else "text")
        else:
            scope, prop = rng.choice(["", "", " itemscope"]), rng.choice(["p", "q r", "p p", ""])
            extra = {"meta": ' content="c1"', "a": ' href="/u"'}.get(tag, "") if rng.random() < 0.7 else ""
            out.append(f'<{tag}{scope} itemprop="{prop}"{extra}>' + rng.choice(["", "x", " two words ", "&amp;"]))
    return "".join(out)


def test_random_pages_as_by_a_stack(spark):
    rng = random.Random(5)
    pages = [made(rng) for _ in range(400)]
    want = []
    for i, page in enumerate(pages):
        reader = Stack()
        reader.feed(page)
        reader.close()
        want += [(i, *r) for r in reader.rows()]
    got = items.microdata_properties(table(spark, pages)).select("page_id", "item", "parent", "property", "value", "child")
    assert rows(got) == sorted(want, key=repr) and len(want) > 1000


def test_definitions(spark):
    pages = [
        None, "", "plain", "<p itemprop=lost>x</p>",
        '<div itemscope itemtype="A"><p>open<p>cells<i itemprop="n">v</i></div><i itemprop="late">w</i>',
        '<div data-x=" itemscope "><i itemprop="n">v</i></div>',
        "<!-- <b itemscope> --><script><b itemscope></script><DIV ITEMSCOPE><I ITEMPROP=n>1</I>",
        '<meta itemscope itemprop="x"><b itemscope><meta itemscope itemprop="x"></b>',
    ]
    assert rows(items.microdata_properties(table(spark, pages))) == sorted([
        (4, 0, "A", None, 0, "n", "v", None), (6, 0, None, None, 0, "n", "1", None),
        (7, 0, None, None, None, None, None, None), (7, 1, None, None, 0, "x", None, 2), (7, 2, None, 1, None, None, None, None),
    ], key=repr)


def test_rdfa_outside_of_items_is_the_page(spark):
    pages = ['<meta property="og:title" content="T"><b typeof="A B"><i property="p" resource="#r">x</i></b>']
    assert rows(items.rdfa_properties(table(spark, pages))) == [(0, 0, "A B", None, 1, "p", "#r", None), (0, None, None, None, 0, "og:title", "T", None)]


def test_empty_table_and_stream_of_work(spark):
    assert items.microdata_properties(table(spark, [None]).limit(0)).count() == 0
    assert "Exchange" not in items.microdata_properties(table(spark, [None]))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("page", ["<b itemscope>" * 9000, "<b itemscope>" * 6000 + "</b>" * 6000, "<b itemscope itemprop=a>x</b>" * 6000])
def test_very_many_items(spark, page):
    got = items.microdata_properties(table(spark, [page]))
    assert got.count() == page.count("itemscope")


def blocks(*texts):
    return "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)


def test_a_node_named_by_its_id_counts_as_typed(spark):
    pages = [
        blocks('{"@type":"Article","author":{"@id":"#p"}}', '{"@type":"Person","@id":"#p"}'),
        blocks('{"@type":"Article","author":{"@id":"#p"}}', '{"@id":"#p","name":"N"}'),
        blocks('{"@type":"A","@id":"#a","self":{"@id":"#a"},"b":{"@type":"B","@id":"#b","a":{"@id":"#a"}}}'),
        blocks('{"@type":"A","x":{"@id":7}}', "not json", '{"@type":"B","x":{"@id":null}}'),
    ]
    assert rows(structured.schema_nesting(table(spark, pages))) == [(1, 0, "author"), (3, 0, "x"), (3, 1, "x")]
    got = structured.schema_references(table(spark, pages))
    assert rows(got) == sorted([
        (0, 0, "author", "#p", True, "Person"), (1, 0, "author", "#p", False, ""), (2, 0, "self", "#a", True, "A"),
        (2, 0, "b.a", "#a", True, "A"), (3, 0, "x", "7", False, ""),
    ], key=repr)


def test_repeated_keys_give_items_where_the_session_allows_them(spark):
    page = table(spark, [blocks('{"@type":"Article","headline":"a","headline":"b"}')])
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert rows(structured.jsonld_types(page)) == [(0, 0, "Article")]
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    assert rows(structured.jsonld_types(page)) == []
