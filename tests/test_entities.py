"""Names against ordinary words: case statistics over the crawl, languages that put capitals on nouns."""

from __future__ import annotations

from sitegauge.operators.entities import entity_density, page_words

GERMAN = [
    "Das Haus steht am See. Wir sahen Angela Merkel im Garten.",
    "Der Hund schläft im Haus, Katzen und Hunde sind am See.",
    "Äpfel, Birnen und Nüsse gibt es im Garten.",
]
ENGLISH = [
    "Paris is large. We went to Paris by train and the train was late.",
    "The train was late, and I saw the old town. Trains are old; the town is not.",
    "We saw Ada Lovelace in Paris, who wrote notes on the engine for all of us to read in the evening.",
]


def crawl(spark, texts):
    rows = [(i, f"<html{f' lang={lang}' if lang else ''}><main>{text}</main></html>") for i, (lang, text) in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, html string")


def names(df, **kwargs):
    return {r.page_id: (r.lang, r.n_words, r.n_entities) for r in entity_density(df, **kwargs).collect()}


def test_german_nouns_are_no_names(spark):
    got = names(crawl(spark, [("de", t) for t in GERMAN]))
    assert [got[i][2] for i in range(3)] == [2, 0, 0]


def test_english_names_and_sentence_starts(spark):
    got = names(crawl(spark, [("en", t) for t in ENGLISH]))
    assert [got[i][2] for i in range(3)] == [2, 0, 3]


def test_languages_do_not_mix(spark):
    got = names(crawl(spark, [("de", t) for t in GERMAN] + [("en", t) for t in ENGLISH]))
    assert [got[i][2] for i in range(6)] == [2, 0, 0, 2, 0, 3]


def test_odd_pages(spark):
    rows = [(0, None), (1, ""), (2, "<main></main>"), (3, "<main>... !!</main>"), (4, "<main>we met Ada. ADA</main>"), (None, "<main>x</main>")]
    got = names(spark.createDataFrame(rows, "page_id long, html string"))
    assert got == {0: (None, 0, 0), 1: (None, 0, 0), 2: (None, 0, 0), 3: (None, 0, 0), 4: (None, 4, 0), None: (None, 1, 0)}
    assert entity_density(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_runs_and_starts(spark):
    text = "„Ein Wort“ von Anna, Berta Kurz! Neue Welt (Ost West) x"
    words = page_words(crawl(spark, [("de", text)])).first().words
    assert [w.word for w in words if w.first] == ["ein", "neue"]
    assert [w.word for w in words if w.run and w.cap and not w.first] == ["berta", "kurz", "ost", "west"]


def test_hot_words_and_long_pages(spark):
    texts = [("en", f"we saw Paris and page {i} of the old town near it") for i in range(300)]
    texts.append(("en", "we saw Paris and the old town. " * 20_000))
    df = crawl(spark, texts)
    split = names(df, rows_per_task=100)
    assert split == names(df) and split[0][2] == 1 and split[300] == ("en", 140_000, 20_000)


def test_html_is_read_once(spark):
    plan = entity_density(crawl(spark, [("en", ENGLISH[0])]))._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan
