"""Names in the content of pages, told from ordinary words by how a whole crawl writes them.

A capital alone says little: words that start a sentence have one, and so have all nouns in some languages. Two passes
over the crawl's words decide: the first counts, per language and word, how often the word is written with a capital where no
sentence starts; the second counts a page's capitalised words against that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit, struct
from sitegauge.operators.content import WORD, language, with_clean, with_text, words_sql
from sitegauge.plans.skew import ROWS_PER_TASK, join_one_per_key
from sitegauge.plans.stored import shared_folder, store

# Our own thresholds, in per cent.
NAME_SHARE = 80
NOUN_CAPITALS = 25

_SENTENCE_GAP = r"(?<=[.!?])\s+"
_NOT_WORDS = r"[^\p{L}\p{N}\s]+"
_CAPITAL = r"^\p{Lu}"


def words_of_sql(text: str) -> str:
    """``array<struct<word, cap, first, run>>``: every word in lower case, whether it has a capital, whether it starts a
    sentence, and whether a word beside it, with only white space between, has a capital without starting one."""
    before, after = (f"coalesce(get(ws, {at}) RLIKE {lit(_CAPITAL)}, false)" for at in ("i - 1", "i + 1"))
    run = f"(i > if(j = 0, 1, 0) AND {before}) OR {after}"
    word = struct(word="lower(w)", cap=f"w RLIKE {lit(_CAPITAL)}", first="i = 0 AND j = 0", run=run)
    pieces = f"filter(transform(split(s, {lit(_NOT_WORDS)}, -1), p -> regexp_extract_all(p, {lit(WORD)}, 0)), ws -> size(ws) > 0)"
    sentence = f"flatten(transform({pieces}, (ws, j) -> transform(ws, (w, i) -> {word})))"
    return f"flatten(transform(split({text}, {lit(_SENTENCE_GAP)}, -1), s -> {sentence}))"


def page_words(df: DataFrame) -> DataFrame:
    """(page_id, lang, n_words, words) of each page's content, row by row."""
    t = with_text(with_clean(df.withColumn("lang", language())))
    return t.select("page_id", "lang", F.expr(words_sql("content_text")).alias("n_words"), F.expr(words_of_sql("content_text")).alias("words"))


def word_cases(words: DataFrame) -> DataFrame:
    """(lang, word, n_capital, n_small) over all words (lang, word, cap, first) that start no sentence; counted in the tasks first."""
    inside = words.filter(~F.col("first"))
    return inside.groupBy("lang", "word").agg(F.count_if("cap").alias("n_capital"), F.count_if(~F.col("cap")).alias("n_small"))


def noun_capitals(cases: DataFrame) -> DataFrame:
    """(lang, nouns): whether so many words inside sentences have a capital that ordinary nouns must be among them."""
    total = F.sum("n_capital") + F.sum("n_small")
    return cases.groupBy("lang").agg((100 * F.sum("n_capital") >= NOUN_CAPITALS * total).alias("nouns"))


def entity_density(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Names per word of content: (page_id, lang, n_words, n_entities, density).

    A capitalised word is a name if its language writes it with a capital in at least ``NAME_SHARE`` per cent of its places
    inside sentences, and in one at least; so a name that starts a sentence counts, an ordinary word there does not. Single letters are
    none. In a language that puts capitals on nouns (see ``noun_capitals``) only names of two words or more count: the
    word must not start a sentence and must stand beside another capitalised word.

    Pages without a stated language share their statistics. Pages without content give 0; rows that share a page_id are
    counted as one page. The html is read once: the words are stored below ``spark.checkpoint.dir`` and read for both passes. The
    vocabulary is joined, never broadcast unless Spark finds it small; words that stand in very many places are split (``rows_per_task``).
    """
    stored = store(page_words(df), f"{shared_folder(df.sparkSession)}/words")
    words = stored.select("page_id", F.coalesce("lang", F.lit("")).alias("lang"), F.inline("words"))
    cases = word_cases(words)
    known = cases.filter((F.col("n_capital") > 0) & (100 * F.col("n_capital") >= NAME_SHARE * (F.col("n_capital") + F.col("n_small"))))
    named = join_one_per_key(known, noun_capitals(cases), "lang", "word", rows_per_task=rows_per_task)
    key = F.concat_ws(" ", "word", "lang").alias("key")
    capitals = words.filter(F.col("cap") & (F.length("word") > 1)).select("page_id", key, (F.col("run") & ~F.col("first")).alias("in_run"))
    found = join_one_per_key(capitals, named.select(key, "nouns"), "key", "page_id", rows_per_task=rows_per_task)
    names = found.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0).alias("n_words"),
                         F.expr("if(nouns IS NOT NULL AND (NOT nouns OR in_run), 1, 0)").alias("n_entities"))
    rows = stored.select("page_id", "lang", "n_words", F.lit(0).alias("n_entities")).unionByName(names)
    out = rows.groupBy("page_id").agg(F.max("lang").alias("lang"), F.sum("n_words").alias("n_words"), F.sum("n_entities").alias("n_entities"))
    return out.withColumn("density", F.expr("if(n_words = 0, 0.0D, n_entities / n_words)"))
