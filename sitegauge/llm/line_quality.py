"""Quality rules (11): figures of each text, and lines that many documents of one host repeat.

Base figures of a text come from one pass over it. Across documents, the lines of a text that hold a
word are normalised (A-Z to lower case, every digit to 0, white space to single blanks) and hashed
together with their host. A line that more than ``max_docs`` distinct texts of a host hold is over
the limit and removed wherever it stands on that host; copies of a text count once, since whole
copies are no boilerplate. A document is depleted, and rejected, if more than ``max_removed`` of its
words went.

Counting takes two steps, so that little is shuffled: rows per line first, with partial sums, then
distinct texts of the few lines that pass. No group of a host or line is ever gathered.

Null texts hold no words; a null host is a host. Rows with equal host and text get equal figures.
Extra columns are ignored by ``judge`` and kept by ``remove_lines``. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit
from sitegauge.llm.common import join_one_per_key, row_key, small_side, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BODY, LINE = ["_h1", "_h2"], ["l1", "l2"]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``."""
    if len(words) <= window:
        return 0
    numbers: dict[str, int] = {}
    row = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    width = 1
    while width < window:  # numbers of windows of twice the width, from pairs of numbers
        step = min(width, window - width)
        _, row = np.unique((row[:-step] << 32) | row[step:], return_inverse=True)
        width += step
    starts = np.flatnonzero(np.bincount(row)[row] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change) > 0).sum())


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def figures_column(text: str) -> Column:
    @F.pandas_udf(_FIGURES)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([figures(t) for t in batch], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return made(F.col(text))


_SPACE = lit(r"[ \t-\r]+")


def _normal(line: str) -> str:
    """SQL: the normalised form of a line; empty if it holds no word."""
    lower = f"translate({line}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"trim(regexp_replace(regexp_replace({lower}, '[0-9]', '0'), {_SPACE}, ' '))"


def _line_key(host: str, line: str) -> str:
    return f"struct(xxhash64({host}, {line}) as l1, xxhash64('second', {host}, {line}) as l2)"


def line_table(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, _h1, _h2 (of host and text), the base figures, and the lines as (l1, l2, words), each with all its words in the text."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("is "), F.col(host).cast("string")), F.lit("none")).alias("host"))
    lines = f"filter(transform(split(text, '\\n'), x -> {_normal('x')}), x -> x <> '')"
    keyed = f"transform({lines}, x -> struct({_line_key('host', 'x')} as key, size(split(x, ' ')) as words))"
    return stored(source.select("doc_id", *row_key("host", "text"), figures_column("text").alias("f"), F.expr(keyed).alias("lines")).select("doc_id", *BODY, "f.*", "lines"))


def lines_over(table: DataFrame, max_docs: int) -> DataFrame:
    """(l1, l2) of lines that more than ``max_docs`` distinct texts of their host hold."""
    lines = table.select(*BODY, F.explode(F.expr("array_distinct(lines.key)")).alias("key")).select(*BODY, "key.*")
    often = stored(lines.groupBy(*LINE).agg(F.count("*").alias("rows")).filter(F.col("rows") > max_docs).select(*LINE))
    holders = lines.join(small_side(often, often.count()), LINE, "left_semi").distinct()
    return stored(holders.groupBy(*LINE).agg(F.count("*").alias("n_texts")).filter(F.col("n_texts") > max_docs).select(*LINE))


def _removed(table: DataFrame, over: DataFrame) -> DataFrame:
    """(_h1, _h2, removed_words, removed_lines) of texts that hold a line over the limit; one row a text."""
    words = table.select(*BODY, F.posexplode("lines").alias("at", "line")).select(*BODY, "at", "line.key.*", "line.words")
    hit = words.join(small_side(over, over.count()), LINE, "left_semi").select(*BODY, "at", "words").distinct()
    return hit.groupBy(*BODY).agg(F.sum("words").cast("long").alias("removed_words"), F.count("*").alias("removed_lines"))


def judge(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 10, min_words: int = 20, max_removed: float = 0.5, max_repeat: int = 30
) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, removed_words and removed_lines of every row."""
    table = line_table(docs, id_column, text, host)
    removed = stored(_removed(table, lines_over(table, max_docs)))
    rows = join_one_per_key(table.drop("lines"), removed, BODY)
    zero, words = F.lit(0).cast("long"), F.col("n_words")
    gone = F.coalesce("removed_words", zero)
    base_failed = (words < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * words)
    depleted = gone > F.lit(max_removed) * words
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~depleted).alias("kept"),
        gone.alias("removed_words"), F.coalesce("removed_lines", zero).alias("removed_lines"),
    )


def remove_lines(docs: DataFrame, max_docs: int = 10, max_removed: float = 0.5, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the lines over the limit and without depleted documents; texts without such lines, null ones too, stay as they are."""
    packed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("is "), F.col(host).cast("string")), F.lit("none")).alias("host"))
    table = line_table(docs, docs.columns[0], text, host)
    over = lines_over(table, max_docs)
    lines = table.select(*BODY, F.explode(F.expr("array_distinct(lines.key)")).alias("key")).select(*BODY, "key.*")
    hit = lines.join(small_side(over, over.count()), LINE, "left_semi").distinct()
    # at most one entry for each line of the text
    gone = stored(hit.groupBy(*BODY).agg(F.collect_list(F.struct(*LINE)).alias("gone")))
    keyed = packed.select("_row", "text", "host", *row_key("host", "text"))
    keep = f"filter(split(text, '\\n'), x -> not array_contains(gone, {_line_key('host', _normal('x'))}))"
    cut = join_one_per_key(keyed, gone, BODY).select("_row", "text", "gone", F.expr(f"if(gone is null, text, array_join({keep}, '\\n'))").alias("left"))
    count = "size(regexp_extract_all({0}, '[^ \\\\t-\\\\r]+', 0))"
    kept = cut.filter(F.expr(f"gone is null or {count.format('text')} - {count.format('left')} <= {max_removed}D * {count.format('text')}"))
    new = F.when(F.col("gone").isNull(), F.col(f"_row.`{text}`")).otherwise(F.col("left"))
    return kept.select(*(new.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
