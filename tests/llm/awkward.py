"""Small inputs with nulls, empty and long texts, copies, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns carry names that the operators use inside.
EXTRA = "n long, part int, shard int, t string, fp long, _h1 long, _row string, start long, text_crc32 long, kind string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
SYLLABLES = "the an er in st re on ha ou ed nd ti wh ing or es".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 200)) for _ in range(30)]
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    passage = prose(rng, 130)
    for i in range(6):
        out.append((100 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 30 + i)))
    for i in range(5):  # copies, and near copies with a word more
        out.append((200 + i, base[3]))
        out.append((300 + i, base[4] + f" {SYLLABLES[i]}"))
    out += [(400, None), (401, None), (402, ""), (403, " \t\n"), (404, "one"), (405, "one two"), (None, base[5]), (None, "no id here"), (406, "ÄÖ ñandú 漢字 \U0001f600 café"), (407, "x" * 3000), (408, "ab " * 2500)]
    long_text = prose(rng, 9000)
    out += [(500, long_text), (501, long_text[:20_000] + " changed " + long_text[20_000:])]
    return out + [out[0], out[0], out[33]]


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    filled = [(i, t, "en", "src0", None if t is None else len(t), 1, 2, 3, "x", 4, 5, "row", 6, 7, "k") for i, t in rows]
    return spark.createDataFrame(filled, SCHEMA)
