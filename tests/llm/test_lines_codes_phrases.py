"""Quality rules, vector codes and collocations against brute force, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import line_quality, phrases, vector_codes
from tests.llm.awkward import EXTRA, frame, prose, texts

VECTORS = f"vec_id long, embedding array<double>, label int, {EXTRA.replace('text_crc32 long', 'code string').replace('kind string', 'v string, error long')}"


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# --- quality rules ------------------------------------------------------------------------------


def brute_repeated(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i : i + window])] > 1:
            hit |= set(range(i, i + window))
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(1, 9))
def test_repeated_words(words, window):
    assert line_quality.repeated_words(words, window) == brute_repeated(words, window)


def brute_quality(rows, max_docs, max_removed=0.5):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def normal(line):
        line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        return " ".join(word.findall(re.sub("[0-9]", "0", line)))

    holders = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if normal(line):
                holders[host, normal(line)].add(text)
    out = []
    for i, text, host in rows:
        text = text or ""
        words, lines = word.findall(text), [x for x in text.split("\n") if normal(x)]
        gone = [len(word.findall(x)) for x in lines if len(holders[host, normal(x)]) > max_docs]
        repeat = brute_repeated(words)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        kept = not failed and sum(gone) <= max_removed * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, failed, kept, sum(gone), len(gone)))
    return out


def hosted(spark, rows):
    filled = [(i, t, "en", h, None, 1, 2, 3, "x", 4, 5, "row", 6, 7, "k") for i, t, h in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def quality_rows():
    rng = random.Random(5)
    menu, foot = "Home | About | Contact 2024", "All rights reserved by the people who made this page for you and yours"
    rows = [(i, t, "a") for i, t in texts()]
    for i in range(40):
        host = ("a", "b", None)[i % 3]
        body = "\n".join(prose(rng, rng.randint(2, 30)) for _ in range(rng.randint(0, 4)))
        rows.append((1000 + i, f"{menu.replace('2024', str(2000 + i))}\n{body}\n \n{foot.upper() if i % 2 else foot}  ", host))
    rows += [(2000, f"{menu}\r\n" * 30 + prose(rng, 60), "b"), (2001, f"{foot}\n{prose(rng, 14)}", "lonely")]
    rows += [(3000, rows[50][1], "a")] * 25 + [(3001 + i, f"{prose(random.Random(9), 40)}\nshared by copies", "copies") for i in range(30)]
    return rows


@pytest.mark.parametrize("max_docs", [2, 10])
def test_quality_equals_brute_force(spark, max_docs):
    rows = quality_rows()
    got = line_quality.judge(hosted(spark, rows).repartition(5), max_docs=max_docs).collect()
    want = brute_quality(rows, max_docs)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[8] and w[7] for w in want) and any(w[8] and not w[6] and not w[7] for w in want)
    # thirty copies of one text are one text, not a line that thirty documents hold
    assert all(w[7] and not w[8] for w in want if w[0] is not None and 3001 <= w[0] < 3031)


def test_lines_are_removed_and_other_columns_kept(spark):
    rows = quality_rows()
    docs = hosted(spark, rows)
    got = line_quality.remove_lines(docs, max_docs=10)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = {i: w for (i, _, _), w in zip(rows, brute_quality(rows, 10), strict=True) if i is not None}
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, w in want.items():
        left = w[1] - w[8]
        assert (i in found) == (w[8] <= 0.5 * w[1]), i
        if i in found:
            assert len(re.findall(r"[^\x20\x09-\x0D]+", found[i] or "")) == left
    assert "Home" not in found[1003] and found[400] is None and found[402] == ""


def test_large_tables_of_removed_lines_shuffle(spark, monkeypatch):
    monkeypatch.setattr("sitegauge.llm.common.BROADCAST_ROWS", 1)
    rows = quality_rows()
    got = line_quality.judge(hosted(spark, rows), max_docs=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_quality(rows, 2), key=repr)


def test_one_row_per_key_with_hot_keys(spark, monkeypatch):
    from sitegauge.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    small = spark.range(0, 1000, 2).selectExpr("id as k", "id * 10 as v")
    got = common.join_one_per_key(big, small, ["k"], rows_per_task=50).collect()
    assert sorted((r["id"], r["k"], r["v"]) for r in got) == [(i, k, k * 10 if k % 2 == 0 else None) for i in range(1000) for k in [0 if i % 3 == 0 else i]]


# --- vector codes -------------------------------------------------------------------------------


def brute_codes(rows, parts=8, count=16, rounds=6):
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], t) for i, v, t in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[(r[1] + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:count]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], book)[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)] if groups[e] else entry for e, entry in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        totals[r[2]] += e
    fits = lambda e: e if e < 1 << 63 else None
    some = {r[2] for r, e in zip(kept, errors, strict=True) if fits(e) is None}
    return [(r[0], "".join(f"{i:02x}" for _, i in f), fits(e), None if r[2] in some else fits(totals[r[2]]), sha) for r, f, e in zip(kept, found, errors, strict=True)]


def vector_frame(spark, rows):
    names = [c.split()[0] for c in VECTORS.split(", ")]
    kinds = [c.split()[1] for c in VECTORS.split(", ")][3:]
    filled = [(i, v, t, *("x" if k == "string" else 7 for k in kinds)) for i, v, t in rows]
    assert len(names) == len(set(names))
    return spark.createDataFrame(filled, VECTORS)


def vectors(seed, count, size, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=size) * scale).tolist(), int(rng.integers(4)) or None) for i in range(count)]


def awkward_vectors():
    rows = vectors(1, 120, 16)
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 16, 1), (203, [float("inf"), *[0.0] * 15], None), (204, [None, *[0.0] * 15], 2), (205, [0.0] * 16, 2)]
    rows += [(206, [1.0] * 8, 3), (None, rows[3][1], 1), (5, rows[9][1], 2), (5, rows[9][1], 2)] + [(300 + i, [0.25, -0.25] * 8, 9) for i in range(60)]
    return rows


@pytest.mark.parametrize(
    "rows",
    [awkward_vectors(), vectors(2, 7, 16), vectors(3, 90, 13), vectors(4, 60, 8, 1e9), vectors(5, 40, 16, 1e40), vectors(6, 300, 8, 0.0005), [(1, [3.0], None)] * 5],
    ids=["awkward", "few", "odd length", "large", "huge", "ties", "one component"],
)
def test_codes_equal_brute_force(spark, rows):
    got = vector_codes.compress(vector_frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_codes(rows), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.integers(1, 3), st.integers(0, 1 << 30))
def test_orchard_finds_the_nearest_with_ties(k, width, seed):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-3, 4, (k, width)), rng.integers(-4, 5, (50, width))
    number, distance = vector_codes.orchard(points, entries, *vector_codes.neighbour_lists(entries))
    all_of_them = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert number.tolist() == all_of_them.argmin(1).tolist() and distance.tolist() == all_of_them.min(1).tolist()


def test_orchard_looks_at_few_entries():
    rng = np.random.default_rng(3)
    entries = rng.normal(size=(64, 2)) * 1000
    ranked, gaps = vector_codes.neighbour_lists(entries)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            found = np.asarray(self)[at]
            if isinstance(at, np.ndarray):
                looked.append(len(at))
            return found

    points = entries[rng.integers(0, 64, 500)] + rng.normal(size=(500, 2)) * 20
    vector_codes.orchard(points, entries.view(Counted), ranked, gaps)
    assert sum(looked) < 0.4 * 64 * 500


def test_codes_are_decoded(spark):
    rows = vectors(8, 200, 16)
    usable = vector_codes.usable(vector_frame(spark, rows))
    books = vector_codes.fit(usable, entries=32)
    coded = vector_codes.encode(usable, books).collect()
    far = [sum((a - b) ** 2 for a, b in zip(rows[r["vec_id"]][1], vector_codes.decode(r["code"], books), strict=True)) for r in coded]
    alone = [sum(a * a for a in v) for _, v, _ in rows]
    assert len(coded) == 200 and sum(far) < 0.35 * sum(alone)


# --- collocations -------------------------------------------------------------------------------


def brute_counts(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    return counts, totals


def brute_collocations(rows, least=30, top=2000):
    counts, totals = brute_counts(rows)
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[lang, w[i : i + n]] = max(longer[lang, w[i : i + n]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in found.items():
        if longer[lang, w] and 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), l, r))
    out = []
    for lang, all_of_them in by_lang.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(all_of_them)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    words = [prose(rng, 1) + str(i) for i in range(40)] + ["Über", "漢字", "it's"]
    rows = []
    for i in range(400):
        lang = ("en", "de", None, "und")[i % 4]
        picked = [rng.choice(words[: 4 + i % 40]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            picked[rng.randint(0, len(picked)) : 0] = ["Kick", "the", "bucket"] if i % 3 else ["of", "the", "people", "by"]
        rows.append((lang, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " ;"]) for w in picked)))
    return rows + [("en", None), ("en", ""), ("xx", "a b. " * 29), ("yy", "a b. " * 30), ("zz", "a " * 500), (None, "\x0b \x0c!\r"), ("en", "x" * 3000)]


def lang_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src", None, *("x" if c.endswith("string") else 3 for c in EXTRA.split(", "))) for i, (lang, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.mark.parametrize("options", [{}, {"partition_bytes": 2000, "batch_words": 500}, {"partition_bytes": 500, "table_bits": 512, "batch_words": 100}], ids=["one batch", "small batches", "full table"])
def test_collocations_equal_brute_force(spark, options):
    rows = phrase_rows()
    found = phrases.frequent_phrases(lang_frame(spark, rows).repartition(6), **options)
    counts, totals = brute_counts(rows)
    want = {(lang, " ".join(w), len(w)): a for (lang, w), a in counts.items() if a >= 30} | {(lang, "", 0): a for lang, a in totals.items()}
    assert {(r["lang"], r["phrase"], r["words"]): r["a"] for r in found.collect()} == want
    assert sorted(map(tuple, phrases.collocations(found).collect())) == brute_collocations(rows)
    top = phrases.collocations(found, top=3).collect()
    assert sorted(map(tuple, top)) == brute_collocations(rows, top=3) and max(r["rank"] for r in top) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=80), max_size=30), st.integers(2, 9), st.booleans())
def test_every_frequent_key_survives(blobs, threshold, many):
    if many:  # many tasks that each see few keys
        blobs = [[x] for b in blobs for x in b]
    cut = [Counter(b) for b in blobs]
    mass = sum(min(c, threshold) for b in cut for c in b.values())
    summary = phrases.Summary(mass, threshold)
    for b in cut:
        keys = np.array(sorted(b), np.uint32)
        summary.merge(keys, np.array([min(b[k], threshold) for k in keys.tolist()], np.int64))
        assert len(summary.keys) <= summary.capacity
    left = set(summary.survivors().tolist())
    assert {k for k, n in Counter(x for b in blobs for x in b).items() if n >= threshold} <= left
    assert summary.taken < threshold


def test_places_are_ordered_and_even():
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2))
    p, key = phrases.place(hashes, 7)
    assert p.tolist() == [int(h) * 7 >> 64 for h in hashes.tolist()] and key.tolist() == [(int(h) * 7 & ((1 << 64) - 1)) >> 32 for h in hashes.tolist()]


# --- empty tables -------------------------------------------------------------------------------


def test_empty_tables(spark, none):
    assert line_quality.judge(none).count() == 0 and line_quality.remove_lines(none).count() == 0
    assert phrases.collocations(phrases.frequent_phrases(none)).count() == 0
    got = vector_codes.compress(vector_frame(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(vector_frame(spark, [(1, None, 2), (2, [float("nan")], None)])).count() == 0
