"""Operators on documents against brute force, on awkward rows and on empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import decontamination, packing, pii, repeats, sharding, simhash_dedup, token_counts
from tests.llm.awkward import frame, prose, texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def sortable(items):
    return sorted(items, key=repr)


# --- fingerprints -----------------------------------------------------------------------------


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(docs, rows):
    got = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.fingerprint_hex().alias("f"), "component_id").collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(fps)
    least = defaultdict(list)
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] += [] if i is None else [i]
    want = [(i, f"{f:016x}", min(least[r], default=None)) for (i, _), f, r in zip(rows, fps, root, strict=True)]
    assert sortable(map(tuple, got)) == sortable(want)


def test_keep_one_keeps_one_of_each_component(docs, rows):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = simhash_dedup.near_duplicates(docs)
    assert kept.count() == found.select("root").distinct().count()
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 200 not in ids and 3 in ids and 300 not in ids[1:] * (4 in ids)


def test_trie_links_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(map(int, seeds)) | {0, 2**64 - 1, 1, 7, 15}
    for s in map(int, seeds):
        for n in (1, 2, 3, 4):
            for _ in range(4):
                fps.add(s ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r.u, r.v) for r in simhash_dedup.trie_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_components_of_a_chain_and_a_star(spark):
    from sitegauge.llm.common import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}


# --- packing ------------------------------------------------------------------------------------


def test_packing_round_trip(docs, rows):
    pieces = packing.pack(docs, BYTES).collect()
    exact = Tokenizer.from_file(BYTES)
    want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        sequences[p.sequence_id].append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    row, order = [], []
    for s in sorted(sequences):
        at = 0
        for p in sorted(sequences[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            row += np.frombuffer(bytes(p.ids), dtype="<u4").tolist()
            order.append(p)
        assert at == 2048 or s == len(sequences) - 1
    got, at = Counter(), 0
    for p in order:
        if p.start == 0:
            got[p.doc_id, tuple(row[at : at + p.doc_tokens])] += 1
        at += p.length
    assert got == want


def test_fast_ids_equal_the_library():
    exact, fast = Tokenizer.from_file(BYTES), packing.byte_bpe(BYTES)
    rng = np.random.default_rng(5)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), 0x301, 0x3000, 0x4E2D, 0x1F600, 0x200B, 0x2028, 0xE000]]
    samples = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b", " <|endoftext|> ", "it's we'LL 12345", " " * 500, "x" * 5000, "\n\n \t x  y   "]
    for s in samples:
        assert fast(s).tolist() == exact.encode(s, add_special_tokens=False).ids, repr(s)


# --- token counts -------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (500, 40)])
def test_token_counts(docs, rows, chunk, overlap):
    exact = Tokenizer.from_file(WORDS)
    want = []
    for i, t in rows:
        n = len(exact.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = token_counts.token_counts(docs, WORDS, chunk=chunk, overlap=overlap).collect()
    assert sortable(map(tuple, got)) == sortable(want)


def test_overlaps_widen_where_nothing_is_stable(spark):
    exact = Tokenizer.from_file(WORDS)
    odd = ["ab" * 700, "word " * 30 + "y" * 900 + " end", "a<|endoftext|>b" * 60, "é" * 400, "It's " * 200, "1234567890" * 90, "ΑΣ ΟΔΟΣ " * 80]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, WORDS, chunk=100, overlap=10).collect()}
    assert got == {i: len(exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(odd)}


# --- personal data ------------------------------------------------------------------------------

PLANTED = [
    "mail a.b+c@mail.example.com or x@y.zz, not x@y nor @a.b; a@b.co_foo@x.com a@b.c.@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 41111111111111111111 5500 0000 0000 0004x", "+1 (017) 555-7713 and +44 20 7946 0958. +1 23 +12345678901234567",
    "credit card 378282246310005 here", "number 378282246310005 here", "iban GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001",
    "ünï +49 (0)30 123456 \U0001f600 me@host.org \U0001f600 10.0.0.1", "1-2-3 " * 300, "a@b.cc " * 600, "9" * 5000, "a." * 4000, "+" * 300, "1 " * 3000,
]


def slow_spans(text):
    def digits(m):
        return [int(c) for c in m if c.isdigit()]

    def luhn(m):
        return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits(m)[::-1])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_pii(spark, docs, rows):
    planted = list(enumerate(PLANTED, 1000))
    both = frame(spark, rows + planted)
    got = pii.pii_digest(pii.find_pii(both)).collect()
    want = Counter()
    for i, t in rows + planted:
        spans = slow_spans(t or "")
        count = Counter(s.split(":")[0] for s in spans)
        want[i, count["email"], count["ip"], count["card"], count["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    added = {r.doc_id: re.findall(r"(?:iban|card_short):\d+:\d+", r.spans) for r in got if r.doc_id and r.doc_id >= 1000}
    assert added[1004] == ["card_short:12:27"] and added[1005] == [] and added[1006] == ["iban:5:32", "iban:33:55"]
    scores = {r.doc_id: r.card_short for r in pii.find_pii(both).filter("doc_id = 1004").collect()}
    assert abs(scores[1004][0].score - 0.6) < 1e-9 and scores[1004][0].value == "378282246310005"


def test_redact(spark, rows):
    planted = list(enumerate(PLANTED, 1000))
    out = {r.doc_id: r for r in pii.redact(frame(spark, planted + rows[:5] + [(7, None)])).collect()}
    assert out[7].text is None and out[1].text == rows[1][1] and out[1].n_chars == len(rows[1][1]) and out[1].kind == "k"
    assert out[1003].text == "[PHONE] and [PHONE]. +1 23 +12345678901234567"
    assert out[1007].text == "ünï [PHONE] \U0001f600 [EMAIL] \U0001f600 [IP]" and out[1007].n_chars == len(out[1007].text)
    assert not any(slow_spans(r.text or "") for r in out.values())


def test_redact_leaves_nothing_of_overlapping_spans(spark):
    texts = ["call +49.170.123.45.67 now", "tel +49 170 1234567@host.com", "+1.2.3.4@a.b and 1.2.3.4", "ü" * 5000 + " +49.170.123.45.67 " + "x" * 9000 + " a@b.c"]
    out = {r.doc_id: r for r in pii.redact(frame(spark, list(enumerate(texts)))).collect()}
    assert out[0].text == "call [PHONE] now" and out[0].n_chars == 16
    assert out[1].text == "tel [PHONE]"
    assert not any(c.isdigit() for i in range(3) for c in out[i].text)
    assert out[3].text == "ü" * 5000 + " [PHONE] " + "x" * 9000 + " [EMAIL]"


def test_redact_equals_merged_spans(spark, rows):
    many = [(2000, " ".join(f"u{i}@h{i}.org 10.0.0.{i % 300}" + " é" * (i % 7) for i in range(900))), (2001, "+1 " * 3000 + "a@b.c")]
    docs = frame(spark, list(enumerate(PLANTED, 1000)) + rows + many)
    spans = {(r.doc_id, r.t): [x for k in pii.KINDS for x in r[k.name]] for r in pii.find_pii(docs.withColumn("both", F.struct("doc_id", "text")), id_column="both").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("t"), *[k.name for k in pii.KINDS]).collect()}
    got = sorted(((r.doc_id, r.text) for r in pii.redact(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        out, reach = [], 0
        for x in sorted(spans[r.doc_id, r.text], key=lambda x: (x["start"], x["end"], f"[{x['kind'].upper()}]")):
            if x["start"] >= reach:
                out.append(r.text[reach : x["start"]] + f"[{x['kind'].upper()}]")
            reach = max(reach, x["end"])
        want.append((r.doc_id, None if r.text is None else "".join(out) + r.text[reach:]))
    assert got == sorted(want, key=repr)


# --- decontamination ----------------------------------------------------------------------------


def slow_matches(rows, items):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = []
    for i, t in rows:
        w = words(t)
        for item, text in items:
            v = words(text)
            if not v or not w:
                continue
            k, size, best = min(5, len(v)), min(len(v), len(w)), 0.0
            a = bag(v, k)
            for x in range(len(w) - size + 1):
                b = bag(w[x : x + size], k)
                both = sum((a & b).values())
                union = sum(a.values()) + sum(b.values()) - both
                best = max(best, both / union if union else 0.0)
            if best >= 0.8:
                out.append((i, item, len(v), round(best, 9)))
    return out


def test_decontamination(spark):
    import random

    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((15, 24, 37, 59, 30, 30, 3, 1, 5))] + [(90, ""), (91, None), (92, "!!! ---")]
    items.append((93, items[1][1]))
    rows = [(i, prose(rng, rng.randint(1, 150))) for i in range(12)] + [(20, None), (21, ""), (22, items[0][1])]
    for i, (_, text) in enumerate(items[:9]):
        w = text.split()
        rows.append((100 + i, prose(rng, 20) + " " + text.upper() + ", " + prose(rng, 9)))
        rows.append((200 + i, prose(rng, 8) + " " + " ".join(w[1:-1]) + " " + prose(rng, 8)))
        rows.append((300 + i, prose(rng, 8) + " " + " ".join(w[: len(w) // 2] + ["zz"] + w[len(w) // 2 :]) + " " + prose(rng, 8)))
        rows.append((400 + i, " ".join(w[2:])))
        rows.append((500 + i, " ".join([text] * 3)))
    rows += [rows[15], rows[15], (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).repartition(4)
    got = [(r.doc_id, r.item_id, r.n_words, round(r.similarity, 9)) for r in decontamination.matches(docs, bench).collect()]
    want = slow_matches(rows, items)
    assert sortable(got) == sortable(want) and len(want) > 30
    bad = {(i, t) for i, t in rows if any(i == w[0] for w in want)}
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sortable((r.doc_id, r.text) for r in left.collect()) == sortable(x for x in rows if x not in bad)


def test_decontamination_of_items_with_repeated_words(spark):
    import random

    rng = random.Random(11)
    bodies = [prose(rng, 49) for _ in range(6)] + [prose(rng, 90) for _ in range(6)]
    bench = spark.createDataFrame([(i, t + " the" * 10) for i, t in enumerate(bodies)], "item_id long, text string")
    rows = [(i, t if i < 6 else t + "".join(f" other{j}" for j in range(10))) for i, t in enumerate(bodies)]
    got = [(r.doc_id, r.item_id, r.n_words, round(r.similarity, 9)) for r in decontamination.matches(frame(spark, rows), bench).collect()]
    want = slow_matches(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert sortable(got) == sortable(want) and len(want) == 12


# --- repeated bytes -----------------------------------------------------------------------------


def slow_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\x01" * length
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 64])
def test_repeats(docs, rows, length):
    got = [tuple(r)[:5] for r in repeats.find_repeats(docs, length).collect()]
    want = slow_repeats(rows, length)
    assert sortable(got) == sortable(want)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)


def test_phrases_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(prose(__import__("random").Random(4), 3000).encode(), dtype=np.uint8)
    whole = repeats.parse(data, 400)
    monkeypatch.setattr(repeats, "_PART", 1000)
    assert all((a == b).all() for a, b in zip(whole, repeats.parse(data, 400), strict=True))


# --- sharding -----------------------------------------------------------------------------------


def check_shards(got, rows, shards, slack):
    assert sortable((r.doc_id, r.size, r.text_crc32) for r in got) == sortable((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load.values()) / shards
    assert max(load[s] for s in range(shards)) <= mean * (1 + slack) and min(load[s] for s in range(shards)) >= mean * (1 - slack)


def test_sharding_evens_sizes_and_keeps_copies_together(spark):
    import random

    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(1500)]
    rows += [(2000 + i, rows[i % 60][1]) for i in range(240)] + [(None, "q"), (None, None), (3000, None), (3001, "")] + [rows[0]] * 3
    got = sharding.shard(frame(spark, rows), shards=10).collect()
    check_shards(got, rows, 10, 0.02)
    by = defaultdict(set)
    for r in got:
        if r.size > 16:  # null and empty texts are two groups that look alike here
            by[r.text_crc32, r.size].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) == 0


def test_sharding_splits_a_group_that_outgrows_a_shard(spark):
    import random

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(5, 60))) for i in range(900)] + [(5000 + i, "the same long text " * 8) for i in range(600)]
    got = sharding.shard(frame(spark, rows), shards=10).collect()
    check_shards(got, rows, 10, 0.05)
    held = {r.shard for r in got if r.doc_id >= 5000}
    assert len(held) <= 8


def test_sharding_of_copies_only(spark):
    rows = [(i, f"text {i % 7} " * 9) for i in range(700)]
    check_shards(sharding.shard(frame(spark, rows), shards=5).collect(), rows, 5, 0.1)


def test_sharding_gathers_small_groups_beside_a_hot_one(spark):
    import random

    rng = random.Random(1)

    def text():
        return f"{rng.getrandbits(64):016x}" + "x" * rng.randint(184, 2984)

    groups = [[text()] * 1000] + [[text()] * rng.randint(2, 8) for _ in range(120)]
    rows = list(enumerate([t for g in groups for t in g] + [text() for _ in range(1400)]))
    got = sharding.shard(frame(spark, rows), shards=10).collect()
    check_shards(got, rows, 10, 0.02)
    by = defaultdict(Counter)
    for r in got:
        by[r.text_crc32, r.size][r.shard] += 1
    hot = max(by, key=lambda k: sum(by[k].values()))
    assert [k for k, c in by.items() if k != hot and len(c) > 1] == []  # no cut edge but those of the hot text
    least = -(-1000 * hot[1] * 10 // sum(r.size for r in got))  # shards that it needs at least
    assert least > 1 and len(by[hot]) <= least + 1


# --- empty tables -------------------------------------------------------------------------------


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).columns == none.columns
    assert packing.pack(none, BYTES).count() == 0 and token_counts.token_counts(none, WORDS).count() == 0
    assert pii.pii_digest(pii.find_pii(none)).count() == 0 and pii.redact(none).count() == 0
    assert decontamination.matches(none, bench).count() == 0 and decontamination.decontaminate(frame(spark, [(1, "a b")]), bench).count() == 1
    assert repeats.find_repeats(none).count() == 0 and sharding.shard(none).count() == 0


def test_fingerprint_column_reads_nulls(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert df.select(simhash_dedup.fingerprint_column("text").alias("f")).agg(F.sum("f")).first()[0] == 0
