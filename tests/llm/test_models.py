"""Fitted and approximate operators: held-out accuracy, recall, exact decoding; and the pipeline."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitegauge.llm import chat, nearest, toxicity
from tests.llm.awkward import frame, texts

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- toxicity -----------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = toxicity.fit_severity(docs, labels, hold_out=4)
    assert list(model.thresholds) == sorted(model.thresholds)
    held = labels.filter("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("y"))
    got = toxicity.severity(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").select("y", "toxic", "expected_severity").toPandas()
    hit = got[got.y == 1].toxic.mean()
    alarm = got[got.y == 0].toxic.mean()
    assert len(got) > 800 and hit > 0.9 and alarm < 0.005, (hit, alarm)
    assert got[got.y == 1].expected_severity.mean() > 1 > 0.1 > got[got.y == 0].expected_severity.mean()


def test_a_repeated_labelled_id_is_one_row_of_the_fit(spark, monkeypatch):
    fitted = []
    real = toxicity._fit_ordinal
    monkeypatch.setattr(toxicity, "_fit_ordinal", lambda rows, at, x, grade, *rest: (fitted.append(len(grade)), real(rows, at, x, grade, *rest))[1])
    rows = [(i, f"plain words number {i} " * 10 + ("vile " if i % 4 == 0 else "")) for i in range(100)]
    rows += [(7, f"other text of one id {i} " * 5) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    toxicity.fit_severity(frame(spark, rows), labels, sample_rows=50)
    assert fitted and fitted[0] <= 55


def test_severity_grows_with_the_share_of_bad_words(spark):
    rows, labels = [], []
    for i in range(400):
        words = [f"word{(i * 7 + j) % 50}" for j in range(60)]
        if i % 4 == 0:
            for j in range(1 + i // 4 % 9):
                words[j * 6] = ("vile", "nasty")[j % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit_severity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = [(n, " ".join(["vile nasty"] * n + ["word1"] * (60 - 2 * n))) for n in (0, 1, 2, 4)]
    got = {r.doc_id: r for r in toxicity.severity(frame(spark, probe), model).collect()}
    severities = [got[n].expected_severity for n in (0, 1, 2, 4)]
    assert severities == sorted(severities) and not got[0].toxic and got[4].toxic and got[4].grade == 3


def test_toxicity_on_awkward_input(spark):
    docs = frame(spark, texts())
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 0), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit_severity(docs, labels)
    assert model.weights == {} and toxicity.severity(docs, model).filter("toxic").count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    none = toxicity.fit_severity(frame(spark, []), labels.limit(0))
    assert toxicity.severity(frame(spark, []), none).count() == 0


# --- chat ---------------------------------------------------------------------------------------


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    n = chat.STATES
    model = {"moves": np.log(rng.dirichlet(np.ones(n), n + 1)), "marker": np.log(rng.dirichlet(np.ones(4), n)), "size": np.log(rng.dirichlet(np.ones(8), n)), "asks": np.log(rng.dirichlet(np.ones(2), n))}
    lines = pd.DataFrame({"marker": rng.integers(0, 4, 5), "size": rng.integers(0, 8, 5), "asks": rng.integers(0, 2, 5)})
    seen = chat.emissions(model, lines.marker, lines["size"], lines.asks)

    def weight(path):
        return model["moves"][chat.START, path[0]] + sum(model["moves"][a, b] for a, b in itertools.pairwise(path)) + sum(seen[t, s] for t, s in enumerate(path))

    best = max(itertools.product(range(n), repeat=5), key=weight)
    matrix = chat.path_matrix(model, seen)
    assert math.isclose(matrix[chat.START].max(), weight(best))
    assert tuple(chat.best_path(model, seen, chat.START, int(matrix[chat.START].argmax()))) == best


def test_chat_roles_and_rendering(spark):
    told = table(spark, "conversations")
    raw = chat.raw_transcripts(told)
    model = chat.fit(raw.filter("conv_id % 2 = 0"))
    got = chat.recover(raw.filter("conv_id % 2 = 1").drop("role"), model).toPandas()
    true = told.filter("conv_id % 2 = 1").toPandas()
    both = got[got.line == 0].merge(true, on=["conv_id", "turn"], suffixes=("", "_true"))
    assert len(both) / len(true) > 0.8 and (both.role == both.role_true).mean() > 0.97
    same = both[both.n_lines == both.text_true.str.count("\n") + 1]
    assert (same.text == same.text_true).all() and (same.rendered == "<|" + same.role + "|>\n" + same.text + "\n<|end|>\n").all()


def test_long_conversation_in_segments_equals_one_piece(spark, monkeypatch):
    rows = [(7, i, ("User: " if i % 2 == 0 and i % 5 else "") + ("what is it?" if i % 2 == 0 else "It is a long answer " * 9), "user" if i % 2 == 0 else "assistant") for i in range(-30, 270)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    model = chat.fit(df)
    cut = chat.recover(df, model).drop("rendered").orderBy("turn").collect()
    monkeypatch.setattr(chat, "FAN", 2)
    tree = chat.recover(df, model).drop("rendered").orderBy("turn").collect()
    monkeypatch.setattr(chat, "SEGMENT", 1 << 20)
    assert cut == tree == chat.recover(df.filter("turn >= -30").withColumn("turn", F.col("turn") + 30), model).drop("rendered").withColumn("turn", F.col("turn") - 30).orderBy("turn").collect()


def test_chat_on_awkward_input(spark):
    rows = [(1, 0, "User: hi", "user", "x"), (1, 0, "User: hi", "user", "x"), (1, 0, "other", "user", "y"), (1, None, "late", None, "z"), (None, 0, "no conversation", "assistant", None),
            (None, None, None, None, None), (2, 0, "", "system", ""), (2, 1, None, "assistant", ""), (3, 5, "AI: yes\n" + "more\n" * 500, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string, seg string")
    got = chat.recover(df, chat.fit(df)).collect()
    assert sum(r.n_lines for r in got) == 7 + 502 and {r.conv_id for r in got} == {1, 2, 3, None}
    none = df.limit(0)
    assert chat.recover(none, chat.fit(none)).count() == 0


# --- nearest neighbours -------------------------------------------------------------------------


def brute(data, k, every):
    out = {}
    for q, v in data:
        if q % every == 0:
            far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in data if i != q)
            out[q] = far[:k]
    return out


def test_recall(spark):
    data = [(r.vec_id, list(r.embedding)) for r in table(spark, "embeddings").collect()]
    want = brute(data, 10, 100)
    got = nearest.search(table(spark, "embeddings")).collect()
    found = Counter()
    for r in got:
        near = {i: d for d, i in want[r.query_id]}
        if r.vec_id in near:
            found[r.query_id] += 1
            assert math.isclose(r.score, near[r.vec_id], rel_tol=1e-12)
    assert len(got) == 10 * len(want) and sum(found.values()) >= 0.9 * len(got)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(1, 90)] + [(100, [1.0, 1.0, 1.0, 1.0]), (200, [2.0, 0.0, 1.0, 1.0]), (201, [1.0, 1.0, 1.0, 1.0])]
    good = [(i, v) for i, v in good if any(v)]
    bad = [(300, None), (301, [0.0] * 4), (302, [nan, 1.0, 1.0, 1.0]), (303, [inf, 1.0, 1.0, 1.0]), (304, [None, 1.0, 1.0, 1.0]), (305, [1.0]), (306, []), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<float>, list string")
    got = nearest.search(df, probe_share=1.0).collect()
    want = [(q, n, i, d) for q, near in brute(good, 10, 100).items() for n, (d, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    few = spark.createDataFrame(good[-3:], "vec_id long, embedding array<float>")
    assert nearest.search(few).groupBy("query_id").count().collect() == [(100, 2), (200, 2)] or nearest.search(few).count() == 4
    assert nearest.search(df.limit(0)).count() == 0


def test_small_probes_fall_back_to_all_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(8) + 40 * (i % 30)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, every=30, probe_share=0.0, least_probes=1)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {10}


def test_blocks_of_few_rows_find_the_same(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(0, 9, 6) + (50 if i % 3 else 0)]) for i in range(400)] + [(600 + i, [1.0] * 6) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, n, i, d) for q, near in brute(rows, 10, 100).items() for n, (d, i) in enumerate(near, 1)]
    got = nearest.search(df, probe_share=1.0, most_rows=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


# --- the pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, "documents", SMALL)
    seen = [docs]
    for _, stage in p.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
    assert all(d.columns == docs.columns for d in seen[:-1])
    counts = [d.count() for d in seen[:-1]]
    assert counts[0] > counts[1] > counts[2] and counts[2] >= counts[3] == counts[4]
    labels = {r.doc_id: r.toxic for r in table(spark, "labels", SMALL).collect()}
    kept = {r.doc_id for r in seen[1].collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i, t in labels.items() if t == 1) <= 0.1 * sum(labels.values())
    packed = seen[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert packed.count() == counts[4] and packed.filter("n <> m").count() == 0


@pytest.mark.parametrize("rows", [0, 1])
def test_pipeline_on_awkward_rows(spark, rows):
    import corpus_pipeline as p

    docs = frame(spark, texts() if rows else [])
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == frame(spark, []).columns
    last = p.STAGES[-1][1](spark, docs, SMALL)
    assert (last.count() > 0) == bool(rows)
