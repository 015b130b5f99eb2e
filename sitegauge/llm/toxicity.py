"""Toxicity (1): cumulative-link ordinal regression on sparse text features.

Features are words (runs of letters and digits, lower case) and their beginnings of 4 to 7 letters,
hashed; a feature's value grows with its share of the text's words. The model is
P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered thresholds.
The labels say only toxic or not; labelled toxic texts get grades 1 to 3 by thirds of the share of
words that stand in toxic texts almost alone, others grade 0. The result is the expected grade.

The model is fitted on the driver to at most ``sample_rows`` labelled documents, taken by hash of
their id over the whole table; features are made in tasks. Every document is scored, in full.

Null and empty texts have no features, expected severity as the thresholds alone give. Labels that
are null count as missing; of several labels for one id the largest counts; without toxic and clean
labels nothing is rejected. Extra columns are ignored (``keep_clean`` keeps them). Repeated rows
score alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import stored

_WORD = re.compile(r"[^\W_]+")
_SPACE = 1 << 22
_STARTS = (4, 5, 6, 7)
_KEPT = 100_000
GRADES = 4


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself, then its beginnings."""
    names = [word, *(word[:n] + "*" for n in _STARTS if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(x) % _SPACE for x in names]


def counts_of(text: str | None) -> tuple[Counter, int]:
    words = Counter(_WORD.findall((text or "").lower()))
    return words, words.total()


def value(count: np.ndarray | float, total: int) -> np.ndarray:
    return np.log1p(1000.0 * np.asarray(count) / max(total, 20))


@dataclass(frozen=True)
class Severity:
    """Weights by feature number, and the ascending thresholds between grades."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - np.asarray(scores)[:, None], -60, 60)))

    def scores(self, texts: list[str | None], memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words, total = counts_of(text)
            found: Counter = Counter()
            for word, n in words.items():
                hit = memo.get(word)
                if hit is None:
                    if len(memo) >= _KEPT:
                        memo.clear()
                    hit = memo[word] = tuple(f for f in features_of(word) if f in self.weights)
                for f in hit:
                    found[f] += n
            if found:
                out[i] = float(np.dot(value(np.array(list(found.values())), total), [self.weights[f] for f in found]))
        return out


def _fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, width: int, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient; the L1 term keeps noise out of long texts."""
    n, cuts = len(grade), GRADES - 1
    share = np.clip(np.array([(grade <= k).mean() for k in range(cuts)]), 1e-3, 1 - 1e-3)
    w, theta = np.zeros(width), np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(cuts))
    size = 4.0 * n / max(1.0, float(np.bincount(rows, weights=values**2, minlength=n).sum()) / 4)
    ahead_w, ahead_t, before = w, theta, 1.0
    for _ in range(steps):
        s = np.bincount(rows, weights=values * ahead_w[columns], minlength=n)
        p = 1 / (1 + np.exp(np.clip(s[:, None] - ahead_t[None, :], -60, 60)))  # P(grade <= k)
        full = np.concatenate((np.zeros((n, 1)), p, np.ones((n, 1))), axis=1)
        upper, lower = full[np.arange(n), grade + 1], full[np.arange(n), grade]
        mass = np.maximum(upper - lower, 1e-9)
        slope = 1 - upper - lower
        grad_w = np.bincount(columns, weights=values * slope[rows], minlength=width) / n
        dens = p * (1 - p)
        grad_t = np.array([((grade == k + 1) * dens[:, k] / mass - (grade == k) * dens[:, k] / mass).mean() for k in range(cuts)])
        new_w = ahead_w - size * grad_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - size * l1, 0)
        new_t = np.maximum.accumulate(ahead_t - size * grad_t)
        after = (1 + np.sqrt(1 + 4 * before**2)) / 2
        ahead_w, ahead_t = new_w + (before - 1) / after * (new_w - w), np.maximum.accumulate(new_t + (before - 1) / after * (new_t - theta))
        w, theta, before = new_w, new_t, after
    return w, theta


def fit_severity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, l1: float = 2e-4, steps: int = 400, hold_out: int | None = None) -> Severity:
    """Fits the model. With ``hold_out`` = m, documents whose id is divisible by m are left for testing."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if hold_out:
        known = known.filter(F.col("doc_id") % hold_out != 0)
    total = known.count()
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(total, 1))) < sample_rows).limit(sample_rows + sample_rows // 10)
    # one row per sampled id, however often it occurs: at most 1.1 x sample_rows rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic")
    sampled = chosen.agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 100):
                some, out = b.iloc[low : low + 100], []
                for text, toxic in zip(some["text"], some["toxic"], strict=True):
                    words, n = counts_of(text)
                    whole, part = Counter(), Counter()
                    for word, c in words.items():
                        first, *rest = features_of(word)
                        whole[first] += c
                        for f in rest:
                            part[f] += c
                    out.append((int(toxic), n, list(whole), list(whole.values()), list(part), list(part.values())))
                yield pd.DataFrame(out, columns=["toxic", "n", "words", "wn", "parts", "pn"])

    made = stored(sampled.mapInPandas(extract, "toxic int, n int, words array<int>, wn array<int>, parts array<int>, pn array<int>"))
    size, bad_share = made.agg(F.count("*"), F.avg("toxic")).first()
    if not size or bad_share in (0, 1):
        return Severity({}, (50.0, 51.0, 52.0))
    # features at least twice as usual in toxic texts; the sample bounds how many there can be
    bar = min(2 * bad_share, 0.5 + bad_share / 2)
    counted = made.select("toxic", F.explode(F.concat("words", "parts")).alias("f")).groupBy("f").agg(F.count("*").alias("seen"), F.sum("toxic").alias("bad"))
    told = counted.filter((F.col("seen") >= 4) & (F.col("bad") >= bar * F.col("seen"))).toPandas()
    ids = np.sort(told["f"].to_numpy(dtype=np.int64))
    strong = np.sort(told.loc[told["bad"] >= 0.8 * told["seen"], "f"].to_numpy(dtype=np.int64))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for toxic, n, words, wn, parts, pn in b.itertuples(index=False):
                features, counts = np.concatenate((words, parts)).astype(np.int64), np.concatenate((wn, pn)).astype(np.int32)
                keep = np.isin(features, ids)
                severe = int(np.asarray(wn)[np.isin(words, strong)].sum())
                out.append((toxic, n, severe, np.searchsorted(ids, features[keep]).astype(np.int32), counts[keep]))
            yield pd.DataFrame(out, columns=["toxic", "n", "severe", "at", "count"])

    rest = made.mapInPandas(narrow, "toxic int, n int, severe int, at array<int>, count array<int>").toPandas()
    toxic, n = rest["toxic"].to_numpy(), np.maximum(rest["n"].to_numpy(), 1)
    dense = rest["severe"].to_numpy() / n
    thirds = np.quantile(dense[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (dense > thirds[0]) + (dense > thirds[1]), 0)
    rows = np.repeat(np.arange(len(rest)), rest["at"].map(len).to_numpy())
    at = np.concatenate(rest["at"].to_list() or [np.zeros(0, int)]).astype(np.int64)
    x = np.log1p(1000.0 * np.concatenate(rest["count"].to_list() or [np.zeros(0)]) / np.maximum(n[rows], 20))
    w, theta = _fit_ordinal(rows, at, x, grade, len(ids), l1, steps)
    return Severity({int(f): float(v) for f, v in zip(ids, w, strict=True) if v != 0}, tuple(map(float, theta)))


def _graded(model: Severity, text: str) -> Column:
    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            above = model.above(model.scores(list(batch), memo))
            yield pd.DataFrame({"expected_severity": above.sum(1), "p_toxic": above[:, 0], "grade": (above >= 0.5).sum(1).astype("int32")})

    return grade(F.col(text))


def severity(docs: DataFrame, model: Severity, threshold: float = 0.5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade (the last one reached with probability 1/2), toxic."""
    graded = docs.select(F.col(id_column).alias("doc_id"), _graded(model, text).alias("g"))
    return graded.select("doc_id", "g.*", (F.col("g.p_toxic") >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, model: Severity, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is toxic with probability ``threshold`` or more."""
    graded = docs.select(F.struct("*").alias("_row"), _graded(model, "text").alias("_g"))
    return graded.filter(F.col("_g.p_toxic") < threshold).select("_row.*")
