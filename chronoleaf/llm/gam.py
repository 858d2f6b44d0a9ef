"""Quality classifier: a generalised additive model with pairwise interactions.

Feature values are cut into quantile bins. Cyclic boosting visits one feature after the other, fits a shallow
tree of at most three leaves to the gradient summed per bin, and adds it to that feature's lookup table. Then
the pairs of features whose joint bins explain most of what is left get tables of their own, by trees with one
cut on the first feature and one on the second on either side. A score is the logistic of the intercept and
the table entries of a text's bins, added for whole batches at once.

The model is fitted on the driver from at most MAX_TRAIN labelled rows (those of the least hashes of their
doc_id); scoring covers all rows. Rows whose crc32(doc_id as text) mod 4 is 2 are held out of fitting.

Defined cases: a null or empty text is scored from the features of an empty text; a null doc_id counts as the
text "" and is not held out; a doc_id with several labels has the least of them; without labels of both kinds,
all scores are the smoothed share of label 1; repeated rows get repeated scores; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches

MAX_TRAIN = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, PENALTY = 32, 8, 150, 60, 8, 0.1, 4.0
CUT = 0.7
SYMBOLS = str.maketrans("", "", "#*$%&|<>{}[]~^=_@\\")
DIGITS = str.maketrans("", "", "0123456789")
FEATURES = (
    "words", "chars", "word_length", "symbols", "pipes", "bangs", "digits", "capital_words", "title_words",
    "dup_lines", "distinct_words", "top_word", "distinct_pairs", "stops", "line_length", "non_ascii", "short_words", "commas", "urls", "last_stop",
)


def features(text: str | None) -> list[float]:
    """The values named FEATURES of a whole text."""
    t = text or ""
    words = t.split()
    n, chars = len(words) or 1, len(t) or 1
    lines = [x for x in t.split("\n") if x.strip()]
    top = max(Counter(words).values(), default=0)
    letters = sum(map(len, words))
    return [
        math.log1p(len(words)),
        math.log1p(len(t)),
        letters / n,
        (len(t) - len(t.translate(SYMBOLS))) / n,
        t.count("|") / n,
        t.count("!") / n,
        (len(t) - len(t.translate(DIGITS))) / chars,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        (len(lines) - len(set(lines))) / (len(lines) or 1),
        len(set(words)) / n,
        top / n,
        len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        t.count(".") / n,
        math.log1p(chars / (len(lines) or 1)),
        (len(t.encode("utf-8", "replace")) - len(t)) / chars,
        sum(len(w) <= 3 for w in words) / n,
        t.count(",") / n,
        (t.count("http") + t.count("@")) / n,
        float(t.rstrip()[-1:] in (".", "!", "?")),
    ]


@dataclass
class Model:
    """edges: inner bin edges by feature; tables: score by bin; pairs: (feature, feature, score by both coarse bins)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((0, len(x)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[j]]
        for i, j, t in self.pairs:
            out += t[self.coarse(i, b[i]), self.coarse(j, b[j])]
        return out

    def coarse(self, j: int, b: np.ndarray) -> np.ndarray:
        return b * COARSE // (len(self.edges[j]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PENALTY)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a run of bins in two, and its place; 0 where none helps."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gains = gain(left_g, left_h) + gain(total_g - left_g, total_h - left_h) - gain(total_g, total_h)
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with one cut and at most one more."""
    score, at = best_cut(g, h)
    cuts = [0, len(g)]
    if score > 0:
        cuts.append(at)
        a, b = best_cut(g[:at], h[:at]), best_cut(g[at:], h[at:])
        if max(a[0], b[0]) > 0:
            cuts.append(a[1] if a[0] >= b[0] else at + b[1])
    cuts.sort()
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts rows once, then the columns of either side once."""
    top_g, top_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
    best, values = 0.0, np.zeros_like(g)
    for i in range(len(top_g)):
        total, out = 0.0, np.zeros_like(g)
        for rows, gg, hh in ((slice(0, i + 1), top_g[i], top_h[i]), (slice(i + 1, None), g.sum(axis=0) - top_g[i], h.sum(axis=0) - top_h[i])):
            extra, at = best_cut(gg, hh)
            total += extra + float(gain(gg.sum(), hh.sum()))
            out[rows, :at] = leaf(gg[:at].sum(), hh[:at].sum()) if at else 0
            out[rows, at:] = leaf(gg[at:].sum(), hh[at:].sum())
        if total > best:
            best, values = total, out
    return best - float(gain(g.sum(), h.sum())), values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts all features' tables in turns, then those of the chosen pairs."""
    model = Model()
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return model
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[j], g, s), np.bincount(bins[j], h, s))
            model.tables[j] += step
            margin += step[bins[j]]
    coarse = [model.coarse(j, bins[j]) for j in range(len(sizes))]

    def joint(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[i] * COARSE + coarse[j]
        return tuple(np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h))

    ranked = sorted(combinations(range(len(sizes)), 2), key=lambda p: -pair_tree(*joint(*p))[0])
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * pair_tree(*joint(i, j))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def vectors(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for big in batches:
        for at in range(0, big.num_rows, 512):
            b = big.slice(at, 512)
            yield b, np.array([features(t.as_py()) for t in b.column(text)], np.float64).reshape(b.num_rows, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("l"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("l")).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in vectors(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    made = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).toArrow()
    if not made.num_rows:
        return Model()
    return fit(np.array(made["x"].to_pylist()), np.array(made["quality"].to_pylist(), np.float64))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in vectors(batches, 2):
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
