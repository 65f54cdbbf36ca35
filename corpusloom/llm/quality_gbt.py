"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken over whole texts with array operations. The trees are fitted
on the driver from a bounded sample of labelled documents, stored as complete
binary trees in flat arrays, and walked for a whole batch of documents at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, release

#: Labelled documents that a fit may use; those whose hashed id comes first.
MAX_TRAIN = 20_000

STATISTICS = (
    "log_words", "mean_word", "distinct_words", "distinct_pairs", "top_word", "adjacent_same", "log_lines",
    "distinct_lines", "words_per_line", "upper", "digit", "punctuation", "symbol", "pipe", "exclaim", "space",
    "wide", "stop", "comma", "longest_word", "end_marks", "ends_in_mark",
)

_SYMBOLS = b"#$%&*@^~<>{}[]\\/=+_"
_MARKS = b".,;:!?'\"()-"


def statistics(text: str) -> list[float]:
    """The numbers of :data:`STATISTICS` for one whole text; all 0 for one without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    white = int(count[[9, 10, 11, 12, 13, 32]].sum())
    tally = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum())
    pairs = len(set(zip(words, words[1:])))
    per = lambda *codes: float(sum(int(count[c]) for c in codes)) / n
    return [
        float(np.log1p(n)), (size - white) / n, len(tally) / n, pairs / max(1, n - 1), max(tally.values()) / n,
        sum(map(eq, words, words[1:])) / n, float(np.log1p(len(lines))), len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)), upper / max(1, letters), int(count[48:58].sum()) / size, per(*_MARKS), per(*_SYMBOLS),
        per(124), per(33), white / size, int(count[128:].sum()) / size, per(46), per(44),
        float(np.log1p(max(map(len, tally)))), per(46, 33, 63), float(words[-1][-1:] in b".!?\"'"),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: row ``t`` holds tree ``t`` in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``x``."""
        total = np.full(len(x), self.bias)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (leaf.shape[0] - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
        l2: float = 1.0) -> Trees:
    """Boosted trees of logistic loss on binned columns; classes weigh the same in total.

    Without rows, or with one class only, the result is a constant: 0.5 without
    labels, else a firm vote for the class seen.
    """
    none = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    good = int((y > 0).sum())
    if good in (0, len(y)):
        return Trees(none.feature, none.threshold, none.leaf, 0.0 if not len(y) else 4.0 if good else -4.0)
    n, d = x.shape
    weight = np.where(y > 0, 0.5 * n / good, 0.5 * n / (n - good))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf, total = np.zeros((trees, leaves)), np.zeros(n)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = at - first
            best = np.full(width, 1e-9)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = slot * bins + code[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gl, hl = gs[:, : len(edges[j])], hs[:, : len(edges[j])]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        slot = at - inner
        gs, hs = np.bincount(slot, g, leaves), np.bincount(slot, h, leaves)
        leaf[t] = -rate * gs / (hs + l2)
        total += leaf[t, slot]
    return Trees(feature, threshold, leaf, 0.0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t or "") for t in each_text(texts)], pa.list_(pa.float64()))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and 0/1 quality of at most ``max_train`` labelled documents.

    Several labels of one document are averaged, a tie counting as good; null ids
    and null labels are left out, as are labels without a document. Of several texts
    of one id the greatest counts.
    """
    voted = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    )
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")  # at most max_train rows; only labelled texts are shuffled
        .groupBy("doc_id", "_good").agg(F.max("text").alias("text"))
        .select("doc_id", "_good", _statistics("text").alias("_x"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["_x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return x, np.array([r["_good"] for r in rows], int)


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    return fit(*training_rows(docs, labels, max_train))


def scorer(model: Trees):
    """A column function: text -> probability of good quality."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t or "") for t in each_text(texts)], float).reshape(-1, len(STATISTICS))
        release()
        return pa.array(model.score(x))

    return lambda text: score(F.col(text).cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5,
                     max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, quality_score, keep`` for every row of ``docs``, over its whole text.

    The score is rounded to 6 places; ``keep`` is score >= ``threshold``. Null and
    empty texts have all statistics 0 and never pass. Repeated rows and null ids
    are scored one by one; other columns are dropped. Without usable labels the
    score is 0.5. The map has no shuffle; the fit gathers ``max_train`` rows of
    statistics at most.
    """
    score = scorer(fit_quality(docs, labels, max_train))
    words = F.col("text").cast("string").rlike(r"[^\s]")
    return docs.select("doc_id", F.round(score("text"), 6).alias("quality_score"), words.alias("_words")).select(
        "doc_id",
        "quality_score",
        F.coalesce(F.col("_words") & (F.col("quality_score") >= threshold), F.lit(False)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`classify_quality` keeps.

    Null, empty and blank texts go; repeated rows and rows without an id are judged
    one by one; documents of equal text share their fate. Without usable labels the
    score of 0.5 keeps all that has words. An empty table stays empty.
    """
    score = scorer(fit_quality(docs, labels, max_train))
    return docs.filter(
        F.col("text").cast("string").rlike(r"[^\s]") & (F.round(score("text"), 6) >= threshold)
    )
