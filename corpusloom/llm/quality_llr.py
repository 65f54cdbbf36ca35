"""Quality rule: hashed n-gram log-likelihood ratio of target and raw corpus.

Words and pairs of words are hashed into buckets. The buckets of trusted documents
and those of all documents give two smoothed multinomials; a document's score is
the mean of log p(target) - log p(raw) over its n-grams. Every document is held
against one threshold, that which keeps a stated share of the trusted documents:
nothing is drawn at random.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, each_text, release, sized

BUCKETS = 10_000
PAIR = 31
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Share of the trusted documents that the threshold lets pass, and its steps in a unit of the mean log ratio.
KEEP = 0.998
STEPS = 1000

#: Hashes of the words of a batch; every worker process holds its own.
_WORDS = Memo(lambda w: int.from_bytes(md5(w).digest()[:4]), 150_000)


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """Buckets of the text's words and of its pairs of neighbouring words, repeats included.

    A word's hash is the first 8 hexadecimal digits of its MD5; words are split on
    ASCII white space, with case and punctuation kept. A pair's is 31 times the
    first word's plus the second's.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    return np.concatenate([h % n, (h[:-1] * PAIR + h[1:]) % n])


def corpus_counts(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents and over those whose id is in ``trusted``.

    Each task adds up its own rows and sends ``n`` sums; the driver gets ``n`` rows.
    """
    trusted = trusted.select(F.col("doc_id").cast("bigint").alias("_id")).filter("_id IS NOT NULL").distinct()
    trusted = trusted.withColumn("_good", F.lit(True))
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"))
        .join(sized(trusted), F.col("_doc") == F.col("_id"), "left")
        .select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    )

    def add(parts):
        raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for part in parts:
            for text, good in zip(each_text(part.column(0)), part.column(1).to_pylist()):
                if text:
                    seen = np.bincount(buckets(text, n), minlength=n)
                    raw += seen
                    if good:
                        target += seen
            _WORDS.clear()
        release()
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"]
        )

    sums = (
        rows.mapInArrow(add, "bucket int, raw bigint, target bigint")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()
    )
    raw, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(target) - log p(raw) by bucket; all 0 if there is no target."""
    if not target.sum():
        return np.zeros(len(raw))
    p = lambda c: np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c))
    return p(target) - p(raw)


def scorer(ratios: np.ndarray):
    n = len(ratios)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for text in each_text(texts):
            b = buckets(text, n)
            out.append(float(ratios[b].sum() / len(b)) if len(b) else None)
        _WORDS.clear()
        release()
        return pa.array(out, pa.float64())

    return lambda text: score(F.col(text).cast("string"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids with a label of good quality and none of bad."""
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q"))
        .filter("_q >= 1")
        .select("doc_id")
    )


def lowest_step(trusted_scores: DataFrame, keep: float = KEEP) -> int:
    """The greatest step (score times ``STEPS``, rounded down) that lets the share ``keep`` of ``llr`` pass.

    Scores are counted by step, so the driver gets as many rows as there are steps
    (mean log ratios stay within some 25, so 50,000), whatever the data. Without a score 0.
    """
    step = F.floor(F.col("llr") * STEPS).alias("step")
    counts = sorted((r["step"], r["count"]) for r in trusted_scores.filter("llr IS NOT NULL").groupBy(step).count().collect())
    spare = sum(c for _, c in counts) * (1 - keep) // 1
    for at, count in counts:
        if spare < count:
            return at
        spare -= count
    return 0


def _passes(step: int):
    return F.coalesce(F.floor(F.col("llr") * STEPS) >= step, F.lit(False))


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``."""
    ids = ids.select(F.col("doc_id").cast("bigint").alias("_id")).filter("_id IS NOT NULL").distinct()
    return docs.join(sized(ids), F.col("doc_id").cast("bigint") == F.col("_id"), "left_semi")


def score_documents(docs: DataFrame, trusted: DataFrame, keep: float = KEEP, n: int = BUCKETS,
                    smoothing: float = SMOOTHING) -> DataFrame:
    """``doc_id, llr, keep`` for every row of ``docs``, over its whole text.

    ``llr`` is rounded to 6 places; ``keep`` says whether it reaches the step that the
    share ``keep`` of the trusted documents reaches. A null text or one without words
    has a null score and is not kept. Repeated rows count as often as they stand;
    null ids are scored but never trusted; other columns are dropped. Without a
    trusted document all scores are 0 and all documents with words are kept; no
    documents give no rows. Two passes over the texts, no shuffle of text while ids
    fit a broadcast.
    """
    score = scorer(log_ratios(*corpus_counts(docs, trusted, n), smoothing))
    scores = cut(docs.select("doc_id", F.round(score("text"), 6).alias("llr")))  # ids and scores only; read twice
    return scores.withColumn("keep", _passes(lowest_step(_of(scores, trusted), keep)))


def keep_likely(docs: DataFrame, trusted: DataFrame, keep: float = KEEP, n: int = BUCKETS,
                smoothing: float = SMOOTHING, raw: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score_documents` keeps.

    Both multinomials and the threshold come from ``raw``, the corpus as it was before
    any filter; without it ``docs`` is taken for that. Null, empty and blank texts go;
    repeated rows and rows without an id are judged one by one; documents of equal
    text share their fate; an empty table stays empty.
    """
    raw = docs if raw is None else raw
    score = scorer(log_ratios(*corpus_counts(raw, trusted, n), smoothing))
    step = lowest_step(_of(raw, trusted).select(F.round(score("text"), 6).alias("llr")), keep)
    return docs.filter(F.floor(F.round(score("text"), 6) * STEPS) >= step)


def oracle(n: int = BUCKETS, smoothing: float = SMOOTHING, keep: float = KEEP) -> str:
    """The same in SQL, for tables ``documents`` and ``labels``."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
trusted AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) >= 1),
words AS (
  SELECT r, doc_id, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+'),
         lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS h FROM docs),
grams AS (
  SELECT r, doc_id, unnest(list_concat(list_transform(h, lambda x: x % {n}),
         list_transform(range(1, len(h)), lambda i: (h[i] * {PAIR} + h[i + 1]) % {n}))) AS b FROM words),
seen AS (SELECT r, doc_id, b, count(*) AS c FROM grams GROUP BY ALL),
sums AS (
  SELECT g.b, sum(g.c) AS raw, coalesce(sum(g.c) FILTER (t.doc_id IS NOT NULL), 0) AS target
  FROM seen g LEFT JOIN trusted t USING (doc_id) GROUP BY g.b),
every AS (SELECT b.b, coalesce(raw, 0) AS raw, coalesce(target, 0) AS target FROM (SELECT unnest(range({n})) AS b) b LEFT JOIN sums USING (b)),
total AS (SELECT sum(raw) AS raw, sum(target) AS target FROM every),
ratio AS (
  SELECT b, CASE WHEN t.target = 0 THEN 0 ELSE ln(e.target + {smoothing}) - ln(t.target + {smoothing} * {n})
         - ln(e.raw + {smoothing}) + ln(t.raw + {smoothing} * {n}) END AS v FROM every e, total t),
score AS (SELECT r, round(sum(c * v) / sum(c), 6) AS llr FROM seen JOIN ratio USING (b) GROUP BY r),
good AS (SELECT llr, row_number() OVER (ORDER BY llr) - 1 AS i, count(*) OVER () AS k FROM score JOIN docs USING (r) WHERE doc_id IN (SELECT doc_id FROM trusted)),
step AS (SELECT coalesce(min(floor(llr * {STEPS})), 0) AS s FROM good WHERE i >= floor(k * (1 - {keep})))
SELECT doc_id, llr, coalesce(floor(llr * {STEPS}) >= s, FALSE) AS keep FROM docs LEFT JOIN score USING (r), step"""
