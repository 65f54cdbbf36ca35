"""Standardisation, distances, attribution and verification on long vectors ``id, feature, value``.

Frames have one row per observation (or work) and feature. Standardisation is a
group by feature; distances are one equality join on the feature and one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("manhattan", "burrows_delta", "cosine_similarity", "cosine_delta")


def fit_zscores(vectors: DataFrame) -> DataFrame:
    """``feature, mean, sd, retained``; sample deviation, and features without variance aren't retained."""
    return vectors.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), (F.min("value") < F.max("value")).alias("retained")
    )


def zscores(vectors: DataFrame, model: DataFrame) -> DataFrame:
    rows = vectors.join(model.filter("retained").select("feature", "mean", "sd"), "feature")
    return rows.withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def _score(metric: str) -> Column:
    a, b = F.col("va"), F.col("vb")
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    none = F.raise_error(F.concat(F.lit("a vector of zeros has no cosine: "), F.when(F.sum(a * a) == 0, F.first("id_a")).otherwise(F.first("id_b")).cast("string")))
    cosine = F.when(norm > 0, F.least(F.greatest(F.sum(a * b) / F.nullif(norm, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))).otherwise(none.cast("double"))
    return {
        "manhattan": F.sum(F.abs(a - b)), "burrows_delta": F.avg(F.abs(a - b)),
        "cosine_similarity": cosine, "cosine_delta": 1 - cosine,
    }[metric]


def distances(left: DataFrame, right: DataFrame, metric: str = "burrows_delta", directed: bool = True) -> DataFrame:
    """``id_a, id_b, score`` of all pairs of different ids; with ``directed=False`` only ``id_a < id_b``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    a = left.select(F.col("id").alias("id_a"), "feature", F.col("value").alias("va"))
    b = right.select(F.col("id").alias("id_b"), "feature", F.col("value").alias("vb"))
    pairs = a.join(b, "feature").filter("id_a <> id_b" if directed else "id_a < id_b")
    return pairs.groupBy("id_a", "id_b").agg(_score(metric).alias("score"))


def neighbors(vectors: DataFrame, metric: str = "burrows_delta", top: int = 5) -> DataFrame:
    """``id_a, rank, id_b, score``: the nearest others of each observation; scores that agree to 9 places count as equal and go by id."""
    scores = distances(vectors, vectors, metric)
    best = F.round("score", 9).desc() if metric == "cosine_similarity" else F.round("score", 9).asc()
    order = Window.partitionBy("id_a").orderBy(best, "id_b")
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select("id_a", "rank", "id_b", "score")


def work_profiles(vectors: DataFrame) -> DataFrame:
    """``work, author, feature, value``: the mean vector of each work's observations."""
    return vectors.groupBy("work", "author", "feature").agg(F.avg("value").alias("value"))


def attach_metadata(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Inner join with ``metadata(id, author, work)``; ids must be unique, works of one author, none missing."""
    twice = metadata.groupBy("id").count().filter("count > 1").limit(1).count()
    shared = metadata.groupBy("work").agg(F.count_distinct("author").alias("n")).filter("n > 1").limit(1).count()
    missing = vectors.select("id").distinct().join(metadata, "id", "left_anti").limit(1).count()
    if twice or shared or missing:
        raise ValueError("metadata has repeated ids, works of several authors or missing ids")
    return vectors.join(metadata.select("id", "author", "work"), "id")


def leave_one_work_out(profiles: DataFrame) -> DataFrame:
    """``work, actual, predicted, distance, runner_up, margin, correct``, a row for each held-out work.

    Each fold's means, deviations and author centroids are those of all works less
    the held-out one. They follow from sums over all works and the work's own row,
    so the folds aren't computed one by one.
    """
    works = profiles.select("work", "author").distinct().groupBy("author").agg(F.count("*").alias("works"))
    row = works.agg(F.count("*").alias("a"), F.sum("works").alias("w"), F.min("works").alias("m")).first()
    if (row["a"] or 0) < 2 or (row["w"] or 0) < 4 or (row["m"] or 0) < 2:
        raise ValueError("needs two authors and four works, and two works of each author")
    # sums over the training works of each fold, by subtraction of the held-out work's centred value
    centre = profiles.groupBy("feature").agg(F.avg("value").alias("c"))
    p = profiles.join(centre, "feature").withColumn("x", F.col("value") - F.col("c")).select("work", "author", "feature", "x")
    allsum = p.groupBy("feature").agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )
    # the next to least and greatest, of repeated ones the same again: bounded sums, no list of a feature's works
    inner = p.join(allsum.select("feature", "lo", "hi"), "feature").groupBy("feature").agg(
        F.when(F.count(F.when(F.col("x") == F.col("lo"), 1)) > 1, F.min("lo")).otherwise(F.min(F.when(F.col("x") > F.col("lo"), F.col("x")))).alias("lo2"),
        F.when(F.count(F.when(F.col("x") == F.col("hi"), 1)) > 1, F.max("hi")).otherwise(F.max(F.when(F.col("x") < F.col("hi"), F.col("x")))).alias("hi2"),
    )
    ends = allsum.join(inner, "feature")
    per = p.groupBy("author", "feature").agg(F.count("*").alias("na"), F.sum("x").alias("sa"))
    held = p.select(F.col("work").alias("held"), F.col("author").alias("actual"), "feature", F.col("x").alias("h")).join(ends, "feature")
    low, high = F.when(F.col("h") == F.col("lo"), F.col("lo2")).otherwise(F.col("lo")), F.when(F.col("h") == F.col("hi"), F.col("hi2")).otherwise(F.col("hi"))
    m = F.col("n") - 1
    mean = (F.col("s") - F.col("h")) / m
    var = (F.col("q") - F.col("h") * F.col("h") - m * mean * mean) / (m - 1)
    held = held.select("held", "actual", "feature", "h", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), (low < high).alias("retained")).filter("retained")
    own = F.col("author") == F.col("actual")
    count, total = F.when(own, F.col("na") - 1).otherwise(F.col("na")), F.when(own, F.col("sa") - F.col("h")).otherwise(F.col("sa"))
    gap = F.abs((F.col("h") - total / count) / F.col("sd"))
    scores = held.join(per, "feature").groupBy("held", "actual", "author").agg(F.avg(gap).alias("distance"))
    best = scores.groupBy("held", "actual").agg(F.array_sort(F.collect_list(F.struct("distance", "author"))).alias("c"))
    return best.select(
        F.col("held").alias("work"), "actual", F.col("c")[0]["author"].alias("predicted"), F.col("c")[0]["distance"].alias("distance"),
        F.col("c")[1]["author"].alias("runner_up"), (F.col("c")[1]["distance"] - F.col("c")[0]["distance"]).alias("margin"),
        (F.col("c")[0]["author"] == F.col("actual")).alias("correct"),
    )


def lowo_summary(folds: DataFrame) -> DataFrame:
    """``author, works, correct, accuracy``; the row without an author has the whole, its accuracy and the mean over authors."""
    per = folds.groupBy(F.col("actual").alias("author")).agg(F.count("*").alias("works"), F.sum(F.col("correct").cast("bigint")).alias("correct"))
    per = per.withColumn("accuracy", F.col("correct") / F.col("works"))
    whole = per.agg(F.sum("works").alias("works"), F.sum("correct").alias("correct"), F.avg("accuracy").alias("macro_accuracy"))
    return per.withColumn("macro_accuracy", F.lit(None).cast("double")).unionByName(
        whole.select(F.lit(None).cast("string").alias("author"), "works", "correct", (F.col("correct") / F.col("works")).alias("accuracy"), "macro_accuracy")
    )


def verification_scores(profiles: DataFrame, query: str, candidate: str) -> DataFrame:
    """``kind, work, author, distance``: genuine and impostor calibration, and the query (kind ``query``).

    Standardised over the references, never over the query. A candidate's own work is
    held against the centroid of the candidate's others, a background work against
    the full one.
    """
    refs = profiles.filter(F.col("work") != query)
    works = refs.select("work", "author").distinct().agg(F.count(F.when(F.col("author") == candidate, 1)).alias("c"), F.count(F.when(F.col("author") != candidate, 1)).alias("b")).first()
    if works["c"] < 3 or works["b"] < 2:
        raise ValueError("needs three works of the candidate and two of others")
    model = fit_zscores(refs.select("feature", "value"))
    z = zscores(profiles.select("work", "author", "feature", "value"), model)
    own = z.filter((F.col("author") == candidate) & (F.col("work") != query)).groupBy("feature").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    kind = F.when(F.col("work") == query, "query").when(F.col("author") == candidate, "genuine").otherwise("impostor")
    rows = z.withColumn("kind", kind).join(own, "feature")
    centroid = F.when(F.col("kind") == "genuine", (F.col("s") - F.col("value")) / (F.col("n") - 1)).otherwise(F.col("s") / F.col("n"))
    return rows.groupBy("kind", "work", "author").agg(F.avg(F.abs(F.col("value") - centroid)).alias("distance"))


def verify(profiles: DataFrame, query: str, candidate: str, genuine_q: float = 0.95, impostor_q: float = 0.05) -> DataFrame:
    """One row: boundaries, thresholds, the query's distance and the decision; on a threshold it is inconclusive."""
    rows = verification_scores(profiles, query, candidate)
    of = lambda k: F.when(F.col("kind") == k, F.col("distance"))
    out = rows.agg(
        F.percentile(of("genuine"), F.lit(genuine_q)).alias("genuine_boundary"), F.percentile(of("impostor"), F.lit(impostor_q)).alias("impostor_boundary"),
        F.max(of("query")).alias("distance"), F.count(of("genuine")).alias("genuine_works"), F.count(of("impostor")).alias("impostor_works"),
    )
    out = out.withColumns({"accept_below": F.least("genuine_boundary", "impostor_boundary"), "reject_above": F.greatest("genuine_boundary", "impostor_boundary")})
    decision = F.when(F.col("distance") < F.col("accept_below"), "accept").when(F.col("distance") > F.col("reject_above"), "reject").otherwise("inconclusive")
    return out.withColumn("decision", decision)


def classify_outcome(genuine: Column, decision: Column) -> Column:
    """One of six outcomes."""
    return F.when(decision == "inconclusive", F.when(genuine, "inconclusive_genuine").otherwise("inconclusive_impostor")).when(
        decision == "accept", F.when(genuine, "true_accept").otherwise("false_accept")
    ).otherwise(F.when(genuine, "false_reject").otherwise("true_reject"))


def verification_summary(outcomes: DataFrame) -> DataFrame:
    """One row of ``outcomes(genuine, decision)``: the six counts, coverage, decisive and balanced accuracy."""
    rows = outcomes.withColumn("o", classify_outcome(F.col("genuine"), F.col("decision")))
    names = ("true_accept", "false_reject", "inconclusive_genuine", "false_accept", "true_reject", "inconclusive_impostor")
    out = rows.agg(F.count("*").alias("works"), *(F.count(F.when(F.col("o") == n, 1)).alias(n) for n in names))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = {n: F.col(n) for n in names}
    right, decided = c["true_accept"] + c["true_reject"], c["true_accept"] + c["true_reject"] + c["false_accept"] + c["false_reject"]
    genuine, other = c["true_accept"] + c["false_reject"] + c["inconclusive_genuine"], c["false_accept"] + c["true_reject"] + c["inconclusive_impostor"]
    return out.withColumns(
        {
            "coverage": share(decided, F.col("works")), "decisive_accuracy": share(right, decided),
            "balanced_rate": (share(c["true_accept"], genuine) + share(c["true_reject"], other)) / 2,
        }
    )
