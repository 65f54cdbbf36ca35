"""Comparison of frequency tables ``label, item, count``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def pair_keyness(
    freq: DataFrame,
    label_a: str,
    label_b: str,
    *,
    scale: float = 10_000,
    correction: str = "zero_only",
    amount: float = 0.5,
    min_total: float = 0,
) -> DataFrame:
    """Counts, rates, difference, log ratio and log likelihood of every item of two tables.

    Both tables and their totals come from one aggregation and one window-free join
    with a single row. ``min_total`` drops rows only: totals and the number of types
    are those of the full tables.
    """
    side = lambda x: F.coalesce(F.sum(F.when(F.col("label") == x, F.col("count"))), F.lit(0)).cast("double")
    rows = freq.filter(F.col("label").isin(label_a, label_b)).groupBy("item").agg(side(label_a).alias("count_a"), side(label_b).alias("count_b"))
    totals = rows.agg(F.sum("count_a").alias("total_a"), F.sum("count_b").alias("total_b"), F.count("*").cast("double").alias("types"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    a, b, ta, tb = (F.col(c) for c in ("count_a", "count_b", "total_a", "total_b"))
    if correction == "additive":
        ra, rb = (stats.additive_rate(c, t, F.col("types"), amount) for c, t in ((a, ta), (b, tb)))
    elif correction == "zero_only":
        ra, rb = (stats.zero_corrected_rate(c, t, amount) for c, t in ((a, ta), (b, tb)))
    else:
        raise ValueError(f"unknown correction: {correction!r}")
    rows = rows.filter(a + b >= min_total)
    rows = rows.withColumns(
        {
            "rate_a": stats.rate(a, ta, scale), "rate_b": stats.rate(b, tb, scale), "log_ratio": stats.log_ratio(ra, rb),
            "log_likelihood": stats.log_likelihood(a, b, ta, tb),
        }
    )
    return rows.withColumns(
        {"difference": F.col("rate_a") - F.col("rate_b"), "direction": stats.direction(F.col("log_ratio"))}
    ).drop("types")


SORT_KEYS = ("log_likelihood", "abs_log_ratio", "total_count", "item")


def ranked(rows: DataFrame, key: str = "log_likelihood", descending: bool = True, top: int | None = None) -> DataFrame:
    """Rows by the key, equals by item from small to large; at most ``top``."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key: {key!r}")
    by = {"abs_log_ratio": F.abs("log_ratio"), "total_count": F.col("count_a") + F.col("count_b")}.get(key, F.col(key))
    out = rows.orderBy(by.desc() if descending else by.asc(), F.col("item").asc())
    return out.limit(top) if top is not None else out


def compare_many(freq: DataFrame, labels: Sequence[str], *, scale: float = 1.0, smoothing: float = 0.5, min_total: float = 0) -> DataFrame:
    """``item, count_<label>..., rate_<label>..., max_label, min_label, range, relative_range`` over n tables.

    Rates are smoothed additively over all types; of equal rates the first label in
    the given order is named.
    """
    side = lambda x: F.coalesce(F.sum(F.when(F.col("label") == x, F.col("count"))), F.lit(0)).cast("double")
    rows = freq.filter(F.col("label").isin(list(labels))).groupBy("item").agg(*(side(x).alias(f"count_{x}") for x in labels))
    totals = rows.agg(*(F.sum(f"count_{x}").alias(f"_t_{x}") for x in labels), F.count("*").cast("double").alias("_types"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    rows = rows.filter(sum((F.col(f"count_{x}") for x in labels), F.lit(0.0)) >= min_total)
    rows = rows.withColumns(
        {f"rate_{x}": stats.additive_rate(F.col(f"count_{x}"), F.col(f"_t_{x}"), F.col("_types"), smoothing) * scale for x in labels}
    )
    high, low = F.greatest(*(f"rate_{x}" for x in labels)), F.least(*(f"rate_{x}" for x in labels))
    named = lambda v: F.coalesce(*(F.when(F.col(f"rate_{x}") == v, F.lit(x)) for x in labels))
    return rows.select(
        "item", *(f"count_{x}" for x in labels), *(f"rate_{x}" for x in labels), named(high).alias("max_label"),
        named(low).alias("min_label"), (high - low).alias("range"), F.when(low > 0, high / low).alias("relative_range"),
    )
