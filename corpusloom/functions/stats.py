"""Numeric functions: rates, keyness, summaries of distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log ratios this near to 0 favour neither side.
EQUAL = 1e-12


def rate(count: Column, total: Column, scale: float = 1.0) -> Column:
    return F.when(total > 0, count / total * F.lit(float(scale))).otherwise(F.lit(0.0))


def zero_corrected_rate(count: Column, total: Column, instead: float = 0.5) -> Column:
    """Rate in which only a count of 0 is replaced."""
    return F.when(count > 0, count).otherwise(F.lit(float(instead))) / total


def additive_rate(count: Column, total: Column, types: Column, smoothing: float = 0.5) -> Column:
    """Rate smoothed over the ``types`` of all tables compared."""
    below = total + F.lit(float(smoothing)) * types
    return F.when(below > 0, (count + F.lit(float(smoothing))) / below).otherwise(F.lit(0.0))


def log_ratio(a: Column, b: Column) -> Column:
    """Base 2; infinite where one side is 0."""
    high, low = F.lit(float("inf")), F.lit(float("-inf"))
    return F.when(b == 0, high).when(a <= 0, low).otherwise(F.log2(a / b))


def log_likelihood(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """G² over the full two-by-two table; empty cells add nothing."""
    both, whole = a + b, total_a + total_b
    cell = lambda seen, margin, total: F.when(seen > 0, seen * F.log(seen / (margin * total / whole))).otherwise(F.lit(0.0))
    rest = whole - both
    value = 2 * (
        cell(a, both, total_a) + cell(b, both, total_b) + cell(total_a - a, rest, total_a) + cell(total_b - b, rest, total_b)
    )
    return F.greatest(value, F.lit(0.0))


def direction(ratio: Column) -> Column:
    return F.when(ratio > EQUAL, "A").when(ratio < -EQUAL, "B").otherwise("equal")


def summary(value: Column, name: str) -> list[Column]:
    """Mean, population variance, median and quartiles (linear between ranks); 0 where there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.avg(value)).alias(f"mean_{name}"),
        zero(F.var_pop(value)).alias(f"{name}_variance"),
        *(zero(F.percentile(value, F.lit(q))).alias(f"{name}_{n}") for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))),
    ]
