"""Predicates and projections on token records."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_key, roman, stripped


def with_inclusion(
    tokens: DataFrame,
    *,
    unit: str = "lemma",
    upos_targets: Collection[str] = ("NOUN",),
    min_length: int = 1,
    drop_roman: bool = False,
    exceptions: Collection[str] = (),
) -> DataFrame:
    """``analysis_key``, ``included`` and ``exclusion_reason``; the first failing test names the reason.

    The key is the lemma, or the token where there is none; a lemma of blanks gives
    no key. No targets means that every part of speech is counted.
    """
    if unit not in ("lemma", "surface"):
        raise ValueError(f"unknown unit: {unit!r}")
    source = F.when(F.coalesce("lemma", F.lit("")) != "", F.col("lemma")).otherwise(F.col("token"))
    key = folded_key(source if unit == "lemma" else F.col("token"))
    reason = F.when(F.col("analysis_key").isNull(), "missing_key")
    if upos_targets:
        reason = reason.when(~F.coalesce(F.col("upos").isin(sorted(upos_targets)), F.lit(False)), "upos_not_targeted")
    reason = reason.when(F.length("analysis_key") < min_length, "too_short")
    if drop_roman:
        reason = reason.when(roman(F.col("analysis_key"), exceptions, unit == "surface"), "roman_numeral")
    out = tokens.withColumn("analysis_key", key).withColumn("exclusion_reason", reason)
    return out.withColumn("included", F.col("exclusion_reason").isNull())


def lexical(tokens: DataFrame, *, min_length: int = 1, drop_roman: bool = True, exceptions: Collection[str] = ()) -> DataFrame:
    """``eligible``, ``token_value`` and ``lemma_value`` for features: the surface form alone decides."""
    token = stripped(F.col("token"))
    good = token.rlike("[\\p{L}\\p{N}]") & (F.length(token) >= min_length)
    if drop_roman:
        good = good & ~roman(token, exceptions, True)
    lemma = F.when(F.coalesce("lemma", F.lit("")) != "", F.col("lemma")).otherwise(F.col("token"))
    return tokens.withColumns(
        {"eligible": F.coalesce(good, F.lit(False)), "token_value": F.lower(token), "lemma_value": F.lower(stripped(lemma))}
    )
