"""Corpus cleaning: profiles, line rules, substitutions, with an event for each change.

Lines become rows only inside one projection (arrays and higher-order functions),
so that cleaning is a map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
PROFILES = ("scholastic_text", "corpus_corporum")
SNIPPET = 200


@dataclass(frozen=True)
class Rule:
    """A line that matches from its start is dropped; or, with a replacement, matches are replaced."""

    name: str
    pattern: str
    replacement: str | None = None
    enabled: bool = True


def _java(replacement: str) -> str:
    """Python's replacement text as Java's."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", "\\$"))


def lines_of(docs: DataFrame, profile: str = "scholastic_text") -> DataFrame:
    """``..., line_no, line``: the profile's lines, numbered from 1 behind its header."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile!r}")
    lines = F.split("text", LINE_BREAK)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    if profile == "corpus_corporum":
        head = F.array_position(F.transform(lines, lambda s: F.startswith(stripped(s), F.lit("#####"))), True)
        lines = F.when(head > 0, F.slice(lines, head.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
        lines = F.transform(lines, lambda s: F.translate(s, "\t", " "))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    return docs.select(*rest, F.posexplode(lines).alias("_i", "line")).withColumn("line_no", (F.col("_i") + 1).cast("bigint")).drop("_i")


def apply_rules(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``lines`` with ``kept`` (null where a rule dropped the line) and ``events`` (kind, rule, count, snippet).

    The first matching drop rule wins and looks at the stripped line; substitutions
    run in order, each on what the one before left, and record the line they met.
    """
    drops = [r for r in rules if r.enabled and r.replacement is None]
    swaps = [r for r in rules if r.enabled and r.replacement is not None]
    event = lambda kind, rule, count, text: F.struct(
        F.lit(kind).alias("kind"), rule.alias("rule"), count.cast("bigint").alias("count"), F.substring(text, 1, SNIPPET).alias("snippet")
    )
    rule = F.lit(None).cast("string")
    for r in reversed(drops):
        rule = F.when(stripped(F.col("line")).rlike(f"^(?:{r.pattern})"), r.name).otherwise(rule)
    out = lines.withColumn("_drop", rule).withColumn("kept", F.col("line"))
    events = [F.when(F.col("_drop").isNotNull(), event("drop_line", F.col("_drop"), F.lit(1), F.col("line")))]
    for k, r in enumerate(swaps):
        out = out.withColumn(f"_e{k}", event("substitute", F.lit(r.name), F.regexp_count("kept", F.lit(r.pattern)), F.col("kept")))
        out = out.withColumn("kept", F.regexp_replace("kept", r.pattern, _java(r.replacement)))
        events.append(F.when(F.col("_drop").isNull() & (F.col(f"_e{k}.count") > 0), F.col(f"_e{k}")))
    out = out.withColumn("events", F.array_compact(F.array(*events))).withColumn("kept", F.when(F.col("_drop").isNull(), F.col("kept")))
    return out.drop("_drop", *(f"_e{k}" for k in range(len(swaps))))


def clean_documents(ruled: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys..., text``: kept lines joined; at most one empty line between, single blanks, one line break at the end."""
    rows = ruled.filter("kept IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "kept"))).alias("l"))
    text = F.regexp_replace(F.array_join("l.kept", "\n"), "\\n{3,}", "\n\n")
    return rows.select(*keys, F.concat(stripped(F.regexp_replace(text, " {2,}", " ")), F.lit("\n")).alias("text"))


def clean_events(ruled: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return ruled.select(*keys, "line_no", F.explode("events").alias("e")).select(*keys, "line_no", "e.*")


def replace_lexicon(docs: DataFrame, lexicon: Mapping[str, str]) -> DataFrame:
    """Whole words replaced in one pass, longer entries first."""
    if not lexicon:
        return docs
    words = sorted(lexicon, key=lambda w: (-len(w), w))
    found = re.compile(r"\b(" + "|".join(map(re.escape, words)) + r")\b")
    mapping = dict(lexicon)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found.sub(lambda m: mapping[m[0]], t), na_action="ignore")

    return docs.withColumn("text", run("text"))
