"""Vocabulary counts, dictionary checks, partitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

#: Rows of a lookup side that is broadcast; larger ones are left to the planner.
BROADCAST_ROWS = 1_000_000


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if there are at most ``limit`` rows; the count reads no more than one row beyond."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def number(rows: DataFrame) -> Column:
    """How many tokens ``rows`` stand for: the sum of ``n`` where there is one, else their number."""
    return F.coalesce(F.sum("n"), F.lit(0)) if "n" in rows.columns else F.count("*")


def frequencies(tokens: DataFrame, by: Sequence[str] = ("group",)) -> DataFrame:
    """``by..., item, count`` of the included keys; partial sums are made before the one shuffle."""
    return tokens.filter("included").groupBy(*by, F.col("analysis_key").alias("item")).agg(number(tokens).alias("count"))


def map_lemmas(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts with items replaced through ``mapping(item, lemma)`` and summed again."""
    mapping = mapping.groupBy("item").agg(F.max("lemma").alias("lemma"))
    others = [c for c in counts.columns if c not in ("item", "count")]
    moved = counts.join(sized(mapping), "item", "left").withColumn("item", F.coalesce("lemma", "item"))
    return moved.groupBy(*others, "item").agg(F.sum("count").alias("count"))


def split_by_dictionary(counts: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts whose item is in ``words(item)``, and the others."""
    words = sized(words.select("item").distinct())
    return counts.join(words, "item", "left_semi"), counts.join(words, "item", "left_anti")


def count_and_strip_tags(docs: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """``docs`` with each pattern, in order, replaced by a space in ``text``, and ``tags``, how often each was met.

    A pattern sees the text that the ones before have left.
    """
    out = docs
    names = []
    for k, (name, pattern) in enumerate(patterns):
        out = out.withColumn(f"_n{k}", F.regexp_count("text", F.lit(pattern)).cast("bigint"))
        out = out.withColumn("text", F.regexp_replace("text", pattern, " "))
        names += [F.lit(name), F.coalesce(F.col(f"_n{k}"), F.lit(0))]
    return out.withColumn("tags", F.create_map(*names)).drop(*(f"_n{k}" for k in range(len(patterns))))


def tag_totals(tagged: DataFrame, group: str = "lang") -> DataFrame:
    rows = tagged.select(F.col(group).alias("group"), F.explode("tags").alias("tag", "count"))
    return rows.groupBy("group", "tag").agg(F.sum("count").alias("count"))


def validate_partition(whole: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """``item, whole_count, <part>_count..., parts_sum, delta, status`` over all items of whole and parts.

    One union and one aggregation, whatever the number of parts.
    """
    rows = whole.select("item", F.lit("").alias("_part"), "count")
    for name, part in parts.items():
        rows = rows.unionByName(part.select("item", F.lit(name).alias("_part"), "count"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("_part") == name, F.col("count"))), F.lit(0)).cast("bigint")
    out = rows.groupBy("item").agg(of("").alias("whole_count"), *(of(n).alias(f"{n}_count") for n in parts))
    return _compared(out, parts)


def group_partition(counts: DataFrame, parts: Sequence[str], group: str = "group") -> DataFrame:
    """:func:`validate_partition` of all counts against those of the groups ``parts``, from one pass over ``counts``."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col(group) == name, F.col("count"))), F.lit(0)).cast("bigint")
    return _compared(counts.groupBy("item").agg(F.sum("count").cast("bigint").alias("whole_count"), *(of(n).alias(f"{n}_count") for n in parts)), parts)


def _compared(out: DataFrame, parts: Iterable[str]) -> DataFrame:
    total = sum((F.col(f"{n}_count") for n in parts), F.lit(0)).cast("bigint")
    out = out.withColumn("parts_sum", total).withColumn("delta", F.col("whole_count") - F.col("parts_sum"))
    status = F.when(F.col("delta") == 0, "match").when(F.col("delta") > 0, "missing_from_parts").otherwise("excess_in_parts")
    return out.withColumn("status", status)


def partition_totals(rows: DataFrame) -> DataFrame:
    """One row: totals, types and items by status, and whether all match."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return rows.agg(
        F.coalesce(F.sum("whole_count"), F.lit(0)).alias("whole_tokens"), F.coalesce(F.sum("parts_sum"), F.lit(0)).alias("parts_tokens"),
        F.count(F.when(F.col("whole_count") > 0, 1)).alias("whole_types"), F.count(F.when(F.col("parts_sum") > 0, 1)).alias("parts_types"),
        of("match"), of("missing_from_parts"), of("excess_in_parts"),
        F.coalesce(F.bool_and(F.col("delta") == 0), F.lit(True)).alias("exact"),
    )


def frequent_forms(words: DataFrame, least: int) -> DataFrame:
    return words.groupBy("item").agg(F.count("*").alias("count")).filter(F.col("count") >= least).select("item")


def word_forms(texts: DataFrame, min_length: int = 1, extra: str = "") -> DataFrame:
    """``item``, a row for each word: ASCII and ``extra`` punctuation parts words; only words all of letters."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + extra
    plain = F.translate("text", marks, " " * len(marks))
    word = F.lower(F.col("word"))
    rows = texts.select(F.explode(F.split(plain, "(?U)\\s+")).alias("word")).select(word.alias("item"))
    return rows.filter((F.length("item") >= min_length) & F.col("item").rlike("^\\p{L}+$"))


def build_wordlist(*parts: DataFrame) -> DataFrame:
    """Union of word lists: every item once."""
    out = parts[0].select("item")
    for part in parts[1:]:
        out = out.unionByName(part.select("item"))
    return out.filter(stripped(F.col("item")) != "").distinct()
