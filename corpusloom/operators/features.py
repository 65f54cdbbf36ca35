"""Stylometric features. Long frames ``unit..., feature, value`` are the native form; ``widen`` pivots them.

A fitted vocabulary has a bounded number of rows (top n), so it may reach the
driver and name columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import character_stream
from .annotate import LEXICAL, SENTENCE, TOKEN, tagged, word_counts
from .counts import number
from .tokens import lexical

UPOS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON", "ADP", "AUX", "CCONJ", "SCONJ", "PART", "DET", "NUM")
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
FUNCTION = ("PRON", "ADP", "AUX", "CCONJ", "SCONJ", "PART", "DET")


def widen(long: DataFrame, unit: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per unit, a column per feature; absent features are 0."""
    return long.groupBy(*unit).pivot("feature", list(columns)).agg(F.first("value")).na.fill(0.0)


def basic(tokens: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Counts, types, hapax lemmas, sentence and token lengths per unit.

    Types are counted over rows already reduced to one per unit and word, so no
    distinct aggregate expands the tokens.
    """
    sentences = tokens.groupBy(*dict.fromkeys([*unit, "source_file", "chunk_index", "sentence_index"])).agg(
        F.count("*").alias("raw"), F.count(F.when(F.col("eligible"), 1)).alias("words")
    )
    words = tokens.filter("eligible").groupBy(*unit, "token_value", "lemma_value").agg(F.count("*").alias("n"))
    return _basic(sentences, words, unit)


def text_basic(docs: DataFrame, unit: Sequence[str]) -> DataFrame:
    """:func:`basic` of the tokens of ``docs``: sentences are counted whole, words by form, so no token is shuffled by itself."""
    rows = docs.select(*unit, "doc_id", F.posexplode(F.split("text", SENTENCE)).alias("_i", "_s"))
    size = lambda pattern: F.regexp_count("_s", F.lit(pattern)).cast("bigint")
    rows = rows.filter(F.col("_s").rlike("\\S")).select(*unit, "doc_id", "_i", size(TOKEN).alias("_raw"), size(LEXICAL).alias("_words"))
    sentences = rows.groupBy(*dict.fromkeys([*unit, "doc_id", "_i"])).agg(F.sum("_raw").alias("raw"), F.sum("_words").alias("words"))
    words = lexical(tagged(word_counts(docs, unit).withColumn("token_index", F.lit(0))))  # the tag isn't asked for
    return _basic(sentences, words.groupBy(*unit, "token_value", "lemma_value").agg(F.sum("n").alias("n")).persist(), unit)  # read three times


def _basic(sentences: DataFrame, words: DataFrame, unit: Sequence[str]) -> DataFrame:
    """``sentences(unit..., raw, words)``, a row for each; ``words(unit..., token_value, lemma_value, n)``, one row for each."""
    weight = lambda x, q, name: F.coalesce(F.percentile(x, F.lit(q), F.col("n")), F.lit(0.0)).alias(name)
    quarters = lambda x, name: [weight(x, q, f"{name}_{n}") for q, n in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))]
    kinds = sentences.groupBy(*unit, "words").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"))
    number, whole = F.sum("n"), F.sum(F.col("words") * F.col("n"))
    square = F.sum(F.col("words") * F.col("words") * F.col("n"))
    per_sentence = kinds.groupBy(*unit).agg(
        number.alias("sentence_count"), F.sum("raw").alias("token_count"), whole.alias("word_token_count"), (whole / number).alias("mean_sentence_length"),
        ((square - whole / number * whole) / number).alias("sentence_length_variance"), *quarters("words", "sentence_length"),
    )
    lengths = words.groupBy(*unit, F.length("token_value").cast("double").alias("x")).agg(F.sum("n").alias("n"))
    mean = F.sum(F.col("x") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("x") * F.col("x") * F.col("n")) / F.sum("n")
    per_token = lengths.groupBy(*unit).agg(
        mean.alias("mean_token_length"), (square - mean * mean).alias("token_length_variance"), *quarters("x", "token_length")
    )
    lemmas = words.groupBy(*unit, "lemma_value").agg(F.sum("n").alias("n")).groupBy(*unit).agg(
        F.count("*").alias("lemma_type_count"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax_lemma_count")
    )
    types = words.select(*unit, "token_value").distinct().groupBy(*unit).agg(F.count("*").alias("token_type_count"))
    out = per_sentence.join(per_token, list(unit), "left").join(lemmas, list(unit), "left").join(types, list(unit), "left")
    numbers = [c for c in out.columns if c not in unit]
    out = out.na.fill(0, numbers)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "hapax_lemma_ratio": ratio("hapax_lemma_count", "lemma_type_count"),
            "type_token_ratio": ratio("token_type_count", "word_token_count"),
            "lemma_type_token_ratio": ratio("lemma_type_count", "word_token_count"),
        }
    )


def upos_profile(lexical: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Count and ratio of 13 tags, of content words and of function words."""
    tag = F.coalesce(F.nullif("upos", F.lit("")), F.lit("X"))
    weight = F.col("n") if "n" in lexical.columns else F.lit(1)
    of = lambda cond: F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("bigint")
    total = number(lexical)
    columns: list[Column] = []
    for name, cond in [(f"upos_{t}", tag == t) for t in UPOS] + [("content_word", tag.isin(*CONTENT)), ("function_word", tag.isin(*FUNCTION))]:
        columns += [of(cond).alias(f"{name}_count"), (of(cond) / total).alias(f"{name}_ratio")]
    return lexical.filter("eligible").groupBy(*unit).agg(*columns)


def top_terms(lexical: DataFrame, column: str, top: int, order_value: str = "term") -> DataFrame:
    """``rank, term, count``: the most frequent values over all units, equals by value."""
    counts = lexical.filter("eligible").groupBy(F.col(column).alias("term")).agg(number(lexical).alias("count")).filter("term <> ''")
    best = counts.orderBy(F.desc("count"), F.asc(order_value)).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.asc(order_value))).cast("bigint"))  # top rows only


def term_ratios(lexical: DataFrame, unit: Sequence[str], column: str, terms: Sequence[str]) -> DataFrame:
    """``unit..., feature, value``: share of each term in all eligible tokens of the unit; absent terms are 0."""
    rows = lexical.filter("eligible").select("*", F.when(F.col(column).isin(list(terms)), F.col(column)).alias("term"))  # one row for all the others
    rows = rows.groupBy(*unit, "term").agg(number(lexical).alias("n"))
    some = F.create_map(*[x for t in terms for x in (F.lit(t), F.sum(F.when(F.col("term") == t, F.col("n")).otherwise(0)))])
    return rows.groupBy(*unit).agg(F.sum("n").alias("_total"), some.alias("_m")).select(*unit, "_total", F.explode("_m").alias("feature", "_n")).select(
        *unit, "feature", (F.col("_n") / F.col("_total")).alias("value")
    )


def morphology_vocabulary(lexical: DataFrame) -> DataFrame:
    """``attribute, value, count`` of the feature pairs of eligible tokens."""
    pair = F.explode(F.str_to_map("feats", F.lit("[|]"), F.lit("="))).alias("attribute", "value")
    rows = lexical.filter("eligible AND feats <> ''").groupBy("feats").agg(number(lexical).alias("n")).select(pair, "n")
    return rows.groupBy("attribute", "value").agg(F.sum("n").alias("count"))


def morphology(lexical: DataFrame, unit: Sequence[str], vocabulary: Sequence[tuple[str, str]]) -> DataFrame:
    """Long frame: coverage, value, conditional, other and other-conditional shares of the fitted pairs."""
    rows = lexical.filter("eligible").groupBy(*unit, F.coalesce("feats", F.lit("")).alias("feats")).agg(number(lexical).alias("n"))
    rows = rows.withColumn("_m", F.when(F.col("feats") == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map("feats", F.lit("[|]"), F.lit("="))))
    total = F.sum("n")
    when = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    parts: list[Column] = []
    for attribute in dict.fromkeys(a for a, _ in vocabulary):
        value = F.element_at("_m", F.lit(attribute))
        known = [v for a, v in vocabulary if a == attribute]
        covered, other = when(value.isNotNull()), when(value.isNotNull() & ~value.isin(known))
        parts += [F.lit(f"coverage_{attribute}"), share(covered, total)]
        for v in known:
            parts += [F.lit(f"value_{attribute}_{v}"), share(when(value == v), total), F.lit(f"conditional_{attribute}_{v}"), share(when(value == v), covered)]
        parts += [F.lit(f"other_{attribute}"), share(other, total), F.lit(f"other_conditional_{attribute}"), share(other, covered)]
    return rows.groupBy(*unit).agg(F.create_map(*parts).alias("_f")).select(*unit, F.explode("_f").alias("feature", "value"))


def morphology_bundles(lexical: DataFrame, attributes: Sequence[str], top: int) -> DataFrame:
    """``bundle, count``: the commonest combinations of the attributes' values."""
    kept = F.filter(F.split("feats", "[|]"), lambda p: F.split_part(p, F.lit("="), F.lit(1)).isin(list(attributes)))
    rows = lexical.filter("eligible AND feats <> ''").groupBy("feats").agg(number(lexical).alias("n")).select(F.array_join(kept, "|").alias("bundle"), "n")
    rows = rows.filter("bundle <> ''").groupBy("bundle").agg(F.sum("n").alias("count"))
    return rows.orderBy(F.desc("count"), F.asc("bundle")).limit(top)


def char_grams(docs: DataFrame, unit: Sequence[str], mode: str, n: int) -> DataFrame:
    """``unit..., gram, count, positions`` of the character stream of each document's whole text."""
    stream = docs.select(*unit, character_stream(F.col("text"), mode).alias("s")).filter(F.length("s") >= n)
    grams = stream.select(*unit, F.explode(F.regexp_extract_all("s", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)).alias("gram"))  # in one pass
    counts = grams.groupBy(*unit, "gram").agg(F.count("*").alias("count"))
    return counts.withColumn("positions", F.sum("count").over(Window.partitionBy(*unit)))


def gram_vocabulary(grams: DataFrame, top: int) -> DataFrame:
    return grams.groupBy("gram").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.asc("gram")).limit(top)


# ------------------------------------------------------------------ lexical diversity


def mattr(lexical: DataFrame, unit: Sequence[str], window: int, value: str = "token_value") -> DataFrame:
    """Mean type-token ratio over all windows, from each token's distance to the last one of its type.

    A token is the first of its type in the windows that start behind its
    predecessor and reach it; adding up their number needs no window of its own.
    """
    order = Window.partitionBy(*unit).orderBy("global_token_index")
    rows = lexical.filter("eligible").select(*unit, F.col(value).alias("v"), "global_token_index")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*unit)))
    rows = rows.withColumn("p", F.coalesce(F.lag("i").over(Window.partitionBy(*unit, "v").orderBy("i")), F.lit(-1)))
    w = F.when(F.col("n") <= window, F.col("n")).otherwise(F.lit(window))
    first = F.greatest(F.col("p") + 1, F.col("i") - w + 1, F.lit(0))
    starts = F.greatest(F.least(F.col("i"), F.col("n") - w) - first + 1, F.lit(0))
    return rows.select(*unit, "n", w.alias("w"), starts.alias("s")).groupBy(*unit).agg(
        (F.sum("s") / (F.first("w") * (F.first("n") - F.first("w") + 1))).alias("mattr")
    )


def msttr(lexical: DataFrame, unit: Sequence[str], segment: int, value: str = "token_value") -> DataFrame:
    """Mean type-token ratio over full segments; that of the whole if there is none."""
    rows = lexical.filter("eligible").select(*unit, F.col(value).alias("v"), "global_token_index")
    order = Window.partitionBy(*unit).orderBy("global_token_index")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*unit)))
    size = F.least(F.col("n"), F.lit(segment))
    rows = rows.withColumn("k", F.floor(F.col("i") / size)).withColumn("size", size).filter("(k + 1) * size <= n")
    types = rows.select(*unit, "k", "size", "v").distinct().groupBy(*unit, "k", "size").agg(F.count("*").alias("t"))
    return types.groupBy(*unit).agg(F.avg(F.col("t") / F.col("size")).alias("msttr"))


def mtld_of(values: Sequence[str], threshold: float = 0.72) -> float:
    """Mean length of runs that keep the type-token ratio above the threshold, both ways."""
    n = len(values)
    if not n:
        return 0.0

    def one_way(run) -> float:
        seen: set[str] = set()
        size, factors = 0, 0.0
        for v in run:
            seen.add(v)
            size += 1
            if len(seen) / size <= threshold:
                factors, size = factors + 1.0, 0
                seen.clear()
        if size:
            factors += (1.0 - len(seen) / size) / (1.0 - threshold)
        return n / factors if factors else float(n)

    return (one_way(values) + one_way(reversed(values))) / 2.0


def mtld(lexical: DataFrame, unit: Sequence[str], threshold: float = 0.72, value: str = "token_value") -> DataFrame:
    """One sequence per unit goes to an Arrow function: the measure is sequential within a unit."""

    @F.pandas_udf("double")
    def run(sequences: pd.Series) -> pd.Series:
        return sequences.map(lambda s: mtld_of(list(s), threshold))

    rows = lexical.filter("eligible").groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("global_token_index", F.col(value).alias("v")))).alias("s"))
    return rows.select(*unit, run(F.col("s.v")).alias("mtld"))


def hdd(lexical: DataFrame, unit: Sequence[str], sample: int = 42, value: str = "token_value") -> DataFrame:
    """Expected type-token ratio of a random sample, from the hypergeometric chance that a type is absent."""
    counts = lexical.filter("eligible").groupBy(*unit, F.col(value).alias("v")).agg(number(lexical).alias("f"))
    # types of one frequency have one chance, and a unit has few frequencies
    rows = counts.groupBy(*unit, "f").agg(F.count("*").alias("m")).groupBy(*unit).agg(
        F.sum(F.col("f") * F.col("m")).alias("n"), F.array_sort(F.collect_list(F.struct("f", "m"))).alias("_c")
    )
    rows = rows.withColumn("k", F.least("n", F.lit(sample))).select(*unit, "n", "k", F.explode("_c").alias("_c")).select(*unit, "n", "k", "_c.f", "_c.m")
    absent = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), F.lit(1.0),
        lambda acc, i: acc * (F.col("n") - F.col("f") - i) / (F.col("n") - i),
    )
    absent = F.when(F.col("n") - F.col("f") < F.col("k"), F.lit(0.0)).otherwise(absent)
    share = F.least(F.greatest(1 - absent, F.lit(0.0)), F.lit(1.0))
    return rows.groupBy(*unit).agg(F.least(F.sum(share * F.col("m")) / F.first("k"), F.lit(1.0)).alias("hdd"))
