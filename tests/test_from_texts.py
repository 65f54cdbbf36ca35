"""Operators that work on whole texts say the same as those on token records, also for odd letters."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from corpusloom.functions.text import casefold
from corpusloom.operators import annotate, counts, features, sequences
from corpusloom.operators.tokens import lexical, with_inclusion
from corpusloom.plans import queries

ODD = "a b e s A E S İ ı ß ſ Σ ς σ K Å ̀ ́ é É . ! ? \n \t \x0b \r     ' \" - , _ i I v V x X m d 1 2 ² ½ Ⅳ ⅳ 漢 ﬁ ŉ 😀 𐐀".split(" ") + [" "] * 12
WORDS = "of in De à auf fÜr the The que di VI xiv mm iix cats Running ment class".split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(WORDS) + rng.choice(" .-") if rng.random() < 0.3 else rng.choice(ODD) for _ in range(rng.choice((0, 1, 5, 400))))
    rows = [(i, text(), "ab"[i % 2], "w" + str(i % 3)) for i in range(60)] + [(60, None, "a", "w1"), (61, ". .\n", "a", "w1"), (62, "́", "b", "w2"), (63, "x" + "\n" * 50_000, "b", "w2")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, work string").repartition(3).persist()


def same(got, want):
    got, want = rows_of(got.toPandas()), rows_of(want.toPandas())
    assert got == want and got


def test_counts_are_those_of_the_records(odd):
    keys = ["group", "work", "token", "lemma", "upos", "feats"]
    same(annotate.annotate_counts(odd, ["work"]).groupBy(*keys).agg(F.sum("n").alias("n")), annotate.annotate(odd).groupBy(*keys).agg(F.count("*").alias("n")))


def test_places_in_the_document(odd):
    rows = annotate.annotate(odd, with_tokens=True, with_sentence=True).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["global_token_index"]):
        assert r["global_token_index"] == (r["doc_id"] << 32) + seen.get(r["doc_id"], 0)
        assert r["sentence_tokens"][r["token_index"]] == r["token"] and r["token"] in r["sentence"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1


def test_lexical_words(odd):
    want = lexical(annotate.annotate(odd)).filter("eligible").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    same(annotate.word_counts(odd, ["doc_id"]), want)


@pytest.mark.parametrize("n", (1, 2, 3))
def test_ngrams(odd, n):
    tokens = annotate.annotate(odd)
    same(sequences.text_ngrams(odd, sequences.token_stream(F.col("text")), n, by_group=True), sequences.token_ngrams(tokens.withColumn("included", F.lit(True)), n, by_group=True))
    skip = tokens.withColumn("included", F.col("upos") != "ADP")
    same(sequences.text_ngrams(odd, sequences.token_stream(F.col("text"), annotate.CLOSED["ADP"]), n), sequences.token_ngrams(skip, n))
    same(sequences.text_ngrams(odd, sequences.config_stream(F.col("text")), n), sequences.token_ngrams(annotate.config_tokens(odd), n))


def test_concordance(odd):
    rows = annotate.annotate(odd, with_tokens=True).withColumn("included", F.col("upos") != "NUM")
    same(sequences.concordance(rows, ["the", "Que", "s", "straße"], window=2), sequences.concordance(rows.drop("sentence_tokens"), ["the", "Que", "s", "straße"], window=2))


@pytest.mark.parametrize("n", (1, 2, 3))
def test_tag_ngrams(odd, n):
    same(sequences.text_upos_ngrams(odd, ["work"], n), sequences.upos_ngrams(lexical(annotate.annotate(odd)), ["work"], n))


def test_basic(odd):
    same(features.text_basic(odd, ["work"]), features.basic(lexical(annotate.annotate(odd)), ["work"]))


@pytest.mark.parametrize("size, step", ((5, 3), (500, 200), (4, 9), (7, 7)))
def test_window_types(odd, size, step):
    rows = lexical(annotate.annotate(odd)).select("work", "eligible", "token_value", "global_token_index")
    units = rows.filter("eligible").groupBy("work").agg(F.count("*").alias("n"))
    members = sequences.window_members(sequences.sample_windows(units, size, step), sequences.lexical_ordinals(rows, ["work"]), ["work"], size, step)
    same(sequences.window_types(odd, ["work"], size, step), members.groupBy("work", "sample_index").agg(F.count("*").alias("tokens"), F.count_distinct("token_value").alias("types")))


def test_casefold_of_all_letters(spark):
    rows = spark.createDataFrame([(chr(c) + "A" + chr(c),) for c in (*range(0xD800), *range(0xE000, 0x30000))], "s string")
    assert [r for r in rows.select("s", casefold(F.col("s")).alias("f")).collect() if r["s"].casefold() != r["f"]] == []


def test_partition_of_groups(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("q", "a", 2), ("q", "b", 4), ("r", "c", 5), (None, "c", 1)], "label string, item string, count bigint")
    whole = rows.groupBy("item").agg(F.sum("count").alias("count"))
    same(counts.group_partition(rows, ("p", "q"), "label"), counts.validate_partition(whole, {x: rows.filter(F.col("label") == x) for x in "pq"}))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tags_are_made_of_sums(odd):
    """Neither a filter on tags nor a join of lemmas is moved below the sums, where it would tag every token."""
    found = counts.frequencies(with_inclusion(annotate.annotate_counts(odd)))
    assert "EndsWith" not in plan(found)[plan(found).index("partial_count") :]
    known = counts.split_by_dictionary(found, odd.sparkSession.createDataFrame([("a",)], ["item"]))[0]
    assert "Join" not in plan(known)[plan(known).index("partial_count") :]


@pytest.mark.parametrize("name", ("token_bigrams", "trigrams_by_group_top", "config_ngrams", "upos_ngram_vocab", "features_upos_ngrams", "features_basic", "concordance"))
def test_no_list_of_tokens_is_shuffled(name, spark, small):
    assert "collect_list" not in plan(queries.QUERIES[name](spark, small)) and "Python" not in plan(queries.QUERIES[name](spark, small)).replace("ArrowEvalPython [_sums_before", "")
