import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import annotate, features, stability


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, options, want",
    [
        ("Væ  (jam)", dict(ligatures=True, u_for_v=True, i_for_j=True), "Uae ( iam ) "),
        ("Rōsa", dict(unaccent=True), "Rosa"),
        ("Straße", dict(fold=True), "strasse"),
        ("a  «b»", dict(enabled=False), "a  «b»"),
        ("ﬁ", dict(form="NFKC"), "fi"),
    ],
)
def test_normalize(spark, given, options, want):
    assert value(spark, text.normalize_text(F.col("t"), **options), t=given) == want


@pytest.mark.parametrize(
    "mode, want",
    [("full", "rōsa, amat—x1! æst"), ("no_punctuation", "rōsa amat x1 æst"), ("letters_spaces", "rōsa amat x æst"), ("letters_only", "rōsaamatxæst")],
)
def test_character_stream(spark, mode, want):
    assert value(spark, text.character_stream(F.col("t"), mode), t="  Rōsa,\nAMAT—X1! æst  ") == want


@pytest.mark.parametrize("word, surface, want", [("XIV", False, True), ("mix", False, True), ("vi", False, True), ("vi", True, False), ("amo", False, False), (" iiii ", False, False)])
def test_roman(spark, word, surface, want):
    assert value(spark, text.roman(F.col("t"), surface=surface), t=word) is want


def test_names():
    assert text.encode_gram("a é") == "a_sp__u0000e9_"
    assert text.encode_feature("Masc,Neut") == "Masc_u0002c_Neut" and text.encode_feature("a_b") == "a_u0005f_b"
    assert text.unique_labels(["A b", "a-b", "", "a b"]) == ["a_b", "a_b_2", "file", "a_b_3"]
    assert text.safe_names(["é", "è"], "mfw_") == {"é": "mfw_empty", "è": "mfw__u0000e8_"}
    assert text.encode_feats([("Number", "Sing"), ("Case", "Nom")]) == "Case=Nom|Number=Sing"
    with pytest.raises(ValueError):
        text.encode_feats([("Case", "Nom"), ("Case", "Acc")])


def test_chunks():
    assert [p for _, p in annotate.chunks("abcdefghij", 4)] == ["abcd", "efgh", "ij"]
    assert annotate.chunks("ab cd ef", 4) == [(0, "ab"), (2, " cd"), (5, " ef")]


@pytest.mark.parametrize("values, want", [("", 0), ("a", 1), ("abcd", 4)])
def test_mtld(values, want):
    assert features.mtld_of(list(values)) == want == features.mtld_of(list(values)[::-1])


def _lexical(spark, words):
    rows = [(1, i, w, w, True) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "u int, global_token_index bigint, token_value string, lemma_value string, eligible boolean")


@pytest.mark.parametrize("values, w, want", [("a", 2, 1), ("aa", 2, 0.5), ("aab", 2, 0.75), ("aaaa", 2, 0.5), ("abcd", 2, 1), ("abac", 3, 5 / 6)])
def test_mattr(spark, values, w, want):
    assert features.mattr(_lexical(spark, values), ["u"], w).first()["mattr"] == pytest.approx(want)


@pytest.mark.parametrize("values, s, want", [("a", 2, 1), ("aa", 2, 0.5), ("aabcc", 2, 0.75), ("abcda", 2, 1)])
def test_msttr(spark, values, s, want):
    assert features.msttr(_lexical(spark, values), ["u"], s).first()["msttr"] == pytest.approx(want)


@pytest.mark.parametrize("values, k, want", [("aaaa", 4, 0.25), ("aabb", 2, 5 / 6), ("abc", 42, 1)])
def test_hdd(spark, values, k, want):
    assert features.hdd(_lexical(spark, values), ["u"], k).first()["hdd"] == pytest.approx(want)


def test_quantile():
    assert stability.linear_quantile([1, 2, 3, 4], 0.5) == 2.5 and stability.linear_quantile([0, 10], 0.05) == 0.5
