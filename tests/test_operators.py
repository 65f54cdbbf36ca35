import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from corpusloom.operators import annotate, cleaning, counts, keyness, sequences, stylometry
from corpusloom.operators.tokens import with_inclusion
from corpusloom.sources import config, readers, writers


def test_partition(spark):
    frame = lambda **c: spark.createDataFrame(list(c.items()) or [("", 0)], "item string, count bigint").filter("item <> ''")
    rows = counts.validate_partition(frame(a=3, b=2), {"p": frame(a=1, b=2), "q": frame(a=2)})
    assert rows.filter("status <> 'match'").count() == 0
    rows = {r["item"]: (r["delta"], r["status"]) for r in counts.validate_partition(frame(a=3), {"p": frame(a=2, c=1), "q": frame()}).collect()}
    assert rows == {"a": (1, "missing_from_parts"), "c": (-1, "excess_in_parts")}


def test_keyness_symmetry(spark):
    freq = spark.createDataFrame([("A", "item", 20.0), ("A", "other", 80.0), ("B", "item", 20.0), ("B", "other", 180.0)], "label string, item string, count double")
    one = keyness.pair_keyness(freq, "A", "B").filter("item = 'item'").first()
    two = keyness.pair_keyness(freq, "B", "A").filter("item = 'item'").first()
    assert one["log_ratio"] == pytest.approx(-two["log_ratio"]) and one["log_likelihood"] == pytest.approx(two["log_likelihood"])
    assert (one["direction"], two["direction"]) == ("A", "B")
    same = spark.createDataFrame([("A", "x", 10.0), ("A", "y", 90.0), ("B", "x", 20.0), ("B", "y", 180.0)], "label string, item string, count double")
    row = keyness.pair_keyness(same, "A", "B").first()
    assert (row["difference"], row["log_ratio"], row["direction"]) == (0, 0, "equal") and row["log_likelihood"] == pytest.approx(0, abs=1e-9)


def _tokens(spark, words, included=None):
    rows = [("g", "f", None, 0, 0, i, i, w, w, w != "," if included is None else included[i]) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "group string, source_file string, section string, chunk_index bigint, sentence_index bigint, token_index bigint, global_token_index bigint, token string, lemma string, included boolean")


def test_ngrams_pass_over_excluded_and_break_at_invalid(spark):
    rows = sequences.token_ngrams(_tokens(spark, ["Arma", ",", "virumque", ".", "cano", "", "troiae"]), 2)
    assert [tuple(r) for r in rows.collect()] == [("arma virumque", 1)]


def test_concordance(spark):
    rows = sequences.concordance(_tokens(spark, "a b VIR c d".split()), ["vir"], window=1).collect()
    assert [(r["left"], r["match"], r["right"]) for r in rows] == [("b", "VIR", "c")]


@pytest.mark.parametrize("n, want", [(0, []), (3, [(0, 3, "partial")]), (10, [(0, 5, "full"), (3, 8, "full"), (6, 10, "partial")])])
def test_windows(spark, n, want):
    rows = sequences.sample_windows(spark.createDataFrame([("u", n)], "u string, n bigint"), 5, 3).orderBy("sample_index").collect()
    assert [(r["start_token"], r["end_token"], r["kind"]) for r in rows] == want


def test_inclusion_order(spark):
    rows = spark.createDataFrame([("a", " ", "NOUN"), ("a", "b", "VERB"), ("a", "b", "NOUN"), ("xiv", None, "NOUN"), ("word", "word", "NOUN")], "token string, lemma string, upos string")
    out = with_inclusion(rows, min_length=2, drop_roman=True).select("exclusion_reason").collect()
    assert [r[0] for r in out] == ["missing_key", "upos_not_targeted", "too_short", "roman_numeral", None]


def test_delta_and_zero_variance(spark):
    values = {"A": (1, 10, 4), "B": (2, 20, 4), "C": (3, 10, 4)}
    rows = spark.createDataFrame([(k, f"f{i}", float(x)) for k, v in values.items() for i, x in enumerate(v)], "id string, feature string, value double")
    model = stylometry.fit_zscores(rows)
    assert {r["feature"] for r in model.filter("retained").collect()} == {"f0", "f1"}
    z = stylometry.zscores(rows, model)
    got = {(r["id_a"], r["id_b"]): r["score"] for r in stylometry.distances(z, z, directed=False).collect()}
    assert got == {("A", "B"): pytest.approx((1 + 3**0.5) / 2), ("A", "C"): pytest.approx(1), ("B", "C"): pytest.approx((1 + 3**0.5) / 2)}


def _profiles(spark, works):
    return spark.createDataFrame([(w, a, "f", float(v)) for w, a, v in works], "work string, author string, feature string, value double")


def test_lowo(spark):
    folds = stylometry.leave_one_work_out(_profiles(spark, [("A1", "A", 0), ("A2", "A", 1), ("B1", "B", 9), ("B2", "B", 11)]))
    total = stylometry.lowo_summary(folds).filter("author IS NULL").first()
    assert (total["works"], total["correct"], total["macro_accuracy"]) == (4, 4, 1.0)
    with pytest.raises(ValueError):
        stylometry.leave_one_work_out(_profiles(spark, [("A1", "A", 0), ("B1", "B", 9), ("B2", "B", 11)]))


def test_verify_does_not_learn_from_the_query(spark):
    works = [("c1", "C", 0), ("c2", "C", 1), ("c3", "C", 2), ("b1", "B", 8), ("b2", "B", 10)]
    near, far = (stylometry.verify(_profiles(spark, [*works, ("q", "?", q)]), "q", "C").first() for q in (1, 100))
    assert near["accept_below"] == far["accept_below"] and (near["decision"], far["decision"]) == ("accept", "reject")


def test_cleaning(spark):
    docs = spark.createDataFrame([(1, "head\n##### x\nkeep  12\n\nDROP me\nthe\tend\n")], "doc_id bigint, text string")
    rules = [cleaning.Rule("drop", "DROP"), cleaning.Rule("digits", "([0-9])", "<\\1>"), cleaning.Rule("off", ".*", "", enabled=False)]
    ruled = cleaning.apply_rules(cleaning.lines_of(docs, "corpus_corporum"), rules)
    assert cleaning.clean_documents(ruled).first()["text"] == "keep <1><2>\n\nthe end\n"
    events = [(r["line_no"], r["kind"], r["rule"], r["count"], r["snippet"]) for r in cleaning.clean_events(ruled).orderBy("line_no").collect()]
    assert events == [(1, "substitute", "digits", 2, "keep  12"), (3, "drop_line", "drop", 1, "DROP me")]
    assert cleaning.replace_lexicon(docs, {"keep": "K", "head": "H"}).first()["text"].startswith("H\n##### x\nK")


def test_annotate_with(spark):
    docs = spark.createDataFrame([(7, "rosa amat\nvilla")], "doc_id bigint, text string")
    make = lambda: lambda part: [[{"token": w, "lemma": w.lower(), "start": part.find(w), "end": part.find(w) + len(w)} for w in line.split()] for line in part.split("\n")]
    rows = annotate.annotate_with(docs, make, 10).orderBy("place").collect()
    assert [(r["token"], r["chunk_index"], r["char_start_in_text"]) for r in rows] == [("rosa", 0, 0), ("amat", 0, 5), ("villa", 1, 10)]


def test_readers_and_writers(spark, tmp_path):
    counted = spark.createDataFrame([("a", 1), ("c", 3), ("b", 3)], "item string, count bigint")
    writers.write_frequencies(counted, str(tmp_path / "f"))
    assert rows_of(readers.frequency_csv(spark, str(tmp_path / "f"), "x").drop("label").toPandas()) == [("1.000000", "a"), ("3.000000", "b"), ("3.000000", "c")]
    (tmp_path / "bad.csv").write_text("term,freq\na,1\nb,nan\n")
    with pytest.raises(Exception, match="not a count"):
        readers.frequency_csv(spark, str(tmp_path / "bad.csv"), "x").collect()
    docs = spark.createDataFrame([(1, "Rosa amat.", "la")], "doc_id bigint, text string, lang string")
    found = with_inclusion(annotate.annotate(docs))
    writers.write_tokens(found, str(tmp_path / "t"))
    back = readers.token_tsv(spark, str(tmp_path / "t"))
    assert back.columns == readers.TOKEN_COLUMNS and back.filter("included").count() == found.filter("included").count()
    (tmp_path / "x.conllu").write_text("# c\n1\tRosam\trosa\tNOUN\n2\t.\t.\tPUNCT\nbad\n")
    assert [tuple(r) for r in readers.conllu(spark, str(tmp_path / "x.conllu")).filter("form IS NOT NULL").collect()] == [("rosam", "rosa")]
    (tmp_path / "tags").write_text("metaphys\tmetaphys\\.\nphysic: physic\\.\ncap\\.\n")
    patterns = readers.tag_patterns(tmp_path / "tags")
    tagged = counts.count_and_strip_tags(spark.createDataFrame([("Rosa metaphys. et physic. cap.",)], ["text"]), patterns)
    assert tagged.first()["tags"] == {"metaphys": 1, "physic": 1, "pattern_3": 1}
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    files = readers.text_files(spark, {"g": [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]})
    assert readers.joined_text(files).first()["text"] == "x\ny"
    shown = writers.trace(found, max_rows=0).collect()
    assert shown[-1]["token"] == "TRACE_TRUNCATED"
    writers.write_json(tmp_path / "m.json", {"a": 1})
    with pytest.raises(ValueError):
        writers.write_json(tmp_path / "m.json", {"a": float("nan")})


def test_config():
    good = config.count_config(config.load("groups: {a: [x.txt]}\nunit: surface"))
    assert good.unit == "surface"
    for bad in ("groups: {a: [x]}\ngroups: {b: [y]}", "- a", "groups: {a: [x]}\nmin_length: .inf", "groups: {a: [x]}\nother: 1"):
        with pytest.raises(config.ConfigError):
            config.count_config(config.load(bad))


def test_stream(spark, tmp_path):
    from corpusloom.streaming.documents import streamed_frequencies

    docs = spark.createDataFrame([(1, "rosa rosa villa", "la"), (2, "rosa", "la")], "doc_id bigint, text string, lang string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streamed_frequencies(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), upos_targets=())
    q = stream.writeStream.outputMode("complete").format("memory").queryName("words").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert {(r["item"], r["count"]) for r in spark.table("words").collect()} == {("rosa", 3), ("villa", 1)}
    finally:
        q.stop()


def test_wordlist(spark):
    texts = spark.createDataFrame([("Rosa, rosa; x1 AD",)], ["text"])
    assert sorted(r[0] for r in counts.word_forms(texts, 2).collect()) == ["ad", "rosa", "rosa"]
    assert [r[0] for r in counts.frequent_forms(counts.word_forms(texts), 2).collect()] == ["rosa"]
    assert counts.split_by_dictionary(texts.select(F.lit("a").alias("item"), F.lit(1).alias("count")), texts.select(F.lit("a").alias("item")))[1].count() == 0
