"""The stages one by one, and the run as a whole."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    whole = corpus_pipeline.run(spark, small)
    key = lambda r: (r["window"], tuple(r["doc_ids"]), tuple(r["starts"]), tuple(r["texts"]))
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


def test_rules_reject_what_the_classifier_keeps(spark):
    """Each stage on its own input, the whole of a middle-sized table."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, two = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    kept = one(spark, docs, folder)
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    before, after = ({r["doc_id"] for r in d.collect()} for d in (kept, two(spark, kept, folder)))
    assert len(after) < len(before)
    assert len(after & good) >= 0.99 * len(before & good)


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame([], docs.schema)
    assert docs.count() == 0


PROSE = "the old house on the hill was quiet that evening and nobody came to the door when she knocked a second time "
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, PROSE * 3), (None, PROSE * 3), (None, None), (4, PROSE * 3), (4, PROSE * 3), (4, "aaa"),
    (5, PROSE * 3), (6, "a long tale of many words " * 60_000), (7, "unlike all others, this one stands alone in what it says"),
]


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, small, stage):
    """Nulls in any column, empty, blank, repeated, tied and very long texts, and columns whose names clash."""
    rows = [(i, t, None, None, None, "x", k, None) for k, (i, t) in enumerate(ODD)]
    form = "doc_id bigint, text string, lang string, source string, n_chars bigint, _gone string, node int, spans string"
    docs = spark.createDataFrame(rows, form)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, small)
    got = out.collect()
    if stage < 4:
        assert out.columns == docs.columns
    if stage < 2:
        assert {r["text"] for r in got} <= {t for _, t in ODD if t and t.strip()}
        for text in {t for _, t in ODD}:  # equal texts share their fate
            assert sum(r["text"] == text for r in got) in (0, sum(t == text for _, t in ODD))
    elif stage == 2:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [1, 2, 3, None, None, None, 4, 6, 7]))
        assert [r["text"] for r in got if r["doc_id"] == 4] == [PROSE * 3]
    elif stage == 3:
        assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(x) for x in ODD)
    else:
        assert {d for r in got for d in r["doc_ids"]} == {4, 5, 6, 7}
        assert sum(r["n_words"] for r in got) == 2 * len(PROSE.split()) * 3 + 360_000 + 11


def test_quality_rules_reject_bad_documents_among_clean_ones(spark, tmp_path):
    """The ratio is taken against the raw documents, not against what the classifier has cleaned already."""
    junk = "click here "
    good = [(i, f"prose of number {i % 7} goes on and says what it means to say in its own words " * 4 + junk * 3, "x") for i in range(40)]
    bad = [(100 + i, junk * 50, "x") for i in range(200)]
    form = "doc_id bigint, text string, lang string"
    spark.createDataFrame(good + bad, form).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _, _ in good], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    planted = [(150, junk * 5, "x")]
    kept = dict(corpus_pipeline.STAGES)["quality_rules"](spark, spark.createDataFrame(good + planted, form), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _ in good]
