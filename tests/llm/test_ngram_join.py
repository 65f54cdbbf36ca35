"""The prefix-tree join against brute force, on texts made to tie, repeat and grow long."""

import random

import pytest

from conftest import rows_of
from corpusloom.llm import ngram_join as nj

FORM = "doc_id bigint, text string"


def words(text):
    low = (text or "").lower()
    kept = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low)
    return (kept if kept.strip(" ") else low).split()


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n, t):
    texts = {}
    for i, x in rows:
        if i is not None:
            texts[i] = max(texts.get(i) or "", x or "")
    sets = {i: grams(x, n) for i, x in texts.items()}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= t - 1e-9:
                out[a, b] = pytest.approx(j, abs=1e-6)
    return out


def corpus(seed, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(size):
        kind = rng.random()
        if kind < 0.4 and rows:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w)))
        elif kind < 0.6:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(40))) + " " + passage))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 30, 200])))))
    return rows


EDGES = [
    (100, None), (101, ""), (102, "  \n\t "), (103, "!!! ###"), (104, "!!!  ###"), (105, "one two"), (106, "One, two!"), (107, "one two three"),
    (108, "é è é è É È " * 5000), (109, "É È É È é è " * 5000), (110, "same text here again and more"), (110, "same text here again and more"),
    (111, "same text here again and more"), (112, "aaa"), (112, "zzz bbb"), (None, "same text here again and more"), (113, "zzz bbb"), (-5, "same text here again and more"),
]


@pytest.mark.parametrize("n, t, block", [(3, 0.5, 512), (3, 0.3, 4), (5, 0.8, 512), (1, 0.6, 2)])
def test_against_brute_force(spark, n, t, block):
    rows = corpus(n * 7) + EDGES
    frame, want = spark.createDataFrame(rows, FORM), brute(rows, n, t)
    for hot in (nj.HOT, 3):  # with a sketch that calls many grams hot, and one that calls none so
        got = nj.near_duplicates(frame, n, t, block, hot).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == classes(rows, want) and len(got) == len(classes(rows, want))


def classes(rows, pairs):
    root, links = {i: i for i, _ in rows if i is not None}, {}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: (find(i), links.get(i, 0)) for i in root}


def test_pairs_of_different_sets(spark):
    rows = corpus(5) + EDGES
    want = brute(rows, 3, 0.5)
    sets = {}
    for i, x in sorted(((i, x) for i, x in rows if i is not None), key=lambda r: r[0]):
        sets[i] = max(sets.get(i) or "", x or "")
    rep = {}
    least = {i: rep.setdefault(frozenset(grams(x, 3)), i) for i, x in sorted(sets.items())}
    short = {p: j for p, j in want.items() if all(least[i] == i for i in p) or (least[p[1]] == p[0])}
    got = nj.jaccard_pairs(spark.createDataFrame(rows, FORM), 3, 0.5, 4)
    assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in got.collect()} == short


def test_a_group_of_many_blocks(spark):
    """A chain of texts, each like the next few only, and a cluster in which all are alike."""
    text = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(text[2 * i : 2 * i + 30])) for i in range(150)]
    rows += [(1000 + i, " ".join([*text[350:390], f"x{i}"])) for i in range(90)]
    got = nj.near_duplicates(spark.createDataFrame(rows, FORM), 3, 0.5, block=8).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == classes(rows, brute(rows, 3, 0.5))


def test_buckets_hold_64_bits():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 2**64, 20_000, dtype=np.uint64)
    x = np.concatenate([x, np.array([0, 2**64 - 1], np.uint64)])
    for buckets in (256, 300, 1000, 65536):
        b = nj._bucket_of_gram(x, buckets)
        assert b.max() < buckets
        assert (nj._from_seven(nj._seven(x - nj._first_gram(b, buckets))) + nj._first_gram(b, buckets) == x).all()


def test_turns_part_the_exchange_and_lose_nothing(spark):
    """Each turn writes its part of the grams only, all turns together every gram once, whatever the ids."""
    import numpy as np
    import pyarrow as pa

    ids = [-(2**63), -1, 0, 7, 2**40, 2**63 - 1]
    texts = [" ".join(f"w{i}-{k}" for k in range(3000)) for i in range(len(ids))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    parts = [[b for out in nj._by_gram(4, 256, np.empty(0, np.int64), turn, 4)(iter([batch])) for b in out.to_pylist()] for turn in range(4)]
    found = {}
    for row in sum(parts, []):
        who, size, count, body = nj._unpack(memoryview(row["blob"]))
        gram = nj._from_seven(body) + nj._first_gram(np.array([row["bucket"]]), 256)
        for doc, n, some in zip(who.tolist(), size.tolist(), np.split(gram, np.cumsum(count)[:-1])):
            assert n == len(nj.gram_sets([texts[ids.index(doc)]])[0])
            found.setdefault(doc, []).append(some)
    for doc, text in zip(ids, texts):
        assert (np.sort(np.concatenate(found[doc])) == nj.gram_sets([text])[0]).all()
    written = [sum(len(r["blob"]) for r in part) for part in parts]
    assert max(written) < 0.3 * sum(written)
    rows = corpus(11) + EDGES
    want = {r["doc_id"]: (r["size"], sorted(np.frombuffer(r["grams"], "<u8"))) for r in nj.partner_candidates(spark.createDataFrame(rows, FORM), 3, 0.5, 3, 1).collect()}
    got = {r["doc_id"]: (r["size"], sorted(np.frombuffer(r["grams"], "<u8"))) for r in nj.partner_candidates(spark.createDataFrame(rows, FORM), 3, 0.5, nj.HOT, 5).collect()}
    assert set(want) >= set(got) and got and all(len(got[d][1]) <= len(want[d][1]) for d in got)


def test_many_copies(spark):
    rows = [(i, "the very same words in every one of these texts") for i in range(2000)] + [(5000, "the very same words in every one of these texts and more")]
    got = nj.near_duplicates(spark.createDataFrame(rows, FORM)).collect()
    assert len(got) == 2001 and {(r["class_id"], r["n_links"]) for r in got} == {(0, 2000)}
    assert nj.jaccard_pairs(spark.createDataFrame(rows, FORM)).count() == 2000


def test_groups_keep_the_least_id_and_all_columns(spark):
    rows = corpus(3) + EDGES
    frame = spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id bigint, text string, _gone string, node int")
    kept = nj.keep_one_of_each_group(frame)
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in sorted(brute(rows, nj.N, nj.THRESHOLD)):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted([str(i) for i in {i for i, _ in rows} if i is not None and find(i) == i] + ["None" for i, _ in rows if i is None])
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 999), (5, 5)]
    got = {r["node"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 999: 999, 1000: 999}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, gram string, bucket int")
    assert nj.jaccard_pairs(empty).collect() == [] and nj.keep_one_of_each_group(empty).collect() == [] and nj.near_duplicates(empty).collect() == []
    assert [tuple(r) for r in nj.near_duplicates(spark.createDataFrame([(1, None)], FORM)).collect()] == [(1, 1, 0)]


def test_same_as_sql(spark, small, sql):
    from corpusloom.llm import queries

    name = "op6_ngram_jaccard_join"
    assert rows_of(queries.QUERIES[name](spark, small).toPandas()) == rows_of(sql.execute(queries.ORACLES[name]).df())
