"""Nearest neighbours and packing against brute force."""

import numpy as np

from corpusloom.llm import ann_tree, packing


def brute(ids, x, k):
    far = np.sqrt(((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2))
    return {i: [ids[j] for j in np.lexsort((ids, far[r])) if j != r][:k] for r, i in enumerate(ids)}


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<float>, leaf string")


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbor_id"]
    return {i: [n[k] for k in sorted(n)] for i, n in out.items()}


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + 0.1 * rng.normal(size=(700, 8)), rng.normal(size=(300, 8))]).astype(np.float32)
    ids = rng.permutation(1000) * 3
    got, want = found(ann_tree.neighbours(frame(spark, ids, x), 5, leaf=60, sample=200)), brute(ids, x, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_all_leaves_are_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, size=(300, 3)).astype(np.float32)  # 27 distinct points
    ids = np.arange(300)
    assert found(ann_tree.neighbours(frame(spark, ids, x), 12, leaf=20, recall=1.1)) == brute(ids, x, 12)


def test_queries_are_a_part_and_the_index_is_all(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "_PART", 40)  # queries of a leaf of equal vectors are spread
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((400, 4)), rng.integers(0, 4, size=(200, 4))]).astype(np.float32)
    ids = rng.permutation(600)
    want = {i: n for i, n in brute(ids, x, 7).items() if i % 50 == 0}
    assert found(ann_tree.neighbours(frame(spark, ids, x), 7, every=50, leaf=20, recall=1.1)) == want


def test_odd_rows(spark):
    x = np.eye(3, dtype=np.float32)
    extra = [(None, [1.0, 1.0, 1.0], "x"), (7, None, "x"), (8, [1.0], "x"), (9, [1.0, float("nan"), 0.0], "x"), (10, [1.0, None, 0.0], "x"), (0, [1.0, 0.0, 0.0], "x"), (11, [], "x")]
    got = found(ann_tree.neighbours(frame(spark, range(3), x, extra), 5))
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert found(ann_tree.neighbours(frame(spark, [], []), 5)) == {}
    assert found(ann_tree.neighbours(frame(spark, [4], [[1.0, 2.0]]), 5)) == {}


def texts_of(windows, size):
    """Each document's parts, in order, of windows that must be full but for the last."""
    parts, sizes = {}, {}
    for w in windows:
        assert w["n_words"] == sum(e - s for s, e in zip(w["starts"], w["ends"])) and len(w["texts"]) == len(w["doc_ids"])
        sizes[w["window"]] = w["n_words"]
        for d, s, e, t in zip(w["doc_ids"], w["starts"], w["ends"], w["texts"]):
            assert len(t.split()) == e - s
            parts.setdefault(d, []).append((s, e, t))
    assert sorted(sizes) == list(range(len(sizes))) and all(n == size for k, n in sizes.items() if k + 1 < len(sizes))
    for found in parts.values():
        found.sort()
        assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    return {d: "".join(t for _, _, t in found) for d, found in parts.items()}


def test_windows_hold_every_word_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n "), (None, "a b"), (9004, "w " * 30_000), (9005, "!!!"), (0, None)], "doc_id bigint, text string")
    docs = docs.unionByName(docs.limit(3)).unionByName(odd, allowMissingColumns=True).withColumn("window", docs["doc_id"])
    want = {r["doc_id"]: r["text"] for r in docs.orderBy("text").collect() if r["doc_id"] is not None and (r["text"] or "").split()}
    assert texts_of(packing.pack_related(docs, window=500).collect(), 500) == want


def brute_near(vectors, k):
    out = {}
    for n, a in vectors.items():
        sums = {m: sum(a[w] * b[w] for w in a.keys() & b.keys()) for m, b in vectors.items() if m != n and a.keys() & b.keys()}
        out[n] = sorted((-round(s, 6), m) for m, s in sums.items())[:k]
    return {n: found for n, found in out.items() if found}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"t{w}" for w in rng.zipf(1.3, 40) if w < 3000)) for i in range(300)]
    docs += [(300 + i, docs[i][1] + " more") for i in range(40)] + [(400, ""), (401, "alone"), (402, docs[0][1])]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    frame, held = packing.document_vectors(rows, 12)
    vectors = {r["node"]: dict(zip(np.frombuffer(r["words"], "<u8").tolist(), np.frombuffer(r["weights"], "<f4").astype(float))) for r in frame.collect()}
    seen = {}
    for _, text in docs:
        for w in set(text.split()):
            seen[w] = seen.get(w, 0) + 1
    assert held.sum() == sum(seen.values())
    want = brute_near(vectors, 4)
    got = {r["node"]: r["near"] for r in packing.neighbours(frame, held, 4).collect()}
    assert set(got) == set(want)
    cosine = lambda a, b: sum(vectors[a][w] * vectors[b].get(w, 0) for w in vectors[a])
    for n, found in want.items():  # of equals any may be taken: sums are rounded behind another order of adding
        assert [round(cosine(n, m), 5) for m in got[n]] == [round(-s, 5) for s, _ in found] or np.allclose([cosine(n, m) for m in got[n]], [-s for s, _ in found], atol=2e-6)


def test_long_postings_lose_nothing():
    """All pairs of a word's vectors meet, once, whether its blocks are one or many."""
    word = np.repeat(np.array([5, 9], np.uint64), [300, 30])
    node = np.concatenate([np.arange(300), np.arange(30)])
    for block in (1000, 64):
        row, key, side = packing.dealt(word, node, np.repeat([300, 30], [300, 30]), block)
        a, b, _ = packing.pairs_of(key, side, node[row], np.ones(len(row), np.float32))
        met = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
        assert met == sorted([(x, y) for n in (300, 30) for y in range(n) for x in range(y)])


def test_neighbours_through_common_words(spark):
    """Texts of words that all hold have their true neighbours too."""
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"t{w}" for w in range(6) for _ in range(rng.integers(1, 30)))) for i in range(150)] + [(200 + i, f"x{i}") for i in range(40)]
    frame, held = packing.document_vectors(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    vectors = {r["node"]: dict(zip(np.frombuffer(r["words"], "<u8").tolist(), np.frombuffer(r["weights"], "<f4").astype(float))) for r in frame.collect()}
    want = brute_near(vectors, 4)
    assert len(want) > packing.POSTING
    cosine = lambda a, b: sum(vectors[a][w] * vectors[b].get(w, 0) for w in vectors[a])
    for block in (packing.BLOCK, 20):
        got = {r["node"]: r["near"] for r in packing.neighbours(frame, held, 4, block).collect()}
        assert set(got) == set(want)
        for n, found in want.items():
            assert np.allclose([cosine(n, m) for m in got[n]], [-s for s, _ in found], atol=2e-6)


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    return sum(s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())))


def test_what_is_sent_grows_as_the_vectors_do(spark):
    """Vectors that all share a word don't send each pair of them; their neighbours are the true ones."""
    rng = np.random.default_rng(4)
    vectors, sent = {}, []
    for n in (500, 2000):
        held = np.zeros(packing.SLOTS, np.int64)
        rows = []
        for i in range(n):
            words = np.unique(np.concatenate([[7 << 44], (rng.integers(10, 10 + n // 20, 3) << 44)])).astype("<u8")
            weights = rng.uniform(0.1, 1, len(words))
            weights = (weights / np.sqrt((weights**2).sum())).astype("<f4")
            held[(words >> np.uint64(44)).astype(int)] += 1
            rows.append((i, words.tobytes(), weights.tobytes()))
        frame = spark.createDataFrame(rows, "node bigint, words binary, weights binary").repartition(2)
        before = shuffled(spark)
        got = {r["node"]: r["near"] for r in packing.neighbours(frame, held, 4).collect()}
        sent.append(shuffled(spark) - before)
        vectors = {i: dict(zip(np.frombuffer(w, "<u8").tolist(), np.frombuffer(v, "<f4").astype(float))) for i, w, v in rows}
        if n == 500:
            want = brute_near(vectors, 4)
            cosine = lambda a, b: sum(vectors[a][w] * vectors[b].get(w, 0) for w in vectors[a])
            assert set(got) == set(want)
            assert all(np.allclose([cosine(i, m) for m in got[i]], [-s for s, _ in found], atol=2e-6) for i, found in want.items())
    assert sent[1] < 6 * sent[0], sent


def test_lines_lose_no_edge_at_a_border(spark):
    """A chain, cut into small cells, is one line again; what hangs together is walked through whatever the cells."""
    chain = [(i, [j for j in (i + 1, i - 1) if 0 <= j < 120]) for i in range(120)]
    near = spark.createDataFrame(chain, "node bigint, near array<bigint>")
    for cell in (1000, 7):
        got = {r["node"]: (r["line"], r["place"]) for r in packing.lines_of(near, cell).collect()}
        assert set(got) == set(range(120)) and len({line for line, _ in got.values()}) == 1
        order = [n for n, _ in sorted(got.items(), key=lambda x: x[1][1])]
        assert order in (list(range(120)), list(range(119, -1, -1))) and sorted(p for _, p in got.values()) == list(range(120))


def test_lines_of_a_tangle(spark):
    rng = np.random.default_rng(6)
    near = {n: rng.permutation(200)[:4].tolist() for n in range(200)}
    rows = [(n, [m for m in found if m != n]) for n, found in near.items()]
    got = [tuple(r) for r in packing.lines_of(spark.createDataFrame(rows, "node bigint, near array<bigint>"), 20).collect()]
    lines = {}
    for node, line, place in got:
        lines.setdefault(line, {})[place] = node
    assert sorted(n for n, _, _ in got) == list(range(200)) and all(sorted(x) == list(range(len(x))) for x in lines.values())
    edges = {frozenset((a, b)) for a, found in rows for b in found}
    for x in lines.values():
        assert all(frozenset((x[i], x[i + 1])) in edges for i in range(len(x) - 1))
    ends = [{x[0], x[len(x) - 1]} for x in lines.values()]
    assert not any(frozenset((a, b)) in edges for i, x in enumerate(ends) for y in ends[:i] for a in x for b in y)


def test_nothing_packs_to_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * 7 + k) % 50}" for k in range(20))) for i in range(90)], "doc_id bigint, text string")
    assert texts_of(packing.pack_related(docs, window=100, cell=30).collect(), 100).keys() == set(range(90))
    assert packing.pack_related(docs.limit(0)).collect() == []
    assert [w["doc_ids"] for w in packing.pack_related(docs.limit(1)).collect()] == [[0]]


def test_walk_starts_low_and_goes_to_the_nearest():
    ids = np.array([10, 11, 12, 13])
    near = [np.array([11]), np.array([12, 10]), np.array([11, 13]), np.array([12])]
    assert packing.walk(ids, near) == [[0, 1, 2, 3]]
    assert packing.walk(ids, [np.array([99])] * 4) == [[0], [1], [2], [3]]


def test_chains_leave_at_the_other_end():
    H, T, B = packing.HEAD, packing.TAIL, packing.BOTH
    assert packing.chain([False] * 3, [(0, T, 1, T, 0), (1, H, 2, H, 0)]) == [[(0, False), (1, True), (2, False)]]
    assert packing.chain([False] * 3, [(0, T, 1, T, 0), (1, T, 2, H, 0)]) == [[(0, False), (1, True)], [(2, False)]]
    assert packing.chain([True, False], [(1, H, 0, B, 0)]) == [[(0, False), (1, False)]]


def test_joined_lines_leave_no_edge_between_ends():
    H, T, B = packing.HEAD, packing.TAIL, packing.BOTH
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        single = rng.integers(0, 2, n).astype(bool).tolist()
        side = lambda i: B if single[i] else int(rng.integers(0, 2))
        pairs = [rng.permutation(n)[:2].tolist() for _ in range(int(rng.integers(1, 20)))]
        edges = [(a, side(a), b, side(b), int(rng.integers(0, 6))) for a, b in pairs]
        lines = packing.joined(single, edges)
        assert sorted(p for line in lines for p, _ in line) == list(range(n))
        meet = {x for a, p, b, q, _ in edges for x in ((a, p, b, q), (b, q, a, p))}
        out = lambda p, back: B if single[p] else H if back else T
        for line in lines:
            assert all((p, out(p, x), q, out(q, not y)) in meet for (p, x), (q, y) in zip(line, line[1:]))
        ends = [((line[0][0], out(line[0][0], not line[0][1])), (line[-1][0], out(*line[-1]))) for line in lines]
        assert not any((*x, *y) in meet for i, one in enumerate(ends) for other in ends[:i] for x in one for y in other)


def test_spans_and_parts_of_a_text():
    assert packing.spans(5, 7, 4) == [(1, 1, 0, 3), (2, 0, 3, 7)]
    text = "  one two\n\nthree four "
    parts = packing.cut_text(text, [(0, 1), (1, 3), (3, 4)])
    assert parts == ["  one ", "two\n\nthree ", "four "] and "".join(parts) == text
