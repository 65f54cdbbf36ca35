"""N-gram Jaccard join: documents whose n-gram sets are alike, by prefix trees.

Only n-grams that several documents hold can add to an overlap, so those are found
first: whole sets go out packed by n-gram, what is shared comes back packed by
document. A document whose shared part is too small for the threshold can have no
partner and drops out. The rest are linked where the rare ends of their sets meet;
each linked group then is stored in tries, in an order common to its sets, and each
is walked once for all its members: members on a common path share the overlap
counted so far, and a subtree is left when the lengths that remain can't reach the
threshold. Every step is exact for 64-bit hashes of the n-grams.

No task gets an unbounded group. N-grams that very many documents hold are counted
in a sketch beforehand and skip the exchange by n-gram, as they are shared for sure.
A linked group of more than ``BLOCK`` sets is split into blocks of sets that are
likely alike, and only blocks that have a rare n-gram in common are joined. Tries
return links counted by document and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, one_row_per_id, release

#: Words in an n-gram, and the least Jaccard index of a pair. Each edited word costs up to N n-grams, so a longer one
#: loses near copies of short texts; a shorter one links texts that share phrases only.
N = 4
THRESHOLD = 0.45
#: Members of a linked group that one trie holds; larger groups are joined block by block, every block with every other.
BLOCK = 256
#: Grams that a task gathers before it sends them on.
_FLUSH = 500_000
#: Slots of the sketch that counts holders, and holders above which all grams of a slot skip the exchange by gram.
_SLOTS = 1 << 22
HOT = 1 << 20
#: Counts of a task's slot that are too few to be sent to the sketch.
_FEW = 256
#: Turns in which the grams are exchanged, and the documents: the files of one turn are gone before the next writes its own.
TURNS = 4

# ------------------------------------------------------------------ hashes of whole texts

#: ASCII letters and digits stay, other ASCII becomes a space; the bytes of other characters stay.
_KEEP = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        span = max(size, 1 << 16)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(span, b, np.uint64)]))
            for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))
        ]
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch of whole texts, and where each text's begin; one more for the end.

    Words are runs of letters and digits, lower-cased; ASCII punctuation parts them.
    A text without letters or digits is taken as it is written, in runs without
    white space.
    """
    raws = []
    for text in texts:
        low = (text or "").lower().encode("utf-8", "surrogatepass")
        raw = low.translate(_KEEP)
        raws.append(raw if not raw.isspace() else b" ".join(low.split()))
    data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    if not data.size:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _power(len(data) + 1)
    solid = data != 32
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)])])
    words = mix((total[last] - total[first]) * down[first])
    ends = np.cumsum([len(r) + 1 for r in raws])
    return words, np.concatenate([[0], np.searchsorted(first, ends)])


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams of words, for a batch of whole texts.

    A text of 1 to n-1 words has one gram, all its words; one without words has none.
    """
    words, at = word_hashes(texts)
    width = max(0, len(words) - n + 1)
    grams = words[:width].copy()
    for k in range(1, n):
        grams = grams * _GRAM + words[k : width + k]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            g = words[a : a + 1]
            for k in range(a + 1, b):
                g = g * _GRAM + words[k : k + 1]
            out.append(mix(g ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


# ------------------------------------------------------------------ packed exchange


def _planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: those that say nothing stand together."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes(), kind)


def _pack(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, body: bytes) -> bytes:
    """Steps from id to id, sizes and counts, compressed, before ``body``."""
    head = _planes(np.diff(ids.astype("<i8"), prepend=0)) + _planes(sizes.astype("<u4")) + _planes(counts.astype("<u4"))
    head = pa.compress(head, "zstd", asbytes=True)
    return len(ids).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + body


def _unpack(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]:
    m, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    head = pa.decompress(blob[8 : 8 + size], 16 * m, "zstd", asbytes=True)
    ids = np.cumsum(_from_planes(head[: 8 * m], "<i8"))
    return ids, _from_planes(head[8 * m : 12 * m], "<u4"), _from_planes(head[12 * m :], "<u4"), blob[8 + size :]


def _runs(ids: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), [len(ids)]])


def _bucket_of_gram(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _first_gram(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The least gram of each bucket."""
    return ((bucket.astype(np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(32)


def _seven(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_seven(raw) -> np.ndarray:
    """Of 256 buckets or more, the distance from a bucket's least gram has 7 bytes."""
    part = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :7] = part
    return full.view("<u8").ravel()


def _bucket_of_id(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * _GRAM) >> np.uint64(32)).astype(np.int64) % buckets


def _sets(batches: Iterator[pa.RecordBatch], n: int, flush: int = _FLUSH) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and sets of ``doc_id, text``, some ``flush`` grams at a time; documents without words are left out."""
    ids: list[int] = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(all_ids):
            to, chars = at, 0
            part = []
            while to < len(all_ids) and (chars < 1 << 18 or not part):
                part.append(all_texts[to].as_py())
                chars += len(part[-1] or "")
                to += 1
            for doc, grams in zip(all_ids[at:to], gram_sets(part, n)):
                if len(grams):
                    ids.append(doc)
                    sets.append(grams)
                    held += len(grams)
            at = to
            if held >= flush:
                yield np.array(ids, np.int64), sets
                ids, sets, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), sets


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(_SLOTS - 1)).astype(np.int64)


def hot_slots(rows: DataFrame, n: int, hot: int = HOT) -> np.ndarray:
    """Slots of the sketch whose grams have more than ``hot`` holders, or four times as many as a slot has on average.

    At most a quarter of the slots can be such, so the driver and every task hold
    some MB, whatever the data. Being a sketch, it may call a rare gram hot; that
    gram then is taken for shared, which costs a little and changes no result.
    """
    few = min(_FEW, max(1, hot // 4))

    def count(batches):
        seen = np.zeros(_SLOTS, np.int64)
        for _, sets in _sets(batches, n):
            seen += np.bincount(_slot(np.concatenate(sets)), minlength=_SLOTS)
        some = np.flatnonzero(seen >= few)
        slots, counts = np.append(some, -1), np.append(seen[some], seen.sum())
        del seen
        release()
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts)], names=["slot", "k"])

    # the counts of slot -1 add up to those of all
    seen = cut(rows.mapInArrow(count, "slot int, k bigint").groupBy("slot").agg(F.sum("k").alias("k")))
    total = seen.filter("slot = -1").first()
    least = max(hot, 4 * (total["k"] if total else 0) // _SLOTS)
    return np.array(sorted(r["slot"] for r in seen.filter((F.col("slot") >= 0) & (F.col("k") > least)).collect()), np.int64)


def _by_gram(n: int, buckets: int, hot: np.ndarray, turn: int = 0, turns: int = 1):
    """Map of ``doc_id, text``: each document's set without hot grams, cut up by bucket of gram; of these a turn has its part."""

    def packed(ids: np.ndarray, sets: list[np.ndarray], cool: np.ndarray | None) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets])
        grams = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        if cool is not None:
            some = cool[_slot(grams)]
            grams, owner = grams[some], owner[some]
        bucket = _bucket_of_gram(grams, buckets).astype(np.uint16)
        if turns > 1:
            some = bucket % turns == turn
            grams, owner, bucket = grams[some], owner[some], bucket[some]
        order = np.argsort(bucket, kind="stable")
        grams, owner, bucket = grams[order], owner[order], bucket[order]
        grams = grams - _first_gram(bucket, buckets)
        keys, blobs, cuts = [], [], _runs(bucket.astype(np.int64)) if len(bucket) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            run = _runs(owner[a:b])
            who = owner[a:b][run[:-1]]
            keys.append(int(bucket[a]))
            blobs.append(_pack(ids[who], size[who], np.diff(run), _seven(grams[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cool = None
        if len(hot):
            cool = np.ones(_SLOTS, bool)
            cool[hot] = False
        for ids, sets in _sets(batches, n):
            yield packed(ids, sets, cool)
        release()

    return run


def _hot_by_document(n: int, buckets: int, hot: np.ndarray):
    """Map of ``doc_id, text``: each document's hot grams, cut up by bucket of document as :func:`_shared` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warm = np.zeros(_SLOTS, bool)
        warm[hot] = True
        for ids, sets in _sets(batches, n):
            size = np.array([len(s) for s in sets])
            gram, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            some = warm[_slot(gram)]
            gram, owner = gram[some], owner[some]
            yield pa.RecordBatch.from_arrays(
                _by_document(gram, np.full(len(gram), 65535), ids[owner], size[owner], buckets, None), names=["bucket", "blob"]
            )
        release()

    return run


def _by_document(gram: np.ndarray, held: np.ndarray, doc: np.ndarray, size: np.ndarray, buckets: int, source: int | None) -> list[pa.Array]:
    """Grams by bucket of document, as distances of 7 bytes where all come from the bucket ``source`` of grams."""
    if source is None:
        base, bare = bytes(8) + b"\x08", lambda x: x.astype("<u8").tobytes()
    else:
        first = _first_gram(np.array([source]), buckets)
        base, bare = first.astype("<u8").tobytes() + b"\x07", lambda x: _seven(x - first)
    to = _bucket_of_id(doc, buckets)
    order = np.lexsort((doc, to))
    gram, held, doc, size, to = gram[order], np.minimum(held[order], 65535).astype("<u2"), doc[order], size[order], to[order]
    keys, blobs, cuts = [], [], _runs(to) if len(to) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        runs = _runs(doc[a:b])
        keys.append(int(to[a]))
        blobs.append(_pack(doc[a:b][runs[:-1]], size[a:b][runs[:-1]], np.diff(runs), base + bare(gram[a:b]) + pa.compress(_planes(held[a:b]), "zstd", asbytes=True)))
    return [pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())]


def _shared(buckets: int):
    """Reduce one bucket of grams: what several documents hold, cut up by bucket of document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [_unpack(memoryview(b.as_buffer())) for b in table.column("blob")]
        gram = np.concatenate([_from_seven(p[3]) for p in parts]) + _first_gram(np.array([bucket]), buckets)
        doc = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        size = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        del parts
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        cuts = _runs(gram.view(np.int64)) if len(gram) else np.zeros(1, np.int64)
        held = np.repeat(np.diff(cuts), np.diff(cuts))
        some = held > 1
        order, gram, held = order[some], gram[some], held[some]
        out = pa.table(_by_document(gram, held, doc[order], size[order], buckets, bucket), names=["bucket", "blob"])
        del gram, held, doc, size, order
        release()
        return out

    return run


def _least(threshold: float, size: np.ndarray) -> np.ndarray:
    """Least overlap of a set of ``size`` with any set that is like enough."""
    return np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)


_SETS = "doc_id bigint, size bigint, whole binary, grams binary"


def _gather(threshold: float):
    """Reduce one bucket of documents: the shared grams of each, rarest first, if they can suffice."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc, size, gram, held = [], [], [], []
        for b in table.column("blob"):
            ids, sizes, counts, body = _unpack(memoryview(b.as_buffer()))
            k = int(counts.sum())
            doc.append(np.repeat(ids, counts))
            size.append(np.repeat(sizes, counts))
            base, width = np.frombuffer(body, "<u8", 1), body[8]
            at = 9 + width * k
            gram.append((_from_seven(body[9:at]) if width == 7 else np.frombuffer(body, "<u8", k, 9)) + base)
            held.append(_from_planes(pa.decompress(body[at:], 2 * k, "zstd", asbytes=True), "<u2"))
        doc, size, gram, held = map(np.concatenate, (doc, size, gram, held))
        order = np.lexsort((gram, held, doc))
        doc, size, gram = doc[order], size[order], gram[order]
        cuts = _runs(doc)
        sizes = size[cuts[:-1]].astype(np.int64)
        rows = np.flatnonzero(np.diff(cuts) >= _least(threshold, sizes))
        sets = [gram[cuts[i] : cuts[i + 1]] for i in rows]
        whole = [s.tobytes() if len(s) == sizes[i] else None for s, i in zip(sets, rows)]
        release()
        return pa.table(
            [
                pa.array(doc[cuts[rows]], pa.int64()),
                pa.array(sizes[rows], pa.int64()),
                pa.array([w and _fingerprint(w) for w in whole], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            names=["doc_id", "size", "whole", "grams"],
        )

    return run


def _fingerprint(raw: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(raw, digest_size=16).digest()


def partner_candidates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, hot: int = HOT, turns: int = TURNS) -> DataFrame:
    """``doc_id, size, whole, grams`` of the documents whose shared grams can reach the threshold.

    ``grams`` are the shared ones, packed, by rising number of holders; ``whole`` is
    a fingerprint if the whole set is shared. Both exchanges carry packed arrays in
    a few rows per task; the buckets follow ``spark.sql.shuffle.partitions``. Grams of
    hot slots (see :func:`hot_slots`) go straight to their document's bucket. All grams
    go out, and all documents are gathered, but in ``turns`` one after the other, each
    with its part of the buckets: the texts are read once more for each, and the disk
    holds one turn's exchange beside what has come of those before. The result is
    checkpointed.
    """
    spark = docs.sparkSession
    buckets = max(256, min(65536, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = one_row_per_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows, packed = rows.select("doc_id", "text"), "bucket int, blob binary"
    slots = hot_slots(rows, n, hot)
    parts = [
        cut(rows.mapInArrow(_by_gram(n, buckets, slots, turn, turns), packed).groupBy("bucket").applyInArrow(_shared(buckets), packed))
        for turn in range(turns)
    ]
    if len(slots):
        parts.append(cut(rows.mapInArrow(_hot_by_document(n, buckets, slots), packed)))
    shared = reduce(DataFrame.unionByName, parts)
    sets = [
        cut(shared.filter(F.col("bucket") % turns == turn).groupBy("bucket").applyInArrow(_gather(threshold), _SETS)) for turn in range(turns)
    ]
    return reduce(DataFrame.unionByName, sets)


# ------------------------------------------------------------------ linked groups


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node of its component.

    Each task first keeps a spanning forest of its own edges, a million nodes at a
    time. Then large-star and small-star steps alternate until nothing changes; each
    round is checkpointed. Edges of a node with itself give a component of one.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def trees() -> Iterator[pa.RecordBatch]:
            nodes = [x for x in root if find(x) != x]
            for k in range(0, len(nodes), 100_000):
                part = nodes[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"]
                )

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > 1_000_000:
                yield from trees()
                root.clear()
        yield from trees()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Each node's neighbours (the larger ones, or the smaller ones and itself) move to its least neighbour."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        moved = both.join(least, "a")
        if large:
            return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return down.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")

    pairs = cut(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(forest, "a bigint, b bigint"))
    mark = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        pairs = cut(star(star(pairs, True).distinct(), False).distinct())
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _prefixes(threshold: float):
    """Map of sets: the grams of which a like pair must have one in common, each with the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            least = _least(threshold, sizes)
            for k in range(0, len(docs), 500):
                heads = []
                for need, raw in zip(least[k : k + 500].tolist(), batch.column(2)[k : k + 500]):
                    g = np.frombuffer(raw.as_buffer(), "<i8")
                    heads.append(g[: len(g) - need + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads)), pa.array(np.repeat(docs[k : k + 500], [len(h) for h in heads]))],
                    names=["gram", "a"],
                )

    return run


# ------------------------------------------------------------------ the trie


def trie_pairs(ids: list[int], sizes: list[int], sets: list[np.ndarray], threshold: float,
               side: list[bool] | None = None) -> list[tuple[int, int, float]]:
    """Pairs of sets with Jaccard index of at least ``threshold``; of a pair the lesser id comes first.

    ``sizes`` are the whole sets' sizes, ``sets`` hold at least what the sets have in
    common. With ``side``, only pairs of one set from either side. Sets become paths
    of a trie in a common order, grams that most members hold first. A walk carries
    the overlap of every member with the path so far; a member leaves a subtree
    when what remains of it or of the subtree's longest set can't reach the least
    overlap for the subtree's smallest set.
    """
    k = len(ids)
    flat = np.concatenate(sets) if k else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, code, held = np.unique(flat, return_inverse=True, return_counts=True)
    keep = held[code] > 1
    code, owner = code[keep], owner[keep]
    order = np.argsort(-held[np.unique(code)], kind="stable")
    rank = np.zeros(len(held), np.int64)
    rank[np.unique(code)[order]] = np.arange(len(order))
    code = rank[code]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(k + 1))
    paths = [code[cuts[i] : cuts[i + 1]] for i in range(k)]
    by_path = sorted(range(k), key=lambda i: paths[i].astype(">u4").tobytes())
    paths = [paths[i] for i in by_path]
    whole, names = np.array(sizes, np.int64)[by_path], [ids[i] for i in by_path]
    left = None if side is None else np.array(side, bool)[by_path]
    length = np.array([len(p) for p in paths], np.int64)
    width = int(code.max()) + 1 if len(code) else 0
    member = np.zeros((width, k), np.uint8)
    for i, p in enumerate(paths):
        member[p, i] = 1
    flat, start = np.concatenate(paths) if k else code, np.concatenate([[0], np.cumsum(length)])
    keyed = flat + np.repeat(np.arange(k), length) * (width + 1)
    ratio = threshold / (1 + threshold)
    out: list[tuple[int, int, float]] = []
    everyone = np.arange(k)
    stack = [(0, k, 0, everyone, np.zeros(k, np.int64))] if k else []
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        one, other = paths[lo], paths[hi - 1]
        m = min(len(one), len(other))
        differ = np.flatnonzero(one[depth:m] != other[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        if to > depth:
            overlap = overlap + member[one[depth:to]].sum(0, dtype=np.int64)[alive]
            passed = np.searchsorted(keyed, alive * (width + 1) + one[to - 1], side="right") - start[alive]
            remain = np.minimum(length[alive] - passed, int(length[lo:hi].max()) - to)
            able = overlap + remain >= ratio * (whole[alive] + int(whole[lo:hi].min())) - 1e-9
            alive, overlap = alive[able], overlap[able]
        if not len(alive):
            continue
        at = lo
        while at < hi and length[at] == to:
            union = whole[alive] + whole[at] - overlap
            good = (overlap >= threshold * union - 1e-9) & (alive > at if left is None else left[alive] & (not left[at]))
            for i in np.flatnonzero(good):
                a, b = names[at], names[alive[i]]
                out.append((min(a, b), max(a, b), float(overlap[i] / union[i])))
            at += 1
        while at < hi:
            token, end = paths[at][to], at + 1
            while end < hi and paths[end][to] == token:
                end += 1
            stack.append((at, end, to, alive, overlap))
            at = end
    return out


_PAIRS = "doc_a bigint, doc_b bigint, jaccard double"
_LINKS = "doc_id bigint, links bigint, other bigint"


def _join_groups(threshold: float, pairs: bool):
    """Reduce the tries of one task: their pairs, or each document's links and its tree in a spanning forest of them.

    A partner counts as often as there are equal sets (``k``).
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int, int], list[int]] = {}
        root, i, j = (table.column(c).to_pylist() for c in ("root", "i", "j"))
        for row, task in enumerate(zip(root, i, j)):
            groups.setdefault(task, []).append(row)
        doc, size, block, times = (table.column(c).to_pylist() for c in ("doc_id", "size", "block", "k"))
        grams = table.column("grams")
        out: list[tuple[int, int, float]] = []
        links: list[tuple[int, int, int]] = []
        for (_, first, second), rows in groups.items():
            sets = [np.frombuffer(grams[r].as_buffer(), "<u8") for r in rows]
            side = None if first == second else [block[r] == first for r in rows]
            found = trie_pairs([doc[r] for r in rows], [size[r] for r in rows], sets, threshold, side)
            if pairs:
                out += found
            else:
                links += _links(found, {doc[r]: times[r] for r in rows})
        form, rows = (_PAIRS, out) if pairs else (_LINKS, links)
        kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in form.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        release()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in form.split(", ")])

    return run


def _links(pairs: list[tuple[int, int, float]], times: dict[int, int]) -> list[tuple[int, int, int]]:
    """(document, links, root) for each document that ``pairs`` link."""
    count: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b, _ in pairs:
        count[a] = count.get(a, 0) + times[b]
        count[b] = count.get(b, 0) + times[a]
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(d, c, find(d)) for d, c in count.items()]


def _equal_sets(sets: DataFrame) -> DataFrame:
    """``doc_id, rep, k`` of the documents that ``k`` > 1 equal sets belong to; ``rep`` is the least id of them."""
    whole = sets.filter("whole IS NOT NULL").select("doc_id", "whole")
    same = whole.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).filter("k > 1")
    return cut(whole.join(same, "whole").select("doc_id", "rep", "k"))


def _tasks(sets: DataFrame, copies: DataFrame, threshold: float, block: int) -> DataFrame:
    """``task, root, i, j, block, doc_id, size, k, grams``: the tries to be walked; of equal sets only ``rep`` is in one.

    Sets with a prefix gram in common are linked. A group of up to ``block`` sets is
    one trie, and small groups share tasks. A larger group is split: sets with the
    same least prefix gram are likely alike and stay together, in blocks of their
    own if they are many. Two blocks meet in a task if they share a prefix gram;
    without one no set of either can be like one of the other.
    """
    single = sets.join(copies.filter("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    heads = single.select("doc_id", "size", "grams").mapInArrow(_prefixes(threshold), "gram bigint, a bigint")
    least = heads.groupBy("gram").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    linked = cut(heads.join(least, "gram").select("gram", "a", "b"))
    group = components(linked.filter("a <> b").select("a", "b"))
    large = group.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > block)
    group = cut(group.join(large, "root", "left").select(F.col("node").alias("doc_id"), "root", "m"))
    tasks = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = group.filter("m IS NULL").select(
        "doc_id", "root", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"),
        F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"),
    )
    split = group.filter("m IS NOT NULL")
    if not split.isEmpty():
        inside = linked.select("gram", F.col("a").alias("doc_id")).join(split, "doc_id")
        low = inside.groupBy("doc_id", "root", "m").agg(F.min(F.xxhash64("gram")).alias("low"))
        many = low.groupBy("root", "low").agg(F.count("*").alias("c")).filter(F.col("c") > block)
        share = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / block))
        place = F.pmod(F.xxhash64("low"), F.ceil(F.col("m") / block))
        blocks = cut(
            low.join(many, ["root", "low"], "left")
            .select("doc_id", "root", F.when(F.col("c").isNotNull(), F.xxhash64("low", share)).otherwise(place).alias("block"))
        )
        held = inside.select("gram", "doc_id").join(blocks, "doc_id").select("gram", "root", "block").distinct()
        meet = (
            held.select("gram", "root", F.col("block").alias("i")).join(held.select("gram", "root", F.col("block").alias("j")), ["gram", "root"])
            .filter("i <= j").select("root", "i", "j").distinct()
        )
        both = meet.select("root", "i", "j", F.col("i").alias("block")).unionByName(meet.filter("i < j").select("root", "i", "j", F.col("j").alias("block")))
        small = small.unionByName(
            blocks.join(both, ["root", "block"]).select("doc_id", "root", "block", "i", "j", (F.xxhash64("root", "i", "j")).alias("task"))
        )
    times = copies.filter("doc_id = rep").select("doc_id", "k")
    return small.join(single.select("doc_id", "size", "grams").join(times, "doc_id", "left"), "doc_id").fillna({"k": 1})


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``doc_a, doc_b, jaccard``: pairs of different n-gram sets of a Jaccard index of at least ``threshold``, and equal sets.

    ``doc_a < doc_b``; the index is rounded to 6 places. Of documents with equal sets
    each is paired, at 1.0, with the least id among them, and that one stands for all
    of them in the other pairs. Odd rows as in :func:`near_duplicates`.
    """
    sets = partner_candidates(docs, n, threshold, hot)
    copies = _equal_sets(sets)
    near = _tasks(sets, copies, threshold, block).groupBy("task").applyInArrow(_join_groups(threshold, True), _PAIRS)
    equal = copies.filter("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(equal).select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard"))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``doc_id, class_id, n_links`` of every document.

    Two documents are linked if the Jaccard index of their n-gram sets is at least
    ``threshold``; ``n_links`` counts the others that a document is linked to, equal
    ones included, and ``class_id`` is the least doc_id that links lead to, its own
    for a document without any. Texts are compared whole, lower-cased, without ASCII
    punctuation (see :func:`gram_sets`). Null, empty and blank texts have no n-gram
    and no link. Rows without an id are left out; repeated rows count once; of
    several texts of one id the greatest counts. Other columns are dropped; no
    documents give no rows. No group is capped.
    """
    found, copies, near = _classes(docs, n, threshold, block, hot)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    near = near.groupBy("doc_id").agg(F.sum("links").alias("links"))
    links = near.join(copies.filter("doc_id = rep").select("doc_id"), "doc_id", "left_anti").unionByName(
        copies.join(near.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("links"))
    )
    return (
        ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(links, "doc_id", "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    )


def _classes(docs: DataFrame, n: int, threshold: float, block: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node, root`` of the linked documents; their equal sets; ``doc_id, links, other`` of different ones."""
    sets = partner_candidates(docs, n, threshold, hot)
    copies = _equal_sets(sets)
    near = cut(_tasks(sets, copies, threshold, block).groupBy("task").applyInArrow(_join_groups(threshold, False), _LINKS))
    edges = near.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).unionByName(
        copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    return components(edges.filter("a <> b")), copies, near


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of :func:`near_duplicates`, that of the least doc_id, with all columns.

    Repeated rows of a doc_id are copies too: one stays, that with the greatest text
    (of equal texts the greatest in the other columns, where those can be compared).
    Documents without a link stay, null, empty and blank texts too; rows without an
    id can't be named as copies and stay as they are. An empty table stays empty.
    """
    found, _, _ = _classes(docs, n, threshold, BLOCK, HOT)
    name = "_gone" + "_" * max(map(len, docs.columns))  # no column of docs has it
    gone = found.filter("node <> root").select(F.col("node").alias(name))
    one = one_row_per_id(docs).join(gone, F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
    return one.unionByName(docs.filter("doc_id IS NULL"))


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """The same in SQL over a table ``documents``: every document held against every other that shares an n-gram."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
low AS (SELECT doc_id, lower(text) AS raw, regexp_replace(lower(text), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]', ' ', 'g') AS kept FROM docs),
words AS (
  SELECT doc_id, regexp_extract_all(CASE WHEN kept ~ '^ *$' THEN raw ELSE kept END, '[^ \\t\\n\\x0b\\x0c\\r]+') AS w FROM low),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k / (x.size + y.size - k) >= {threshold} - 1e-9),
reach(node, met) AS (SELECT doc_id, doc_id FROM docs UNION SELECT b, met FROM reach JOIN links ON a = node),
class AS (SELECT node, min(met) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM docs JOIN class ON node = doc_id LEFT JOIN counts ON a = doc_id"""
