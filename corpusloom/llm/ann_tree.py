"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is grown level by level: every task assigns its vectors, the sums of each
child come together, and only centroids reach the driver. A vector first searches
its own leaf. Other leaves are then taken best bin first from a priority queue, as
long as their nearest possible point is nearer than the k-th neighbour so far, and
up to a number of visits that is widened until the recall measured against brute
force reaches the target. Vectors travel in packed arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, release

#: Children of a node, vectors that a leaf should hold, leaves at most (centroids are broadcast: 16 MB at 64 dimensions).
BRANCH = 32
LEAF = 1024
MAX_LEAVES = 65_536
#: Points below a node that one task clusters.
LOCAL = 65_536
ROUNDS = 3
#: Recall to calibrate for, and the queries that calibrate it: those whose hashed id comes first.
RECALL = 0.96
CALIBRATION = 512


@dataclass
class Tree:
    """Nodes in order of growth; node 0 is the root. Leaves have no children."""

    centroid: np.ndarray
    children: list[list[int]] = field(default_factory=lambda: [[]])
    radius: np.ndarray | None = None
    count: np.ndarray | None = None
    parent: list[int] = field(default_factory=lambda: [-1])

    def add(self, node: int, centroids: np.ndarray) -> None:
        first = len(self.children)
        self.centroid = np.vstack([self.centroid, centroids])
        self.children[node] = list(range(first, first + len(centroids)))
        self.children += [[] for _ in centroids]
        self.parent += [node] * len(centroids)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``: the nearest child, level by level, the first of equals."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            c = self.centroid[kids]
            to = ((c**2).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)
            for k in np.unique(to):
                todo.append((kids[k], rows[to == k]))
        return at

    def bounds(self, x: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Least possible distance of each row to a point below each node.

        A point below a child is no farther from its centroid than from its
        siblings', so it lies behind the plane halfway to the sibling nearest to the
        row; and it lies within the child's radius.
        """
        low = np.maximum(far - self.radius, 0.0)
        for node, kids in enumerate(self.children):
            if kids:
                c = self.centroid[kids].astype(np.float64)
                d = far[:, kids]
                own = d.argmin(1)
                gap = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0.0))[own]
                behind = (d**2 - d.min(1)[:, None] ** 2) / np.maximum(2 * gap, 1e-12)
                low[:, kids] = np.maximum(np.maximum(low[:, kids], behind), low[:, [node]])
        return low

    def bins(self, x: np.ndarray, bound: np.ndarray, visits: int) -> list[list[int]]:
        """For each row the leaves to visit, nearest centroid first, none that can't hold a point within ``bound``."""
        out: list[list[int]] = []
        square = (self.centroid.astype(np.float64) ** 2).sum(1)
        step = max(1, 4_000_000 // max(1, len(self.children)))  # rows whose distances to all nodes are held at once
        for k in range(0, len(x), step):
            part = x[k : k + step].astype(np.float64)
            far = np.sqrt(np.maximum(0, (part**2).sum(1)[:, None] + square - 2 * (part @ self.centroid.T)))
            able = self.bounds(part, far) <= bound[k : k + step, None] * 1.00001 + 1e-5
            for row, ok in zip(far, able):
                open_, row_of = set(np.flatnonzero(ok).tolist()), row.item
                queue, found = [(0.0, 0)], []
                while queue and len(found) < visits:
                    _, node = heapq.heappop(queue)
                    if kids := self.children[node]:
                        for kid in open_.intersection(kids):
                            heapq.heappush(queue, (row_of(kid), kid))
                    else:
                        found.append(node)
                out.append(found)
        return out


def vectors_of(blobs: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), np.float32).reshape(-1, dims) for b in blobs] or [np.empty((0, dims), np.float32)])


def _batches(batches: Iterator[pa.RecordBatch], dims: int, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, parts, held = [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        parts.append(vectors_of(batch.column(1), dims))
        held += len(parts[-1])
        if held >= rows:
            yield np.concatenate(ids), np.concatenate(parts)
            ids, parts, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(parts)


def _first_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that hold one of the ``k`` least ids of their vector."""
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, 4 * x.shape[1]))).ravel()
    _, code = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, code))
    start = np.searchsorted(code[order], code[order])
    return np.sort(order[np.arange(len(order)) - start < k])


def _grow_here(ids: np.ndarray, x: np.ndarray, leaf: int, branch: int) -> Tree:
    """The subtree over the points of one task."""
    order = np.argsort(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    x = x[order]
    tree = Tree(np.zeros((1, x.shape[1]), np.float32))
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= 2 * leaf:
            continue
        part = x[rows]
        b = min(branch, -(-len(rows) // leaf))
        _, first = np.unique(part[: 64 * b], axis=0, return_index=True)
        if len(first) < 2:
            _, first = np.unique(part, axis=0, return_index=True)
        if len(first) < 2:
            continue  # all its vectors are equal
        c = part[np.sort(first)[:b]].copy()
        for k in range(ROUNDS + 1):
            to = ((c**2).sum(1) - 2 * (part @ c.T)).argmin(1)
            count = np.bincount(to, minlength=len(c))
            if k < ROUNDS:
                sums = np.stack([np.bincount(to, part[:, d], len(c)) for d in range(x.shape[1])], 1)
                c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c).astype(np.float32)
        if count.max() == len(rows):
            continue
        tree.add(node, c)
        todo += [(kid, rows[to == i]) for i, kid in enumerate(tree.children[node])]
    return tree


def _grow_below(points: DataFrame, tree: Tree, dims: int, leaf: int, branch: int) -> None:
    """Give each large leaf its subtree, grown by one task from all of the leaf's points."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def assign(batches):
        for ids, x in _batches(batches, dims):
            some = _first_of_equals(ids, x, 1)  # a leaf may hold any number of equal vectors
            ids, x = ids[some], x[some]
            at = shared.value.descend(x)
            keys = np.unique(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([ids[at == n].tobytes() for n in keys], pa.binary()), pa.array([x[at == n].tobytes() for n in keys], pa.binary())],
                names=["node", "ids", "vecs"],
            )

    def run(key, table):
        ids = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("ids")])
        below = _grow_here(ids, vectors_of(table.column("vecs"), dims), leaf, branch)
        n = len(below.parent)
        return pa.table(
            [pa.array([key[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(below.parent, pa.int64()), pa.array([c.tobytes() for c in below.centroid], pa.binary())],
            names=["node", "here", "parent", "vec"],
        )

    rows = points.mapInArrow(assign, "node bigint, ids binary, vecs binary").groupBy("node").applyInArrow(run, "node bigint, here bigint, parent bigint, vec binary")
    found: dict[int, list] = {}
    for r in rows.collect():
        found.setdefault(r["node"], []).append(r)
    for node in sorted(found):
        place = {0: node}
        below = sorted(found[node], key=lambda r: r["here"])
        kids: dict[int, list] = {}
        for r in below[1:]:
            kids.setdefault(r["parent"], []).append(r)
        for parent in sorted(kids):  # a node's number is greater than its parent's
            tree.add(place[parent], np.stack([np.frombuffer(r["vec"], np.float32) for r in kids[parent]]))
            place.update(zip((r["here"] for r in kids[parent]), tree.children[place[parent]]))


def grow(points: DataFrame, dims: int, leaf: int = LEAF, branch: int = BRANCH, local: int = LOCAL) -> Tree:
    """Tree over all rows of ``points(id, vec)``; ``vec`` is packed float32.

    Nodes of more than ``local`` points are split by all tasks together, the others
    are grown down by one task each. Leaves hold up to twice ``leaf`` points, or any
    number of equal ones.
    """
    sc = points.sparkSession.sparkContext
    total = points.count()
    leaf = max(leaf, -(-total // MAX_LEAVES))
    local = max(local, 4 * leaf)
    tree = Tree(np.zeros((1, dims), np.float32), count=np.array([total]))
    ready: set[int] = set()
    while True:
        split = {n: min(branch, -(-2 * int(tree.count[n]) // local)) for n, kids in enumerate(tree.children) if not kids and n not in ready and tree.count[n] > local}
        if not split:
            break
        shared = sc.broadcast((tree, split))

        def seeds(batches):
            tree, split = shared.value
            wanted = np.zeros(len(tree.children), np.int64)
            wanted[list(split)] = [2 * b for b in split.values()]
            for ids, x in _batches(batches, dims):
                at, place = tree.descend(x), mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                order = np.lexsort((place, at))
                start = np.searchsorted(at[order], at[order])
                rows = order[np.arange(len(order)) - start < wanted[at[order]]]
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[rows]), pa.array(place[rows]), pa.array([x[r].tobytes() for r in rows], pa.binary())],
                        names=["node", "place", "vec"],
                    )

        drawn = points.mapInArrow(seeds, "node bigint, place bigint, vec binary").groupBy("node", "vec").agg(F.min("place").alias("place"))
        first: dict[int, list] = {}
        for r in drawn.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "vec"))), 1, branch).alias("v")).collect():
            first[r["node"]] = [np.frombuffer(v["vec"], np.float32) for v in r["v"]][: split[r["node"]]]
        for n in split:
            if len(first.get(n, [])) > 1:
                tree.add(n, np.stack(first[n]))
            else:
                ready.add(n)  # all its vectors are equal
        for k in range(ROUNDS + 1):
            sums = statistics(points, tree, dims, kinds := [c for n in split for c in tree.children[n]])
            tree.count = np.array([sums[n][0] if n in sums else (0 if n in kinds else tree.count[n] if n < len(tree.count) else 0) for n in range(len(tree.children))])
            if k == ROUNDS:
                break
            for n, (count, total_of, _) in sums.items():
                tree.centroid[n] = total_of / count
    _grow_below(points, tree, dims, leaf, branch)
    tree.radius, tree.count = np.zeros(len(tree.children)), np.zeros(len(tree.children), np.int64)
    for n, (count, _, radius) in statistics(points, tree, dims, list(range(len(tree.children)))).items():
        tree.radius[n], tree.count[n] = radius, count
    return tree


def statistics(points: DataFrame, tree: Tree, dims: int, nodes: list[int]) -> dict[int, tuple[int, np.ndarray, float]]:
    """Count, vector sum and greatest distance from the centroid of each of ``nodes``, over all points below it."""
    shared = points.sparkSession.sparkContext.broadcast((tree, frozenset(nodes)))

    def add(batches):
        tree, chosen = shared.value
        n = len(tree.children)
        wanted, parent = np.zeros(n, bool), np.array(tree.parent)
        wanted[list(chosen)] = True
        count, total, far = np.zeros(n, np.int64), np.zeros((n, dims)), np.zeros(n)
        for _, x in _batches(batches, dims):
            node, rows = tree.descend(x), np.arange(len(x))
            while len(rows):
                some = rows[wanted[node]]
                if len(some):
                    here, part = node[wanted[node]], x[some].astype(np.float64)
                    count += np.bincount(here, minlength=n)
                    for d in range(dims):
                        total[:, d] += np.bincount(here, part[:, d], n)
                    np.maximum.at(far, here, np.sqrt(((part - tree.centroid[here]) ** 2).sum(1)))
                up = parent[node]
                rows, node = rows[up >= 0], up[up >= 0]
        seen = np.flatnonzero(count)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array(count[seen]), pa.array(total[seen].tolist(), pa.list_(pa.float64())), pa.array(far[seen])],
                names=["node", "n", "total", "far"],
            )

    def merge(key, table):
        total = np.array(table.column("total").to_pylist()).sum(0)
        return pa.table(
            [[key[0].as_py()], [sum(table.column("n").to_pylist())], pa.array([total.tolist()], pa.list_(pa.float64())), [max(table.column("far").to_pylist())]],
            names=["node", "n", "total", "far"],
        )

    form = "node bigint, n bigint, total array<double>, far double"
    rows = points.mapInArrow(add, form).groupBy("node").applyInArrow(merge, form).collect()
    return {r["node"]: (r["n"], np.array(r["total"]), r["far"]) for r in rows}


# ------------------------------------------------------------------ search


def nearest(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``p`` and exact distances of the ``k`` nearest to each row of ``q``, unordered beyond distance."""
    k = min(k, len(p))
    near = np.empty((len(q), k), np.int64)
    far = np.empty((len(q), k))
    wide = min(len(p), k + 8)  # single precision chooses a few more, double precision decides
    square = (p**2).sum(1)
    step = max(1, 4_000_000 // max(1, len(p)))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        rough = square - 2 * (part @ p.T)
        some = np.argpartition(rough, wide - 1, 1)[:, :wide] if wide < len(p) else np.tile(np.arange(len(p)), (len(part), 1))
        exact = np.sqrt(((part[:, None, :].astype(np.float64) - p[some]) ** 2).sum(2))
        order = np.lexsort((some, exact), axis=1)[:, :k] if len(part) else np.empty((0, k), np.int64)
        near[a : a + step] = np.take_along_axis(some, order, 1)
        far[a : a + step] = np.take_along_axis(exact, order, 1)
    return near, far


def distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and the ids of each in rising order."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order]) + np.float32(0)  # -0.0 becomes 0.0
    rows = x.view(np.dtype((np.void, x.shape[1] * 4))).ravel() if x.shape[1] else np.zeros(len(x), "V1")
    _, first, code = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(first) + 1))
    return x[first], [ids[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _result_rows(query: np.ndarray, near: np.ndarray, far: np.ndarray, members: list[np.ndarray], k: int, buckets: int,
                 bound: np.ndarray | None = None):
    """(bucket, blob) rows with up to ``k`` candidates of each query; a vector stands for its first ids."""
    firsts = [m[:k] for m in members]  # all of one distance; merging puts them in order of id
    sizes = np.array([len(m) for m in firsts])
    pool, start = np.concatenate(firsts), np.concatenate([[0], np.cumsum(sizes)])
    flat = near.ravel()
    q, d = np.repeat(query, near.shape[1]), far.ravel()
    if bound is not None:
        some = d <= np.repeat(bound, near.shape[1])
        flat, q, d = flat[some], q[some], d[some]
    times = sizes[flat]
    ends = np.cumsum(times)
    n = pool[np.repeat(start[flat] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)]
    q, d = np.repeat(q, times), np.repeat(d, times)
    to = _bucket(q, buckets)
    order = np.argsort(to, kind="stable")
    to, q, n, d = to[order], q[order], n[order], d[order]
    keys, starts = np.unique(to, return_index=True)
    for key, a, b in zip(keys.tolist(), starts, [*starts[1:], len(to)]):
        yield key, q[a:b].tobytes() + n[a:b].tobytes() + d[a:b].tobytes()


_ROWS = "kind int, key bigint, blob binary, extra binary"


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    kind, key, blob, extra = zip(*rows) if rows else ((), (), (), ())
    return pa.table(
        [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(blob, pa.binary()), pa.array(extra, pa.binary())],
        names=["kind", "key", "blob", "extra"],
    )


_POINTS, _QUERIES, _FOUND = 0, 1, 2
#: Rows of a leaf (equal ones, if there are so many) for which one task searches.
_PART = 262_144


def calibrate(points: DataFrame, tree: Tree, dims: int, k: int, recall: float = RECALL, sample: int = CALIBRATION) -> int:
    """Least number of leaf visits at which the sample's true neighbours are found often enough.

    The true neighbours of each sampled query come from brute force over all points;
    each lies in a leaf whose place in the query's best-bin-first order is known, so
    that the recall of every number of visits follows.
    """
    order = F.xxhash64("id")
    drawn = points.orderBy(order, "id").limit(sample).collect()
    if not drawn:
        return 1
    q = np.stack([np.frombuffer(r["vec"], np.float32) for r in drawn])
    names = np.array([r["id"] for r in drawn], np.int64)
    shared = points.sparkSession.sparkContext.broadcast((tree, q, names))

    def brute(batches):
        tree, q, names = shared.value
        for ids, x in _batches(batches, dims):
            near, far = nearest(q, x, k + 1)
            leaf = tree.descend(x)
            rows = np.repeat(np.arange(len(q)), near.shape[1])
            other = ids[near.ravel()] != names[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[other]), pa.array(far.ravel()[other]), pa.array(leaf[near.ravel()][other])], names=["q", "d", "leaf"]
            )

    best = (
        points.mapInArrow(brute, "q bigint, d double, leaf bigint").groupBy("q")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "leaf"))), 1, k).alias("best")).collect()
    )
    orders = tree.bins(q, np.full(len(q), np.inf), len(tree.children))
    homes = tree.descend(q)
    places = []
    for r in best:
        own = homes[r["q"]]
        seen = {leaf: i for i, leaf in enumerate([own] + [b for b in orders[r["q"]] if b != own])}
        places += [seen[b["leaf"]] + 1 for b in r["best"]]
    if not places:
        return 1
    counts = np.cumsum(np.bincount(places)) / len(places)
    visits = 1
    while visits < len(counts) and counts[min(visits, len(counts) - 1)] < recall:
        visits += 1
    return visits


def search(points: DataFrame, queries: DataFrame, dims: int, k: int, leaf: int = LEAF, recall: float = RECALL,
           sample: int = CALIBRATION) -> DataFrame:
    """``id, neighbors, distances`` of every row of ``queries(id, vec)`` among ``points(id, vec)``, ids unique.

    Neighbours exclude the query's own id, nearest first, equals by id. Of equal
    points no more than the ``k + 1`` least ids of each task's share are sent on, as
    no query can need more of them; queries of a leaf that holds very many equal
    points are spread over tasks, the points given to each.
    """
    spark = points.sparkSession
    tree = grow(points, dims, leaf)
    visits = calibrate(points, tree, dims, k, recall, sample)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared, nodes = spark.sparkContext.broadcast(tree), len(tree.children)
    parts = np.maximum(1, tree.count // _PART)

    def part_of(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Key of each query at its leaf: the leaf, and the share of its queries."""
        return at + nodes * (mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % parts[at].astype(np.uint64)).astype(np.int64)

    def assign(batches):
        tree = shared.value
        for ids, x in _batches(batches, dims):
            some = _first_of_equals(ids, x, k + 1)
            ids, x = ids[some], x[some]
            at = tree.descend(x)
            for n in np.unique(at).tolist():
                blob, vecs = ids[at == n].tobytes(), x[at == n].tobytes()
                yield from _table([(_POINTS, n + nodes * i, blob, vecs) for i in range(int(parts[n]))]).to_batches()

    def ask(batches):
        tree = shared.value
        for ids, x in _batches(batches, dims):
            key = part_of(ids, tree.descend(x))
            free = np.concatenate([x, np.full((len(x), 1), np.inf, np.float32)], 1)
            yield from _table([(_QUERIES, n, ids[key == n].tobytes(), free[key == n].tobytes()) for n in np.unique(key).tolist()]).to_batches()

    def unpack(table: pa.Table, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        blobs, extras, ids, x = table.column("blob"), table.column("extra"), [np.empty(0, np.int64)], [np.empty((0, width), np.float32)]
        for i in np.flatnonzero(table.column("kind").to_numpy() == kind).tolist():
            ids.append(np.frombuffer(blobs[i].as_buffer(), np.int64))
            x.append(np.frombuffer(extras[i].as_buffer(), np.float32).reshape(-1, width))
        return np.concatenate(ids), np.concatenate(x)

    def visit(table: pa.Table, going: bool) -> pa.Table:
        """What the queries find in a leaf; with ``going``, the queries that go on to others too."""
        query, q = unpack(table, _QUERIES, dims + 1)
        if not len(query):
            return _table([])
        x, bound = np.ascontiguousarray(q[:, :dims]), q[:, dims].astype(np.float64) * 1.000001 + 1e-9
        p, members = distinct(*unpack(table, _POINTS, dims))
        rows = []
        if len(p):
            near, far = nearest(x, p, k + 1)
            rows = [(_FOUND, b, blob, None) for b, blob in _result_rows(query, near, far, members, k + 1, buckets, bound)]
        if going and visits > 1 and nodes > 1:
            if len(p):
                held = np.cumsum(np.array([len(m) for m in members])[near], 1)  # the query itself may be among them
                enough = held > k
                first = enough.argmax(1)
                bound = np.where(enough.any(1), far[np.arange(len(far)), first], np.inf)
            else:
                bound = np.full(len(x), np.inf)
            own = shared.value.descend(x)
            to: dict[int, list[int]] = {}
            for i, leaves in enumerate(shared.value.bins(x, bound, visits)):
                for n in leaves if own[i] in leaves else leaves[: visits - 1]:
                    if n != own[i]:
                        to.setdefault(n, []).append(i)
            for n, some in to.items():
                key = part_of(query[some], np.full(len(some), n))
                with_bound = np.concatenate([x[some], np.nextafter(bound[some, None].astype(np.float32), np.float32(np.inf))], 1)
                for one in np.unique(key).tolist():
                    mine = key == one
                    rows.append((_QUERIES, one, query[some][mine].tobytes(), np.ascontiguousarray(with_bound[mine]).tobytes()))
        release()
        return _table(rows)

    def merge(key, table):
        q, n, d = [], [], []
        for blob in table.column("blob"):
            raw = blob.as_buffer()
            m = raw.size // 24
            q.append(np.frombuffer(raw, np.int64, m))
            n.append(np.frombuffer(raw, np.int64, m, 8 * m))
            d.append(np.frombuffer(raw, np.float64, m, 16 * m))
        q, n, d = np.concatenate(q), np.concatenate(n), np.concatenate(d)
        other = q != n
        q, n, d = q[other], n[other], d[other]
        order = np.lexsort((n, d, q))
        q, n, d = q[order], n[order], d[order]
        start = np.searchsorted(q, q)
        some = np.arange(len(q)) - start < k
        q, n, d = q[some], n[some], d[some]
        ids, sizes = np.unique(q, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.table(
            [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(n)), pa.ListArray.from_arrays(offsets, pa.array(d))],
            names=["id", "neighbors", "distances"],
        )

    cells = cut(points.mapInArrow(assign, _ROWS))
    asked = queries.mapInArrow(ask, _ROWS)
    first = cut(cells.unionByName(asked).groupBy("key").applyInArrow(lambda table: visit(table, True), _ROWS))
    second = cells.unionByName(first.filter(f"kind = {_QUERIES}")).groupBy("key").applyInArrow(lambda table: visit(table, False), _ROWS)
    found = first.filter(f"kind = {_FOUND}").unionByName(second).groupBy("key")
    return found.applyInArrow(merge, "id bigint, neighbors array<bigint>, distances array<double>")


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """``id, vec`` from ``id, embedding``: float32 bytes; no rows of another length or with null or non-finite parts."""

    def pack(batches):
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = v.values
                x = values.to_numpy(zero_copy_only=False).astype(np.float32)
                if len(x) == dims and not values.null_count and np.isfinite(x).all():
                    ids.append(i)
                    vecs.append((x + np.float32(0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(pack, "id bigint, vec binary")


def neighbours(rows: DataFrame, k: int = 10, every: int = 1, leaf: int = LEAF, recall: float = RECALL,
               sample: int = CALIBRATION) -> DataFrame:
    """``vec_id, rank, neighbor_id, distance``: the ``k`` nearest among all of ``rows(vec_id, embedding)``.

    Queries are the rows whose id is divisible by ``every``; every row is in the
    index. Euclidean distance, rounded to 6 places; rank 1 is nearest, equals by id;
    a row is not its own neighbour. The recall against brute force is calibrated on
    ``sample`` rows to be at least ``recall``. Rows without an id or with a null,
    non-finite or odd-sized embedding (the commonest size counts, the least of
    equals) are left out; repeated rows count once, of several embeddings of one id
    the greatest. Other columns are dropped. Fewer than ``k`` other rows give as many
    neighbours as there are; no rows give none.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.filter("id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = sizes["dims"] if sizes else 1
    unique = rows.filter(F.size("embedding") == dims).groupBy("id").agg(F.max("embedding").alias("embedding"))
    points = cut(packed(unique, dims))
    found = search(points, points.filter(F.col("id") % every == 0), dims, k, leaf, recall, sample)
    return found.select(F.col("id").alias("vec_id"), F.posexplode(F.arrays_zip("neighbors", "distances")).alias("pos", "x")).select(
        "vec_id",
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("x.neighbors").alias("neighbor_id"),
        F.round("x.distances", 6).alias("distance"),
    )
