"""N-gram Jaccard join with count-vector R-trees.

The distinct word shingles of a text are hashed into groups.  The counts of the
groups are a point; the sum of coordinate minima of two points bounds the overlap of
their sets, and of a point and a box the overlap with every point in the box, so an
R-tree over the points prunes what cannot reach the similarity.  Pairs that survive
are verified on the sets themselves.

Where points meet: sets as similar as asked differ in few shingles, so among more hash
groups than that some hold the very same shingles on both sides.  Each set sends a
signature of each group, and only sets that share one are indexed together.  This is
by counting, for sets of any size, so no pair similar enough is missed.  With
``exact=False`` large sets take fewer and larger groups, chosen so that a pair just
similar enough is expected to share ``EXPECTED`` of them: it shares none with a chance
of about e**-EXPECTED, and passages that many texts have rarely fill a group.

Links, not pairs, are the result.  Copies of a set are one node.  First each node is
checked against the least node of its signatures, which joins groups of near copies
by one pair for each member; then an R-tree finds, for each signature whose nodes
are still apart, the likeliest link of each node out of its component (as in
Boruvka's algorithm, two rounds).  At last the tree tells which nodes of a signature
may link out of their components at all; their sets meet there, and each pair still
between components is verified on the spot, so that only links that join something
leave the task, fewer than nodes came in, and no pairs are listed.  No link is lost: a
pair left out joins nodes already connected.  Indexes hold about ``INDEX`` points and
``HELD`` shingles; larger groups take several, and their queries are dealt, too, so
that no task grows with a group.

Shingles and sets are known by 64-bit hashes: among 10**9 distinct sets one pair of
different ones is expected to be taken as equal with a chance of 3 in 100.

Defined results: texts without words have an empty set and link with nothing, as do
null texts; rows of a null id get the component of an equal set that has an id, else
null; rows that share an id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import collect, release, salted_join, settle, trimmed, with_maybe
from .words import Words, mix

EXPECTED = 30.0
INDEX = 2048
#: Queries of a block that go to one task.
ASKS = 4 * INDEX
#: Shingles of the sets of an index, and of the queries of a block that go to one task; and of sets that are compared at once.
HELD, ASKED, COMPARED = 1 << 22, 1 << 24, 1 << 18
#: Rounds in which each node still apart is joined by its likeliest link, before all pairs left over are looked at.
BEST_ROUNDS = 2
LEAF = 24
_U = np.uint64
_PIECE = 1 << 20  # bytes of text taken at once
_SENT = 1 << 16  # signatures sent at once: as large as their texts, they must not pile up
#: Coordinates of the tree; the points themselves have more.
TREE_DIMS = 64


class Plan:
    """Classes of set sizes and the number of signature groups of each, for similarity num / den."""

    def __init__(self, num: int, den: int, exact: bool = True):
        self.num, self.den, self.exact = num, den, exact
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * 1.6)))
        self.edges = np.array(self.low, np.int64)

    def need(self, total):
        """The least overlap of a linked pair with so many shingles together."""
        return -(-self.num * total // (self.num + self.den))

    def class_of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def classes(self, n: int) -> range:
        """A pair meets in the class of its larger set."""
        return range(self.class_of(n), self.class_of(n * self.den // self.num) + 1)

    def groups(self, c: int) -> tuple[int, int]:
        """(groups, most differing shingles of a linked pair, -1 if counting proves no shared group); no groups: only equal sets link."""
        if not hasattr(self, "_groups"):
            self._groups: dict[int, tuple[int, int]] = {}
        if c not in self._groups:
            top = 2 * (self.low[c + 1] - 1)
            most = max(s - 2 * self.need(s) for s in range(max(2, top - 4), top + 1))
            if most <= 0:
                self._groups[c] = (0, 0)
            else:
                g = most + 2
                small = max(1, self.low[c] * self.num // self.den)
                while g - most - 1 < 1 + 2 * g * math.exp(-small / g) and g < 1.5 * most + 4:
                    g += 1
                few = max(40, most // 4)
                while few < g and few * math.exp(-most / few) < EXPECTED:
                    few += max(1, few // 50)
                self._groups[c] = (g, most) if self.exact or few >= g else (few, -1)
        return self._groups[c]

    def signatures(self, x: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Of the sorted distinct hashes ``x`` of a set (``mixed``: mixed once more)."""
        out = [np.zeros(0, np.int64)]
        high = x >> _U(32)
        for c in self.classes(len(x)):
            g, most = self.groups(c)
            if not g:
                continue
            cuts = np.searchsorted(high, (np.arange(g, dtype=np.uint64) << _U(32)) // _U(g))
            sums = np.append(np.cumsum(np.append(_U(0), mixed))[cuts], mixed.sum(dtype=_U))
            sums = np.diff(sums)
            full = np.diff(np.append(cuts, len(x))) > 0
            if most >= 0 and (~full).sum() >= g - most:
                full[:] = True  # counting needs the empty groups too
            keys = mix(sums + mix(np.arange(g, dtype=np.uint64) + _U(c << 40)))
            out.append(keys[full].astype(np.int64))
        return np.concatenate(out)


def point(x: np.ndarray, mixed: np.ndarray) -> bytes:
    """Counts of about len / 2 groups (a power of two of them, 8 bits each), then a 16-bit sum of the members of each; empty if a count doesn't fit."""
    bits = min(14, max(3, (len(x) // 2).bit_length()))
    cuts = np.searchsorted(x, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits))
    counts = np.diff(np.append(cuts, len(x)))
    if counts.max() > 255:
        return b""
    total = np.append(_U(0), np.cumsum(mixed))
    sums = total[np.append(cuts[1:], len(x))] - total[cuts]
    return counts.astype(np.uint8).tobytes() + (sums & _U(0xFFFF)).astype("<u2").tobytes()


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vector) // 3
    return np.frombuffer(vector, np.uint8, n).astype(np.int32), np.frombuffer(vector, "<u2", n, n)


def fold(vector: np.ndarray, dims: int) -> np.ndarray:
    """Counts (or sums) of fewer groups from those of more."""
    return vector.reshape(dims, -1).sum(axis=1, dtype=vector.dtype)


def overlap_bound(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of coordinate minima; one less where counts agree and the sums of the members don't."""
    dims = min(len(a[0]), len(b[0]))
    if not dims:
        return 1 << 60
    (x, p), (y, q) = ((v if len(v[0]) == dims else (fold(v[0], dims), fold(v[1], dims))) for v in (a, b))
    return int(np.minimum(x, y).sum()) - int(np.count_nonzero((x == y) & (p != q)))


class CountTree:
    """An R-tree over count vectors, packed by splitting at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, plan: Plan):
        self.points, self.sizes, self.plan = points, sizes, plan
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.below: list = []
        self._pack(np.arange(len(points)))

    def _pack(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        node = len(self.high)
        self.high.append(own.max(axis=0))
        self.least.append(int(self.sizes[rows].min()))
        self.most.append(int(self.sizes[rows].max()))
        self.below.append(rows)
        if len(rows) > LEAF:
            spread = own.max(axis=0) - own.min(axis=0)
            size = self.sizes[rows]
            by = size if size.max() - size.min() > spread.max() else own[:, int(spread.argmax())]
            order = rows[np.argsort(by, kind="stable")]
            half = len(rows) // 2
            self.below[node] = (self._pack(order[:half]), self._pack(order[half:]))
        return node

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Rows of points whose bound reaches what a link with (q, n) needs."""
        plan, out, stack = self.plan, [], [0]
        while stack:
            node = stack.pop()
            if self.most[node] * plan.den < plan.num * n or self.least[node] * plan.num > plan.den * n:
                continue
            if np.minimum(q, self.high[node]).sum() < plan.need(n + self.least[node]):
                continue
            below = self.below[node]
            if isinstance(below, tuple):
                stack += below
            else:
                out.append(below[np.minimum(q, self.points[below]).sum(axis=1) >= plan.need(n + self.sizes[below])])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _PIECE):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _node(x: np.ndarray, mixed: np.ndarray) -> int:
    """A set's node: the hash of the set."""
    total = (3 * int(x.sum(dtype=_U)) + int(mixed.sum(dtype=_U)) + len(x)) % (1 << 64)
    return int(mix(np.array([total], _U)).astype(np.int64)[0])


_NODES = "doc_id long, n long, node long, vector binary"


def _sets_of(texts: list[bytes], k: int, seen: set[int]) -> Iterator[tuple[int, int | None, np.ndarray | None, np.ndarray | None]]:
    """(size, node, set, its hashes mixed once more) of each text; no set for a copy of one in ``seen``."""
    for a, z in _pieces(texts):
        for x in Words(texts[a:z]).shingles(k):
            if not len(x):
                yield 0, None, None, None
                continue
            mixed = mix(x ^ _U(0xA5A5A5A5A5A5A5A5))
            node = _node(x, mixed)
            if node in seen:
                yield len(x), node, None, None
            else:
                seen.add(node)
                yield len(x), node, x, mixed


def _nodes(k: int):
    """(doc_id, text) -> the node of each document, and its point where the task meets it first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for b in batches:
            rows = [(n, node, None if x is None else point(x, mixed)) for n, node, x, mixed in _sets_of([t or b"" for t in b.column(1).to_pylist()], k, seen)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))],
                                             names=["doc_id", "n", "node", "vector"])

    return trimmed(run)


def _sent(k: int, num: int, den: int, exact: bool):
    """(doc_id, text) -> (node, signature)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        plan, seen = Plan(num, den, exact), set()
        nodes, sent, held = [], [], 0

        def batch() -> pa.RecordBatch:
            own = np.repeat(np.array(nodes, np.int64), [len(s) for s in sent])
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sent))], names=["node", "sig"])

        for b in batches:
            for _, node, x, mixed in _sets_of([t or b"" for t in b.column(1).to_pylist()], k, seen):
                if x is not None:
                    nodes.append(node)
                    sent.append(plan.signatures(x, mixed))
                    held += len(sent[-1])
                if held > _SENT:
                    yield batch()
                    nodes, sent, held = [], [], 0
        if nodes:
            yield batch()

    return trimmed(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            for a, z in _pieces(texts):
                found = [(_node(x, mix(x ^ _U(0xA5A5A5A5A5A5A5A5))), x.astype(np.int64)) for x in Words(texts[a:z]).shingles(k) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                                  pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return trimmed(run)


def _bounded(num: int, den: int):
    """Pairs (a, b, n_a, n_b, vector_a, vector_b) -> those whose bound reaches what a link needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        for b in batches:
            keep = [overlap_bound(unpacked(va), unpacked(vb)) >= plan.need(na + nb) for na, nb, va, vb in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return trimmed(run)


def coarse(vector: bytes) -> bytes:
    """Counts of a quarter of the groups and 8-bit sums of their members, which travel with each signature; empty if a count doesn't fit."""
    if not vector:
        return b""
    dims = max(8, len(vector) // 12)
    counts, sums = (fold(x, dims) for x in unpacked(vector))
    return counts.astype(np.uint8).tobytes() + (sums & 0xFF).astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, vector) -> (node, n, coarse vector)."""
    for b in batches:
        yield b.set_column(2, "vector", pa.array(map(coarse, b.column(2).to_pylist()), pa.binary()))


class _Index:
    """The nodes of one block: a tree over coarse counts for each number of coordinates."""

    def __init__(self, plan: Plan):
        self.plan, self.rows, self.parts = plan, [], None

    def add(self, node: int, comp: int, n: int, vector: bytes) -> None:
        self.rows.append((node, comp, n, vector))

    def search(self, n: int, vector: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, components, bounds) of what may link."""
        if self.parts is None:
            by: dict[int, list] = {}
            for r in self.rows:
                by.setdefault(len(r[3]), []).append(r)
            self.parts = []
            for dims, rows in by.items():
                both = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), dims)
                dims //= 2
                counts, sums = both[:, :dims].astype(np.int32), both[:, dims:]
                node, comp, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(3))
                tree = CountTree(counts.reshape(len(rows), min(TREE_DIMS, dims), -1).sum(axis=2), sizes, self.plan) if dims else None
                self.parts.append((dims, counts, sums, node, comp, sizes, tree))
        found = []
        whole = np.frombuffer(vector, np.uint8)
        mine, its = whole[:len(whole) // 2].astype(np.int32), whole[len(whole) // 2:]
        for dims, counts, sums, node, comp, sizes, tree in self.parts:
            if not dims or not len(mine):  # nothing known: the sizes alone
                rows = np.arange(len(node))
                bound = np.minimum(sizes, n)
            else:
                low = min(TREE_DIMS, dims)
                rows = tree.search(fold(mine, low), n) if len(mine) >= low else np.arange(len(node))
                same = min(dims, len(mine))
                c, m = counts[rows].reshape(len(rows), same, dims // same).sum(axis=2), fold(mine, same)
                bound = np.minimum(c, m).sum(axis=1)
                near = np.flatnonzero(bound >= self.plan.need(n + sizes[rows]))  # equal counts of different members: one less
                differ = sums[rows[near]].reshape(len(near), same, dims // same).sum(axis=2, dtype=np.uint8) != fold(its, same)
                bound[near] -= np.count_nonzero((c[near] == m) & differ, axis=1)
            fit = bound >= self.plan.need(n + sizes[rows])
            rows = rows[fit]
            found.append((node[rows], comp[rows], bound[fit]))
        if not found:  # no node fell into this block
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _likeliest(num: int, den: int):
    """Rows (signature, block, part, query, node, component, main, n, vector), sorted -> each query's pair of the highest bound out of its component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        key, index = None, None
        for b in batches:
            pairs = set()
            for sig, block, part, query, node, comp, _, n, vector in zip(*(c.to_pylist() for c in b.columns)):
                if (sig, block, part) != key:
                    key, index = (sig, block, part), _Index(plan)
                if not query:
                    index.add(node, comp, n, vector)
                    continue
                other, its, bound = index.search(n, vector)
                other, bound = other[its != comp], bound[its != comp]
                pairs.update((min(node, o), max(node, o)) for o in other[np.lexsort((other, -bound))[:1]].tolist())
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return trimmed(run)


def _asked(node: int, comp: int, main: int, other: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Which nodes a query is compared with: of two outside the main component the greater asks."""
    return (its != comp) & ((its == main) | (other < node))


_MET = "sig long, query boolean, node long, comp long, main long"


def _met(num: int, den: int):
    """Rows (signature, block, part, query, node, component, main, n, vector), sorted -> the queries that may link, and the nodes that they may link with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        key, index, seen = None, None, set()
        for b in batches:
            rows = []
            for sig, block, part, query, node, comp, main, n, vector in zip(*(c.to_pylist() for c in b.columns)):
                if (sig, block, part) != key:
                    key, index, seen = (sig, block, part), _Index(plan), set()
                if not query:
                    index.add(node, comp, n, vector)
                    continue
                other, its, _ = index.search(n, vector)
                ask = _asked(node, comp, main, other, its)
                if not ask.any():
                    continue
                rows.append((sig, True, node, comp, main))
                fresh = [(o, c) for o, c in zip(other[ask].tolist(), its[ask].tolist()) if o not in seen]
                seen.update(o for o, _ in fresh)
                rows += [(sig, False, o, c, main) for o, c in fresh]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.bool_(), *[pa.int64()] * 3))],
                                                 names=["sig", "query", "node", "comp", "main"])

    return trimmed(run)


class _Joined:
    """What is connected so far: components joined by links."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, comp: int) -> int:
        while (up := self.above.get(comp, comp)) != comp:
            self.above[comp] = self.above.get(up, up)
            comp = up
        return comp

    def join(self, a: int, b: int) -> bool:
        """False if they were connected before."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def _overlaps(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of the set ``x`` with each other one (all sorted, none empty)."""
    every = np.concatenate(others)
    hit = x.take(np.searchsorted(x, every), mode="clip") == every
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _linked(num: int, den: int):
    """Rows (signature, block, part, query, node, component, main, n, vector, shingles), sorted -> links that join components of their cell.

    A link is verified on the sets.  Nodes that earlier links of the cell connect are not compared, so
    that fewer links come out than rows went in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den)
        key, index, sets, joined = None, None, {}, _Joined()
        for b in batches:
            links = []
            shingles = b.column(9)
            for i, (sig, block, part, query, node, comp, main, n, vector) in enumerate(zip(*(b.column(j).to_pylist() for j in range(9)))):
                if (sig, block, part) != key:
                    key, index, sets, joined = (sig, block, part), _Index(plan), {}, _Joined()
                x = np.sort(shingles[i].values.to_numpy())
                if not query:
                    index.add(node, comp, n, vector)
                    sets[node] = x
                    continue
                other, its, bound = index.search(n, vector)
                ask = np.flatnonzero(_asked(node, comp, main, other, its))
                left = [(o, c) for o, c in zip(*(v[ask[np.argsort(-bound[ask], kind="stable")]].tolist() for v in (other, its)))]
                many = 8  # the likeliest first: what they connect need not be looked at
                while left:
                    own = joined.root(comp)
                    left = [(o, c) for o, c in left if joined.root(c) != own]
                    now, held = [], 0
                    while len(now) < min(many, len(left)) and (not now or held + len(sets[left[len(now)][0]]) <= COMPARED):
                        held += len(sets[left[len(now)][0]])
                        now.append(left[len(now)])
                    left, many = left[len(now):], 2 * many
                    if now:
                        for (o, c), both in zip(now, _overlaps(x, [sets[o] for o, _ in now]).tolist()):
                            if both >= plan.need(n + len(sets[o])) and joined.join(comp, c):
                                links.append((min(node, o), max(node, o)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links)], names=["a", "b"])

    return trimmed(run)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable.

    Alternating large and small stars; each round is settled in the shared folder.
    """
    def starry(e: DataFrame) -> bool:
        """Every node points at one root, and no root points anywhere."""
        own = e.groupBy("a").agg(F.count("*").alias("n"))
        return own.filter("n > 1").unionAll(own.join(e.select(F.col("b").alias("a")), "a", "left_semi")).isEmpty()

    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    while not starry(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = settle(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), label)
    collect(e.sparkSession)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                       exact: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link at similarity num / den."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    table = settle(slim.mapInArrow(_nodes(k), _NODES), "join-nodes")
    points = table.filter("vector is not null").select("node", "n", "vector").dropDuplicates(["node"])
    # Signatures are as large as the text: they are computed twice and never stored.  Counted before the
    # shuffle, they tell which are shared; only those travel with their nodes, a frequent one to many tasks.
    sent = slim.mapInArrow(_sent(k, num, den, exact), "node long, sig long")
    shared = settle(sent.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n")).filter("lead <> last").drop("last"), "join-shared")
    member = settle(salted_join(with_maybe(sent, "sig", shared, "m").filter("m").drop("m"), shared.drop("n"), "sig", shared.select("sig", "n"), ["node"]).distinct(), "join-members")
    light = settle(points.mapInArrow(_coarse, "node long, n long, vector binary"), "join-coarse")
    collect(docs.sparkSession)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of distinct nodes, settled."""
        wanted = settle(table.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "join-wanted")
        texts = with_maybe(slim, "doc_id", wanted, "__m").filter("__m").select("text")
        sets = settle(texts.mapInArrow(_sets(k), "node long, shingles array<long>"), "join-sets")
        if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # rows of one id or of a null id
            sets = settle(sets.dropDuplicates(["node"]), "join-sets")
        collect(docs.sparkSession)
        return sets

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        pairs = settle(pairs, "join-pairs")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        joined = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
                  .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"))
        both = F.size(F.array_intersect("x", "y")).cast("long")
        return settle(joined.filter((num + den) * both >= num * (F.size("x") + F.size("y"))).select("a", "b").distinct(), "join-links")

    # First: each node with the least node of its signatures, the one it shares most of them with.
    star = (member.filter("node <> lead").groupBy("node", "lead").count()
            .groupBy("node").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
            .select(F.col("lead").alias("a"), F.col("node").alias("b")))
    at = lambda x: points.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}"))
    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole count vectors don't rule out a link."""
        return (pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", "n_a", "n_b", "v_a", "v_b")
                .mapInArrow(_bounded(num, den), "a long, b long"))

    near = settle(star, "join-near")
    first = components(verified(close(near)))

    # Then: what is still apart below a signature; first the likeliest pair of each node, then all.
    column = ["sig", "block", "part", "query", "node", "comp", "main", "n", "vector"]
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    mine = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")

    def cells(rows: DataFrame, asks: DataFrame) -> DataFrame:
        """Rows of signatures of so many ``blocks`` and ``shares``: a cell holds a block of the index and a share of the queries; both are bounded."""
        index = rows.withColumn("block", mine("blocks", 1)).withColumn("part", each("shares")).withColumn("query", F.lit(False))
        query = asks.withColumn("part", mine("shares", 2)).withColumn("block", each("blocks")).withColumn("query", F.lit(True))
        return index.unionByName(query)

    def dealt(cells: DataFrame) -> DataFrame:
        return cells.repartition("sig", "block", "part").sortWithinPartitions("sig", "block", "part", "query")

    def apart(root: DataFrame, best: bool) -> DataFrame:
        """The rows of signatures whose nodes are still apart, and their queries, in cells; ``best``: each node asks below its largest signature only."""
        placed = settle(member.select("sig", "node").join(root, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("comp")), "join-placed")
        open_ = (placed.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("comp", "node").alias("main"))
                 .filter("c0 <> c1").select("sig", "main", "m", F.ceil(F.col("m") / INDEX).cast("int").alias("blocks"), F.ceil(F.col("m") / ASKS).cast("int").alias("shares")))
        rows = placed.join(open_, "sig")
        asks = rows.filter("comp <> main")
        if best:
            asks = asks.join(asks.groupBy("node").agg(F.max_by("sig", F.struct("m", "sig")).alias("sig")), ["node", "sig"])
            rows = rows.join(asks.select("sig").distinct(), "sig", "left_semi")
        return dealt(cells(rows, asks).join(light, "node").select(column))

    def likeliest(root: DataFrame) -> DataFrame:
        found = settle(apart(root, True).mapInArrow(_likeliest(num, den), "a long, b long").distinct(), "join-found")
        collect(docs.sparkSession)
        return found

    def left_over(root: DataFrame) -> DataFrame:
        """Links that connect all that is still apart."""
        met = settle(apart(root, False).mapInArrow(_met(num, den), _MET).distinct(), "join-met")
        sets = sets_of(met.select("node").distinct())
        sized = settle(met.join(light, "node"), "join-sized")
        of = lambda least, most, query: F.greatest(F.lit(1), *(F.ceil(F.sum(F.when(F.col("query") == query, x)) / y).cast("int") for x, y in ((F.lit(1), least), (F.col("n"), most))))
        counts = sized.groupBy("sig").agg(of(INDEX, HELD, False).alias("blocks"), of(ASKS, ASKED, True).alias("shares"))
        rows = sized.join(counts, "sig")
        found = cells(rows.filter("not query"), rows.filter("query")).select(column).join(sets, "node").select(*column, "shingles")
        return settle(dealt(found).mapInArrow(_linked(num, den), "a long, b long").distinct(), "join-left")

    def merged(root: DataFrame, more: DataFrame) -> DataFrame:
        """(node, root) with more links: only those between components are left to follow."""
        here = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        between = more.join(here("a"), "a", "left").join(here("b"), "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        above = components(between)
        return settle(root.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                      .select("node", F.coalesce("top", "root").alias("root"))
                      .unionByName(above.join(root.select("node"), "node", "left_anti")), "join-roots")

    root, tried = first, near
    for _ in range(BEST_ROUNDS):
        found = settle(likeliest(root).join(tried, ["a", "b"], "left_anti"), "join-asked")
        root, tried = merged(root, verified(close(found))), settle(tried.unionByName(found), "join-tried")
    root = merged(root, left_over(root))

    copies = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    joined = copies.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = joined.filter("root <> node").select("root").distinct()
    grouped = joined.join(whole, "root", "left_semi")
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "root").select("node", "component_id").unionByName(
        joined.join(whole, "root", "left_anti").filter("rows > 1").select("node", F.col("id").alias("component_id")))
    return table.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
