"""Hard negatives from k-means inverted lists with stored radii.

Centroids are fitted on a bounded sample; every row is then put on the list of its nearest
centroid, and each list keeps the largest distance from its centroid.  A list can't hold a row
that scores more than anchor . centroid + |anchor| * radius, nor less than the difference
(Cauchy-Schwarz).  Anchors visit lists by that upper bound, in rounds of doubling width: a list
outside an anchor's window is skipped, and an anchor stops when the bound falls strictly below
the worst score that it would still return.  So results are exact, whatever the centroids.

A visit is a join of a block of anchors with the blocks of a list; blocks are bounded, so a
large list or a popular centroid is many rows of the join, and each is one matrix product in
double precision, exact for these integers (beyond 2**53, or for vectors that wide, Python's integers are used).

Defined results: rows with a null id, label or vector, or a null or non-finite component take
no part.  A shorter vector counts as padded with zeros.  Repeated rows are candidates each, and
``other`` rows are rows of another id; equal anchors (id, label and vector) are one anchor.
Ties go to the smaller id.  An anchor without positives, or a positive without negatives, has no rows.  A
score that a long can't hold becomes the nearest long.  An empty table gives an empty
result.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import release, settle, trimmed

#: Rows on which the centroids are fitted (those of the least hashes), and rounds of fitting.
SAMPLE, FIT_ROUNDS = 1 << 14, 8
#: Most centroids: they are sent to every task. About half the root of the rows otherwise.
CENTROIDS = 1 << 12
#: Rows of a list in a block, anchors in a block.
LISTED, ASKING = 1 << 11, 1 << 8
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str, every: int = 7) -> DataFrame:
    """id, label, vector (doubles with whole values): floor(256 * x), the label moved on where ``every`` divides the id."""
    v, i = F.col(vector_col), F.col(id_col).cast("long")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    moved = F.when(i % every == 0, (F.col(label_col).cast("long") + 1) % 10).otherwise(F.col(label_col).cast("long"))
    rows = table.filter(i.isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).filter(~bad)
    # floor in double: a component beyond a long stays what it is
    whole = F.transform(v, lambda x: F.rint(256.0 * x.cast("double")) - (F.rint(256.0 * x.cast("double")) > 256.0 * x.cast("double")).cast("double"))
    return rows.select(i.alias("id"), moved.alias("label"), whole.alias("vector"))


def fitted(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k centroids of the rows, by Lloyd's rounds from evenly spaced rows."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)
        order = np.argsort(near, kind="stable")
        there, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        centroids[there] = sums / np.diff(np.append(first, len(order)))[:, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    return np.concatenate([(half - rows[lo:lo + 4096] @ centroids.T).argmin(axis=1) for lo in range(0, len(rows), 4096)] or [np.zeros(0, int)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of ``width``."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _listed(kind: str, width: int, shared):
    """A task's rows -> with their list and their distance from its centroid."""
    schema = pa.schema([("list", pa.int32()), ("away", pa.float64()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        centroids = shared.value
        for b in batches:
            m = _matrix(b.column("vector"), width)
            with np.errstate(over="ignore", invalid="ignore"):
                near = nearest(m, centroids)
                away = np.sqrt(((m - centroids[near]) ** 2).sum(axis=1))
            away[np.isnan(away)] = np.inf
            m = np.ascontiguousarray(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(away), b.column("id"), b.column("label"),
                                              pa.array([r.tobytes() for r in m], pa.binary())], schema=schema)

    return run


def listed_blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(list, block, ids, labels, vectors: rows of a list in blocks of about ``size``, by id), (list, radius, parts)."""
    lists = settle(rows.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
                   .select("list", "radius", F.ceil(F.col("n") / size).cast("int").alias("parts")), "negatives-lists")
    dealt = rows.join(F.broadcast(lists.select("list", "parts")), "list").withColumn("block", F.pmod(F.xxhash64("id", "vector"), "parts").cast("int"))
    packed = F.array_sort(F.collect_list(F.struct("id", "label", "vector")))
    return settle(dealt.groupBy("list", "block").agg(packed.alias("rows")).select(
        "list", "block", F.col("rows.id").alias("ids"), F.col("rows.label").alias("labels"), F.col("rows.vector").alias("vectors")), "negatives-blocks"), lists


def _packed(size: int):
    """A task's anchors, alike ones together -> blocks of them."""
    schema = pa.schema([("asking", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        asking = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                yield pa.RecordBatch.from_arrays([pa.array([asking], pa.int64()), *(
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("id", "label", "vector"))], schema=schema)
                asking += 1

    return run


def _stacked(vectors: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), kind).astype(float).reshape(len(vectors), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-valued rows: doubles that hold them, or Python's integers, clipped to a long."""
    with np.errstate(over="ignore"):
        if np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0)) < 2.0 ** 52:
            return a @ b.T
    x, y = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, _LEAST, _MOST)


#: A search: each anchor (place ``i`` in its block) has windows ``w``; a row must score from ``lo`` to ``hi``, and at least ``least`` to be returned.
_ASKED = "array<struct<i:int,w:int,lo:bigint,hi:bigint,least:bigint>>"


def _windows(b: pa.RecordBatch, j: int) -> dict[str, np.ndarray]:
    flat = b.column("asked")[j].values
    return {c: flat.field(c).to_numpy() for c in ("i", "w", "lo", "hi", "least")}


def _planned(kind: str, width: int, shared, begin: int, end: int):
    """Blocks of anchors -> the lists at places ``begin`` to ``end`` in an anchor's order that may hold a row for it, and for ``who`` (places of windows)."""
    schema = pa.schema([("asking", pa.int64()), ("list", pa.int32()), ("who", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        centroids, lists, radii = shared.value
        for b in batches:
            for j in range(b.num_rows):
                m, ask = _stacked(b.column("vectors")[j].values, kind, width), _windows(b, j)
                with np.errstate(over="ignore", invalid="ignore"):
                    at, away = m @ centroids.T, np.outer(np.sqrt((m * m).sum(axis=1)), radii)
                    away += 1e-9 * (1 + np.abs(at) + away + np.outer(np.sqrt((m * m).sum(axis=1)), np.sqrt((centroids * centroids).sum(axis=1))))  # rounding
                    upper, lower = at + away, at - away
                upper[~np.isfinite(upper)], lower[~np.isfinite(lower)] = np.inf, -np.inf  # not known: visit
                place = np.empty(upper.shape, int)
                np.put_along_axis(place, np.argsort(-upper, axis=1, kind="stable"), np.arange(upper.shape[1])[None, :], axis=1)
                i = ask["i"]
                fits = (upper[i] >= np.maximum(ask["lo"], ask["least"])[:, None]) & (lower[i] <= ask["hi"][:, None]) & (place[i] >= begin) & (place[i] < end)
                visited = np.flatnonzero(fits.any(axis=0))
                who = [np.flatnonzero(fits[:, x]) for x in visited]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(visited), b.column("asking")[j].as_py())), pa.array(lists[visited], pa.int32()),
                                                  pa.array(who, pa.list_(pa.int32()))], schema=schema)

    return run


def best_of(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest valid scores of each row; ties go to the smaller column."""
    some = np.flatnonzero(valid.any(axis=1))
    scores, valid = scores[some], valid[some]
    held = np.where(valid, scores, -np.inf)
    if held.shape[1] > k:
        kth = np.partition(held, held.shape[1] - k, axis=1)[:, [held.shape[1] - k]] if held.dtype != object else np.sort(held, axis=1)[:, [held.shape[1] - k]]
        valid = valid & (held >= kth)
    row, column = np.nonzero(valid)
    if scores.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda x: (row[x], -scores[row[x], column[x]], column[x])), int)
    else:
        order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return some[row[rank < k]], column[rank < k]


def _scored(kind: str, width: int, same: bool, k: int):
    """Pairs of a block of anchors and a block of a list -> the best rows of it for each window."""
    schema = pa.schema([("asking", pa.int64()), ("i", pa.int32()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for j in range(b.num_rows):
                who = b.column("who")[j].values.to_numpy()
                ask = {c: x[who] for c, x in _windows(b, j).items()}
                ids, labels, its, its_labels = (b.column(c)[j].values.to_numpy() for c in ("ids", "labels", "its_ids", "its_labels"))
                scores = products(_stacked(b.column("vectors")[j].values, kind, width), _stacked(b.column("its_vectors")[j].values, kind, width))
                alike = (labels[:, None] == its_labels) & (ids[:, None] != its) if same else labels[:, None] != its_labels
                i = ask["i"]
                mine = scores[i]
                row, column = best_of(mine, alike[i] & (mine >= np.maximum(ask["lo"], ask["least"])[:, None]) & (mine <= ask["hi"][:, None]), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), b.column("asking")[j].as_py())), pa.array(i[row], pa.int32()), pa.array(ask["w"][row], pa.int32()),
                     pa.array(its[column]), pa.array([int(x) for x in mine[row, column]], pa.int64())], schema=schema)

    return run


class Lists:
    """Inverted lists of ``rows`` (id, label, vector)."""

    def __init__(self, rows: DataFrame, kind: str):
        spark = rows.sparkSession
        self.kind = kind
        n, self.width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        self.empty = not n
        if self.empty:
            return
        self.width = max(1, self.width)
        take = max(1, min(SAMPLE, (1 << 20) // self.width))
        sample = rows.orderBy(F.xxhash64("id", "vector")).limit(take).select("vector").toArrow().column("vector").combine_chunks()
        k = max(1, min(int(math.sqrt(n) / 2), CENTROIDS, take, (1 << 21) // self.width))
        with np.errstate(over="ignore", invalid="ignore"):
            centroids = fitted(_matrix(sample, self.width), k)
        self.rows = settle(rows.mapInArrow(trimmed(_listed(kind, self.width, spark.sparkContext.broadcast(centroids))),
                                           "list int, away double, id long, label long, vector binary"), "negatives-rows")
        self.blocks, self.lists = listed_blocks(self.rows, LISTED)
        radii = self.lists.select("list", "radius").toPandas()
        self.shared = spark.sparkContext.broadcast((centroids[radii["list"]], radii["list"].to_numpy(), radii["radius"].to_numpy()))

    def search(self, asking: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """asking, i, w, id, score, rank: for each window (asking, i, w, lo, hi) its k best rows of the same or of other labels."""
        order = Window.partitionBy("asking", "i", "w").orderBy(F.col("score").desc(), "id")
        best, begin, end = None, 0, 4
        while begin < len(self.shared.value[1]):
            now = windows.withColumn("least", F.lit(_LEAST))
            if best is not None:
                worst = best.groupBy("asking", "i", "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
                now = windows.join(worst, ["asking", "i", "w"], "left").withColumn("least", F.coalesce("worst", F.lit(_LEAST)))
            now = now.groupBy("asking").agg(F.collect_list(F.struct("i", "w", "lo", "hi", "least")).cast(_ASKED).alias("asked"))
            asked = settle(asking.join(now, "asking"), "negatives-asked")
            visits = asked.mapInArrow(trimmed(_planned(self.kind, self.width, self.shared, begin, end)), "asking long, list int, who array<int>")
            visits = visits.join(F.broadcast(self.lists.select("list", "parts")), "list").select("asking", "list", "who", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
            its = self.blocks.select("list", "block", F.col("ids").alias("its_ids"), F.col("labels").alias("its_labels"), F.col("vectors").alias("its_vectors"))
            scored = visits.join(asked, "asking").join(its, ["list", "block"]).mapInArrow(
                trimmed(_scored(self.kind, self.width, same, k)), "asking long, i int, w int, id long, score long")
            every = scored if best is None else scored.unionByName(best)
            best = settle(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "negatives-best")
            begin, end = end, 8 * end
        return best.withColumn("rank", F.row_number().over(order))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 50, moved: int = 7,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """A row for each negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative scores from ``low`` to ``high`` hundredths of its positive.
    """
    kind = "<f4" if dict(table.dtypes)[vector_col] == "array<float>" else "<f8"  # both hold floor(256 * x) exactly
    index = Lists(vectors(table, id_col, label_col, vector_col, moved), kind)
    if index.empty:
        return table.sparkSession.createDataFrame([], _RESULT)
    anchors = index.rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "vector"]).repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    asking = settle(anchors.select("id", "label", "vector").mapInArrow(_packed(ASKING), "asking long, ids array<long>, labels array<long>, vectors array<binary>"), "negatives-asking")
    all_of_it = asking.select("asking", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("i")).select(
        "asking", "i", F.lit(0).alias("w"), F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))
    near = settle(index.search(asking, all_of_it, True, positives), "negatives-positives")
    score = F.col("score").cast("decimal(20,0)")
    windows = near.select("asking", "i", F.col("rank").alias("w"), F.ceil(score * low / 100).cast("long").alias("lo"), F.floor(score * high / 100).cast("long").alias("hi")).filter("lo <= hi")
    far = index.search(asking, windows, False, negatives)
    names = asking.select("asking", F.posexplode("ids").alias("i", "anchor_id"))
    chosen = near.select("asking", "i", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (far.join(chosen, ["asking", "i", "w"]).join(names, ["asking", "i"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
