"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers stands at
its start or at its end.  Whether it is one depends on the k-mer alone, so equal
passages have equal anchors wherever they stand.  48 k-mers in a row hold an anchor
at least; in a text of fewer that holds none, the k-mer of the smallest hash (the
first of equals) is one, so that no text but the empty one is without.  A fingerprint is the list of
(position, hash) of all anchors of the whole text; two are compared by the longest
chain of equal anchors in the same order.

Defined results: a null text is the empty text with the empty fingerprint; a text
shorter than k has one anchor, its whole; two empty fingerprints are alike to 1, an
empty and another to 0.  In the order of descending ids null ids come last and rows
of one id follow by the hash of their text, then by the text; after the last comes
the first; a row alone is its own next.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, rows_with
from .words import mix

K, S = 64, 16  # S: a power of two
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15) | _U(1)
_PIECE = 400_000  # code points taken at once


def _mers(codes: np.ndarray, size: int, low: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` (a power of two) code points, by doubling."""
    h, n = mix(codes.astype(_U) + _U(1)), 1
    while n < size:
        h = h[:-n] * np.power(_BASE, _U(n)) + h[n:]
        n *= 2
    return h


def _anchors_of(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (positions, 32-bit hashes) of its anchors."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at, values = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(codes) >= k:
        order = mix(_mers(codes, s))
        span = k - s + 1
        low, n = order, 1
        while 2 * n <= span:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < span:
            low = np.minimum(low[:len(order) - span + 1], low[span - n:])
        first = order[:len(low)] == low
        last = order[span - 1:] == low
        at = np.flatnonzero(first | last)
        at = at[ends[np.searchsorted(ends, at, side="right")] >= at + k]  # not across the end of a text
        h = _mers(codes, s)

        def hashes(at: np.ndarray) -> np.ndarray:
            """Of the k-mers at ``at``, from the hashes of their s-mers side by side."""
            whole = np.zeros(len(at), _U)
            for j in range(0, k - s + 1, s):
                whole = whole * np.power(_BASE, _U(s)) + h[at + j]
            if k % s:
                whole = whole * _BASE + h[at + k - s]
            return (mix(whole) >> _U(32)).astype(np.uint32)

        starts, held = ends - sizes, np.searchsorted(at, np.append(0, ends))
        without = np.flatnonzero((sizes >= k) & (held[1:] == held[:-1]))
        if len(without):  # shorter than 2k - s each
            least = [starts[i] + int(hashes(np.arange(starts[i], ends[i] - k + 1)).argmin()) for i in without]
            at = np.sort(np.append(at, np.array(least, np.int64)))
        values = hashes(at)
    cut = np.searchsorted(at, np.append(0, ends))
    out = []
    for i, t in enumerate(texts):
        if 0 < len(t) < k:
            short = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest()
            out.append((np.zeros(1, np.int64), np.frombuffer(short, "<u4")))
        else:
            a, z = cut[i], cut[i + 1]
            out.append((at[a:z] - (ends[i] - sizes[i]), values[a:z]))
    return out


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < _PIECE):
            size += len(texts[end])
            end += 1
        out += _anchors_of(texts[start:end], k, s)
        start = end
    return out


def printed(found: tuple[np.ndarray, np.ndarray]) -> str:
    """base64 of gaps between positions (7 bits a byte, low first) and hashes, anchor by anchor."""
    at, values = found
    if not len(at):
        return ""
    gaps = np.diff(at, prepend=0)
    if gaps.max() < 128:
        raw = np.zeros(len(at), np.dtype([("gap", "u1"), ("hash", "<u4")]))
        raw["gap"], raw["hash"] = gaps, values
        data = raw.tobytes()
    else:
        parts = []
        for g, v in zip(gaps.tolist(), values.tolist()):
            while g > 127:
                parts.append(bytes((g & 127 | 128,)))
                g >>= 7
            parts.append(bytes((g,)) + v.to_bytes(4, "little"))
        data = b"".join(parts)
    return base64.b64encode(data).decode()


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data, at, here, places, values = base64.b64decode(fingerprint), 0, 0, [], []
    while at < len(data):
        shift = 0
        while True:
            here += (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        places.append(here)
        values.append(int.from_bytes(data[at:at + 4], "little"))
        at += 4
    return np.array(places, np.int64), np.array(values, np.uint32)


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two lists, exactly.

    Over the pairs of equal anchors (Hunt and Szymanski) while these are few, else
    row by row over bits: no more than len(x) * len(y) / 64 steps on words.
    """
    both = set(x) & set(y)
    x, y = [v for v in x if v in both], [v for v in y if v in both]
    if len(both) < 2:
        return min(len(x), len(y))
    if len(y) < len(x):
        x, y = y, x
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(len(y) - 1, -1, -1):
        places[y[i]].append(i)  # from the last, so that no two of one anchor follow each other
    if sum(len(places[v]) for v in x) <= 8 * (len(x) + len(y)):
        tails: list[int] = []
        for v in x:
            for i in places[v]:
                k = bisect_left(tails, i)
                tails[k:k + 1] = [i]
        return len(tails)
    full = (1 << len(y)) - 1
    masks: dict[int, int] = {}
    for v in both:
        bits = bytearray(len(y) // 8 + 1)
        for i in places[v]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[v] = int.from_bytes(bits, "little")
    row = full  # a 0 bit for each step of the length
    for v in x:
        hit = row & masks[v]
        row = (row + hit | row - hit) & full
    return len(y) - row.bit_count()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Twice the longest common chain of anchors over all anchors of both."""
    x, y = a[1], b[1]
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    chain = 0
    for step in (1, -1):  # what is the same at the start, then at the end
        n = min(len(x), len(y))
        differs = np.flatnonzero(x[::step][:n] != y[::step][:n])
        same = int(differs[0]) if differs.size else n
        chain += same
        x, y = (x[same:], y[same:]) if step == 1 else (x[:len(x) - same], y[:len(y) - same])
    if len(x) and len(y) and np.isin(y, x).any():
        chain += _common(x.tolist(), y.tolist())
    return 2 * chain / (len(a[1]) + len(b[1]))


def edited(text: str, after: str) -> str:
    """The last third (rounded down) replaced by as many of the first code points of ``after``."""
    m = len(text) // 3
    return text[:len(text) - m] + after[:m]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, text, extra) in order; a row is compared with the one after it in its bucket."""
    held: list[tuple] = []
    for b in batches:
        rows = held + list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [t or "" for t in b.column(2).to_pylist()], b.column(3).to_pylist()))
        held = rows[-1:]
        pairs = [(p, q) for p, q in zip(rows, rows[1:]) if not p[3] and p[0] == q[0]]
        if not pairs:
            continue
        texts = [r[2] for r in rows]
        own = dict(zip(map(id, rows), anchors(texts)))
        changed = [edited(p[2], q[2]) for p, q in pairs]
        far = anchors(changed)
        yield pa.RecordBatch.from_arrays([
            pa.array([p[1] for p, _ in pairs], pa.int64()), pa.array([len(p[2]) for p, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
            pa.array([printed(own[id(p)]) for p, _ in pairs]), pa.array(map(printed, far), pa.string()),
            pa.array([likeness(own[id(p)], f) for (p, _), f in zip(pairs, far)], pa.float64()),
            pa.array([likeness(own[id(p)], own[id(q)]) for p, q in pairs], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness.

    Documents are dealt over id ranges and sorted within them; the first row of each
    range goes along to the range before it, so no row is compared across tasks.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "at", F.coalesce("doc_id", F.lit(least)))
    n = buckets or partitions(spark)
    cuts = slim.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], _SCHEMA)
    cuts = sorted(set(cuts), reverse=True)  # bucket i: at >= cuts[i]; at most one number for each task
    # Cuts in groups of about the square root of their number: a row looks at one group of them and at each group's first.
    step = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    above = lambda edges: F.size(F.filter(edges, lambda c: c > F.col("at")))
    group = F.greatest(above(F.array(*[F.lit(g[0]) for g in groups])) - 1, F.lit(0))
    bucket = group * step + above(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group + 1))
    dealt = slim.withColumn("bucket", bucket.cast("int")).withColumn("h", F.xxhash64("text"))
    heads = {r["bucket"]: (r["m"]["at"], r["m"]["h"]) for r in
             dealt.groupBy("bucket").agg(F.max(F.struct("at", "h")).alias("m")).collect()}  # one row for each bucket
    there = sorted(heads)
    before = {b: there[i - 1] for i, b in enumerate(there)}  # the bucket that a head follows; the first follows the last
    keys = spark.createDataFrame([(b, *heads[b], before[b]) for b in there], "bucket int, at long, h long, to int")  # as few rows as buckets
    extra = (rows_with(dealt, "at", keys).join(F.broadcast(keys), ["bucket", "at", "h"])
             .groupBy("to").agg(F.max(F.struct("text", "doc_id")).alias("m"))  # of rows equal in id and hash, the first in order
             .select(F.col("to").alias("bucket"), "m.doc_id", "m.text", F.lit(least).alias("at"), F.lit(least).alias("h"), F.lit(True).alias("extra")))
    rows = dealt.withColumn("extra", F.lit(False)).select("bucket", "doc_id", "text", "at", "h", "extra").unionByName(extra)
    ordered = rows.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions(
        "bucket", "extra", F.desc("at"), F.desc("h"), F.desc("text"))
    return ordered.select("bucket", "doc_id", "text", "extra").mapInArrow(_pairs, _SCHEMA)
