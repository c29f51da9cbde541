"""Exact dedup by Golomb-coded fingerprint exchange.

Each scan partition sends its sorted distinct fingerprints, Golomb-Rice coded, to
the owners of the fingerprint ranges.  An owner sees which fingerprints occur more
than once and answers with a bitmap per sender.  Only the rows so marked are then
shuffled with their text, and equality is decided on the bytes: each against the row
of its fingerprint that stays, which is found on ids and digests, and goes to all the
tasks over which the rows of a frequent fingerprint are dealt.

Defined results: a null text is the empty text.  Of equal texts the smallest id
stays (null ids last); among rows with that same id any one of them stays.  An
empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, release, rows_with, rows_without, salted_join, settle, small_batches, trimmed, with_maybe

#: Bits of a fingerprint. Fewer bits make messages smaller and suspects more; results don't depend on it.
FP_BITS = 48
_SPACE = b" \t\n\r\x0b\x0c"


def normalise(text: bytes) -> bytes:
    """Every run of [\\x20\\x09-\\x0D] becomes one space."""
    out = b" ".join(text.split())
    if text[:1] in _SPACE and text:
        out = b" " + out
    if out != b" " and text and text[-1:] in _SPACE:
        out += b" "
    return out


def fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - FP_BITS)


def rice_encode(values: np.ndarray, low: int) -> bytes:
    """Sorted distinct values >= low: header (n, k), all unary quotients, then all k-bit remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    quot = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quot + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    body = np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()
    return n.to_bytes(4, "little") + k.to_bytes(1, "little") + len(unary).to_bytes(4, "little") + body


def rice_decode(message: bytes, low: int) -> np.ndarray:
    if not message:
        return np.zeros(0, np.uint64)
    n, k, bits = int.from_bytes(message[:4], "little"), message[4], int.from_bytes(message[5:9], "little")
    cut = 9 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(message[9:cut], np.uint8), count=bits)
    gaps = np.diff(np.flatnonzero(unary == 0), prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(message[cut:], np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= rest[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _bounds(owners: int) -> list[int]:
    return [(o << FP_BITS) // owners for o in range(owners + 1)]


_SCAN = "src int, doc_id long, fp long, sha binary, owner int, message binary, locals binary"


def _scan(owners: int):
    bounds = _bounds(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        src, seen = TaskContext.get().partitionId(), []
        schema = pa.schema([("src", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()),
                            ("owner", pa.int32()), ("message", pa.binary()), ("locals", pa.binary())])
        for b in batches:
            shas = [hashlib.sha256(normalise(t or b"")).digest() for t in b.column(1).to_pylist()]
            fps = [fingerprint(x) for x in shas]
            seen += [np.array(fps, np.uint64)]
            n = len(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array([src] * n, pa.int32()), b.column(0), pa.array(fps, pa.int64()), pa.array(shas, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        cuts = np.searchsorted(values, np.array(bounds, np.uint64))
        out = [(o, rice_encode(values[a:z], bounds[o]), np.packbits(counts[a:z] > 1).tobytes())
               for o, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
        m = len(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([src] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
             pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()),
             pa.array([x[2] for x in out], pa.binary())], schema=schema)

    return run


def _answer(owners: int):
    """At an owner: which fingerprints of each message occur elsewhere too, or twice in its own partition."""
    bounds = _bounds(owners)

    def run(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        sent = [rice_decode(m, bounds[owner]) for m in table.column("message").to_pylist()]
        own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool)
               for x, s in zip(table.column("locals").to_pylist(), sent)]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        twice = counts > 1
        for s, flag in zip(sent, own):
            twice[np.searchsorted(values, s[flag])] = True
        maps = [np.packbits(twice[np.searchsorted(values, s)]).tobytes() for s in sent]
        return pa.table({"src": table.column("src"), "owner": table.column("owner"),
                         "bitmap": pa.array(maps, pa.binary())})

    return run


def _mark(owners: int):
    """At a sender: its rows with the owners' bitmaps applied."""
    bounds = np.array(_bounds(owners), np.uint64)

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().astype(np.uint64)
        values = np.unique(fps)
        cuts, flags = np.searchsorted(values, bounds), np.zeros(len(values), bool)
        for o, bitmap in zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist()):
            a, z = cuts[o], cuts[o + 1]
            flags[a:z] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=z - a).astype(bool)
        return pa.table({"doc_id": rows.column("doc_id"), "fp": rows.column("fp"), "sha": rows.column("sha"),
                         "suspect": pa.array(flags[np.searchsorted(values, fps)])})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, fp, sha, text normalised)."""
    for b in batches:
        texts = [normalise(t or b"") for t in b.column(1).to_pylist()]
        shas = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(map(fingerprint, shas), pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.binary())],
            names=["doc_id", "fp", "sha", "body"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    owners = owners or partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scan = settle(slim.mapInArrow(trimmed(_scan(owners)), _SCAN), "dedup-scan")
    replies = (scan.filter("owner is not null").select("src", "owner", "message", "locals")
               .groupBy("owner").applyInArrow(_answer(owners), "src int, owner int, bitmap binary"))
    marked = settle(
        scan.filter("owner is null").select("src", "doc_id", "fp", "sha").groupBy("src")
        .cogroup(replies.groupBy("src"))
        .applyInArrow(_mark(owners), "doc_id long, fp long, sha binary, suspect boolean"), "dedup-marked")
    single = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))

    # Which row of a fingerprint stays is told by ids and digests; counts come together before the shuffle.
    lead = settle(marked.filter("suspect").groupBy("fp")
                  .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("first"), F.count("*").alias("n"))
                  .select("fp", F.col("first.doc_id").alias("keep_id"), F.col("first.sha").alias("keep_sha"), "n"), "dedup-leads")
    # The fingerprints are a filter on the second scan; texts of the others stay where they are.
    body = settle(with_maybe(slim.mapInArrow(trimmed(_texts), "doc_id long, fp long, sha binary, body binary"), "fp", lead, "m")
                  .filter("m").drop("m").withColumn("row", F.xxhash64("fp", "doc_id", "sha")), "dedup-bodies")
    leads = lead.withColumn("row", F.xxhash64("fp", F.col("keep_id").alias("doc_id"), F.col("keep_sha").alias("sha")))
    ours = leads.select("row", F.col("fp").alias("its"), "keep_id", "keep_sha", "n")
    kept = settle(with_maybe(body, "row", leads, "m").filter("m").drop("m").dropDuplicates(["fp", "doc_id", "sha"]).join(ours, "row")
                  .filter("fp = its and doc_id <=> keep_id and sha = keep_sha").select("fp", "keep_id", "n", F.col("body").alias("kept_body")), "dedup-kept")
    checked = settle(salted_join(body.drop("row"), kept, "fp", lead.select("fp", "n"), ["doc_id", "sha"]).select(
        "doc_id", "fp", "sha", "keep_id", "n", (F.col("body") == F.col("kept_body")).alias("same")), "dedup-checked")
    other = settle(checked.filter("not same").select("fp").distinct(), "dedup-clashes")
    if other.isEmpty():
        groups = checked.select("doc_id", "sha", "keep_id", "n")
    else:  # different texts under one fingerprint: those few are grouped by their bytes
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")
        clash = rows_with(body, "fp", other)
        exact = clash.groupBy("body").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        groups = rows_without(checked, "fp", other).select("doc_id", "sha", "keep_id", "n").unionByName(
            clash.join(exact, "body").select("doc_id", "sha", F.col("first.doc_id").alias("keep_id"), "n"))
    # A row stays if its id is the group's; of several rows with that id, one does.
    stay = groups.filter("doc_id <=> keep_id").groupBy("sha", "keep_id").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    again = stay.filter("rows > 1")
    member = groups.select("doc_id", "keep_id", F.col("n").alias("group_size"), (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("dropped"), "sha")
    lead = stay.select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "sha")
    repeats = again.select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("kept"), "sha",
                           F.explode(F.sequence(F.lit(2).cast("long"), "rows"))).drop("col")
    rest = member.filter("dropped").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "sha")
    return single.unionByName(rest.unionByName(lead).unionByName(repeats)
                              .select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")))


def drop_copies(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows with a null id can't be named by a verdict and stay.
    """
    gone = settle(verdict.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)), "dedup-gone")
    clear = rows_without(docs, id_col, gone)
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    kept = verdict.filter("kept").select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias("__sha"))
    back = (rows_with(docs, id_col, gone).withColumn("__sha", digest).join(kept, [id_col, "__sha"], "left_semi")
            .dropDuplicates([id_col, "__sha"]).select(*docs.columns))
    return clear.select(*docs.columns).unionByName(back)
