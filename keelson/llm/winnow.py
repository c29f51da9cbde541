"""Benchmark decontamination by winnowing.

Documents and benchmark items are read as words.  Of each run of WINDOW words the least hash
of its WINDOW - GRAM + 1 grams of GRAM words is a fingerprint, on both sides by the same rule,
so a document that holds a window of an item has a fingerprint of it.  Fingerprints meet in a
join by hash.  Each hit carries the words around its gram that a window with it can reach,
is extended to both sides while the words agree, and counts if WINDOW words or more agree: equal
words decide, hashes don't.  An item of fewer than WINDOW words is one window: its hash
meets those of the runs of as many words.

Document fingerprints that are surely no item's stay in their task (``keyset``, bounded; it
decides nothing), rows of a frequent fingerprint are dealt over many tasks, and items of equal
words are one until the end.

Defined results: null and empty texts have no words, no hits and the digest of the empty
string.  Each row of ``docs`` gives a row, repeated ids or rows too.  An item whose id is
null marks words, but isn't counted or named; an id on several items is named once.  Texts of any
length are read whole, in slices that overlap by a window less one word.  Empty tables give no
hits or no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import release, salted_join, settle, trimmed
from .keyset import key_filter, maybe
from .words import Words, mix

#: A window, and the grams whose least hash stands for it.
WINDOW, GRAM = 10, 5
#: Bytes of text taken at once.
_SLICE = 1 << 20
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; runs of different lengths get different hashes."""
    out = np.full(max(0, len(h) - n + 1), _U(n), _U)
    for j in range(n):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[j:len(h) - n + 1 + j])
    return out


def _winnowed(h: np.ndarray, last: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the least gram of each window that starts at ``last`` places; of equal ones the last of a window."""
    g = _grams(h, gram)
    wide = window - gram + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, wide):
        better = g[j:n + j] <= least
        np.copyto(least, g[j:n + j], where=better)
        at[better] = j
    places = np.unique((np.arange(n) + at)[last[:n]])
    return places, g[places]


def slices(text: bytes, overlap: int, size: int = _SLICE) -> Iterator[tuple[bytes, int]]:
    """(part, words of it that the next part has again): cut between words; the next part starts ``overlap`` words back."""
    lo = 0
    while len(text) - lo > size:
        cut = lo + size
        while cut < len(text) and not _BREAKS[_FOLD[text[cut]]]:
            cut += 1
        back, left = cut, overlap
        while back > lo and left:  # to the start of the overlap-th word before the cut
            while back > lo and _BREAKS[_FOLD[text[back - 1]]]:
                back -= 1
            while back > lo and not _BREAKS[_FOLD[text[back - 1]]]:
                back -= 1
            left -= 1
        if back <= lo or cut >= len(text):
            size *= 2  # words so long that a slice holds too few of them
            continue
        yield text[lo:cut], overlap
        lo = back
    yield text[lo:], 0


def _batches(texts: list[bytes], overlap: int, size: int = _SLICE) -> Iterator[list[tuple[int, bytes, int]]]:
    """(text number, slice, words seen again) in lots of about ``size`` bytes; slices of a text in order."""
    lot, n = [], 0
    for i, t in enumerate(texts):
        for part, again in slices(t, overlap, size):
            lot.append((i, part, again))
            n += len(part)
            if n >= size:
                yield lot
                lot, n = [], 0
    if lot:
        yield lot


class _Read:
    """Words of a lot, with their text: ``context(i, a, z)`` are words a to z of slice i, joined by blanks."""

    def __init__(self, lot: list[tuple[int, bytes, int]]):
        self.words = Words([part for _, part, _ in lot], _BREAKS)

    def joined(self, a: int, z: int) -> bytes:
        w = self.words
        return w.data[w.start[a]:w.end[z - 1]].tobytes() if z - a == 1 else b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[a:z].tolist(), w.end[a:z].tolist()))


_SENT = "row long, doc_id long, n_words long, hash long, place long, at int, context string"
_SENT_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()), ("at", pa.int32()), ("context", pa.string())])


def _sent(field, lengths: list[int], window: int, gram: int):
    """A task's texts -> a row for each with its number of words, and a row for each place whose hash may be an item's."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
            seen = np.zeros(len(texts), np.int64)
            for lot in _batches(texts, window - 1):
                read = _Read(lot)
                w = read.words
                left = w.first[w.doc + 1] - np.arange(len(w.doc)) if len(w.doc) else np.zeros(0, np.int64)  # words to the end of the slice
                found = []
                places, keys = _winnowed(w.hash, left >= window, window, gram)
                some = maybe(field.value, keys)
                found.append((places[some], keys[some], reach, gram))
                for n in lengths:
                    keys = _grams(w.hash, n)
                    some = maybe(field.value, keys)
                    some = some[left[some] >= n]
                    found.append((some, keys[some], 0, n))
                offset = np.zeros(len(lot), np.int64)  # words of the text before the slice
                for k, (i, _, again) in enumerate(lot):
                    offset[k] = seen[i]
                    seen[i] += w.first[k + 1] - w.first[k] - again
                out = []
                for places, keys, about, n in found:
                    for p, key in zip(places.tolist(), keys.view(np.int64).tolist()):
                        k = int(w.doc[p])
                        a, z = max(int(w.first[k]), p - about), min(int(w.first[k + 1]), p + n + about)
                        i = lot[k][0]
                        out.append((row + i, key, int(offset[k]) + p - int(w.first[k]), p - a, read.joined(a, z).decode("utf-8", "replace")))
                if out:
                    rows, keys, places, at, contexts = zip(*out)
                    m = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(keys, pa.int64()),
                                                      pa.array(places, pa.int64()), pa.array(at, pa.int32()), pa.array(contexts, pa.string())], schema=_SENT_ARROW)
            m = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + m)), b.column(0), pa.array(seen), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.string())], schema=_SENT_ARROW)
            row += m

    return run


_ITEMS = "item_id long, class binary, hash long, at int, n int, context string"


def _items(window: int, gram: int):
    """A task's items -> a row for each fingerprint with the words around it; ``class`` is the digest of all words."""
    reach = window - gram
    schema = pa.schema([("item_id", pa.int64()), ("class", pa.binary()), ("hash", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = list(slices(text or b"", window - 1))
                digest = hashlib.sha256()
                out = []
                for part, again in parts:
                    read = _Read([(0, part, 0)])
                    w = read.words
                    m = len(w.hash)
                    if m:
                        digest.update(read.joined(0, m - again) + b" ")
                    if m >= window:
                        places, keys = _winnowed(w.hash, np.ones(m, bool), window, gram)
                        n, about = gram, reach
                    elif m and len(parts) == 1:
                        places, keys, n, about = np.zeros(1, np.int64), _grams(w.hash, m), m, 0
                    else:
                        continue
                    for p, key in zip(places.tolist(), keys.view(np.int64).tolist()):
                        a, z = max(0, p - about), min(m, p + n + about)
                        out.append((key, p - a, n if about else -n, read.joined(a, z).decode("utf-8", "replace")))
                if out:
                    keys, at, n, contexts = zip(*out)
                    m = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * m, pa.int64()), pa.array([digest.digest()] * m, pa.binary()), pa.array(keys, pa.int64()),
                                                      pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(contexts, pa.string())], schema=schema)

    return run


def _extended(window: int):
    """Pairs of contexts with the same hash -> the words of the document that agree, where a window is among them."""
    schema = pa.schema([("row", pa.int64()), ("class", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            kept = []
            for j, (p, x, i, y, j_at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("place", "context", "at", "its", "its_at", "n")))):
                x, y = x.split(" "), y.split(" ")
                need, n = (-n, -n) if n < 0 else (window, n)
                if x[i:i + n] != y[j_at:j_at + n]:
                    continue
                before = after = 0
                while before < min(i, j_at) and x[i - before - 1] == y[j_at - before - 1]:
                    before += 1
                while i + n + after < len(x) and j_at + n + after < len(y) and x[i + n + after] == y[j_at + n + after]:
                    after += 1
                if before + n + after >= need:
                    kept.append((j, p - before, p + n + after))
            if kept:
                rows, start, stop = zip(*kept)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row").take(rows), b.column("class").take(rows), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], schema=schema)

    return run


def spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: row, doc_id, n_words), (spans: row, class, start, stop: agreeing words), (items: item_id, class)."""
    slim = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    sides = settle(slim.mapInArrow(trimmed(_items(window, gram)), _ITEMS), "winnow-items")
    lengths = sorted(-r.n for r in sides.filter("n < 0").select("n").distinct().collect())  # fewer than a window
    field = key_filter(sides.select("hash").distinct(), "hash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sent = settle(texts.mapInArrow(trimmed(_sent(field, lengths, window, gram)), _SENT), "winnow-sent")
    hits = sent.filter("hash is not null").select("row", "hash", "place", "at", "context")
    known = sides.select("hash", "class", F.col("at").alias("its_at"), "n", F.col("context").alias("its")).distinct()
    counts = settle(hits.groupBy("hash").agg(F.count("*").alias("n")), "winnow-counts")
    pairs = salted_join(hits, known, "hash", counts, ["row", "place"])
    found = pairs.select("row", "class", "place", "context", "at", "its", "its_at", "n").mapInArrow(trimmed(_extended(window)), "row long, class binary, start long, stop long")
    return (sent.filter("n_words is not null").select("row", "doc_id", "n_words"), settle(found.distinct(), "winnow-spans"), sides.select("item_id", "class").distinct())


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found, names = spans(docs, items, id_col, text_col, item_col, item_text, window, gram)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.col("start"))))
    hit = found.select("row", "start", "stop").distinct().select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = (found.select("row", "class").distinct().join(names.filter("item_id is not null"), "class")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return rows.join(hit, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
