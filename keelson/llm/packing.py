"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers
whatever the input.  A bin takes the longest length left and the combination of
available lengths that fills it furthest, found by subset-sum dynamic programming on
bitsets; the combination is removed as often as the counts allow.  The plan maps
(length, rank among the pieces of that length) to (sequence, offset), and ranks are
dealt out without bringing the pieces of a length together.

Defined results: a null text is the empty text (its end id alone is a piece); ids may
be null or repeated, rows are pieces of their own; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, settle, small_batches, trimmed
from .tokens import encoder, sliced

CAPACITY = 2048
END_ID = 0


def _best_fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """{length: copies} of the fullest combination of available lengths not over ``room``."""
    reach, steps, goal = 1, [], 1 << room
    mask = (1 << (room + 1)) - 1
    for length in order:
        left = min(counts[length], room // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            new = (reach | reach << (take * length)) & mask
            if new != reach:
                steps.append((reach, length, take))
                reach = new
            left -= take
            copies *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """[(repeats, [(length, copies), ...]), ...] and the number of bins."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan, bins = [], 0
    while counts:
        order = sorted(counts, reverse=True)
        lead = order[0]
        counts[lead] -= 1
        fill = _best_fill(counts, [x for x in order if x <= capacity - lead and counts[x]], capacity - lead) if lead < capacity else {}
        counts[lead] += 1
        fill[lead] = fill.get(lead, 0) + 1
        repeats = min(counts[x] // n for x, n in fill.items())
        plan.append((repeats, sorted(fill.items(), reverse=True)))
        bins += repeats
        for x, n in fill.items():
            counts[x] -= n * repeats
            if not counts[x]:
                del counts[x]
    return plan, bins


class _Lookup:
    """(length, rank) -> (sequence, offset) from a plan, by binary search."""

    def __init__(self, plan):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for repeats, fill in plan:
            offset = 0
            for length, copies in fill:
                rows.append((length, used.get(length, 0), sequence, copies, offset))
                used[length] = used.get(length, 0) + copies * repeats
                offset += length * copies
            sequence += repeats
        rows.sort()
        self.length, self.start, self.sequence, self.copies, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        self.lengths, self.first = np.unique(self.length, return_index=True)
        self.last = np.append(self.first[1:], len(rows))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        group = np.searchsorted(self.lengths, length)
        for g in np.unique(group):
            own = group == g
            a, z = self.first[g], self.last[g]
            at[own] = a + np.searchsorted(self.start[a:z], rank[own], side="right") - 1
        within = rank - self.start[at]
        copies = self.copies[at]
        return self.sequence[at] + within // copies, self.offset[at] + within % copies * length


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a settled table) with sequence_id and offset.

    Pieces as long as a sequence need no plan: each fills one of its own.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.filter(F.col(length_col) < capacity).groupBy(length_col).count().collect()}
    plan, bins = plan_bins(histogram, capacity)
    lookup = _Lookup(plan)
    # Ranks: rows of a length are numbered within salted buckets, and buckets start where earlier ones end.
    salts = 4 * partitions(spark)
    cols = [F.col(c) for c in pieces.columns]
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "ids"]), F.lit(salts)).cast("int"))
    part = salted.groupBy(length_col, "__salt").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    starts = part.withColumn("__start", F.sum("__n").over(Window.partitionBy(length_col).orderBy("__salt")) - F.col("__n")).drop("__n")
    within = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(length_col, "__salt").orderBy(*cols)).cast("long") - 1)
    ranked = within.join(starts, [length_col, "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__start")).select(*pieces.columns, "__rank")
    at = pieces.columns.index(length_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(at).to_numpy().astype(np.int64), b.column(b.num_columns - 1).to_numpy()
            sequence, offset = bins + rank, np.zeros(len(rank), np.int64)
            short = length < capacity
            if short.any():
                sequence[short], offset[short] = lookup(length[short], rank[short])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*b.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(trimmed(place), schema)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids with ``end_id`` after them.

    A document longer than ``capacity`` is cut so that all pieces but the first are full.
    """
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
        """Ids and texts, a megabyte at a time: the ids of a whole batch would be several times its texts."""
        for b in batches:
            at = 0
            for part in sliced([t or "" for t in b.column(1).to_pylist()]):
                yield b.column(0).slice(at, len(part)), part
                at += len(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer, True), int(end_id).to_bytes(4, "little")
        for ids, texts in slices(batches):
            rows = []
            for i, data in enumerate(coder.encode(texts)):
                data += end
                n = len(data) // 4
                first = n - (n - 1) // capacity * capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    size = first if k == 0 else capacity
                    rows.append((i, k, start, size, data[4 * start:4 * (start + size)]))
            at = pa.array([r[0] for r in rows], pa.int32())
            columns = [ids.take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                       pa.array([r[3] for r in rows], pa.int64()), pa.array([zlib.crc32(r[4]) for r in rows], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[4], "<i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place (and its ids): the pieces are settled, texts are encoded once."""
    return pack(settle(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces"), "length", capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids of pieces placed with their ids; a sequence has at most ``capacity`` of them."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
