"""Token-id files: an adaptive context-mixing range coder over blocks of ids.

Three predictions are mixed for each id: order 2 and order 1 name the id that came
last after the two ids, or the one id, before it, with the number of times that has
held; order 0 is a distribution over all ids met so far, with an escape for new ones.
The weights of the mixture follow the success of the predictors, for each pair of
confidences, and the mixture drives a carry-less range coder.

A block is coded in lock-step lanes: lane l holds the l-th stretch of its ids, and at
each step one id of every lane is coded, by vector operations over the lanes.  All
that is learned (contexts, counts, weights) is learned from the steps before, of all
lanes.  A block begins with nothing learned, carries its own lengths and checksums of
its ids and of its payload, and is decoded without any other.

File: ``KIDS`` version | blocks | footer (ids and lengths of documents) | its size.
Block: sizes, checksums | words of each lane | payload.

Defined results: a null text is the empty text; documents are in ascending id order,
null ids first, repeated ids by their text; an empty table gives no file.  Ids of
2**24 or more are refused with a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import file_system, scratch_path, settle
from .tokens import encoder

MAGIC = b"KIDS\x02"
BLOCK = 1 << 22  # ids
LANES = 4096  # at most, of a block
#: A lane of fewer ids than this isn't worth the words that end it.
SHORTEST = 256
MIX = 12  # bits of the mixture's weights
ORDER1, ORDER2 = 17, 20  # bits of the context tables
SURE = 15  # the highest confidence
_U = np.uint64
_LOW = _U((1 << 32) - 1)
_HEAD = struct.Struct("<IIIIIII")  # ids, lanes, bits of an id, payload words, crc of ids, crc of payload, crc of this head


_MASK1, _MASK2 = np.int64((1 << ORDER1) - 1), np.int64((1 << ORDER2) - 1)
_SPREAD, _FOUR, _SURE, _WHOLE = np.int64(0x9E3779B1), np.int64(4), np.int64(15), np.int64(1 << MIX)


class _Model:
    """What both sides have learned of a block; integers only, so they agree."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 1 << bits
        self.after1, self.after2 = np.zeros(1 << ORDER1, np.int64), np.zeros(1 << ORDER2, np.int64)  # id << 4 | confidence
        self.count = np.zeros(self.size, np.int64)
        self.tried = np.zeros((512, 3), np.int64)  # by both confidences, and whether both name one id: who was right
        self.ids: list[np.ndarray] = []  # since the last refresh
        self.outcomes: list[np.ndarray] = []
        self.a = self.b = None
        self._refresh()

    def _refresh(self) -> None:
        if self.ids:
            self.count += np.bincount(np.concatenate(self.ids), minlength=self.size)
            self.tried += np.bincount(np.concatenate(self.outcomes), minlength=512 * 3).reshape(512, 3)
            self.ids, self.outcomes = [], []
        n = self.tried.sum(axis=1)
        room = (1 << MIX) - 128  # the rest is always left to order 0
        self.weight1 = 1 + room * (2 * self.tried[:, 1] + 1) // (2 * n + 32)
        self.weight2 = 1 + room * (2 * self.tried[:, 2] + 1) // (2 * n + 32)
        # Order 0: a share for each id met, and one for the escape by the number of ids met once.
        self.met = np.flatnonzero(self.count)
        self.names = np.append(self.met, -1)
        c, total = self.count[self.met], int(self.count.sum())
        self.fine = 16 if len(c) < 1 << 14 else 20
        self.shift, whole = np.int64(self.fine), 1 << self.fine
        escape = min(max(whole * int((c == 1).sum()) // max(total, 1), 16), whole >> 2) if total else whole
        freq = c * (whole - escape - len(c)) // max(total, 1) + 1
        self.freq = np.append(freq, whole - int(freq.sum())).astype(np.int64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq)
        self.place = np.full(self.size, len(c))
        self.place[self.met] = np.arange(len(c))

    def predict(self, step: int, n: int) -> None:
        """The two predicted ids and their weights for the first ``n`` lanes."""
        if step & (step - 1) == 0 or step % 64 == 0:  # what was counted counts after 1, 2, 4, ... steps, then after every 64
            self._refresh()
        if self.a is None:
            self.a = self.b = np.zeros(n, np.int64)
        elif len(self.a) > n:
            self.a, self.b = self.a[:n], self.b[:n]
        self.at1, self.at2 = self.a & _MASK1, self.a * _SPREAD + self.b & _MASK2
        v1, v2 = self.v1, self.v2 = self.after1.take(self.at1), self.after2.take(self.at2)
        self.s1, self.s2, self.c1, self.c2 = v1 >> _FOUR, v2 >> _FOUR, v1 & _SURE, v2 & _SURE
        self.context = (self.c2 << _FOUR) + self.c1
        same = (self.s1 == self.s2).nonzero()[0]
        self.context[same] += 256
        self.w1, self.w2 = self.weight1.take(self.context), self.weight2.take(self.context)
        self.base = self.w1 + self.w2
        self.rest = _WHOLE - self.base

    def update(self, s: np.ndarray, named1: np.ndarray, named2: np.ndarray, hit1: np.ndarray) -> None:
        """``named1``, ``named2``: the lanes whose id order 1 and order 2 named; ``hit1``: those that order 1 alone named."""
        outcome = self.context * 3
        outcome[hit1] += 1
        outcome[named2] += 2
        self.ids.append(s)
        self.outcomes.append(outcome)
        fresh = (s << _FOUR) + 1
        for after, at, v, c, named in ((self.after1, self.at1, self.v1, self.c1, named1), (self.after2, self.at2, self.v2, self.c2, named2)):
            new = fresh.copy()
            sure = (c > 1).nonzero()[0]  # a miss halves the confidence; from 1 it goes to the new id
            new[sure] = v[sure] - (c[sure] + 1 >> 1)
            new[named] = v[named] + (c[named] < SURE)
            after[at] = new
        self.b, self.a = self.a, s


class _Writer:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def put(self, start: np.ndarray, freq: np.ndarray, bits: int, at: np.ndarray | slice) -> None:
        """Narrow the intervals of the lanes ``at`` to [start, start + freq) of 2**bits."""
        size = self.range[at] >> _U(bits)
        low = self.low[at] + size * start.view(_U)
        size *= freq.view(_U)
        self.low[at], self.range[at] = low, size
        need = np.flatnonzero(size <= _LOW)
        if len(need):
            low, size = low[need], size[need]
            size = np.where((low ^ (low + size)) > _LOW, (_U(0) - low) & _LOW, size)  # an interval over the edge of a word is cut there
            lane = need if isinstance(at, slice) else at[need]
            self.lanes.append(lane.astype(np.int16))
            self.words.append((low >> _U(32)).astype("<u4"))
            self.low[lane], self.range[lane] = low << _U(32), size << _U(32)

    def end(self) -> tuple[np.ndarray, bytes]:
        """(words of each lane, all words lane by lane)."""
        every = np.arange(len(self.low), dtype=np.int16)
        lanes = np.concatenate([*self.lanes, every, every])
        words = np.concatenate([*self.words, (self.low >> _U(32)).astype("<u4"), (self.low & _LOW).astype("<u4")])
        return np.bincount(lanes, minlength=len(every)).astype("<u4"), words[np.argsort(lanes, kind="stable")].tobytes()


class _Reader:
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        lanes = len(counts)
        self.words, self.at = words, np.cumsum(counts.astype(np.int64)) - counts
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
        self.code = words.take(self.at, mode="clip").astype(_U) << _U(32) | words.take(self.at + 1, mode="clip").astype(_U)
        self.at += 2

    def target(self, bits: int, at: np.ndarray | slice) -> np.ndarray:
        self.size = self.range[at] >> _U(bits)
        return np.minimum((self.code[at] - self.low[at]) // self.size, _U((1 << bits) - 1)).view(np.int64)

    def took(self, start: np.ndarray, freq: np.ndarray, at: np.ndarray | slice) -> None:
        low = self.low[at] + self.size * start.view(_U)
        size = self.size * freq.view(_U)
        self.low[at], self.range[at] = low, size
        need = np.flatnonzero(size <= _LOW)
        if len(need):
            low, size = low[need], size[need]
            size = np.where((low ^ (low + size)) > _LOW, (_U(0) - low) & _LOW, size)
            lane = need if isinstance(at, slice) else at[need]
            self.code[lane] = self.code[lane] << _U(32) | self.words.take(self.at[lane], mode="clip").astype(_U)  # damaged data may ask for more
            self.at[lane] += 1
            self.low[lane], self.range[lane] = low << _U(32), np.maximum(size, _U(1)) << _U(32)


def _shape(n: int, lanes: int) -> tuple[int, int]:
    """(lanes, steps) of a block of ``n`` ids: all lanes but the last have an id at each step."""
    steps = -(-n // min(lanes, -(-n // SHORTEST)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, lanes: int = LANES) -> bytes:
    """At least one id (uint32), below 2**24."""
    bits = max(1, int(ids.max()).bit_length())
    if bits > 24:
        raise ValueError("ids of 2**24 or more")
    lanes, steps = _shape(len(ids), lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = len(ids) - (lanes - 1) * steps
    model, coder = _Model(bits), _Writer(lanes)
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        s, at = grid[t, :n], slice(0, n)
        model.predict(t, n)
        place = model.place.take(s)
        edge = model.base << model.shift
        start = edge + model.rest * model.start.take(place)
        freq = model.rest * model.freq.take(place)
        named1, named2 = (s == model.s1).nonzero()[0], (s == model.s2).nonzero()[0]
        hit1 = named1[s[named1] != model.s2[named1]]
        start[hit1], freq[hit1] = model.w2[hit1] << model.shift, model.w1[hit1] << model.shift
        start[named2], freq[named2] = 0, model.w2[named2] << model.shift
        coder.put(start, freq, MIX + model.fine, at)
        new = (place == len(model.met)).nonzero()[0]
        if len(new):
            new = new[(s[new] != model.s1[new]) & (s[new] != model.s2[new])]
            coder.put(s[new], np.ones(len(new), np.int64), bits, new)
        model.update(s, named1, named2, hit1)
    counts, payload = coder.end()
    body = counts.tobytes() + payload
    fields = (len(ids), lanes, bits, len(payload) // 4, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    head = struct.pack("<6I", *fields)
    return head + struct.pack("<I", zlib.crc32(head)) + body


def body_size(head: bytes) -> int:
    """Bytes after a block's head; ValueError if the head is damaged."""
    n, lanes, bits, words, _, _, crc = _HEAD.unpack(head)
    if zlib.crc32(head[:-4]) != crc:
        raise ValueError("head checksum differs")
    return 4 * (lanes + words)


def decode_block(head: bytes, body: bytes) -> np.ndarray:
    """ids of a block; ValueError if a checksum doesn't hold."""
    count, lanes, bits, words, crc_ids, crc_body, _ = _HEAD.unpack(head)
    if body_size(head) != len(body) or zlib.crc32(body) != crc_body:
        raise ValueError("payload checksum differs")
    steps = -(-count // lanes)
    last = count - (lanes - 1) * steps
    grid = np.zeros((steps, lanes), np.int64)
    model = _Model(bits)
    coder = _Reader(np.frombuffer(body, "<u4", lanes), np.frombuffer(body, "<u4", words, 4 * lanes))
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        at = slice(0, n)
        model.predict(t, n)
        v = coder.target(MIX + model.fine, at)
        edge = model.base << model.shift
        v -= edge
        place = model.slot.take(v // model.rest, mode="clip")
        start = edge + model.rest * model.start.take(place)
        freq = model.rest * model.freq.take(place)
        s = model.names.take(place)
        hit = (v < 0).nonzero()[0]
        first = v[hit] + edge[hit] < model.w2[hit] << model.shift
        hit1, named2 = hit[~first], hit[first]
        start[hit1], freq[hit1], s[hit1] = model.w2[hit1] << model.shift, model.w1[hit1] << model.shift, model.s1[hit1]
        start[named2], freq[named2], s[named2] = 0, model.w2[named2] << model.shift, model.s2[named2]
        coder.took(start, freq, at)
        new = (s < 0).nonzero()[0]
        if len(new):
            s[new] = got = coder.target(bits, new)
            coder.took(got, np.ones(len(new), np.int64), new)
        model.update(s, (s == model.s1).nonzero()[0], named2, hit1)
        grid[t, :n] = s
    ids = np.ascontiguousarray(grid.T).ravel()[:count].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise ValueError("id checksum differs")
    return ids


def write_file(out, documents: Iterable[tuple[int | None, bytes]], block: int = BLOCK, lanes: int = LANES) -> tuple[int, int]:
    """(id, ids as little-endian uint32) in order, to a binary stream; returns the numbers of documents and ids."""
    out.write(MAGIC)
    names, sizes, buffer, held = [], [], [], 0
    for name, data in documents:
        names.append(name)
        sizes.append(len(data) // 4)
        buffer.append(data)
        held += len(data)
        if held >= 4 * block:
            whole = b"".join(buffer)
            for at in range(0, held - 4 * block + 1, 4 * block):
                out.write(encode_block(np.frombuffer(whole, "<u4", block, at), lanes))
            held %= 4 * block
            buffer = [whole[len(whole) - held:]]
    if held:
        out.write(encode_block(np.frombuffer(b"".join(buffer), "<u4"), lanes))
    footer = zlib.compress(b"".join((
        struct.pack("<Q", len(names)), np.array([n is None for n in names], np.uint8).tobytes(),
        np.array([n or 0 for n in names], "<i8").tobytes(), np.array(sizes, "<u8").tobytes())))
    out.write(footer + struct.pack("<IQ", zlib.crc32(footer), len(footer)))
    return len(names), sum(sizes)


def read_file(file) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, start in this file, ids as bytes) of each document, from a seekable binary file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    end = file.size()
    file.seek(end - 12)
    crc, size = struct.unpack("<IQ", file.read(12))
    file.seek(end - 12 - size)
    footer = file.read(size)
    if zlib.crc32(footer) != crc:
        raise ValueError("footer checksum differs")
    footer = zlib.decompress(footer)
    file.seek(len(MAGIC))
    (n,) = struct.unpack_from("<Q", footer)
    null = np.frombuffer(footer, np.uint8, n, 8)
    names = np.frombuffer(footer, "<i8", n, 8 + n)
    sizes = np.frombuffer(footer, "<u8", n, 8 + 9 * n)
    have, start, at = b"", 0, 0
    for gone, name, count in zip(null.tolist(), names.tolist(), sizes.tolist()):
        while len(have) - at < 4 * count:
            head = file.read(_HEAD.size)
            have, at = have[at:] + decode_block(head, file.read(body_size(head))).tobytes(), 0
        yield None if gone else name, start, have[at:at + 4 * count]
        at += 4 * count
        start += count


_MANIFEST = "part int, path string, documents long, ids long"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", root: str | None = None) -> DataFrame:
    """Encode ``docs`` and write one file for each range of ids; returns the settled manifest.

    A task run again writes another file; the manifest names the one that counts.
    """
    spark = docs.sparkSession
    root = root or scratch_path(spark, "ids")
    fs, folder = file_system(root)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, coder, end = TaskContext.get(), encoder(tokenizer, False), int(end_id).to_bytes(4, "little")

        def documents(first):
            for b in (first, *[None]):
                while b is not None:
                    names = b.column(0).to_pylist()
                    yield from ((n, data + end) for n, data in zip(names, coder.encode([t or "" for t in b.column(1).to_pylist()])))
                    b = next(batches, None)

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.kids"
        fs, folder = file_system(root)
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            n, ids = write_file(out, documents(first))
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [f"{root}/{name}"],
                                          "documents": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64())})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(text_col).alias("h"))
    ordered = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return settle(ordered.mapInArrow(write, _MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document in the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = file_system(path)
                with fs.open_input_file(name) as file:
                    rows: list = []
                    for doc_id, start, data in read_file(file):
                        rows.append((doc_id, base + start, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<i4") if with_ids else None))
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        if with_ids:
            columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    # One row for each file is summed in order; files are few beside their documents.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    spark = manifest.sparkSession
    files = manifest.select("path", before.alias("base")).repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
