"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The merges of a text are taken from an agenda, best score first and leftmost among
equals; each candidate taken up is skipped if its keyed hash falls below the dropout
rate.  The key is (seed, document, place of the chunk, both symbols' places in it,
merged piece), so the same rows give the same segmentation anywhere.  Chunks (runs of
blanks with the word after them) are independent, because no piece of the vocabulary
continues over a blank.  The agendas of many chunks of one length advance together,
a candidate of each at a time, as vectors; a chunk of more than ``SHORT`` code points
has a heap of its own.

Defined results: a null text is the empty text with no pieces; a null id counts as
0 in the key; U+2581 in a text is spelt in bytes, so that it comes back as itself;
repeated rows have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import only
from .tokens import sliced
from .words import mix

BLANK = "▁"
_M = (1 << 64) - 1
#: Factors of both places and of the merged piece's id.
_KEYS = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7
DROPOUT, SEED = 0.1, 1
#: Chunks of at most so many code points (below 2**6 - 1) advance together, so many of them at once.
SHORT, TOGETHER = 48, 8192
_GONE = -1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


class _Pairs:
    """Pieces that pairs of symbols merge to, by their ids: a hash table, and tables for what collides in the one before."""

    def __init__(self, merged: dict[tuple[int, int], int], symbols: int, none: int):
        self.symbols, self.none = np.int64(symbols), none
        keys = np.array([a * symbols + b for a, b in merged], np.int64)
        values = np.array(list(merged.values()), np.int64)
        self.tables = []
        while len(keys):
            bits = (4 * len(keys)).bit_length()
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            own, piece = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int64)
            own[slot[first]], piece[slot[first]] = keys[first], values[first]
            self.tables.append((bits, own, piece))
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(64 - bits)) & np.int64((1 << bits) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.symbols + right
        out, where = None, None
        for bits, own, piece in self.tables:
            slot = self._slot(keys, bits)
            there = own.take(slot)
            got = piece.take(slot)
            other = (there != keys).nonzero()[0]
            got[other] = self.none
            if where is None:
                out = got
            else:
                out[where] = got
            again = other[there[other] >= 0]  # the slot is another pair's: this one may be in the next table
            if not len(again):
                break
            where = again if where is None else where[again]
            keys = keys[again]
        return np.full(len(left), self.none) if out is None else out


class Pieces:
    """A BPE model file of sentencepiece."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.pieces = sp.get_piece_size()
        self.bytes_id, self.ids, self.spelt, score = {}, {}, [], {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.spelt.append(bytes((int(piece[3:5], 16),)))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelt.append(b"")
            else:
                self.ids[piece] = i
                score[piece] = sp.get_score(i)
                self.spelt.append(piece.replace(BLANK, " ").encode())
        self.unknown = sp.unk_id()
        if any(BLANK in p.lstrip(BLANK) or p.startswith(BLANK * 2) and p.strip(BLANK) for p in self.ids):
            raise ValueError("pieces of this vocabulary continue over blanks")
        self.limit, self.seed = int(dropout * (1 << 53)), seed
        ranks = {x: r for r, x in enumerate(sorted({-x for x in score.values()}))}
        self.rank = {p: ranks[-x] for p, x in score.items()}
        self.own = {p: i * _KEYS[2] & _M for p, i in self.ids.items()}
        # Symbols: pieces by their ids, characters that only longer pieces hold, one for all other characters.
        symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, n + len(symbol) - len(self.ids))
        self.other = n + len(symbol) - len(self.ids)
        self.by_code = np.full(0x110000, self.other, np.int64)
        for c, s in symbol.items():
            if len(c) == 1 and c != BLANK:
                self.by_code[ord(c)] = s
        self.by_code[32] = symbol.get(BLANK, self.other)
        self.far = len(ranks)  # the rank of two symbols that don't merge
        self.rank_of, self.own_of = np.full(n + 1, self.far, np.int32), np.zeros(n + 1, np.uint64)
        for p, i in self.ids.items():
            self.rank_of[i], self.own_of[i] = self.rank[p], self.own[p]
        self.pairs = _Pairs({(symbol[p[:i]], symbol[p[i:]]): q for p, q in self.ids.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol},
                            self.other + 1, n)
        at = np.arange(SHORT + 2, dtype=np.uint64) - np.uint64(1)
        self.left, self.right = at * np.uint64(_KEYS[0]), at * np.uint64(_KEYS[1])

    def _advance(self, symbols: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Agendas of chunks of one length: a column each, symbols between two rows that never merge; returns what is left."""
        rows, n = symbols.shape
        out, where, done = symbols, np.arange(n), self.far << 6
        both = self.pairs(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(rows - 1, n)
        key = (self.rank_of[both] << 6) + np.arange(rows - 1, dtype=np.int32)[:, None]  # the least is the next candidate: rank, then place
        after = np.repeat(np.arange(1, rows + 1), n).reshape(rows, n)
        before = after - 2
        symbols = symbols.copy()
        while True:
            best = key.min(axis=0)
            at = (best < done).nonzero()[0]
            if 2 * len(at) < n:  # what is done leaves
                out[:, where] = symbols
                if not len(at):
                    return out
                where, n, best, draws = where[at], len(at), best[at], draws[at]
                both, key, after, before, symbols = (np.ascontiguousarray(x[:, at]) for x in (both, key, after, before, symbols))
                at = np.arange(n)
            else:
                best = best[at]
            b, k, a, s = both.ravel(), key.ravel(), after.ravel(), symbols.ravel()
            i = (best & 63).astype(np.int64)
            here = i * n + at
            j = a.take(here)
            merged = b.take(here)
            if self.limit:
                drawn = mix(draws[at] + self.left.take(i) + self.right.take(j) + self.own_of.take(merged)) >> np.uint64(11)
                skip = drawn < np.uint64(self.limit)
                k[here[skip]] = done
                go = (~skip).nonzero()[0]
                i, j, here, at, merged = i[go], j[go], here[go], at[go], merged[go]
            there = j * n + at
            s[here], s[there] = merged, _GONE
            k[there] = done
            j = a.take(there)
            right = j * n + at
            a[here] = j
            before.ravel()[right] = i
            h = before.ravel().take(here)
            left = h * n + at
            new = self.pairs(np.concatenate((merged, s.take(left))), np.concatenate((s.take(right), merged)))
            rank = self.rank_of.take(new) << 6
            m = len(at)
            b[here], b[left] = new[:m], new[m:]
            k[here], k[left] = rank[:m] + i, rank[m:] + h

    def segment(self, chunk: str, draw: int) -> list[str]:
        """The pieces of one chunk of any length (blanks as U+2581), by a heap."""
        symbols: list[str | None] = list(chunk)
        n, rank, own, limit = len(symbols), self.rank.get, self.own, self.limit
        agenda = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            both = left + right
            r = rank(both)
            if r is not None:
                agenda.append((r, i - 1, i, both))
            left = right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(agenda)
        while agenda:
            _, i, j, merged = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != len(merged):
                continue
            if _mix((draw + i * _KEYS[0] + j * _KEYS[1] + own[merged]) & _M) >> 11 < limit:
                continue
            symbols[i], symbols[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = merged + symbols[k]
                r = rank(both)
                if r is not None:
                    heappush(agenda, (r, i, k, both))
            h = before[i]
            if h >= 0:
                both = symbols[h] + merged
                r = rank(both)
                if r is not None:
                    heappush(agenda, (r, h, i, both))
        return [s for s in symbols if s is not None]

    def encode_all(self, texts: list[str], doc_keys: list[int]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        out, done = [], 0
        for part in sliced(texts):
            out += self._encode([" " + t if t else "" for t in part], np.array([_mix(k & _M) for k in doc_keys[done:done + len(part)]], np.uint64))
            done += len(part)
        return out

    def _encode(self, texts: list[str], doc_keys: np.ndarray) -> list[bytes]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        begin = np.append(0, ends)
        blank, mark = codes == 32, codes == ord(BLANK)  # U+2581 itself is a chunk of its own
        start = mark | blank & ~np.append(False, blank[:-1]) | np.append(False, mark[:-1])
        start[begin[begin < len(codes)]] = True
        start = start.nonzero()[0]
        size = np.diff(start, append=len(codes))
        text = np.searchsorted(ends, start, side="right")
        place = np.arange(len(start)) - np.searchsorted(start, begin[:-1])[text]
        draws = mix(mix(place.astype(np.uint64) + np.uint64(_mix(self.seed & _M))) + doc_keys[text])
        symbols = self.by_code.take(codes)
        by_size = np.argsort(size, kind="stable")
        sizes, cuts = np.unique(size[by_size], return_index=True)
        for n, a, z in zip(sizes.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(size)]):
            if n == 1:
                continue
            chunks = by_size[a:z]
            if n > SHORT:
                for c in chunks.tolist():
                    at = int(start[c])
                    for piece in self.segment(whole[at:at + n].replace(" ", BLANK), int(draws[c])):
                        if len(piece) > 1:
                            symbols[at], symbols[at + 1:at + len(piece)] = self.ids[piece], _GONE
                        at += len(piece)
                continue
            for b in range(0, len(chunks), TOGETHER):
                some = chunks[b:b + TOGETHER]
                at = start[some] + np.arange(n)[:, None]
                framed = np.full((n + 2, len(some)), self.other)
                framed[1:-1] = symbols[at]
                symbols[at] = self._advance(framed, draws[some])[1:-1]
        left = (symbols >= 0).nonzero()[0]
        ids = symbols[left]
        times = np.ones(len(ids), np.int64)
        spelt = (ids >= self.pieces).nonzero()[0]
        if len(spelt):
            own = [list(chr(c).encode("utf-8", "surrogatepass")) if self.bytes_id else [] for c in codes[left[spelt]].tolist()]
            times[spelt] = [max(1, len(x)) for x in own]
            first = np.cumsum(times) - times
            ids = np.repeat(ids, times)
            at = first[spelt]
            for k in range(max(map(len, own), default=0) or 1):
                longer = [i for i, x in enumerate(own) if len(x) > k]
                ids[at[longer] + k] = [self.bytes_id[own[i][k]] for i in longer]
            if not self.bytes_id:
                ids[at] = self.unknown
        total = np.append(0, np.cumsum(times))
        data = ids.astype("<u4").tobytes()
        cut = (4 * total[np.searchsorted(left, begin)]).tolist()
        return [data[a:z] for a, z in zip(cut, cut[1:])]

    def encode(self, text: str, doc_key: int = 0) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text], [doc_key])[0]

    def decode(self, ids) -> str:
        """The text again; ids as numbers or as little-endian unsigned 32-bit bytes."""
        if isinstance(ids, bytes):
            ids = array("I", ids)
        data = b"".join(map(self.spelt.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def pieces_model(path: str, dropout: float, seed: int) -> Pieces:
    return only(("pieces", path, dropout, seed), lambda: Pieces(path, dropout, seed))


def encode_pieces(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED,
                  id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless (decoding gives the text back) and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_model(model, dropout, seed)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            ids = pieces.encode_all(texts, b.column(1).to_pylist())
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()),
                       pa.array([pieces.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][:len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("0"))).alias("k"),
                       F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; a column of the text's name is replaced."""
    from pyspark.sql import types as T

    encoded = encoded.drop(text_col)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_model(model, 0.0, 0)
        for b in batches:
            texts = [pieces.decode(x) if x is not None else None for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))
