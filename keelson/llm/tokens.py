"""Encoding with the tokenizers library, each distinct piece of text once.

Pre-tokens repeat far more than texts do; their ids are kept, up to a bound.  A text
of ASCII and Latin-1 letters alone is cut into pre-tokens by the tokenizer's own
pattern, and each new one goes to the library's model; where blanks only separate,
each distinct one of a slice is looked up once.  Any other text is cut before
blanks where the pre-tokenizer always cuts, and each new chunk goes through the
library's whole encoder; either way the ids of the parts are those of the text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import only

#: Chunks of one generation kept by a worker (about 25 MB); the generation before it is kept, too.
KEPT_CHUNKS = 120_000
#: Times that bound for words of separated vocabularies: most are met once or twice, and a word costs more to make than to keep.
WORDS_KEPT = 4
#: Bytes of text taken at once.
SLICE = 1 << 20

_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
#: Characters that every Unicode version classes and lower-cases alike.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[\t\n\r {_MARK}0-9{_LETTER}]*")
#: The pre-tokens of both kinds of vocabulary, for plain texts.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_STOP = "\0"  # in no plain text
_APART = rf"({_SUFFIXES}|[0-9]|[{_MARK}]+)"  # and runs of letters
_JOINED = re.compile(rf"{_SUFFIXES}| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\s+(?!\S)|\s+")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_NAMES = _byte_names()


class _Kept(dict):
    """What is known of chunks, in two generations: what the older one has and is met again moves to the younger."""

    def __init__(self, times: int = 1):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.times = times

    def turn(self) -> None:
        if len(self) > self.times * KEPT_CHUNKS:
            self.older = dict(self)
            self.clear()

    def unknown(self, chunks: Iterable[str]) -> list[str]:
        """Those of ``chunks`` that neither generation has."""
        older, rest = self.older, []
        for c in chunks:
            if c not in self:
                if c in older:
                    self[c] = older[c]
                else:
                    rest.append(c)
        return rest


class _Made(_Kept):
    """A chunk that neither generation has is made when it is asked for."""

    def __init__(self, make: Callable[[str], bytes], times: int = 1):
        super().__init__(times)
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        data = self.older.get(chunk)
        if data is None:
            data = self.make(chunk)
        self[chunk] = data
        return data


def sliced(texts: list[str], size: int = SLICE) -> Iterator[list[str]]:
    """``texts`` in runs of about ``size`` code points, at least one text each."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= size):
            held += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``joined``: the tokenizer takes a blank with the word after it and keeps case
    (byte-level BPE); otherwise blanks only separate and case is dropped.
    """

    def __init__(self, path: str, joined: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.joined = Tokenizer.from_file(path), joined
        self.model = self.tokenizer.model
        self.starts = _Kept()  # chunks without a blank before them
        self.others = _Kept()  # chunks after a blank, which isn't part of the key
        self.words = _Made(self._word, 1 if joined else WORDS_KEPT)  # pre-tokens of plain texts
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _learn(self, into: dict[str, bytes], blank: str, parts: list[str]) -> None:
        for i in range(0, len(parts), 5_000):
            part = parts[i:i + 5_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast([blank + p for p in part], add_special_tokens=False)):
                into[p] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for part in sliced(texts, SLICE if self.joined else 4 * SLICE):
            for kept in (self.starts, self.others, self.words):
                kept.turn()
            plain = [self._plain(t) for t in part]
            easy, hard = self._pre_tokens([t for t, p in zip(part, plain) if p]), self._chunks([t for t, p in zip(part, plain) if not p])
            for p in plain:
                yield next(easy if p else hard)

    def _word(self, word: str) -> bytes:
        if word == _STOP:
            return b""
        name = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(_NAMES)
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()  # none of the empty word

    def _pre_tokens(self, texts: list[str]) -> Iterator[bytes]:
        if self.joined:
            for t in texts:
                yield b"".join(map(self.words.__getitem__, _JOINED.findall(t)))
        elif texts:
            yield from self._separated(texts)

    def _separated(self, texts: list[str]) -> Iterator[bytes]:
        """All pre-tokens but letters are set apart by blanks; the slice is split there as one text with a mark after each."""
        whole = pa.array([f" {_STOP} ".join([*texts, ""])], pa.string())
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(whole), _APART, r" \1 ")).flatten().dictionary_encode()
        names = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        names = pc.binary_join(names, "\n")[0].as_py().split("\n")
        known = list(map(self.words.__getitem__, names))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        place, at = np.cumsum(size) - size, words.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(place[at] - end + n, n) + np.arange(end[-1])]
        bounds = [0, *end[at == names.index(_STOP)].tolist()]
        for a, z in zip(bounds, bounds[1:]):
            yield ids[a:z].tobytes()

    def _chunks(self, texts: list[str]) -> Iterator[bytes]:
        cut = [t.split(" ") for t in texts]
        new: set[str] = set()
        if not self.joined:
            for c in cut:
                new.update(c)
            self._learn(self.starts, "", self.starts.unknown(new))
            for c in cut:
                yield b"".join(map(self.starts.__getitem__, c))
            return
        first, odd = set(), {}
        for c in cut:
            new.update(c)
        self.odd = {p for p in new if not p or p[-1].isspace()}
        for i, c in enumerate(cut):
            if self.odd.isdisjoint(c):
                first.add(c[0])
            else:  # runs of white space: blanks start chunks only after something else
                odd[i] = _BEFORE_BLANK.split(" ".join(c))
                first.update(odd[i])
        self._learn(self.others, " ", self.others.unknown(new))
        self._learn(self.starts, "", self.starts.unknown(first))
        for i, c in enumerate(cut):
            if i in odd:
                yield b"".join(map(self.starts.__getitem__, odd[i]))
            else:
                yield self.starts[c[0]] + b"".join(map(self.others.__getitem__, c[1:]))


def encoder(path: str, joined: bool) -> ChunkEncoder:
    """The encoder of this worker process; the library's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return only((path, joined), lambda: ChunkEncoder(path, joined))
