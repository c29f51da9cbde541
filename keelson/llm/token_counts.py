"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a task go into a trie.  At each node the best unigram
segmentation of its prefix (score and number of pieces) follows from those of its
ancestors, so a prefix that many pre-tokens share is computed once; the count at a
pre-token's terminal node is kept for it.  A document's count is the sum over its
pre-tokens.

Scores are log-probabilities.  Those of a unigram vocabulary file are such; a BPE file
has ranks instead, from which they are estimated by Zipf's law: the piece of rank r has
a probability in proportion to 1 / (r + ``ZIPF``).  Counts by a BPE file are therefore
those of a unigram tokenizer with its pieces, not those of its merges.

Defined results: a null or empty text has 0 tokens; a character without a piece
counts as its UTF-8 bytes; among segmentations of equal score the one with fewer
pieces counts; repeated rows have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import only
from .tokens import sliced

BLANK = "▁"
#: Score of a character without a piece: the worst piece's, less this (a fixed value of unigram models).
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's shift of Zipf's law.
ZIPF = 2.7
#: Nodes and terminal counts kept by a worker (about 90 MB); beyond that it starts anew.
KEPT_NODES = 600_000
_CHUNK = re.compile(rf"{BLANK}*[^{BLANK}]+|{BLANK}+")


def pre_tokens(text: str) -> list[str]:
    """Runs of blanks with the word after them, blanks written as U+2581, one before the text."""
    return _CHUNK.findall(BLANK + text.replace(" ", BLANK)) if text else []


class Trie:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {
            sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        ranks = sorted(set(self.score.values()), reverse=True)
        if ranks and all(float(s).is_integer() for s in ranks):  # a BPE file
            whole = math.log(sum(1 / (r + 1 + ZIPF) for r in range(len(self.score))))
            place = {s: r for r, s in enumerate(ranks)}
            self.score = {p: -math.log(place[s] + 1 + ZIPF) - whole for p, s in self.score.items()}
        usual = list(self.score.values())
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def insert(self, token: str) -> int:
        """The number of pieces of ``token``; nodes on its way are made once."""
        node, path, child, best, pieces, score = 0, [0], self.child, self.best, self.pieces, self.score
        for end, char in enumerate(token, 1):
            key = (node, char)
            node = child.get(key)
            if node is None:
                node = child[key] = len(best)
                top, count = None, 0
                if char not in score:
                    top, count = best[path[-1]] + self.unknown, pieces[path[-1]] + len(char.encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - self.longest), end):
                    s = score.get(token[start:end])
                    if s is not None:
                        prior = path[start]
                        s += best[prior]
                        if top is None or s > top or s == top and pieces[prior] + 1 < count:
                            top, count = s, pieces[prior] + 1
                best.append(top)
                pieces.append(count)
            path.append(node)
        self.terminal[token] = pieces[node]
        return pieces[node]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        cut = [pre_tokens(t) for t in texts]
        if len(self.best) > KEPT_NODES:
            self.clear()
        new: set[str] = set()
        for c in cut:
            new.update(c)
        for token in sorted(t for t in new if t not in self.terminal):
            self.insert(token)
        get = self.terminal.__getitem__
        return [(sum(map(get, c)), len(c)) for c in cut]


def trie(path: str) -> Trie:
    return only(("trie", path), lambda: Trie(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(model)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            counts = [c for part in sliced(texts) for c in t.counts(part)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(2)), pa.array(map(len, texts), pa.int64())],
                names=["doc_id", "n_tokens", "n_pre_tokens", "n_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_pre_tokens long, n_chars long")
