"""Spelling variants by full neighbourhood generation.

Words are counted over all texts.  Each word of the vocabulary then emits every distinct
string that is one deletion, replacement or insertion away, over the alphabet that the
vocabulary shows, and these candidates are hash-joined with the vocabulary: what meets is
near by construction, so no distance is computed.  A candidate travels as a hash with its
edit, 25 bytes whatever the word's length; after the join the edit is carried out and
the strings are compared, so that a clash of hashes can't link.  Candidates that are surely
no words don't leave the task (``keyset``, bounded; it decides nothing).

An edit is emitted in one form only: of equal neighbouring letters the last is deleted, and a
letter is inserted behind its equals.  So the candidates of a word are distinct.

Defined results: a null text has no words; a null id counts as empty before the colon.  Each
row of the table counts, repeated ones too.  Ties of n go to the first in code-point order.
Texts and words of any length are taken whole; positions of long words are taken in blocks.
An empty table, or one without words, gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import only, settle, trimmed
from .keyset import key_filter, maybe
from .words import mix

#: A word has at least so many code points and so many occurrences.
LENGTH, COUNT = 7, 2
#: A near word is a form if it occurs at least so many times as often.
TIMES = 10
_RUN = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
#: Candidates hashed at once.
_BLOCK = 1 << 16
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = COUNT) -> DataFrame:
    """word, n: runs of letters, only A-Z lower-cased, with one letter deleted where crc32 of "id:run" is a multiple of 31."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(_RUN % length), F.lit(0))).alias("run"))
    upper = "".join(map(chr, range(65, 91)))
    runs = runs.select("id", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word")
    return hashed.select(word).filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _letters(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(_U) + _U(0x632BE59BD9B4E019))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(_U(1), np.full(n, _BASE, _U)), dtype=_U)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_of(word: str) -> int:
    """The 64-bit hash under which words and candidates meet, as a signed number."""
    return int((_letters(_codes(word)) * _powers(len(word))[:len(word)]).sum(dtype=_U).view(np.int64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hash_of(w) for w in b.column(0).to_pylist()], pa.int64())], names=["word", "n", "hash"])


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, passes, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of words of one length (``codes``, a row each): (row, hash, place, skip, letter) of the distinct candidates that pass.

    The candidate is the word up to ``place``, then ``letter`` (none if 0), then the rest behind
    ``skip`` letters.  ``passes(hashes)`` gives the places of those to go on with.
    """
    rows, size = codes.shape
    mixed, power = _letters(codes), _powers(size + 1)
    head = np.zeros((rows, size + 1), _U)
    np.cumsum(mixed * power[:size], axis=1, dtype=_U, out=head[:, 1:])
    whole = head[:, -1:]
    letters = _letters(alphabet)
    tail = np.hstack([codes, np.zeros((rows, 1), codes.dtype)])
    step = max(1, block // max(1, rows * len(alphabet)))
    for lo in range(0, size + 1, step):
        hi = min(size + 1, lo + step)
        end = min(hi, size)
        keys = (head[:, lo:end] + (whole - head[:, lo + 1:end + 1]) * _UNBASE).ravel()
        if len(keys):  # deletions: of equal neighbours only the last
            at = passes(keys)
            row, place = np.divmod(at, end - lo)
            ok = tail[row, place + lo] != tail[row, place + lo + 1]
            yield row[ok], keys[at[ok]], place[ok] + lo, np.ones(ok.sum(), np.int32), np.zeros(ok.sum(), np.uint32)
        # replacements by other letters, and insertions of a letter where it doesn't stand already
        for skip, stop, base in ((1, end, whole - mixed[:, lo:end] * power[lo:end]), (0, hi, head[:, lo:hi] + (whole - head[:, lo:hi]) * _BASE)):
            keys = (base[:, :, None] + power[lo:stop, None] * letters).ravel()
            at = passes(keys)
            row, rest = np.divmod(at, max(1, (stop - lo) * len(letters)))
            place, x = np.divmod(rest, max(1, len(letters)))
            ok = tail[row, place + lo] != alphabet[x]
            yield row[ok], keys[at[ok]], place[ok] + lo, np.full(ok.sum(), skip, np.int32), alphabet[x[ok]]


_CANDIDATES = "source long, hash long, place int, skip int, letter string"


def _emitted(field, alphabet: str):
    """A task's words -> the candidates that may be words."""
    letters = _codes(alphabet)
    schema = pa.schema([("source", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("skip", pa.int32()), ("letter", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("spelling", dict)
        for b in batches:
            words, hashes = b.column("word").to_pylist(), b.column("hash").to_numpy()
            sizes = np.array([len(w) for w in words])
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                step = max(1, _BLOCK // (size * len(letters)))
                for lo in range(0, len(mine), step):
                    part = mine[lo:lo + step]
                    codes = np.stack([_codes(words[i]) for i in part])
                    for row, keys, place, skip, letter in neighbourhood(codes, letters, lambda keys: maybe(field.value, keys)):
                        if len(row):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(hashes[part[row]]), pa.array(keys.view(np.int64)), pa.array(place, pa.int32()), pa.array(skip, pa.int32()),
                                 pa.array([chr(c) if c else "" for c in letter.tolist()], pa.string())], schema=schema)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: a row for each ordered pair of words (``words``: word, n) that one edit separates."""
    vocabulary = settle(words.mapInArrow(trimmed(_hashed), "word string, n long, hash long"), "spelling-words")
    alphabet = "".join(sorted(x[0] for x in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()))
    field = key_filter(vocabulary, "hash")
    found = vocabulary.select("word", "hash").mapInArrow(trimmed(_emitted(field, alphabet)), _CANDIDATES)
    target = vocabulary.select("hash", F.col("word").alias("near"), F.col("n").alias("near_n"))
    source = vocabulary.select(F.col("hash").alias("source"), "word", "n")
    edited = F.concat(F.substring("word", F.lit(1), F.col("place")), "letter", F.substring("word", F.col("place") + F.col("skip") + 1, F.char_length("word")))
    return found.join(target, "hash").join(source, "source").filter(edited == F.col("near")).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form (``forms``: word, form) to the last, in strides that double.

    A form occurs at least ten times as often as its word, so a way has fewer than 20 steps.
    """
    way = forms.select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = settle(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if way.filter("moved").isEmpty():
            return way.drop("moved")
        way = way.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = COUNT, times: int = TIMES) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = settle(count_words(docs, id_col, text_col, length, least), "spelling-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likes = F.col("n_near").isNotNull() & (-F.col("best.less") >= times * F.col("n"))
    table = settle(words.join(near, "word", "left").select(
        "word", F.when(likes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(likes, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(table.filter("form is not null").select("word", "form"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
