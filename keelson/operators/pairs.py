"""What pairs of rows show of a table: which columns they agree on, and what that rules out.

Two rows that agree on columns X prove that X is no key, and that X doesn't determine a column
in which they differ.  Such pairs come from sorted neighbourhoods of a bounded sample and from
the groups that refuted an earlier guess; what no pair refutes is proven on all rows, several
guesses in one aggregate.  The sample only saves work, results never rest on it.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import islice, takewhile
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Values of the sample at most (rows times the square of the columns), neighbours looked at, and pairs kept.
VALUES, NEIGHBOURS, KEPT = 1 << 20, 2, 4096
#: Guesses that are tried on one key in SHARE (in more for a large table, so that about LOOKED keys are), and of those that stand,
#: how many are proven on all rows at a time once the first of all has failed.
GUESSES, SHARE, LOOKED, PROOFS = 24, 16, 1 << 17, 4
#: Keys that a task of a proof counts, about.
PART = 1 << 18


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _digests(names: Sequence[str]) -> Column:
    """Two 64-bit hashes of each value, null for a null: pairs of rows are narrow, whatever their columns hold."""
    return F.expr(f"array({', '.join(f'if({c} is null, null, xxhash64({c})), if({c} is null, null, xxhash64(1, {c}))' for c in map(_quoted, names))})")


def _letters(a: Sequence, b: Sequence) -> str:
    """A letter for each column of two rows: 1 equal, n both null, 0 different, - one null."""
    sides = zip(zip(a[::2], a[1::2]), zip(b[::2], b[1::2]))
    return "".join(("n" if x == y else "-") if None in (x[0], y[0]) else "1" if x == y else "0" for x, y in sides)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of neighbours among the rows of a sample in an order for each column, those that agree on it being together; most agreement first."""
    lists = [b.column(0) for b in batches if b.num_rows]
    if not lists:
        return
    flat, rows = pa.concat_arrays([x.flatten() for x in lists]), sum(map(len, lists))
    values = flat.fill_null(0).to_numpy().reshape(rows, -1, 2)
    null = flat.is_null().to_numpy(zero_copy_only=False).reshape(rows, -1, 2)[:, :, 0]
    shuffled = np.bitwise_xor.reduce(values[:, :, 1] * np.arange(1, 2 * values.shape[1], 2), axis=1)  # any order that isn't that of a column
    found = []
    for c in range(values.shape[1]):
        order = np.lexsort((shuffled, values[:, c, 1], values[:, c, 0], null[:, c]))
        v, u = values[order], null[order]
        for step in range(1, NEIGHBOURS + 1):
            near = np.flatnonzero((v[step:, c] == v[:-step, c]).all(axis=1) & (u[step:, c] == u[:-step, c]))
            same, some, both = (v[near + step] == v[near]).all(axis=2), u[near + step] | u[near], u[near + step] & u[near]
            letters = np.where(both, b"n", np.where(some, b"-", np.where(same, b"1", b"0")))
            found.append(np.unique(letters.view(f"S{letters.shape[1]}")))
    pairs = np.unique(np.concatenate(found))
    most = np.argsort(-(np.char.count(pairs, b"1") + np.char.count(pairs, b"n")), kind="stable")[:KEPT]
    yield pa.RecordBatch.from_pydict({"x": pairs[most].astype("U").tolist()})


class Pairs:
    """Evidence on the columns ``names`` of ``df``; with ``nulls_equal`` nulls agree, else rows with a null in a tuple don't count for it."""

    def __init__(self, df: DataFrame, names: Sequence[str], nulls_equal: bool = True, rows: int | None = None):
        """``rows``: how many the table has, if that is known."""
        self.df, self.names, self.nulls_equal, self._rows = df, list(dict.fromkeys(names)), nulls_equal, rows
        self.bit = {c: 1 << i for i, c in enumerate(self.names)}
        self.seen: dict[tuple[int, int], None] = {}  # (columns that agree, columns that differ)
        self.proven: set[int] = set()
        self.scans = 0  # aggregates over all rows
        self._sampled = False

    def mask(self, columns) -> int:
        return sum(self.bit[c] for c in set(columns))

    def _add(self, letters: str) -> None:
        agree = sum(1 << i for i, x in enumerate(letters) if x == "1" or (x == "n" and self.nulls_equal))
        differ = sum(1 << i for i, x in enumerate(letters) if x == "0" or (x == "-" and self.nulls_equal))
        self.seen[agree, differ] = None

    def sample(self) -> None:
        """Neighbours of the first rows in an order for each column, those that agree on it being together."""
        if self._sampled or not self.names:
            return
        self._sampled = True
        rows = self.df.select(_digests(self.names).alias("h")).limit(max(2, VALUES // len(self.names) ** 2))
        for r in rows.mapInArrow(_neighbours, "x string").collect():
            self._add(r.x)

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def refuted(self, columns) -> bool:
        """Whether a pair is known that agrees on all of the columns."""
        m = self.mask(columns)
        return any(m & agree == m for agree, _ in self.seen)

    def undetermined(self, columns, dependent: str) -> bool:
        """Whether a pair is known that agrees on the columns and differs in the dependent."""
        m, d = self.mask(columns), self.bit[dependent]
        return any(m & agree == m and differ & d for agree, differ in self.seen)

    def _hashes(self, guess: tuple[str, ...]) -> tuple[Column, Column, Column]:
        """Two 64-bit hashes of a guess's values, and whether the row counts for it; where one is unique, so are the values."""
        cols = [_quoted(c) for c in guess]
        values = ", ".join([*cols, *(f"{c} is null" for c in cols)])  # a null is no value that hashes alike
        counts = F.lit(True) if self.nulls_equal else F.expr(" and ".join(f"{c} is not null" for c in cols))
        return F.expr(f"xxhash64({values})"), F.expr(f"xxhash64(1, {values})"), counts

    def prove(self, guesses: Sequence[tuple[str, ...]], share: int = 1) -> list[bool]:
        """Which of the column tuples are unique, by one aggregate; what refutes the others is remembered.

        Only hashes are shuffled, and dealt out before they are counted, as keys hardly repeat within a task.  With a ``share``
        of n one key in n is looked at: a tuple may then be refuted, but isn't proven.  Where a hash repeats, one more scan
        finds rows that have it.
        """
        asked = [g for g in guesses if not self.holds(g) and not self.refuted(g)]
        if asked:
            self.scans += 1
            keys, looked = [], []
            for g in asked:
                key, _, counts = self._hashes(g)
                looked.append(counts & (F.pmod(key, F.lit(share)) == 0) if share > 1 else counts)
                keys.append(F.when(looked[-1], key))
            some = self.df.filter(reduce(lambda x, y: x | y, looked))
            one = len(asked) == 1
            keyed = some.select(keys[0].alias("k")) if one else some.select(F.posexplode(F.array(*keys)).alias("i", "k")).filter("k is not null")
            by = ["k"] if one else ["i", "k"]  # no constant: it would be dealt out a second time
            if share == 1:
                keyed = keyed.repartition(self.rows * len(asked) // PART + 1, *by)
            twice = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            twice = [r for r in twice.groupBy((F.lit(0) if one else F.col("i")).alias("i")).agg(F.min("k").alias("k")).collect() if r.k is not None]
            if twice:
                self._learn({asked[r.i]: r.k for r in twice}, share == 1)
            if share == 1:
                self.proven |= {self.mask(g) for i, g in enumerate(asked) if i not in {r.i for r in twice}}
        return [self.holds(g) or (share > 1 and not self.refuted(g)) for g in guesses]

    def holds(self, columns) -> bool:
        """Whether the columns are known to be unique: those of a unique tuple and more are."""
        m = self.mask(columns)
        return any(m & p == p for p in self.proven)

    def _learn(self, keys: dict[tuple[str, ...], int], decide: bool) -> None:
        """Two rows of a group of each refuted tuple, by their values; the rows are few once their hash is known."""
        self.scans += 1
        own = [(counts & (a == k), b) for g, k in keys.items() for a, b, counts in [self._hashes(g)]]
        hit = [F.when(found, F.struct(F.lit(i).alias("i"), b.alias("b"))) for i, (found, b) in enumerate(own)]
        some = self.df.filter(reduce(lambda x, y: x | y, [found for found, _ in own])).select(_digests(self.names).alias("h"), F.explode(F.array(*hit)).alias("k")).filter("k is not null")
        twice = some.groupBy("k.i", "k.b").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.max("h").alias("p")).filter("n > 1")
        for r in twice.select("h", "p").collect():
            self._add(_letters(r.h, r.p))
        for g in keys if decide else ():
            if not self.refuted(g):  # hashes clashed: values decide
                if self._unique(g):
                    self.proven.add(self.mask(g))
                else:
                    self.seen[self.mask(g), 0] = None

    def _unique(self, columns) -> bool:
        rows = self.df if self.nulls_equal else self.df.dropna(subset=list(columns))
        self.scans += 1
        return rows.groupBy(*map(_quoted, columns)).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty()

    # -- searches -----------------------------------------------------------

    def hitting(self, width: int, distinct: dict[str, int] | None = None, rows: int = 0) -> Iterator[tuple[str, ...]]:
        """Tuples of ``width`` columns, first ones first, that no known pair refutes.

        Such a tuple has a column in each set in which a pair disagrees, so columns are taken only as
        long as the sets not met yet can be met by those that follow.  Tuples whose distinct
        values multiply to fewer than ``rows`` can't be unique and are left out.
        """
        n, every = len(self.names), (1 << len(self.names)) - 1
        room = [max((distinct or {}).get(c, rows), 1) for c in self.names]
        missed: list[int] = []  # least sets: a larger one is met with them
        for d in sorted({every & ~agree for agree, _ in self.seen}, key=int.bit_count):
            if not any(d & m == m for m in missed):
                missed.append(d)

        def apart(sets: list[int]) -> int:
            taken = count = 0
            for d in sets:
                if not d & taken:
                    taken |= d
                    count += 1
            return count

        def deeper(start: int, chosen: tuple[int, ...], open_: list[int]) -> Iterator[tuple[int, ...]]:
            left = width - len(chosen)
            if not left:
                yield chosen
                return
            for i in range(start, n - left + 1):
                if any(d >> i == 0 for d in open_):
                    return  # a set that nothing from here on meets
                rest = [d for d in open_ if not d >> i & 1]
                if (rest and left == 1) or apart(rest) > left - 1:
                    continue
                own = (*chosen, i)
                if prod(room[j] for j in own) * prod(sorted(room[i + 1:], reverse=True)[:left - 1]) < rows:
                    continue
                yield from deeper(i + 1, own, rest)

        for chosen in deeper(0, (), missed):
            yield tuple(self.names[i] for i in chosen)

    def first_unique(self, distinct: dict[str, int] | None = None, rows: int = 0, narrowest: int = 2, widest: int | None = None) -> tuple[str, ...]:
        """The first unique tuple, narrow ones first, in the order of the columns; () if there is none."""
        self.sample()
        self._rows = self._rows or rows or None
        everything, stood, failed = tuple(self.names), set(), False
        if len(everything) < narrowest:
            return ()
        share = max(SHARE, self.rows // LOOKED)
        for width in range(narrowest, len(everything) + 1):
            if widest and width > widest:
                log.warning("no key of up to %d of %d columns; wider ones are not looked for", widest, len(everything))
                return ()
            while guesses := list(islice(self.hitting(width, distinct, rows), GUESSES)):
                if guesses[0] not in stood:
                    open_ = [g for g in guesses if g not in stood]
                    stood.update(g for g, stands in zip(open_, self.prove(open_, share)) if stands)
                    continue
                standing = list(takewhile(stood.__contains__, guesses))[:PROOFS if failed else 1]
                for g, holds in zip(standing, self.prove(standing)):
                    if holds:
                        return g
                if not failed and not self.prove([everything])[0]:
                    return ()
                failed = True
            if not failed and width < len(everything) and not self.prove([everything])[0]:
                return ()  # no tuple of more columns is a key if all of them are none
            failed = True
        return ()

    def least(self, columns: Sequence[str]) -> tuple[str, ...] | None:
        """A unique tuple without the columns that it doesn't need, the first that can go going first; None if it isn't unique.

        What can't go from a tuple can't go from a smaller one, so each column is looked at once.
        What is left proves the whole with it, which is asked for itself only once a guess has failed.
        """
        self.sample()
        whole, failed = tuple(dict.fromkeys(columns)), False
        while not self.refuted(whole):
            kept = whole
            for c in whole:
                rest = tuple(x for x in kept if x != c)
                if rest and not self.refuted(rest):
                    kept = rest
            if all(self.prove([whole, kept] if failed else [kept])):
                return kept
            failed = True
        return None
