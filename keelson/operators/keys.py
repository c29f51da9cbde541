"""Candidate keys: simple ones from the profiles, minimal composite ones, and their ranking."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame

from ..functions.names import key_like
from ..types import CONTINUOUS, ColumnEvidence, Key
from . import dependencies
from .pairs import Pairs

# Weights of a key's confidence, and the shape of columns with few values.
UNIQUENESS, IDENTIFIABILITY = 0.7, 0.3
EXACT = 0.999999999
FEW_VALUES, FEW_ROWS = 0.2, 10


def few_values(c: ColumnEvidence) -> bool:
    return c.rows >= FEW_ROWS and c.uniqueness <= FEW_VALUES and c.null_ratio < 1


def confidence(uniqueness: float, identifiability: float) -> float:
    return round(UNIQUENESS * uniqueness + IDENTIFIABILITY * identifiability, 6)


def make_key(columns: list[ColumnEvidence], rows: int, null_ratio: float, uniqueness: float) -> Key:
    ident = sum(c.identifiability for c in columns) / len(columns)
    return Key(columns[0].table, tuple(c.column for c in columns), tuple(c.type for c in columns), tuple(c.kind for c in columns),
               rows, null_ratio, uniqueness, ident, confidence(uniqueness, ident), sum(map(few_values, columns)))


def rank_of(k: Key) -> tuple:
    """Smaller is better; table and columns settle what is equal otherwise."""
    return (len(k.columns), k.kinds.count(CONTINUOUS), k.low_cardinality, -sum(map(key_like, k.columns)),
            -sum(x in ("integer", CONTINUOUS) for x in k.kinds), -k.uniqueness, k.null_ratio, -k.identifiability, -k.confidence,
            k.table, k.columns)


def ranked(keys: list[Key]) -> list[Key]:
    return sorted(keys, key=rank_of)


def best_by_table(keys: list[Key]) -> dict[str, Key]:
    best: dict[str, Key] = {}
    for k in ranked(keys):
        best.setdefault(k.table, k)
    return best


def simple_keys(evidence: list[ColumnEvidence], threshold: float = EXACT) -> list[Key]:
    """Columns without nulls whose exact distinct count is the row count, but no fractions.

    The profile's counts are exact, so they verify a key without another scan.
    """
    return ranked([make_key([c], c.rows, 0.0, 1.0) for c in evidence
                   if c.rows > 0 and c.null_rows == 0 and c.uniqueness >= threshold and c.distinct == c.rows
                   and c.kind != CONTINUOUS and not c.column.startswith("__")])


def minimal_composite(df: DataFrame, columns: list[ColumnEvidence], max_width: int | None = None) -> tuple[str, ...]:
    """The first unique combination of two or more columns, narrow ones first, in the order given.

    Combinations that a known pair of rows refutes are never formed, and the rest is proven on
    all rows (``pairs``): one aggregate on a share of the keys for up to 24 guesses, and one on all rows for the
    first that stands; whether there is a key at all is asked only once that has failed.
    """
    names = list(dict.fromkeys(c.column for c in columns))
    if len(names) < 2 or not columns[0].rows:
        return ()
    return Pairs(df, names).first_unique({c.column: c.distinct for c in columns}, columns[0].rows, 2, max_width)


def composite_keys(tables: dict[str, DataFrame], evidence: list[ColumnEvidence], without: list[str], max_width: int | None = None,
                   known: dict[str, tuple[str, ...]] | None = None) -> list[Key]:
    """A minimal composite key for each table that has no simple one; of tables in ``known`` it is known."""
    by_table: dict[str, list[ColumnEvidence]] = defaultdict(list)
    for c in sorted(evidence, key=lambda c: (c.table, c.column)):
        if c.null_rows == 0 and not c.column.startswith("__"):
            by_table[c.table].append(c)
    found = []
    for t in without:
        own = sorted(by_table[t], key=lambda c: (confidence(c.uniqueness, c.identifiability), c.uniqueness, c.identifiability), reverse=True)
        combo = (known or {}).get(t) or (minimal_composite(tables[t], own, max_width) if len(own) > 1 else ())
        if combo:
            at = {c.column: c for c in own}
            found.append(make_key([at[c] for c in combo], own[0].rows, max(at[c].null_ratio for c in combo), 1.0))
    return found


def tables_without(keys: list[Key], tables) -> list[str]:
    have = {k.table for k in keys}
    return sorted(t for t in tables if t not in have)


def infer_keys(tables: dict[str, DataFrame], evidence: list[ColumnEvidence], max_width: int | None = None, known: dict[str, tuple[str, ...]] | None = None) -> list[Key]:
    """All candidates: simple keys, and composite ones for tables without."""
    simple = simple_keys([c for c in evidence if c.table in tables])
    return ranked(simple + composite_keys(tables, evidence, tables_without(simple, tables), max_width, known))


def determinant_keys(tables: dict[str, DataFrame], evidence: list[ColumnEvidence], determinants: dict[str, tuple[str, ...]], proven: dict[str, list[tuple[str, ...]]] | None = None) -> list[Key]:
    """Keys of logical dimensions from their determinants, where these are exact; ``proven``: tuples that are exact keys without a look at the table."""
    at = {(c.table, c.column): c for c in evidence}
    found = []
    for table, columns in sorted(determinants.items()):
        if not columns or any((table, c) not in at for c in columns):
            continue
        if any(set(p) == set(columns) for p in (proven or {}).get(table, ())):
            found.append(make_key([at[table, c] for c in columns], at[table, columns[0]].rows, 0.0, 1.0))
            continue
        shape = dependencies.key_shape(tables[table], table, [columns]).first()
        if shape.rows > 0 and shape.null_ratio == 0 and shape.uniqueness_ratio == 1:
            found.append(make_key([at[table, c] for c in columns], shape.rows, 0.0, 1.0))
    return ranked(found)


def logical_keys(tables: dict[str, DataFrame], evidence: list[ColumnEvidence], determinants: dict[str, tuple[str, ...]],
                 proven: dict[str, list[tuple[str, ...]]] | None = None) -> list[Key]:
    """The official key of each logical table; a dimension's determinant comes before anything else.

    ``proven``: for tables with the rows of their source its keys, as far as they have the columns.  A composite one
    is the first of fewer columns, too.
    """
    composite = {t: next(c for c in own if len(c) > 1) for t, own in (proven or {}).items() if any(len(c) > 1 for c in own)}
    best = best_by_table(infer_keys(tables, evidence, known=composite)) | best_by_table(determinant_keys(tables, evidence, determinants, proven))
    return ranked(list(best.values()))
