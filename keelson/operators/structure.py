"""Entity keys and relationships of source tables."""

from __future__ import annotations

from ..functions.names import key_like
from ..types import Join, Key, Structure


def entity_keys(keys: list[Key], joins: list[Join]) -> dict[str, Key]:
    """The key that a table owns: the one others point to more than it points elsewhere."""
    def score(k: Key) -> tuple:
        sources = {j.source for j in joins if j.target == k.table and j.target_columns == k.columns}
        targets = {j.target for j in joins if j.source == k.table and j.source_columns == k.columns}
        return (len(sources) - len(targets), len(sources), sum(map(key_like, k.columns)), k.identifiability, -len(k.columns), ",".join(k.columns))

    best: dict[str, Key] = {}
    for k in keys:
        if k.exact and (k.table not in best or score(k) > score(best[k.table])):
            best[k.table] = k
    return best


def relationships(joins: list[Join], owned: dict[str, Key]) -> list[Join]:
    """Joins to entity keys, each once."""
    once: dict[tuple, Join] = {}
    for j in joins:
        if j.target in owned and j.target_columns == owned[j.target].columns:
            once.setdefault((j.source, j.source_columns, j.target, j.target_columns), j)
    return list(once.values())


def structures(tables, keys: list[Key], joins: list[Join]) -> dict[str, Structure]:
    owned = entity_keys(keys, joins)
    edges = relationships(joins, owned)
    return {t: Structure(t, owned.get(t), tuple(j for j in edges if j.target == t), tuple(j for j in edges if j.source == t)) for t in sorted(tables)}
