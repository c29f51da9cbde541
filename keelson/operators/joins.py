"""Joins: coverage of a key, orphans, and the discovery of relationships."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import same_concept, yearly_parts
from ..types import ColumnEvidence, Join, Key

# Of discovery.
LEAST_RATIO = 0.95
WIDEST_KEY = 3
MARGIN = 1.1
THREADS = 4


def _parts(df: DataFrame, columns, prefix: str) -> DataFrame:
    out = df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"{prefix}{i}") for i, c in enumerate(columns)])
    return out.dropna(how="any")


def coverage(source: DataFrame, source_columns, target: DataFrame, target_columns, limit: int | None = None) -> DataFrame:
    """(rows, matched, ratio): source tuples without nulls, and how many the target has.

    Equal source tuples are counted before the join, so a frequent one costs a row.
    """
    s = _parts(source, source_columns, "k")
    s = s.limit(limit) if limit else s
    keys = [f"k{i}" for i in range(len(source_columns))]
    counted = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = _parts(target, target_columns, "k").distinct().withColumn("hit", F.lit(1))
    total, matched = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.coalesce("hit", F.lit(0))), F.lit(0))
    return counted.join(there, keys, "left").agg(
        total.cast("long").alias("rows"), matched.cast("long").alias("matched"),
        F.round(F.coalesce(F.try_divide(matched.cast("double"), total.cast("double")), F.lit(0.0)), 6).alias("ratio"))


def evaluate(tables: dict[str, DataFrame], source: str, columns, key: Key, limit: int | None = None) -> Join:
    """The coverage of one key; ValueError if it is not one."""
    if not key.exact:
        raise ValueError(f"{key.table}({', '.join(key.columns)}) is not an exact key")
    if len(columns) != len(key.columns):
        raise ValueError("source and key differ in width")
    r = coverage(tables[source], columns, tables[key.table], key.columns, limit).first()
    return Join(source, tuple(columns), key.table, key.columns, r.rows, r.matched, r.ratio)


def evaluate_named(tables: dict[str, DataFrame], keys: list[Key], source: str, columns, target: str, target_columns, limit: int | None = None) -> Join:
    """The same for a key given by name; ValueError if no such key is known."""
    for k in keys:
        if k.table == target and k.columns == tuple(target_columns):
            return evaluate(tables, source, columns, k, limit)
    raise ValueError(f"no key {target}({', '.join(target_columns)})")


def orphans(source: DataFrame, source_columns, target: DataFrame, target_columns) -> DataFrame:
    """Distinct source tuples without nulls that the target lacks."""
    keys = [f"k{i}" for i in range(len(source_columns))]
    return _parts(source, source_columns, "k").distinct().join(_parts(target, target_columns, "k"), keys, "left_anti")


def count_orphans(source: DataFrame, source_columns, target: DataFrame, target_columns) -> DataFrame:
    return orphans(source, source_columns, target, target_columns).agg(F.count(F.lit(1)).alias("orphans"))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def may_refer(c: ColumnEvidence, k: ColumnEvidence) -> bool:
    """Whether a column's type, number of values and range fit those of a key column elsewhere."""
    if c.table == k.table or c.type != k.type or c.distinct > MARGIN * k.distinct:
        return False
    ends = [_number(x) for x in (c.min_value, c.max_value, k.min_value, k.max_value)] if c.numeric else [None]
    return None in ends or (ends[0] >= ends[2] and ends[1] <= ends[3])


def prefiltered(evidence: list[ColumnEvidence], keys: list[Key]) -> list[ColumnEvidence]:
    at = {(c.table, c.column): c for c in evidence}
    parts = [at[k.table, c] for k in keys for c in k.columns if (k.table, c) in at]
    return [c for c in evidence if c.null_ratio < 1 and not c.column.startswith("__") and any(may_refer(c, k) for k in parts)]


def candidates(evidence: list[ColumnEvidence], keys: list[Key], widest: int = WIDEST_KEY) -> list[tuple[str, tuple[str, ...], Key]]:
    """(source, columns, key) worth a test: prefiltered columns of the key's types with its concepts."""
    keys = [k for k in keys if k.exact]
    pools: dict[str, dict[str, list[ColumnEvidence]]] = defaultdict(lambda: defaultdict(list))
    for c in prefiltered(evidence, keys):
        pools[c.table][c.type].append(c)
    jobs = []
    for k in keys:
        if len(k.columns) > widest:
            continue
        for table in pools:
            if table == k.table or yearly_parts(table, k.table):
                continue
            fits = [[c for c in pools[table].get(t, ()) if same_concept(c.column, kc)] for t, kc in zip(k.types, k.columns)]
            for combo in product(*fits):
                columns = tuple(c.column for c in combo)
                if len(set(columns)) == len(columns):
                    jobs.append((table, columns, k))
    return jobs


#: Source tuples that one aggregate counts side by side, and keys that it marks.
SOURCES, MARKS = 48, 60


def covered(tables: dict[str, DataFrame], jobs: list[tuple[str, tuple[str, ...], Key]], limit: int | None = None, known: dict[tuple, Join] | None = None) -> list[Join]:
    """The coverage of every (source, columns, key), by one pass for all whose columns have the same types.

    Each value (a tuple for a composite key) gets one row: how often each source column has it, and
    which keys have it.  Counts are combined before the only shuffle, so a frequent value is a row
    for each task.  Sums over these rows give all pairs at once; no pair is joined.  What is ``known``
    by (source, columns, target, columns) isn't tested; what is tested is added.
    """
    found = {} if known is None else known
    by_type: dict[tuple[str, ...], list] = defaultdict(list)
    for j in jobs:
        if (j[0], j[1], j[2].table, j[2].columns) not in found:
            by_type[j[2].types].append(j)
    lots = []
    for same in by_type.values():
        keys = list(dict.fromkeys((j[2].table, j[2].columns) for j in same))
        for k in range(0, len(keys), MARKS):
            marked = keys[k:k + MARKS]
            near = [j for j in same if (j[2].table, j[2].columns) in marked]
            sources = list(dict.fromkeys((j[0], j[1]) for j in near))
            lots += [(part := sources[s:s + SOURCES], marked, [j for j in near if (j[0], j[1]) in part]) for s in range(0, len(sources), SOURCES)]
    with ThreadPoolExecutor(THREADS) as pool:
        for lot in pool.map(lambda lot: _covered(tables, *lot, limit), lots):
            found.update(lot)
    return [found[s, c, k.table, k.columns] for s, c, k in jobs]


def _covered(tables: dict[str, DataFrame], sources, marked, jobs, limit) -> dict:
    def tuples(table: str, columns, source: int, key: int) -> Column:
        cols = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        return F.when(whole, F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)], F.lit(source).alias("s"), F.lit(key).alias("k")))

    rows = []
    for table in dict.fromkeys([t for t, _ in sources] + [t for t, _ in marked]):
        own = [tuples(t, c, i, -1) for i, (t, c) in enumerate(sources) if t == table]
        keys = [tuples(t, c, -1, i) for i, (t, c) in enumerate(marked) if t == table]
        if limit:  # a quick look: so many tuples of each source
            rows += [tables[table].select(x.alias("x")).filter("x is not null").limit(limit) for x in own] + [tables[table].select(x.alias("x")).filter("x is not null") for x in keys]
        else:
            rows.append(tables[table].select(F.explode(F.array(*own, *keys)).alias("x")).filter("x is not null"))
    every = reduce(DataFrame.unionAll, rows).select("x.*")
    values = every.groupBy(*[c for c in every.columns if c.startswith("v")]).agg(*[F.count_if(F.col("s") == i).alias(f"n{i}") for i in range(len(sources))],
                                    F.coalesce(F.bit_or(F.when(F.col("k") >= 0, F.expr("shiftleft(1L, k)"))), F.lit(0)).alias("keys"))
    at, to = {x: i for i, x in enumerate(sources)}, {x: i for i, x in enumerate(marked)}
    pairs = list(dict.fromkeys((s, c, k.table, k.columns) for s, c, k in jobs))
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(sources))] + [
        F.sum(F.when(F.col("keys").bitwiseAND(F.lit(1 << to[t, tc])) != 0, F.col(f"n{at[s, c]}")).otherwise(0)).alias(f"m{i}") for i, (s, c, t, tc) in enumerate(pairs)]
    r = values.agg(*sums).first()
    out = {}
    for i, (s, c, t, tc) in enumerate(pairs):
        total, matched = r[f"n{at[s, c]}"] or 0, r[f"m{i}"] or 0
        out[s, c, t, tc] = Join(s, tuple(c), t, tuple(tc), total, matched, round(matched / total, 6) if total else 0.0)
    return out


def discover(tables: dict[str, DataFrame], evidence: list[ColumnEvidence], keys: list[Key], least: float = LEAST_RATIO, limit: int | None = None,
             known: dict[tuple, Join] | None = None) -> list[Join]:
    """Joins whose coverage reaches ``least``; candidates of the same types are tested together.

    All rows are tested unless ``limit`` asks for a quick look at some.
    """
    evidence = [c for c in evidence if c.table in tables]
    jobs = candidates(evidence, [k for k in keys if k.table in tables])
    return [j for j in covered(tables, jobs, limit, known) if j.ratio >= least]


def coverage_table(tables: dict[str, DataFrame], pairs) -> DataFrame:
    """coverage of many (source, columns, target, columns) as one DataFrame."""
    def one(s, sc, t, tc):
        return coverage(tables[s], sc, tables[t], tc).select(
            F.lit(s).alias("source_table"), F.lit(",".join(sc)).alias("source_columns"), F.lit(t).alias("target_table"),
            F.lit(",".join(tc)).alias("target_columns"), "rows", "matched", "ratio")

    return reduce(DataFrame.unionAll, [one(*p) for p in pairs])
