"""Validators of candidate models: topology, integrity, grain, homogeneity, stability."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..types import CONTINUOUS, TEMPORAL, TEXT, ColumnEvidence, Key, Model, Role
from . import dependencies, joins
from .models import STAR
from .pairs import Pairs

# Weights of dimension purity, words of descriptive columns, tolerances of stability.
ENTROPY, VARIATION, SKEWNESS, IMPURE = 0.4, 0.3, 0.3, 0.85
DESCRIPTIVE_WORDS = ("name", "label", "description", "category", "type", "status", "city", "country", "region")
ABSOLUTE, RELATIVE = 0.001, 0.000001
METRICS = ("sum", "count", "avg", "min", "max")
THREADS = 4


@dataclass(frozen=True)
class Issue:
    rule: str
    severity: str
    message: str
    table: str = ""
    target: str = ""


# -- topology ---------------------------------------------------------------

def cycles(edges) -> list[tuple[str, ...]]:
    """Cycles met by a depth-first walk, each as the path that closes it; no recursion."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    found, done = set(), set()
    for root in list(after):
        path, place, todo = [], {}, [(root, False)]
        while todo:
            node, leave = todo.pop()
            if leave:
                del place[path.pop()]
                done.add(node)
            elif node in place:
                found.add((*path[place[node]:], node))
            elif node not in done:
                place[node] = len(path)
                path.append(node)
                todo.append((node, True))
                todo += [(n, False) for n in reversed(after.get(node, []))]
    return sorted(found)


def topology(m: Model) -> list[Issue]:
    facts, dimensions, out = set(m.facts), set(m.dimensions), []
    for e in m.edges:
        if e.source == e.target:
            out.append(Issue("NO_SELF_LOOP", "ERROR", f"{e.source} links to itself.", e.source, e.target))
        elif e.source in facts and e.target in facts:
            out.append(Issue("NO_FACT_TO_FACT_EDGE", "ERROR", f"{e.source} and {e.target} are both facts.", e.source, e.target))
        if m.kind == STAR and (e.source not in facts or e.target not in dimensions or e.depth != 1):
            out.append(Issue("STAR_DIRECT_TO_DIMENSION", "ERROR", "A star has only edges from its fact to dimensions.", e.source, e.target))
    return out + [Issue("NO_CYCLE", "ERROR", f"Cycle: {' -> '.join(c)}.") for c in cycles([(e.source, e.target) for e in m.edges])]


def topology_issues(edges: DataFrame) -> DataFrame:
    """The same without cycles, over rows (model_id, model_type, source_table, source_role, target_table, target_role, depth)."""
    c = F.col
    loop = c("source_table") == c("target_table")
    fact_fact = (c("source_role") == "FACT") & (c("target_role") == "FACT") & ~loop
    not_star = (c("model_type") == STAR) & ((c("source_role") != "FACT") | (c("target_role") != "DIMENSION") | (c("depth") != 1))
    rules = F.array(F.when(loop, "NO_SELF_LOOP"), F.when(fact_fact, "NO_FACT_TO_FACT_EDGE"), F.when(not_star, "STAR_DIRECT_TO_DIMENSION"))
    return edges.select("model_id", F.explode(F.array_compact(rules)).alias("rule_name"), "source_table", "target_table")


def structure(m: Model, tables: dict[str, DataFrame], known: dict[tuple, int]) -> dict:
    """Topology and referential integrity; orphan counts of a join are kept in ``known``."""
    issues, total = topology(m), 0
    for e in m.edges:
        at = (e.source, e.source_columns, e.target, e.target_columns)
        if at not in known:
            known[at] = joins.count_orphans(tables[e.source], e.source_columns, tables[e.target], e.target_columns).first().orphans
        if known[at]:
            total += known[at]
            issues.append(Issue("REFERENTIAL_INTEGRITY", "ERROR", f"{known[at]} value(s) of {e.source} are missing in {e.target}.", e.source, e.target))
    return {"model_id": m.id, "is_valid": not issues, "issue_count": len(issues), "orphan_count": total, "issues": issues}


# -- grain ------------------------------------------------------------------

def fact_grain(m: Model, fact: str, best: Key | None) -> tuple[str, ...]:
    """Foreign keys of the fact's dimensions, then the columns of its best key."""
    own = [c for e in m.edges if e.source == fact and e.target in m.dimensions for c in e.source_columns]
    return tuple(dict.fromkeys([*own, *(best.columns if best else ())]))


def count_duplicate_grains(df: DataFrame, columns) -> DataFrame:
    return dependencies.duplicate_groups(df, columns, ignore_nulls=True).agg(F.count(F.lit(1)).alias("duplicates"))


class Grains:
    """Grains of tables; what was found for a tuple of columns is kept.  ``proven``: tuples of columns known to be unique."""

    def __init__(self, tables: dict[str, DataFrame], proven: dict[str, list[tuple[str, ...]]] | None = None):
        self.tables, self.proven, self.known, self.least = tables, proven or {}, {}, {}

    def duplicates(self, table: str, columns: tuple[str, ...]) -> int:
        at = (table, frozenset(columns))
        if at not in self.known:
            self.known[at] = count_duplicate_grains(self.tables[table], columns).first().duplicates
        return self.known[at]

    def minimal(self, table: str, columns: tuple[str, ...]) -> tuple[str, ...] | None:
        """Without the columns that uniqueness doesn't need; the first that can go goes, again and again. None if it isn't unique.

        What pairs of rows refute is not counted, and the tuple that is left proves the wider ones
        with it, so a table is usually aggregated once.
        """
        at = (table, tuple(columns))
        if at not in self.least:
            pairs = Pairs(self.tables[table], columns, nulls_equal=False)
            pairs.proven |= {pairs.mask(c) for c in self.proven.get(table, ()) if set(c) <= set(columns)}
            self.least[at] = pairs.least(columns)
        return self.least[at]

    def validate(self, m: Model, fact: str, best: Key | None) -> dict:
        grain, n = fact_grain(m, fact, best), 0
        if grain:
            least = self.minimal(fact, grain)
            n = 0 if least else self.duplicates(fact, grain)
            grain = least or grain
        ok = bool(grain) and n == 0
        reason = "each grain has one row" if ok else f"{n} grain(s) with several rows" if grain else "no foreign key or key gives a grain"
        return {"model_id": m.id, "fact_table": fact, "grain_columns": grain, "duplicate_count": n, "is_valid": ok, "reason": reason}


# -- homogeneity ------------------------------------------------------------

def impurity(c: ColumnEvidence) -> float:
    """How much a dimension's column looks like a measure."""
    return ENTROPY * c.entropy_ratio + VARIATION * min(abs(c.variation) / 2, 1.0) + SKEWNESS * math.tanh(abs(c.skewness))


def impurity_column(entropy_ratio: Column, variation: Column, skewness: Column) -> Column:
    return ENTROPY * entropy_ratio + VARIATION * F.least(F.abs(variation) / 2, F.lit(1.0)) + SKEWNESS * F.tanh(F.abs(skewness))


def descriptive_in_fact(c: ColumnEvidence, structural: set[str]) -> bool:
    low = c.column.lower()
    skip = c.column in structural or names.key_like(c.column) or c.kind == TEMPORAL or "date" in low or names.measure_like(c.column)
    return not skip and c.kind == TEXT and any(w in low for w in DESCRIPTIVE_WORDS)


def homogeneity(role: Role, columns: list[ColumnEvidence], structural: set[str]) -> dict | None:
    """Dimensions without measures, facts without descriptions; other tables are not judged."""
    if role.role == "DIMENSION":
        bad = [c.column for c in columns if c.numeric and not names.key_like(c.column) and impurity(c) > IMPURE]
    elif role.role == "FACT":
        bad = [c.column for c in columns if descriptive_in_fact(c, structural)]
    else:
        return None
    kind = role.role.lower()
    return {"table_name": role.table, "role": role.role, "is_valid": not bad, "homogeneity_score": round(max(0.0, 1 - 0.2 * len(bad)), 2),
            "columns": bad, "issue_count": len(bad),
            "reason": f"Columns out of place in a {kind} table: {', '.join(bad)}" if bad else f"every column fits a {kind} table"}


# -- stability --------------------------------------------------------------

def best_measure(columns: list[ColumnEvidence]) -> str | None:
    """The numeric column that varies most, but no key, constant or flat one."""
    fit = [c for c in columns if c.numeric and not names.key_like(c.column) and c.distinct > 1 and (c.entropy_ratio >= 0.05 or abs(c.variation) >= 0.05)]
    return min(fit, key=lambda c: (-c.variation, c.column)).column if fit else None


def best_grouping(columns: list[ColumnEvidence]) -> str | None:
    """The text or date column of least entropy that repeats, else another such column."""
    fit = [c for c in columns if c.uniqueness < 0.95 and not names.key_like(c.column) and c.kind != CONTINUOUS]
    return min(fit, key=lambda c: (c.kind not in (TEXT, TEMPORAL), c.entropy_ratio, c.column)).column if fit else None


def _metrics(prefix: str, x: dict[str, Column]) -> list[Column]:
    return [(F.coalesce(x[m], F.lit(0)).cast("long") if m == "count" else F.coalesce(x[m].cast("double"), F.lit(0.0))).alias(f"{prefix}_{m}") for m in METRICS]


def stability(fact: DataFrame, dimension: DataFrame, source_columns, target_columns, measure: str, grouping: str) -> DataFrame:
    """One row: metrics of the measure on the fact, and through the dimension's grouping, and whether they agree."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    x, keys = q(measure), [f"k{i}" for i in range(len(source_columns))]
    # Sums by foreign key come before the join: the fact is shuffled once, a row for each key and task, and a key that the dimension repeats still repeats its sums.
    f = fact.select(x.alias("__x"), *[q(c).alias(k) for c, k in zip(source_columns, keys)]).groupBy(*keys).agg(
        F.sum("__x").cast("double").alias("s"), F.count("__x").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    parts = {"sum": F.sum("s"), "count": F.sum("n"), "avg": F.try_divide(F.sum("s"), F.sum("n")), "min": F.min("lo"), "max": F.max("hi")}
    fine = f.agg(*_metrics("fine", parts))
    d = dimension.select(q(grouping).alias("__g"), *[q(c).alias(k) for c, k in zip(target_columns, keys)])
    level = f.join(d, keys, "left").groupBy("__g").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    through = level.agg(*_metrics("agg", parts))
    both = fine.crossJoin(F.broadcast(through))  # one row each

    def close(m: str) -> Column:
        a, b = F.col(f"fine_{m}"), F.col(f"agg_{m}")
        if m == "count":
            return a == b
        gap = F.abs(a - b)
        return (gap <= ABSOLUTE) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= RELATIVE)

    failed = F.array_compact(F.array(*[F.when(~close(m), f"{m} differs") for m in METRICS]))
    shown = [F.round(F.col(f"{p}_{m}"), 4).alias(f"{p}_{m}") if m != "count" else F.col(f"{p}_{m}") for m in METRICS for p in ("fine", "agg")]
    return both.withColumn("failed", failed).select(
        *shown, (F.size("failed") == 0).alias("is_stable"),
        F.when(F.size("failed") == 0, F.lit(f"Agrees when grouped by {grouping}")).otherwise(F.array_join("failed", ", ")).alias("reason"))


def check_stability(m: Model, tables: dict[str, DataFrame], evidence: dict[str, list[ColumnEvidence]], known: dict[tuple, dict]) -> list[dict]:
    """Reports of the fact-to-dimension edges that have a measure and a grouping."""
    asked = []
    for e in m.edges:
        if e.source not in m.facts or e.target not in m.dimensions or len(e.source_columns) != len(e.target_columns):
            continue
        measure, grouping = best_measure(evidence.get(e.source, [])), best_grouping(evidence.get(e.target, []))
        if not measure or not grouping:
            continue
        asked.append(((e.source, e.source_columns, e.target, e.target_columns), measure, grouping))
    new = {at: (measure, grouping) for at, measure, grouping in asked if at not in known}
    with ThreadPoolExecutor(THREADS) as pool:
        known.update(zip(new, pool.map(lambda at: stability(tables[at[0]], tables[at[2]], at[1], at[3], *new[at]).first().asDict(), new)))
    return [{"model_id": m.id, "fact_table": at[0], "dimension_table": at[2], "measure_column": measure, "group_column": grouping} | known[at] for at, measure, grouping in asked]
