"""Uniqueness, functional dependencies and the shapes of keys and determinants."""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pairs import Pairs


def _cols(names) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def _none_null(names) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in _cols(names)])


def duplicate_groups(df: DataFrame, columns, ignore_nulls: bool = False) -> DataFrame:
    """Groups of rows equal in ``columns``, nulls being equal; optionally only of rows without nulls there."""
    rows = df.filter(_none_null(columns)) if ignore_nulls else df
    return rows.groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")


def is_unique(df: DataFrame, columns) -> bool:
    return duplicate_groups(df, columns).isEmpty()


def unique_only(df: DataFrame, candidates) -> list[tuple[str, ...]]:
    """Those of the column tuples that are unique, in their order."""
    return [tuple(c) for c in candidates if is_unique(df, c)]


def unique_test(df: DataFrame, table: str, candidates) -> DataFrame:
    """(table_name, columns, is_unique) for each candidate column tuple."""
    def one(columns):
        return duplicate_groups(df, columns).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("columns"), (F.col("n") == 0).alias("is_unique"))

    return reduce(DataFrame.unionAll, map(one, candidates))


def _told_apart(df: DataFrame, dependents) -> list[list[Column]]:
    """For each dependent the columns whose least and greatest value in a group differ if it takes two values there.

    Texts are told apart by two 64-bit hashes, which keeps the aggregate on fixed-width values.
    """
    text = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return [[F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c))] if n in text else [c] for n, c in zip(dependents, _cols(dependents))]


def dependency_test(df: DataFrame, determinants, dependents) -> DataFrame:
    """(dependent, violations) of one determinant for all dependents in one aggregate.

    Rows with a null in the determinant don't count, nor nulls of a dependent.  A group
    violates if its least and greatest value differ.
    """
    own = df.filter(_none_null(determinants)).groupBy(*_cols(determinants)).agg(
        *[(F.min(c) != F.max(c)).alias(f"__v{i}") for i, c in enumerate(_cols(dependents))])
    return own.agg(*[F.count_if(F.coalesce(f"__v{i}", F.lit(False))).alias(f"__v{i}") for i in range(len(dependents))]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dependent"), F.col(f"__v{i}").alias("violations")) for i, c in enumerate(dependents)])).alias("x")).select("x.*")


#: Rows times determinants from which those of many values are grouped one after another, rows looked at to tell them, and of those the
#: least share of different values and the most of one value.
LARGE, LOOKED, MANY, ONE = 1 << 23, 1 << 17, 1 / 8, 1 / 64
#: Rows that a task groups, about.
PART = 1 << 18


def dependency_sets(df: DataFrame, determinants, dependents) -> DataFrame:
    """(position, determinant, distinct, uniqueness, repeated, violations: a map by dependent) of many determinants.

    Rows with a null in a determinant don't count for it.  Of a small table all are grouping sets of one aggregate over one scan.
    Of a large one those whose values hardly repeat get an aggregate each, computed now, as their rows
    can't be combined before the shuffle; what one left on disk is freed before the next.
    """
    sets = [tuple(dict.fromkeys(d)) for d in determinants]
    rows = df.count() if sets else 0
    many = _many_values(df, sets) if rows * len(sets) > LARGE else set()
    parts = [_grouping_sets(df, few, dependents)] if (few := [(i, d) for i, d in enumerate(sets) if i not in many]) or not many else []
    done = []
    for i in sorted(many):
        done += _one_set(df, sets[i], dependents, rows).select(F.lit(i).alias("position"), F.lit(",".join(sets[i])).alias("determinant"), "*").collect()
        _free(df.sparkSession)
    if done:
        parts.append(df.sparkSession.createDataFrame(done, "position int, determinant string, distinct long, uniqueness double, repeated long, violations map<string,bigint>"))
    return reduce(DataFrame.unionAll, parts)


def _free(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _many_values(df: DataFrame, sets) -> set[int]:
    """Those of the sets whose values hardly repeat among some rows, none of them often: a look that decides how they are grouped, no more."""
    some = df.select(F.array(*[F.when(_none_null(d), F.xxhash64(*_cols(d))) for d in sets]).alias("h")).limit(LOOKED)
    counted = some.select(F.posexplode("h").alias("i", "h")).filter("h is not null").groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
    looked = counted.groupBy("i").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"), F.max("n").alias("most")).collect()
    return {r.i for r in looked if r["values"] > r.rows * MANY and r.most < LOOKED * ONE}


def _violated(value: list[list[Column]]) -> list[Column]:
    """For each dependent whether it takes two values in a group; its columns are v{i}_{j}."""
    return [reduce(lambda a, b: a | b, [F.coalesce(F.min(f"v{i}_{j}") != F.max(f"v{i}_{j}"), F.lit(False)) for j in range(len(vs))]) for i, vs in enumerate(value)]


def _map(dependents) -> Column:
    if not dependents:
        return F.lit(None).cast("map<string,bigint>")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in dependents]), F.array(*[F.coalesce(f"__v{i}", F.lit(0)).cast("long") for i in range(len(dependents))]))


def _shape() -> list[Column]:
    n, total = F.coalesce("distinct", F.lit(0)), F.coalesce("rows", F.lit(0))
    return [n.alias("distinct"), F.coalesce(F.try_divide(n.cast("double"), total.cast("double")), F.lit(1.0)).alias("uniqueness"), (total - n).alias("repeated")]


def _one_set(df: DataFrame, d, dependents, rows: int) -> DataFrame:
    """(distinct, uniqueness, repeated, violations) of one determinant whose values hardly repeat: rows are dealt out by it before they are grouped."""
    value, by = _told_apart(df, dependents), [f"d{i}" for i in range(len(d))]
    own = df.filter(_none_null(d)).select(*[c.alias(n) for n, c in zip(by, _cols(d))], *[v.alias(f"v{i}_{j}") for i, vs in enumerate(value) for j, v in enumerate(vs)])
    grouped = own.repartition(rows // PART + 1, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"__v{i}") for i, x in enumerate(_violated(value))])
    return grouped.agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), *[F.count_if(f"__v{i}").alias(f"__v{i}") for i in range(len(dependents))]).select(
        *_shape(), _map(dependents).alias("violations"))


def _grouping_sets(df: DataFrame, asked: list[tuple[int, tuple[str, ...]]], dependents) -> DataFrame:
    """The determinants as grouping sets of one aggregate: each row is expanded to a row for each of them and combined before the shuffle."""
    sets = [d for _, d in asked]
    names = list(dict.fromkeys(c for d in sets for c in d))
    value = _told_apart(df, dependents)
    rows = df.select(*[c.alias(f"d{i}") for i, c in enumerate(_cols(names))], *[v.alias(f"v{i}_{j}") for i, vs in enumerate(value) for j, v in enumerate(vs)])
    at = {n: f"d{i}" for i, n in enumerate(names)}
    grouped = rows.groupingSets([[F.col(at[c]) for c in d] for d in sets], *[F.col(f"d{i}") for i in range(len(names))]).agg(
        F.grouping_id().alias("__id"), F.count(F.lit(1)).alias("__n"), *[x.alias(f"__v{i}") for i, x in enumerate(_violated(value))])
    ids = {d: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in d) for d in sets}  # a bit for each column that is not grouped by
    mine = F.array(*[F.when((F.col("__id") == ids[d]) & reduce(lambda a, b: a & b, [F.col(at[c]).isNotNull() for c in d]), F.lit(i)) for i, d in enumerate(sets)])
    found = grouped.withColumn("__i", F.explode(F.array_compact(mine))).groupBy("__i").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("__n").alias("rows"), *[F.count_if(f"__v{i}").alias(f"__v{i}") for i in range(len(dependents))])
    every = df.sparkSession.createDataFrame([(i, at, ",".join(d)) for i, (at, d) in enumerate(asked)], "__i int, position int, determinant string")
    return every.join(found, "__i", "left").select("position", "determinant", *_shape(), _map(dependents).alias("violations"))


#: Grouping sets of one aggregate, and columns grouped by (their marks share a long).
SETS, GROUPED = 64, 60


def tested(df: DataFrame, asked: list[tuple[tuple[str, ...], list[str]]], pairs: Pairs | None = None) -> list[tuple[int, float, int, list[str]]]:
    """(distinct, uniqueness, repeated, those of the dependents that are determined) for each (determinant, dependents), by one scan for up to SETS of them.

    Dependents that a known pair of rows refutes are not looked at, nor determinants that have
    no others: these determine nothing, and are given as never repeated.
    """
    left = [(d, [c for c in dep if not (pairs and pairs.undetermined(d, c))]) for d, dep in asked]
    out: list = [(0, 1.0, 0, [])] * len(asked)
    lots: list[list[int]] = [[]]
    for i, (d, dep) in enumerate(left):
        if dep:
            if len(lots[-1]) == SETS or len({c for j in (*lots[-1], i) for c in left[j][0]}) > GROUPED:
                lots.append([])
            lots[-1].append(i)
    for some in filter(None, lots):
        every = list(dict.fromkeys(c for i in some for c in left[i][1]))
        for r in dependency_sets(df, [left[i][0] for i in some], every).collect():
            out[some[r.position]] = (r.distinct, r.uniqueness, r.repeated, [c for c in left[some[r.position]][1] if not r.violations[c]])
    return out


def dependency_matrix(df: DataFrame, determinants, dependents) -> DataFrame:
    """(determinant, dependent, violations, holds) of each pair, by one scan for all determinant tuples."""
    every = dependency_sets(df, determinants, dependents).select("determinant", F.explode("violations").alias("dependent", "violations"))
    own = reduce(lambda a, b: a | b, [(F.col("determinant") == ",".join(d)) & F.col("dependent").isin(*d) for d in determinants])
    return every.filter(~own).select("determinant", "dependent", "violations", (F.col("violations") == 0).alias("holds"))


def determined(df: DataFrame, determinants, dependents, max_violations: int = 0) -> list[str]:
    """The dependents that ``determinants`` determine, in their order."""
    if not dependents:
        return []
    rows = {r.dependent: r.violations for r in dependency_test(df, determinants, dependents).collect()}
    return [c for c in dependents if rows[c] <= max_violations]


def key_shape(df: DataFrame, table: str, candidates) -> DataFrame:
    """(table_name, columns, rows, null_ratio, uniqueness_ratio): tuples keep their null parts."""
    def one(columns):
        n = F.sum("n")
        return df.groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(n, F.lit(0)).cast("long").alias("rows"),
            F.coalesce(F.try_divide(F.sum(F.when(~_none_null(columns), F.col("n")).otherwise(0)), n), F.lit(0.0)).cast("double").alias("null_ratio"),
            F.coalesce(F.try_divide(F.count(F.lit(1)), n), F.lit(0.0)).cast("double").alias("uniqueness_ratio")).select(
            F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("columns"), "rows", "null_ratio", "uniqueness_ratio")

    return reduce(DataFrame.unionAll, map(one, candidates))


def determinant_shape(df: DataFrame, columns) -> DataFrame:
    """(distinct, uniqueness, repeated) over the rows without nulls in ``columns``; uniqueness 1 if there are none."""
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    d = F.count(F.lit(1))
    return df.filter(_none_null(columns)).groupBy(*_cols(columns)).agg(F.count(F.lit(1)).alias("n")).agg(
        d.alias("distinct"), F.coalesce(F.try_divide(d.cast("double"), n.cast("double")), F.lit(1.0)).alias("uniqueness"), (n - d).alias("repeated"))
