"""Profiles of columns: completeness, cardinality, entropy, dispersion, identifiability.

Each column's value frequencies give its counts, extremes, distinct count, entropy
and mean in one pass (texts are told apart by 128-bit hashes, their extremes take a pass without a shuffle); the moments around the means of all columns take one more.  The
jobs run side by side from a few threads, so small ones fill the gaps of large ones.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import CONTINUOUS, INTEGER, ColumnEvidence, analysed, kind_of

# Weights and labels of identifiability.
UNIQUENESS, ENTROPY, COMPLETENESS = 0.5, 0.3, 0.2
LABELS = ((0.85, "HIGH"), (0.5, "MEDIUM"), (0.2, "LOW"))
THREADS = 8

PROFILE = T.StructType([T.StructField(n, t) for n, t in (
    ("table_name", T.StringType()), ("column_name", T.StringType()), ("column_type", T.StringType()), ("kind", T.StringType()),
    ("rows", T.LongType()), ("non_null_rows", T.LongType()), ("null_rows", T.LongType()), ("null_ratio", T.DoubleType()),
    ("distinct_count", T.LongType()), ("uniqueness_ratio", T.DoubleType()), ("min_value", T.StringType()), ("max_value", T.StringType()),
    ("entropy", T.DoubleType()), ("entropy_ratio", T.DoubleType()), ("sparsity", T.DoubleType()),
    ("variation_coefficient", T.DoubleType()), ("skewness_score", T.DoubleType()),
    ("identifiability_score", T.DoubleType()), ("identifiability_label", T.StringType()))])


def _squashed(x: Column) -> Column:
    """|x| / (1 + |x|), 0 for what is not a number."""
    a = F.abs(F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(0.0)))
    return a / (1 + a)


_COUNTED = ("column_name string, column_type string, kind string, rows long, non_null_rows long, min_value string, max_value string, "
            "distinct_count long, entropy double, mean double")


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.StringType, T.BinaryType))


def frequencies(df: DataFrame, f: T.StructField) -> DataFrame:
    """All that the frequencies of one column's values tell, in one row: counts, extremes, entropy and mean.

    Texts are counted by a 128-bit hash, so whatever their length a row of 16 bytes is shuffled for
    each; their extremes are left to ``text_extremes``.
    """
    v, n, kind = F.col("v"), F.col("n").cast("double"), kind_of(f.dataType)
    number, text = kind in (INTEGER, CONTINUOUS), _is_text(f)
    own = F.col(f"`{f.name.replace('`', '``')}`")
    if text:
        values = df.select(own.isNotNull().alias("known"), F.when(own.isNotNull(), F.xxhash64(own)).alias("v"), F.when(own.isNotNull(), F.xxhash64(F.lit(1), own)).alias("w"))
        by, low, high = ["known", "v", "w"], F.lit(""), F.lit("")
    else:
        values, by, low, high = df.select(own.isNotNull().alias("known"), own.alias("v")), ["known", "v"], F.min("v"), F.max("v")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        low, high = low + 0.0, high + 0.0  # no negative zero
    known, total = F.col("known"), F.sum(F.when(F.col("known"), n))
    return (values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null_rows"),
                 low.cast("string").alias("lo"), high.cast("string").alias("hi"), F.count_if(known).alias("distinct_count"),
                 (F.log2(total) - F.sum(F.when(known, n * F.log2(n))) / total).alias("entropy"),
                 (F.sum(v.cast("double") * n) / total if number else F.lit(None).cast("double")).alias("mean"))
            .select(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.lit(kind).alias("kind"), "rows", "non_null_rows",
                    F.coalesce("lo", F.lit("")).alias("min_value"), F.coalesce("hi", F.lit("")).alias("max_value"), "distinct_count",
                    F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "mean"))


def text_extremes(df: DataFrame, fields: list[T.StructField]) -> dict[str, tuple[str, str]]:
    """The least and greatest text of each column: each task sends one of either."""
    row = df.agg(*[x(F.col(f"`{f.name.replace('`', '``')}`")).cast("string") for f in fields for x in (F.min, F.max)]).first()
    return {f.name: (row[2 * i] or "", row[2 * i + 1] or "") for i, f in enumerate(fields)}


def central_sums(df: DataFrame, means: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Sums of squares and cubes around the means of the columns, in one pass over all of them."""
    aggs = []
    for i, (name, mean) in enumerate(means.items()):
        d = F.col(f"`{name.replace('`', '``')}`").cast("double") - F.lit(mean)
        aggs += [F.sum(d * d).alias(f"q{i}"), F.sum(d * d * d).alias(f"c{i}")]
    row = df.agg(*aggs).first()
    return {name: (row[f"q{i}"], row[f"c{i}"]) for i, name in enumerate(means)}


def completed(rows: DataFrame) -> DataFrame:
    """Ratios and scores from counts and moments."""
    n, total = F.col("non_null_rows"), F.col("rows")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    entropy = F.greatest(F.col("entropy"), F.lit(0.0))
    ratio = F.when(n > 1, entropy / F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    sparsity = F.when(total > 0, 1 - share(n, total)).otherwise(F.lit(0.0))
    ident = UNIQUENESS * share(F.col("distinct_count"), total) + ENTROPY * ratio + COMPLETENESS * (1 - sparsity)
    label = reduce(lambda rest, x: F.when(ident >= x[0], x[1]).otherwise(rest), reversed(LABELS), F.lit("VERY_LOW"))
    return rows.select(
        "table_name", "column_name", "column_type", "kind", "rows", "non_null_rows", (total - n).alias("null_rows"),
        F.round(share(total - n, total), 6).alias("null_ratio"), "distinct_count",
        F.round(share(F.col("distinct_count"), n), 6).alias("uniqueness_ratio"), "min_value", "max_value",
        F.round(entropy, 6).alias("entropy"), F.round(ratio, 6).alias("entropy_ratio"), F.round(sparsity, 6).alias("sparsity"),
        F.round("variation_coefficient", 6).alias("variation_coefficient"), F.round("skewness_score", 6).alias("skewness_score"),
        F.round(ident, 6).alias("identifiability_score"), label.alias("identifiability_label"))


def profile(df: DataFrame, table: str) -> DataFrame:
    """The profile of a table, computed now: a row for each analysed column."""
    return profile_all(df.sparkSession, {table: df})


def evidence_of(rows) -> list[ColumnEvidence]:
    """Profile rows as records of the driver."""
    return [ColumnEvidence(r.table_name, r.column_name, r.column_type, r.kind, r.rows, r.null_rows, r.distinct_count, r.null_ratio,
                           r.uniqueness_ratio, r.min_value, r.max_value, r.entropy, r.entropy_ratio, r.sparsity,
                           r.variation_coefficient, r.skewness_score, r.identifiability_score) for r in rows]


def profile_all(spark: SparkSession, tables: dict[str, DataFrame], threads: int = THREADS) -> DataFrame:
    """The profiles of all tables, computed now; jobs of different columns overlap."""
    fields = {t: analysed(df) for t, df in tables.items()}
    with ThreadPoolExecutor(threads) as pool:
        jobs = [(t, f) for t in tables for f in fields[t]]
        counted = list(zip(jobs, pool.map(lambda j: frequencies(tables[j[0]], j[1]).first(), jobs)))
        means: dict[str, dict[str, float]] = {}
        for (t, _), r in counted:
            if r.mean is not None and math.isfinite(r.mean):
                means.setdefault(t, {})[r.column_name] = r.mean
        sums = pool.map(lambda t: central_sums(tables[t], means[t]), means)
        texts = {t: own for t in tables if (own := [f for f in fields[t] if _is_text(f)])}
        ends = dict(zip(texts, pool.map(lambda t: text_extremes(tables[t], texts[t]), texts)))
        sums = dict(zip(means, sums))
    rows = []
    for (t, f), r in counted:
        r = r.asDict()
        r["min_value"], r["max_value"] = ends.get(t, {}).get(f.name, (r["min_value"], r["max_value"]))
        rows.append((t, *r.values(), *sums.get(t, {}).get(f.name, (None, None))))
    found = spark.createDataFrame(rows, f"table_name string, {_COUNTED}, second double, third double")
    n, q = F.col("non_null_rows"), F.col("second")
    mean = F.when(F.col("mean") == 0, None).otherwise(F.col("mean"))
    scored = found.withColumn("variation_coefficient", _squashed(F.try_divide(F.sqrt(q / n), mean))).withColumn(
        "skewness_score", _squashed(F.when(q > 0, F.sqrt(n.cast("double")) * F.col("third") / F.pow(q, F.lit(1.5)))))
    return spark.createDataFrame(completed(scored).collect(), PROFILE)  # a row for each column of the tables


def low_cardinality(profiles: DataFrame, most: float = 0.2, least_rows: int = 10) -> DataFrame:
    """Columns that take few values for their rows."""
    return profiles.filter((F.col("rows") >= least_rows) & (F.col("uniqueness_ratio") <= most) & (F.col("null_ratio") < 1))


def kind_counts(profiles: DataFrame) -> DataFrame:
    """Columns of each table: all, numeric, text, date; and its rows."""
    is_a = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return profiles.groupBy("table_name").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("attributes"), is_a(INTEGER, CONTINUOUS).alias("numeric"),
        is_a("text").alias("text"), is_a("temporal").alias("date"))
