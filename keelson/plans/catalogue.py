"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, shapes, similarity
from ..operators import certify, dependencies, graph, groups, joins, keys, logical, models, profile, report, structure, validate, views
from ..sources import csv_folder
from ..sources.tables import ALIASES, read_star, read_table
from ..types import Edge, Key, LogicalPlan, Model
from .pipeline import Pipeline

#: Columns of the driver's tables with their kinds, for generated SQL.
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}
STAR = tuple(ALIASES)
KIND = {"int": "integer", "bigint": "integer", "double": "continuous", "string": "text", "timestamp_ntz": "temporal"}
#: The foreign keys of the tables.
FOREIGN = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"),
)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _read(spark: SparkSession, sf: str, t: str) -> DataFrame:
    return read_table(spark, sf, t)


def _rows(spark: SparkSession, schema: str, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _sql_values(rows, columns: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns})"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _has(words) -> str:
    return f"list_has_any(string_split(column_name, '_'), {_list(words)})"


# -- profiles ---------------------------------------------------------------

def _profile_sql(t: str, c: str, type_: str, alias: str | None = None) -> str:
    if KIND[type_] in ("integer", "continuous"):
        spread = (f"(SELECT CASE WHEN m = 0 OR m IS NULL THEN 0.0 ELSE abs(s / m) / (1 + abs(s / m)) END FROM (SELECT avg({c}) m, stddev_pop({c}) s FROM {t}))")
        skew = (f"(SELECT coalesce(abs(k) / (1 + abs(k)), 0.0) FROM (SELECT avg(power(({c} - m) / nullif(s, 0), 3)) k FROM {t}, "
                f"(SELECT avg({c}) m, stddev_pop({c}) s FROM {t})))")
    else:
        spread = skew = "0.0"
    low, high = (f"({x}({c}) + 0.0)" if type_ == "double" else f"{x}({c})" for x in ("min", "max"))
    return f"""
        SELECT '{t}' AS table_name, '{alias or c}' AS column_name, '{type_}' AS column_type, '{KIND[type_]}' AS kind, a.n AS rows, a.nn AS non_null_rows, a.n - a.nn AS null_rows,
          round(CASE WHEN a.n > 0 THEN (a.n - a.nn)::DOUBLE / a.n ELSE 0 END, 6) AS null_ratio, f.d AS distinct_count,
          round(CASE WHEN a.nn > 0 THEN f.d::DOUBLE / a.nn ELSE 0 END, 6) AS uniqueness_ratio, coalesce(a.lo, '') AS min_value, coalesce(a.hi, '') AS max_value,
          round(f.h, 6) AS entropy, round(CASE WHEN a.nn > 1 THEN f.h / log2(a.nn) ELSE 0 END, 6) AS entropy_ratio,
          round(CASE WHEN a.n > 0 THEN 1 - a.nn::DOUBLE / a.n ELSE 0 END, 6) AS sparsity, round({spread}, 6) AS variation_coefficient, round({skew}, 6) AS skewness_score,
          round(CASE WHEN a.n > 0 THEN 0.5 * f.d / a.n + 0.3 * (CASE WHEN a.nn > 1 THEN f.h / log2(a.nn) ELSE 0 END) + 0.2 * a.nn / a.n ELSE 0.2 END, 6) AS identifiability_score
        FROM (SELECT count(*) n, count({c}) nn, {low}::VARCHAR lo, {high}::VARCHAR hi FROM {t}) a,
             (SELECT count(*) d, coalesce(greatest(log2(sum(f)) - sum(f * log2(f)) / sum(f), 0), 0) h
              FROM (SELECT count(*)::DOUBLE f FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) f"""


_LABEL = "CASE WHEN identifiability_score >= 0.85 THEN 'HIGH' WHEN identifiability_score >= 0.5 THEN 'MEDIUM' WHEN identifiability_score >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END"


def _profiles_sql(tables, aliased: bool = False) -> str:
    parts = [_profile_sql(t, c, k, ALIASES[t][c] if aliased else None) for t in tables for c, k in COLUMNS[t].items()]
    return f"SELECT *, {_LABEL} AS identifiability_label FROM ({' UNION ALL '.join(parts)})"


def _profiles(spark: SparkSession, sf: str, tables, aliased: bool = False) -> DataFrame:
    source = read_star(spark, sf, tables) if aliased else {t: _read(spark, sf, t) for t in tables}
    return reduce(DataFrame.unionAll, [profile.profile(df, t) for t, df in source.items()])


for _t in COLUMNS:
    _register(f"profile_{_t}", lambda s, d, t=_t: profile.profile(_read(s, d, t), t), _profiles_sql([_t]))

_register("profile_all_tables", lambda s, d: profile.profile_all(s, {t: _read(s, d, t) for t in COLUMNS}), _profiles_sql(COLUMNS))
_register("column_entropy_lineitem", lambda s, d: profile.profile(_read(s, d, "lineitem"), "lineitem").select("column_name", "entropy", "entropy_ratio", "sparsity"),
          f"SELECT column_name, entropy, entropy_ratio, sparsity FROM ({_profiles_sql(['lineitem'])})")
_register("column_moments_orders", lambda s, d: profile.profile(_read(s, d, "orders"), "orders").select("column_name", "variation_coefficient", "skewness_score"),
          f"SELECT column_name, variation_coefficient, skewness_score FROM ({_profiles_sql(['orders'])})")
_register("identifiability_customer", lambda s, d: profile.profile(_read(s, d, "customer"), "customer").select("column_name", "identifiability_score", "identifiability_label"),
          f"SELECT column_name, identifiability_score, identifiability_label FROM ({_profiles_sql(['customer'])})")
_register("low_cardinality_columns", lambda s, d: profile.low_cardinality(_profiles(s, d, STAR)).select("table_name", "column_name", "uniqueness_ratio"),
          f"SELECT table_name, column_name, uniqueness_ratio FROM ({_profiles_sql(STAR)}) WHERE rows >= 10 AND uniqueness_ratio <= 0.2 AND null_ratio < 1")
_register("type_class_counts", lambda s, d: profile.kind_counts(_profiles(s, d, STAR)),
          f"""SELECT table_name, max(rows) AS rows, count(*) AS attributes, count(*) FILTER (kind IN ('integer', 'continuous')) AS numeric,
              count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'temporal') AS date FROM ({_profiles_sql(STAR)}) GROUP BY table_name""")

# -- dependencies and keys --------------------------------------------------

_UNIQUE = {"lineitem": (("l_orderkey", "l_linenumber"), ("l_extendedprice", "l_orderkey"), ("l_orderkey",)), "orders": (("o_orderkey",), ("o_custkey", "o_orderdate")),
           "customer": (("c_custkey",), ("c_name",), ("c_nationkey", "c_mktsegment"))}


def _same(columns) -> str:
    return ", ".join(columns)


for _t, _cs in _UNIQUE.items():
    _register(f"unique_test_{_t}", lambda s, d, t=_t, cs=_cs: dependencies.unique_test(_read(s, d, t), t, cs), " UNION ALL ".join(
        f"SELECT '{_t}' AS table_name, '{','.join(c)}' AS columns, NOT EXISTS (SELECT 1 FROM {_t} GROUP BY {_same(c)} HAVING count(*) > 1) AS is_unique" for c in _cs))
    _register(f"key_shape_{_t}", lambda s, d, t=_t, cs=_cs: dependencies.key_shape(_read(s, d, t), t, cs), " UNION ALL ".join(
        f"""SELECT '{_t}' AS table_name, '{','.join(c)}' AS columns, (SELECT count(*) FROM {_t}) AS rows,
            (SELECT coalesce(avg(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in c)} THEN 1.0 ELSE 0.0 END), 0.0) FROM {_t}) AS null_ratio,
            (SELECT count(*) FROM (SELECT DISTINCT {_same(c)} FROM {_t}))::DOUBLE / (SELECT count(*) FROM {_t}) AS uniqueness_ratio""" for c in _cs))

_FD = {"customer": (("c_custkey",), ("c_nationkey",), ("c_nationkey", "c_mktsegment")), "part": (("p_name",), ("p_brand",), ("p_brand", "p_type")),
       "nation": (("n_name",), ("n_regionkey",)), "orders": (("o_custkey",), ("o_orderstatus", "o_orderpriority"))}


def _fd_sql(t: str, determinant, dependent: str) -> str:
    where = " AND ".join(f"{c} IS NOT NULL" for c in (*determinant, dependent))
    return (f"SELECT '{','.join(determinant)}' AS determinant, '{dependent}' AS dependent, count(*) AS violations, count(*) = 0 AS holds "
            f"FROM (SELECT 1 FROM {t} WHERE {where} GROUP BY {_same(determinant)} HAVING count(DISTINCT {dependent}) > 1)")


for _t, _ds in _FD.items():
    _register(f"fd_matrix_{_t}", lambda s, d, t=_t, ds=_ds: dependencies.dependency_matrix(_read(s, d, t), ds, list(COLUMNS[t])),
              " UNION ALL ".join(_fd_sql(_t, det, c) for det in _ds for c in COLUMNS[_t] if c not in det))


def _dependency_sets(spark, sf):
    """Every column, and every pair of columns of the smaller tables, as determinant of every other column."""
    def one(t):
        names_ = list(COLUMNS[t])
        sets = [(c,) for c in names_] + (list(combinations(names_, 2)) if len(names_) < 7 else [])
        found = dependencies.dependency_sets(_read(spark, sf, t), sets, names_)
        return found.select(F.lit(t).alias("table_name"), "determinant", "distinct", F.round("uniqueness", 6).alias("uniqueness"), "repeated", F.explode("violations").alias("dependent", "violations"))

    return reduce(DataFrame.unionAll, map(one, STAR))


def _dependency_sets_sql(t: str) -> str:
    sets = [(c,) for c in COLUMNS[t]] + (list(combinations(COLUMNS[t], 2)) if len(COLUMNS[t]) < 7 else [])
    return " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{','.join(d)}' AS determinant, count(*) AS "distinct", round(count(*)::DOUBLE / sum(n), 6)::DOUBLE AS uniqueness,
        (sum(n) - count(*))::BIGINT AS repeated, '{c}' AS dependent, count(*) FILTER (v > 1) AS violations
        FROM (SELECT count(*) n, count(DISTINCT {c}) v FROM {t} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in d)} GROUP BY {_same(d)})""" for d in sets for c in COLUMNS[t])


_register("dependency_sets", _dependency_sets, " UNION ALL ".join(map(_dependency_sets_sql, STAR)))
_register("determinant_shape_orders", lambda s, d: dependencies.determinant_shape(_read(s, d, "orders"), ("o_custkey", "o_orderstatus")),
          """SELECT count(*) AS "distinct", count(*)::DOUBLE / sum(n)::DOUBLE AS uniqueness, (sum(n) - count(*))::BIGINT AS repeated
             FROM (SELECT count(*) n FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_custkey, o_orderstatus)""")


def _simple_keys(spark, sf):
    found = keys.simple_keys(profile.evidence_of(_profiles(spark, sf, COLUMNS).collect()))
    return _rows(spark, "table_name string, column_name string, confidence double", [(k.table, k.columns[0], k.confidence) for k in found])


_register("simple_keys_all", _simple_keys, f"""SELECT table_name, column_name, round(0.7 + 0.3 * identifiability_score, 6) AS confidence FROM ({_profiles_sql(COLUMNS)})
    WHERE rows > 0 AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous'""")


def _evidence(spark, sf, tables):
    source = read_star(spark, sf, tables)
    return source, profile.evidence_of(profile.profile_all(spark, source).collect())


def _composite(spark, sf):
    source, evidence = _evidence(spark, sf, ["lineitem"])
    found = keys.composite_keys(source, evidence, ["lineitem"])
    return _rows(spark, "table_name string, columns string, uniqueness_ratio double", [(k.table, ",".join(k.columns), k.uniqueness) for k in found])


def _combinations_sql(t: str, widest: int = 3) -> str:
    """CTE ``best``: the first unique combination of two or more null-free columns of a table, by width and trust in the columns."""
    tests = " UNION ALL ".join(
        f"SELECT {_list(ALIASES[t][c] for c in combo)} AS names, (SELECT count(*) FROM (SELECT DISTINCT {_same(combo)} FROM {t})) = (SELECT count(*) FROM {t}) AS is_unique"
        for w in range(2, widest + 1) for combo in combinations(COLUMNS[t], w))
    return f"""
      cp AS ({_profiles_sql([t], aliased=True)}),
      trust AS (SELECT *, row_number() OVER (ORDER BY round(0.7 * uniqueness_ratio + 0.3 * identifiability_score, 6) DESC, uniqueness_ratio DESC, identifiability_score DESC, column_name) AS pos
                FROM cp WHERE null_rows = 0),
      found AS (SELECT names, unnest(names) AS name FROM ({tests}) WHERE is_unique),
      best AS (SELECT list(name ORDER BY pos) AS names FROM found JOIN trust ON name = column_name GROUP BY found.names ORDER BY len(found.names), list(pos ORDER BY pos) LIMIT 1)"""


_register("composite_key_lineitem", _composite, f"""WITH {_combinations_sql('lineitem')}
    SELECT 'lineitem' AS table_name, array_to_string(names, ',') AS columns, 1.0::DOUBLE AS uniqueness_ratio FROM best""")


def _ranking(spark, sf):
    source, evidence = _evidence(spark, sf, STAR)
    order = keys.infer_keys(source, evidence)
    best = keys.best_by_table(order)
    return _rows(spark, "position int, table_name string, columns string, confidence double, is_best boolean",
                 [(i, k.table, ",".join(k.columns), k.confidence, best[k.table] == k) for i, k in enumerate(order, 1)])


_register("key_ranking", _ranking, f"""WITH {_combinations_sql('lineitem')},
    p AS ({_profiles_sql(STAR, aliased=True)}),
    k AS (SELECT table_name, [column_name] AS names FROM p WHERE rows > 0 AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous'
          UNION ALL SELECT 'lineitem', names FROM best WHERE NOT EXISTS (SELECT 1 FROM p WHERE table_name = 'lineitem' AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous')),
    part AS (SELECT k.table_name, k.names, unnest(k.names) AS name FROM k),
    s AS (SELECT part.table_name, names, len(names) AS width, count(*) FILTER (kind = 'continuous') AS fractions,
            count(*) FILTER (rows >= 10 AND uniqueness_ratio <= 0.2 AND null_ratio < 1) AS low, count(*) FILTER ({_has(names.KEYS)}) AS named,
            count(*) FILTER (kind IN ('integer', 'continuous')) AS numbers, avg(identifiability_score) AS ident
          FROM part JOIN p ON p.table_name = part.table_name AND p.column_name = part.name GROUP BY part.table_name, names),
    r AS (SELECT *, round(0.7 + 0.3 * ident, 6) AS confidence, row_number() OVER (ORDER BY width, fractions, low, -named, -numbers, -ident, -round(0.7 + 0.3 * ident, 6), table_name, names) AS position FROM s)
    SELECT position::INT AS position, table_name, array_to_string(names, ',') AS columns, confidence, position = min(position) OVER (PARTITION BY table_name) AS is_best FROM r""")

# -- joins ------------------------------------------------------------------

_register("join_coverage", lambda s, d: joins.coverage_table({t: _read(s, d, t) for f in FOREIGN for t in (f[0], f[2])}, [(a, (b,), c, (e,)) for a, b, c, e in FOREIGN]),
          " UNION ALL ".join(f"""SELECT '{a}' AS source_table, '{b}' AS source_columns, '{c}' AS target_table, '{e}' AS target_columns, count(*) AS rows,
              count(*) FILTER ({b} IN (SELECT {e} FROM {c})) AS matched, round(count(*) FILTER ({b} IN (SELECT {e} FROM {c}))::DOUBLE / count(*), 6) AS ratio
              FROM {a} WHERE {b} IS NOT NULL""" for a, b, c, e in FOREIGN))
_register("join_coverage_partial", lambda s, d: joins.coverage_table({t: _read(s, d, t) for t in ("lineitem", "part", "orders")},
          [("lineitem", ("l_orderkey",), "part", ("p_partkey",)), ("lineitem", ("l_orderkey", "l_quantity"), "orders", ("o_orderkey", "o_totalprice"))]),
          """SELECT 'lineitem' AS source_table, 'l_orderkey' AS source_columns, 'part' AS target_table, 'p_partkey' AS target_columns, count(*) AS rows,
               count(*) FILTER (l_orderkey IN (SELECT p_partkey FROM part)) AS matched,
               round(count(*) FILTER (l_orderkey IN (SELECT p_partkey FROM part))::DOUBLE / count(*), 6) AS ratio FROM lineitem WHERE l_orderkey IS NOT NULL
             UNION ALL SELECT 'lineitem', 'l_orderkey,l_quantity', 'orders', 'o_orderkey,o_totalprice', count(*), count(m), round(count(m)::DOUBLE / count(*), 6)
             FROM (SELECT l_orderkey k, l_quantity q FROM lineitem WHERE l_orderkey IS NOT NULL AND l_quantity IS NOT NULL) l
             LEFT JOIN (SELECT DISTINCT o_orderkey k, o_totalprice q, 1 m FROM orders) o ON l.k = o.k AND l.q = o.q""")
_register("orphans_lineitem_part", lambda s, d: joins.orphans(_read(s, d, "lineitem"), ("l_orderkey",), _read(s, d, "part"), ("p_partkey",)).withColumnRenamed("k0", "l_orderkey"),
          "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT p_partkey FROM part)")


def _orphan_counts(spark, sf):
    return reduce(DataFrame.unionAll, [joins.count_orphans(_read(spark, sf, a), (b,), _read(spark, sf, c), (e,)).select(
        F.lit(a).alias("source_table"), F.lit(b).alias("source_columns"), F.lit(c).alias("target_table"), "orphans") for a, b, c, e in FOREIGN])


_register("orphan_counts", _orphan_counts, " UNION ALL ".join(
    f"SELECT '{a}' AS source_table, '{b}' AS source_columns, '{c}' AS target_table, count(DISTINCT {b}) AS orphans FROM {a} WHERE {b} NOT IN (SELECT {e} FROM {c})" for a, b, c, e in FOREIGN))


def _discovered(spark, sf):
    source, evidence = _evidence(spark, sf, STAR)
    found = joins.discover(source, evidence, keys.simple_keys(evidence))
    return _rows(spark, "source_table string, source_columns string, target_table string, target_columns string, rows long, matched long, ratio double",
                 [(j.source, ",".join(j.source_columns), j.target, ",".join(j.target_columns), j.rows, j.matched, j.ratio) for j in found])


_register("join_discovery", _discovered)


def _prefiltered(spark, sf, tables):
    _, evidence = _evidence(spark, sf, tables)
    kept = joins.prefiltered(evidence, keys.simple_keys(evidence))
    return _rows(spark, "table_name string, column_name string", [(c.table, c.column) for c in kept])


_SMALL = ("region", "nation", "customer", "supplier")


def _prefilter_sql(tables) -> str:
    return f"""
    WITH p AS ({_profiles_sql(tables, aliased=True)}), k AS (SELECT * FROM p WHERE rows > 0 AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous')
    SELECT table_name, column_name FROM p WHERE null_ratio < 1 AND EXISTS (
      SELECT 1 FROM k WHERE k.table_name <> p.table_name AND k.column_type = p.column_type AND p.distinct_count <= 1.1 * k.distinct_count
        AND (p.kind NOT IN ('integer', 'continuous') OR (TRY_CAST(p.min_value AS DOUBLE) >= TRY_CAST(k.min_value AS DOUBLE) AND TRY_CAST(p.max_value AS DOUBLE) <= TRY_CAST(k.max_value AS DOUBLE))))"""


def _values_sql(tables) -> str:
    """(table_name, column_name, v, n): how often each column has each value, as text."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{ALIASES[t][c]}' AS column_name, {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
                              for t in tables for c in COLUMNS[t])


# Every column that passes the prefilter against every key of its type in another table; the words of a name are split at underscores.
ORACLE["join_discovery"] = f"""
    WITH f AS ({_prefilter_sql(STAR)}), p AS ({_profiles_sql(STAR, aliased=True)}), v AS ({_values_sql(STAR)}),
    w AS (SELECT *, array_to_string(list_filter(string_split(column_name, '_'), lambda x: NOT list_contains({_list(names.KEYS)}, x)), ' ') AS about FROM p),
    k AS (SELECT * FROM w WHERE rows > 0 AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous'),
    pair AS (SELECT w.table_name AS s, w.column_name AS sc, k.table_name AS t, k.column_name AS tc FROM w JOIN f USING (table_name, column_name) JOIN k
             ON k.table_name <> w.table_name AND k.column_type = w.column_type
             AND (w.about = '' OR k.about = '' OR w.about = k.about OR ends_with(w.about, ' ' || k.about) OR ends_with(k.about, ' ' || w.about))),
    j AS (SELECT s, sc, t, tc, sum(a.n)::BIGINT AS rows, coalesce(sum(a.n) FILTER (b.v IS NOT NULL), 0)::BIGINT AS matched
          FROM pair JOIN v a ON a.table_name = s AND a.column_name = sc LEFT JOIN v b ON b.table_name = t AND b.column_name = tc AND a.v = b.v GROUP BY ALL)
    SELECT s AS source_table, sc AS source_columns, t AS target_table, tc AS target_columns, rows, matched, round(matched::DOUBLE / rows, 6) AS ratio
    FROM j WHERE matched::DOUBLE / rows >= {joins.LEAST_RATIO}"""

_register("fk_prefilter", lambda s, d: _prefiltered(s, d, _SMALL), _prefilter_sql(_SMALL))
_register("fk_prefilter_star", lambda s, d: _prefiltered(s, d, STAR), _prefilter_sql(STAR))

# -- names, shapes and evidence ---------------------------------------------

def _name_rules(spark, sf):
    n = F.col("name")
    return _profiles(spark, sf, STAR, aliased=True).unionAll(_profiles(spark, sf, ["events"])).select(F.col("column_name").alias("name")).distinct().select(
        "name", F.array_join(names.tokens_col(n), " ").alias("tokens"), names.key_like_col(n).alias("key_like"), names.measure_like_col(n).alias("measure_like"),
        names.grain_like_col(n).alias("grain_like"), names.time_like_col(n).alias("time_like"), names.place_like_col(n).alias("place_like"),
        F.array_join(names.concept_col(n), " ").alias("concept"), names.normalized_col(n).alias("normalized"), names.same_concept_col(n, F.lit("order_key")).alias("names_an_order"))


_register("name_rules", _name_rules, f"""
    WITH n AS (SELECT DISTINCT column_name AS name, string_split(column_name, '_') t FROM ({_profiles_sql(STAR, aliased=True)} UNION ALL {_profiles_sql(['events'])})), c AS (SELECT *, list_filter(t, lambda x: NOT list_contains({_list(names.KEYS)}, x)) k FROM n)
    SELECT name, array_to_string(t, ' ') AS tokens, list_has_any(t, {_list(names.KEYS)}) AS key_like, regexp_matches(name, '{'|'.join(names.MEASURES)}') AS measure_like,
      list_has_any(t, {_list(names.GRAINS)}) AS grain_like, list_has_any(t, {_list(names.TIMES)}) AS time_like, list_has_any(t, {_list(names.PLACES)}) AS place_like,
      array_to_string(k, ' ') AS concept, array_to_string(list_filter(t, lambda x: NOT list_contains({_list(names.TECHNICAL)}, x)), '') AS normalized,
      len(k) = 0 OR k[-1] = 'order' AS names_an_order FROM c""")


def _shape_scores(spark, sf):
    return _profiles(spark, sf, ["lineitem", "customer"], aliased=True).withColumns(shapes.shape_columns()).select(
        "table_name", "column_name", *[F.round(c, 4).alias(c) for c in ("measure_score", "grain_score", "descriptive_score", "lookup_score")])


def _shape_ctes(profiles: str) -> str:
    """CTE ``s``: profiles with what their names tell (k, g, t, l, m) and the measure score ms."""
    return f"""p AS ({profiles}),
    f AS (SELECT *, {_has(names.KEYS)} k, {_has(names.GRAINS)} g, {_has(names.TIMES)} t, {_has(names.PLACES)} l, regexp_matches(column_name, '{'|'.join(names.MEASURES)}') m FROM p),
    s AS (SELECT *, CASE WHEN distinct_count <= 1 OR kind NOT IN ('integer', 'continuous') OR t OR l OR k OR g OR (kind <> 'continuous' AND uniqueness_ratio >= 0.95 AND NOT m)
        OR (distinct_count <= 2 AND entropy_ratio <= 0 AND variation_coefficient <= 0) THEN 0.0
      ELSE least(CASE WHEN kind = 'continuous' THEN 0.3 ELSE 0.1 END + 0.15 * (1 - uniqueness_ratio) + 0.2 * entropy_ratio + 0.3 * variation_coefficient
        + 0.1 * (distinct_count >= 3)::INT + 0.15 * m::INT, 1.0) END AS ms FROM f)"""


_register("shape_scores", _shape_scores, f"""WITH {_shape_ctes(_profiles_sql(['lineitem', 'customer'], aliased=True))}
    SELECT table_name, column_name, round(ms::DOUBLE, 4) AS measure_score,
      round((CASE WHEN null_ratio > 0.2 OR distinct_count <= 1 OR ms >= 0.4 THEN 0.0 ELSE least(0.6 * (k OR g)::INT + 0.55 * (t OR kind = 'temporal')::INT + 0.55 * (uniqueness_ratio >= 0.95)::INT, 1.0) END)::DOUBLE, 4) AS grain_score,
      round((CASE WHEN (distinct_count <= 1 AND NOT l) OR k OR g OR t OR kind = 'temporal' OR ms >= 0.4 OR uniqueness_ratio >= 0.95 THEN 0.0 ELSE least(0.35 + 0.25 * (1 - uniqueness_ratio) + 0.15 * l::INT, 1.0) END)::DOUBLE, 4) AS descriptive_score,
      round((CASE WHEN null_ratio > 0.05 OR distinct_count <= 1 OR t OR kind = 'temporal' OR ms >= 0.4 OR g THEN 0.0
        ELSE least(0.55 * k::INT + 0.25 * (uniqueness_ratio >= 0.01 AND uniqueness_ratio < 0.95)::INT + 0.25 * identifiability_score, 1.0) END)::DOUBLE, 4) AS lookup_score
    FROM s""")

def _similarity_sql(pairs: str) -> str:
    """(left_name, right_name, similarity) of name pairs: twice the longest common subsequence over both lengths, a row of its table for each step."""
    plain = lambda c: f"array_to_string(list_filter(string_split({c}, '_'), lambda x: NOT list_contains({_list(names.TECHNICAL)}, x)), '')"
    return f"""
      lcs AS (SELECT left_name, right_name, {plain('left_name')} AS a, {plain('right_name')} AS b, 0 AS step, list_transform(range(length({plain('left_name')})), lambda x: 0) AS cells FROM ({pairs})
        UNION ALL SELECT left_name, right_name, a, b, step + 1, list_transform(range(1, length(a) + 1), lambda i: greatest(cells[i], coalesce(list_max(list_transform(range(1, i + 1),
          lambda k: CASE WHEN substr(a, k, 1) = substr(b, step + 1, 1) THEN 1 + CASE WHEN k > 1 THEN cells[k - 1] ELSE 0 END ELSE 0 END)), 0))) FROM lcs WHERE step < length(b)),
      alike AS (SELECT left_name, right_name, CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE round(2.0 * coalesce(list_max(cells), 0) / (length(a) + length(b)), 4) END::DOUBLE AS similarity
        FROM lcs WHERE step = length(b))"""


def _similar(spark, sf):
    """All pairs of the order tables' column names."""
    found = sorted({c.column for c in _evidence(spark, sf, STAR)[1]})
    return _rows(spark, "left_name string, right_name string, similarity double", [(a, b, similarity.name_similarity(a, b)) for a in found for b in found])


_register("name_similarity_edges", _similar, f"""WITH RECURSIVE n AS (SELECT DISTINCT column_name FROM ({_profiles_sql(STAR, aliased=True)})),
    {_similarity_sql('SELECT a.column_name AS left_name, b.column_name AS right_name FROM n a, n b')} SELECT * FROM alike""")


def _edges(spark, sf):
    """The joins that the data of the order tables show, with the evidence of their names."""
    source, evidence = _evidence(spark, sf, STAR)
    return graph.edges(joins.discover(source, evidence, keys.simple_keys(evidence)))


def _edge_rows(spark, sf):
    return _rows(spark, "source_table string, source_columns string, target_table string, target_columns string, ratio double, similarity double",
                 [(e.source, ",".join(e.source_columns), e.target, ",".join(e.target_columns), e.ratio, e.similarity) for e in _edges(spark, sf)])


def _edge_evidence(spark, sf):
    score, label = graph.evidence_column(F.col("ratio"), F.col("similarity"))
    return _edge_rows(spark, sf).select("source_table", "source_columns", "target_table", "target_columns", score.alias("score"), label.alias("evidence"))


_EDGES_SQL = f"""WITH RECURSIVE found AS ({ORACLE['join_discovery']}),
    {_similarity_sql('SELECT DISTINCT source_columns AS left_name, target_columns AS right_name FROM found')},
    e AS (SELECT source_table, source_columns, target_table, target_columns, round(0.34 * ratio + 0.66 * similarity, 6)::DOUBLE AS score,
          CASE WHEN round(0.34 * ratio + 0.66 * similarity, 6) >= 0.75 THEN 'CONFIRMED' WHEN round(0.34 * ratio + 0.66 * similarity, 6) <= 0.25 THEN 'WEAK' ELSE 'COINCIDENCE' END AS evidence
          FROM found JOIN alike ON left_name = source_columns AND right_name = target_columns)"""
_register("edge_evidence", _edge_evidence, f"{_EDGES_SQL} SELECT * FROM e")
_register("adjacency_matrix", lambda s, d: graph.matrix_table(STAR, _edge_evidence(s, d)), f"""{_EDGES_SQL}
    SELECT t AS table_name, {', '.join(f"coalesce(max(score) FILTER (target_table = '{t}'), 0.0) AS {t}" for t in STAR)}
    FROM (SELECT unnest({_list(STAR)}) AS t) LEFT JOIN e ON source_table = t AND evidence = 'CONFIRMED' GROUP BY t""")

# -- graph, roles, models ---------------------------------------------------

_register("degree_counts", lambda s, d: graph.degrees(_edge_rows(s, d)), f"""{_EDGES_SQL},
    o AS (SELECT source_table t, count(DISTINCT target_table) n FROM e GROUP BY 1), i AS (SELECT target_table t, count(DISTINCT source_table) n FROM e GROUP BY 1)
    SELECT coalesce(o.t, i.t) AS table_name, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM o FULL JOIN i ON o.t = i.t""")

def _table_roles(spark, sf):
    p = _profiles(spark, sf, STAR, aliased=True)
    measures = p.groupBy("table_name").agg(F.count_if(graph.additive_column()).alias("measures"))
    has = F.col("table_name").isin(*{k.table for k in keys.simple_keys(profile.evidence_of(p.collect()))})
    tables = (profile.kind_counts(p).join(measures, "table_name").join(graph.degrees(_edge_rows(spark, sf)), "table_name", "left")
              .fillna(0, ["outgoing", "incoming"]).withColumns({"has_key": has, "grain": has}))
    return (graph.role_columns(tables)
            .select("table_name", "measures", "outgoing", "incoming", "role"))


_ROLES_SQL = f"""{_EDGES_SQL}, p AS ({_profiles_sql(STAR, aliased=True)}),
    c AS (SELECT table_name, max(rows) n, count(*) FILTER (kind IN ('integer', 'continuous')) x, count(*) FILTER (kind = 'text') t,
      count(*) FILTER (NOT {_has(names.KEYS)} AND kind IN ('integer', 'continuous') AND distinct_count > 1 AND uniqueness_ratio < 0.95 AND (entropy_ratio >= 0.05 OR variation_coefficient >= 0.05)) m
      FROM p GROUP BY 1),
    d AS (SELECT c.*, (SELECT count(DISTINCT target_table) FROM e WHERE source_table = table_name) o, (SELECT count(DISTINCT source_table) FROM e WHERE target_table = table_name) i,
      EXISTS (SELECT 1 FROM p WHERE p.table_name = c.table_name AND null_rows = 0 AND distinct_count = rows AND kind <> 'continuous') k FROM c),
    l AS (SELECT *, k AND m = 0 AND n < 100 AND i >= 1 AND x <= t + o AS lookup FROM d),
    roles AS (SELECT table_name, m AS measures, o AS outgoing, i AS incoming, CASE WHEN o = 0 AND i = 0 THEN 'ISOLATED' WHEN o >= 1 AND k AND m > 0 AND NOT lookup THEN 'FACT'
      WHEN o >= 2 AND n >= 5 AND x > t AND m > 0 AND NOT lookup THEN 'FACT' WHEN o >= 2 AND n >= 5 AND k AND m > 0 AND NOT lookup THEN 'FACT'
      WHEN o >= 1 AND i = 0 AND k AND n >= 5 AND x > t AND m > 0 AND NOT lookup THEN 'FACT' WHEN o >= 1 AND k AND t >= x THEN 'DIMENSION' WHEN k AND i >= 1 THEN 'DIMENSION' ELSE 'UNKNOWN' END AS role
    FROM l)"""
_register("table_roles", _table_roles, f"{_ROLES_SQL} SELECT * FROM roles")

def _candidates(spark, sf) -> tuple[models.Builder, list]:
    """Models of the order tables: their roles and confirmed joins are those that the data show."""
    source, flat = _evidence(spark, sf, STAR)
    evidence = {t: sorted((c for c in flat if c.table == t), key=lambda c: c.column) for t in source}
    found = keys.simple_keys(flat)
    edges = graph.edges(joins.discover(source, flat, found))
    roles = graph.roles(evidence, {k.table for k in found}, edges, {})
    return models.Builder(roles, graph.confirmed(edges), evidence), edges


def _model_rows(spark, found: list[Model]) -> DataFrame:
    return _rows(spark, "model_type string, facts string, dimensions string, joins long, covered_facts long, coverage double",
                 [(m.kind, ",".join(m.facts), ",".join(m.dimensions), len(m.edges), m.covered_facts, m.coverage) for m in found])


_MODELS_SQL = f"""{_ROLES_SQL},
    facts AS (SELECT table_name FROM roles WHERE role = 'FACT'),
    into_dimensions AS (SELECT e.* FROM e JOIN roles ON target_table = table_name WHERE evidence = 'CONFIRMED' AND role = 'DIMENSION'),
    near AS (SELECT i.* FROM into_dimensions i JOIN facts ON source_table = table_name),
    far AS (SELECT n.source_table AS fact, i.* FROM (SELECT DISTINCT source_table, target_table FROM near) n JOIN into_dimensions i ON i.source_table = n.target_table),
    stars AS (SELECT 'STAR' AS model_type, source_table AS facts, list_sort(list(DISTINCT target_table)) AS dims, count(*) AS joins, 1 AS covered FROM near GROUP BY source_table),
    flakes AS (SELECT 'SNOWFLAKE' AS model_type, s.facts, list_sort(list_distinct(list_concat(s.dims, f.dims))) AS dims, s.joins + f.joins AS joins, 1 AS covered
      FROM stars s JOIN (SELECT fact, list(DISTINCT target_table) AS dims, count(*) AS joins FROM far GROUP BY fact) f ON s.facts = f.fact
      WHERE len(list_filter(f.dims, lambda x: NOT list_contains(s.dims, x))) > 0),
    sharing AS (SELECT DISTINCT n.source_table AS t FROM near n JOIN near o ON n.target_table = o.target_table AND n.source_table <> o.source_table),
    reached AS (SELECT t FROM sharing UNION SELECT i.target_table FROM reached JOIN into_dimensions i ON i.source_table = t),
    round_ AS (SELECT DISTINCT i.source_table, i.target_table, i.source_columns FROM into_dimensions i JOIN reached ON i.source_table = t),
    constellations AS (SELECT 'CONSTELLATION' AS model_type, (SELECT string_agg(t, ',' ORDER BY t) FROM sharing) AS facts, list_sort(list(DISTINCT target_table)) AS dims, count(*) AS joins,
      (SELECT count(*) FROM sharing) AS covered FROM round_ HAVING count(*) > 0),
    built AS (SELECT *, round(covered::DOUBLE / (SELECT count(*) FROM facts), 6) AS coverage FROM (FROM stars UNION ALL FROM flakes UNION ALL FROM constellations))"""
for _n, _kind, _build in (("star_candidates", models.STAR, models.Builder.stars), ("snowflake_candidates", models.SNOWFLAKE, models.Builder.snowflakes),
                          ("constellation", models.CONSTELLATION, models.Builder.constellation)):
    _register(_n, lambda s, d, build=_build: _model_rows(s, build(_candidates(s, d)[0])), f"""{_MODELS_SQL}
        SELECT model_type, facts, array_to_string(dims, ',') AS dimensions, joins, covered AS covered_facts, coverage FROM built WHERE model_type = '{_kind}'""")


def _model_scores(spark, sf):
    """Raw and relative scores of all models; the records that the pipeline ranks must agree with the table."""
    built = _candidates(spark, sf)[0].build()
    name = lambda m: f"{m.kind}:{','.join(m.facts)}"
    rows = _rows(spark, "model_id string, model_type string, facts int, dimensions int, tables int, attributes int, numeric_attributes int, coverage_ratio double",
                 [(name(m), m.kind, len(m.facts), len(m.dimensions), m.tables, m.attributes, m.numeric_attributes, m.coverage) for m in built])
    ranked = _rows(spark, "model_id string, pipeline_score double", [(name(m), m.score) for m in models.ranked(built)])
    return models.score_table(rows).join(ranked, "model_id").select("model_id", "raw_score", "score", "pipeline_score")


_register("model_scores", _model_scores, f"""{_MODELS_SQL},
    member AS (SELECT model_type, facts, dims, covered, coverage, unnest(list_distinct(list_concat(string_split(facts, ','), dims))) AS t FROM built),
    sized AS (SELECT model_type, facts, len(any_value(dims)) AS d, any_value(covered) AS f, any_value(coverage) AS coverage, count(DISTINCT t) AS tables, count(*) AS attributes,
      count(*) FILTER (kind IN ('integer', 'continuous')) AS numbers FROM member JOIN p ON t = table_name GROUP BY model_type, facts),
    scored AS (SELECT model_type || ':' || facts AS model_id, round(-1.0 * tables - 0.05 * attributes + 2.0 * numbers + 8.0 * d + 30.0 * coverage
      + CASE WHEN model_type = 'CONSTELLATION' AND f > 1 THEN (f - 1) * (15.0 + 10.0 * d) ELSE 0 END, 2)::DOUBLE AS raw_score FROM sized),
    final AS (SELECT *, CASE WHEN max(raw_score) OVER () = min(raw_score) OVER () THEN 1.0 ELSE round((raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()), 4) END AS score FROM scored)
    SELECT model_id, raw_score, score, score AS pipeline_score FROM final""")


def _star_edges(spark, sf):
    """All joins of a table taken as one star, and all joins as one constellation: rows for the topology rules."""
    builder, edges = _candidates(spark, sf)
    return _rows(spark, "model_id string, model_type string, source_table string, source_role string, target_table string, target_role string, depth int",
                 [(i, kind, e.source, builder.role[e.source], e.target, builder.role[e.target], 1) for e in edges for i, kind in ((f"star_{e.source}", "STAR"), ("all", "CONSTELLATION"))])


_TOPOLOGY_SQL = """
    t AS (SELECT e.*, a.role AS source_role, b.role AS target_role FROM e JOIN roles a ON source_table = a.table_name JOIN roles b ON target_table = b.table_name),
    topology AS (SELECT model_id, rule_name, source_table, target_table FROM (
      SELECT 'star_' || source_table AS model_id, 'NO_FACT_TO_FACT_EDGE' AS rule_name, * FROM t WHERE source_role = 'FACT' AND target_role = 'FACT'
      UNION ALL SELECT 'all', 'NO_FACT_TO_FACT_EDGE', * FROM t WHERE source_role = 'FACT' AND target_role = 'FACT'
      UNION ALL SELECT 'star_' || source_table, 'STAR_DIRECT_TO_DIMENSION', * FROM t WHERE source_role <> 'FACT' OR target_role <> 'DIMENSION'))"""
_register("topology_issues", lambda s, d: validate.topology_issues(_star_edges(s, d)), f"{_ROLES_SQL}, {_TOPOLOGY_SQL} SELECT * FROM topology")

# -- logical tables, validation, views --------------------------------------

_PLANS = {"part": LogicalPlan("dim_part", "part", ("p_brand",), ("p_brand", "p_type"), "DIMENSION", True),
          "nation": LogicalPlan("dim_nation", "nation", ("n_name",), ("n_name",), "DIMENSION", True),
          "lineitem": LogicalPlan("fact_lineitem", "lineitem", ("l_orderkey",), ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "FACT", False)}
_register("logical_dimension_part", lambda s, d: logical.materialize(_PLANS["part"], _read(s, d, "part")), "SELECT DISTINCT p_brand, p_type FROM part")
_register("logical_fact_lineitem", lambda s, d: logical.materialize(_PLANS["lineitem"], _read(s, d, "lineitem")),
          "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem")
_register("grain_duplicates_lineitem", lambda s, d: validate.count_duplicate_grains(_read(s, d, "lineitem"), ("l_orderkey", "l_linenumber")),
          "SELECT count(*) AS duplicates FROM (SELECT 1 FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")


#: Facts with the columns that give their grain: foreign keys, then a key.
_GRAINS = {"lineitem": (("l_orderkey", "l_partkey", "l_suppkey"), None), "orders": (("o_custkey",), "o_orderkey"), "customer": (("c_nationkey",), None), "nation": (("n_regionkey",), "n_name")}


def _fact_grains(spark, sf):
    tables = {t: _read(spark, sf, t) for t in COLUMNS}
    counter, rows = validate.Grains(tables), []
    for t, (own, last) in _GRAINS.items():
        edges = [Edge(a, c, (b,), (e,), 1.0) for a, b, c, e in FOREIGN if a == t and b in own]
        m = Model(models.STAR, (t,), tuple(e.target for e in edges), tuple(edges))
        best = Key(t, (last,), ("string",), ("text",), 1, 0.0, 1.0, 1.0, 1.0) if last else None
        g = counter.validate(m, t, best)
        rows.append((t, ",".join(g["grain_columns"]), g["duplicate_count"], g["is_valid"], g["reason"]))
    return _rows(spark, "fact_table string, grain_columns string, duplicate_count long, is_valid boolean, reason string", rows)


def _grain_sql(t: str) -> str:
    own, last = _GRAINS[t]
    whole = own + ((last,) if last else ())
    twice = lambda cs: f"(SELECT count(*) FROM (SELECT 1 FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY {_same(cs)} HAVING count(*) > 1))"

    def least(cs) -> str:
        if len(cs) == 1:
            return f"'{cs[0]}'"
        return "CASE " + " ".join(f"WHEN {twice(r)} = 0 THEN {least(r)}" for r in (tuple(x for x in cs if x != c) for c in cs)) + f" ELSE '{','.join(cs)}' END"

    return f"""SELECT '{t}' AS fact_table, CASE WHEN n = 0 THEN {least(whole)} ELSE '{','.join(whole)}' END AS grain_columns, n AS duplicate_count, n = 0 AS is_valid,
        CASE WHEN n = 0 THEN 'each grain has one row' ELSE n || ' grain(s) with several rows' END AS reason FROM (SELECT {twice(whole)} AS n)"""


_register("fact_grains", _fact_grains, " UNION ALL ".join(map(_grain_sql, _GRAINS)))


def _dimension_purity(spark, sf):
    p = _profiles(spark, sf, ["customer", "part", "supplier", "nation", "region"], aliased=True)
    score = validate.impurity_column(F.col("entropy_ratio"), F.col("variation_coefficient"), F.col("skewness_score"))
    return p.filter(F.col("kind").isin("integer", "continuous") & ~names.key_like_col(F.col("column_name"))).select(
        "table_name", "column_name", F.round(score, 4).alias("impurity"), (score > validate.IMPURE).alias("violates"))


_register("dimension_purity", _dimension_purity, f"""
    SELECT table_name, column_name, round(s, 4) AS impurity, s > 0.85 AS violates FROM (
      SELECT *, 0.4 * entropy_ratio + 0.3 * least(abs(variation_coefficient) / 2, 1.0) + 0.3 * tanh(abs(skewness_score)) s
      FROM ({_profiles_sql(['customer', 'part', 'supplier', 'nation', 'region'], aliased=True)}) WHERE kind IN ('integer', 'continuous') AND NOT {_has(names.KEYS)})""")


def _fact_purity(spark, sf):
    evidence = profile.evidence_of(_profiles(spark, sf, ["lineitem", "orders"], aliased=True).collect())
    return _rows(spark, "table_name string, column_name string, violates boolean", [(c.table, c.column, validate.descriptive_in_fact(c, set())) for c in evidence])


_register("fact_purity", _fact_purity, f"""SELECT table_name, column_name, NOT ({_has(names.KEYS)} OR kind = 'temporal' OR contains(column_name, 'date') OR regexp_matches(column_name, '{'|'.join(names.MEASURES)}'))
    AND kind = 'text' AND regexp_matches(column_name, '{'|'.join(validate.DESCRIPTIVE_WORDS)}') AS violates FROM ({_profiles_sql(['lineitem', 'orders'], aliased=True)})""")


def _stability_sql(f: str, fk: str, d: str, dk: str, x: str, g: str) -> str:
    close = lambda a, b: f"(abs({a} - {b}) <= 0.001 OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0) <= 0.000001)"
    shown = ", ".join(f"round({p}_{m}, 4) AS {p}_{m}" if m != "count" else f"{p}_{m}" for m in validate.METRICS for p in ("fine", "agg"))
    fails = " || ".join(f"CASE WHEN {close(f'fine_{m}', f'agg_{m}') if m != 'count' else 'fine_count = agg_count'} THEN '' ELSE ', {m} differs' END" for m in validate.METRICS)
    return f"""
      WITH a AS (SELECT coalesce(sum({x}), 0)::DOUBLE fine_sum, count({x}) fine_count, coalesce(avg({x}), 0)::DOUBLE fine_avg, coalesce(min({x}), 0)::DOUBLE fine_min, coalesce(max({x}), 0)::DOUBLE fine_max FROM {f}),
      b AS (SELECT coalesce(sum(s), 0)::DOUBLE agg_sum, coalesce(sum(n), 0)::BIGINT agg_count, coalesce(sum(s) / nullif(sum(n), 0), 0)::DOUBLE agg_avg, coalesce(min(lo), 0)::DOUBLE agg_min, coalesce(max(hi), 0)::DOUBLE agg_max
        FROM (SELECT sum({x}) s, count({x}) n, min({x}) lo, max({x}) hi FROM {f} LEFT JOIN {d} ON {fk} = {dk} GROUP BY {g})),
      c AS (SELECT *, {fails} AS bad FROM a, b)
      SELECT {shown}, bad = '' AS is_stable, CASE WHEN bad = '' THEN 'Agrees when grouped by {g}' ELSE substr(bad, 3) END AS reason FROM c"""


for _n, (_f, _fk, _d, _dk, _x, _g) in {
    "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey", "l_quantity", "p_brand"),
    "orders_customer": ("orders", "o_custkey", "customer", "c_custkey", "o_totalprice", "c_mktsegment"),
    "fan_out": ("orders", "o_orderkey", "lineitem", "l_orderkey", "o_custkey", "l_returnflag"),
}.items():
    _register(f"aggregation_stability_{_n}", lambda s, d, f=_f, fk=_fk, t=_d, dk=_dk, x=_x, g=_g: validate.stability(_read(s, d, f), _read(s, d, t), (fk,), (dk,), x, g),
              _stability_sql(_f, _fk, _d, _dk, _x, _g))


def _certification(spark, sf):
    """Every candidate model with a warning unless it covers all facts, and every star of a table with the errors of its topology."""
    errors = validate.topology_issues(_star_edges(spark, sf)).select("model_id", F.lit("ERROR").alias("severity"))
    covers = F.when(F.col("coverage") < 0.999999, "WARNING").alias("severity")
    return certify.certification(errors.unionAll(_model_rows(spark, _candidates(spark, sf)[0].build()).select(F.concat_ws(":", "model_type", "facts").alias("model_id"), covers)))


_register("certification", _certification, f"""{_MODELS_SQL}, {_TOPOLOGY_SQL},
    issue AS (SELECT model_id, 'ERROR' AS severity FROM topology UNION ALL SELECT model_type || ':' || facts, CASE WHEN coverage < 0.999999 THEN 'WARNING' END FROM built)
    SELECT *, CASE WHEN errors > 0 THEN 'INVALID' WHEN warnings > 0 THEN 'WARNING' ELSE 'VALID' END AS status, greatest(0.0, 100.0 - 35.0 * errors - 10.0 * warnings)::DOUBLE AS certification_score
    FROM (SELECT model_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM issue GROUP BY 1)""")


def _star_view(spark, sf):
    tables = {t: _read(spark, sf, t) for t in ("lineitem", "orders", "part", "supplier")}
    edges = [Edge(a, c, (b,), (e,), 1.0) for a, b, c, e in FOREIGN[:3]]
    return views.build_view(tables, "lineitem", edges).groupBy("part_p_brand", "orders_o_orderstatus").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("fact_l_quantity"), 2).alias("quantity"), F.count_distinct("supplier_s_name").alias("suppliers"))


_register("star_view_lineitem", _star_view, """SELECT p_brand AS part_p_brand, o_orderstatus AS orders_o_orderstatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, count(DISTINCT s_name) AS suppliers
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")


def _snowflake_view(spark, sf):
    tables = {t: _read(spark, sf, t) for t in ("orders", "customer", "nation")}
    edges = [Edge("orders", "customer", ("o_custkey",), ("c_custkey",), 1.0), Edge("customer", "nation", ("c_nationkey",), ("n_nationkey",), 1.0, depth=2)]
    m = Model(models.SNOWFLAKE, ("orders",), ("customer", "nation"), tuple(edges))
    return views.build_view(tables, "orders", views.edges_for(m, "orders"))


_register("snowflake_view_orders", _snowflake_view, "SELECT " + ", ".join(
    [f"{c} AS fact_{c}" for c in sorted(COLUMNS["orders"])] + [f"{c} AS {t}_{c}" for t in ("customer", "nation") for c in sorted(COLUMNS[t])])
    + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")

# -- CSV rows ---------------------------------------------------------------

def _csv_rows(spark, sf):
    """Orders as a careless export writes them: mixed dates, decimal commas, spellings of null, lines of dashes, notes and blanks."""
    o, k, day = _read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    price = F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")
    rows = o.select(k.cast("string").alias("a"), F.when(k % 3 == 0, F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("b"),
                    F.when(k % 7 == 0, " null ").otherwise(price).alias("c"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:20:30")).alias("d"),
                    F.when(k % 5 == 0, "N/A").otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("e"))
    for n, junk in ((11, ("---", "--", "-", "---", "-")), (13, ("Source: export", "", "", "", "")), (17, ("", " ", None, "", ""))):
        rows = rows.unionAll(o.filter(k % n == 0).select(*[F.lit(x).cast("string").alias(c) for c, x in zip("abcde", junk)]))
    return rows


_CSV_SQL = """SELECT o_orderkey AS a, o_orderdate::DATE AS b, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS c, o_orderdate::DATE + INTERVAL '10:20:30' HOUR TO SECOND AS d,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS e FROM orders""".replace("INTERVAL '10:20:30' HOUR TO SECOND", "INTERVAL 37230 SECOND")
_register("csv_clean_rows", lambda s, d: csv_folder.clean_rows(_csv_rows(s, d)), f"""
    SELECT a::VARCHAR AS a, CASE WHEN a % 3 = 0 THEN day(b) || '/' || month(b) || '/' || year(b) ELSE b::VARCHAR END AS b, replace(c::VARCHAR, '.', ',') AS c, strftime(d, '%Y-%m-%d %H:%M:%S') AS d, e FROM ({_CSV_SQL})""")
_register("csv_types", lambda s, d: csv_folder.infer_types(csv_folder.clean_rows(_csv_rows(s, d))), f"""WITH r AS ({_CSV_SQL})
    SELECT 'a' AS name, 'long' AS type, count(a) < count(*) AS nullable FROM r UNION ALL SELECT 'b', 'date', count(b) < count(*) FROM r UNION ALL SELECT 'c', 'double', count(c) < count(*) FROM r
    UNION ALL SELECT 'd', 'timestamp_ntz', count(d) < count(*) FROM r UNION ALL SELECT 'e', 'string', count(e) < count(*) FROM r""")


def _csv_cast(spark, sf):
    rows = csv_folder.clean_rows(_csv_rows(spark, sf))
    types = {r.name: r.type for r in csv_folder.infer_types(rows).collect()}
    return csv_folder.cast_rows(rows, types)


_register("csv_cast", _csv_cast, f"SELECT a::BIGINT AS a, b, c::DOUBLE AS c, d, e FROM ({_CSV_SQL})")

# -- whole stages -----------------------------------------------------------


#: Orders with what is known of their customers, as one table: its columns and their places.
_FLAT = {"order_key": ("o_orderkey", "bigint"), "order_status": ("o_orderstatus", "string"), "total_price": ("o_totalprice", "double"), "order_date": ("o_orderdate", "timestamp_ntz"),
         "customer_key": ("o_custkey", "bigint"), "customer_name": ("c_name", "string"), "market_segment": ("c_mktsegment", "string"), "nation_key": ("c_nationkey", "int"),
         "nation_name": ("n_name", "string"), "region_key": ("n_regionkey", "int"), "region_name": ("r_name", "string")}


def _flat(spark, sf) -> tuple[DataFrame, list]:
    o, c, n, r = (_read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(*[F.col(x).alias(a) for a, (x, _) in _FLAT.items()])
    return df, sorted(profile.evidence_of(profile.profile(df, "flat").collect()), key=lambda c: c.column)


def _group_rows(spark, found) -> DataFrame:
    return _rows(spark, "determinants string, dependents string, confidence double, distinct long, uniqueness double, repeated long",
                 [(",".join(g.determinants), ",".join(g.dependents), round(g.confidence, 4), g.distinct, round(g.uniqueness, 6), g.repeated) for g in found])


def _group_candidates(spark, sf):
    """Determinants of one column, and pairs of them, with the columns they determine, before any is chosen."""
    df, columns = _flat(spark, sf)
    tests, determinants = groups.Tests(df, [c.column for c in columns]), groups.determinant_candidates(columns)
    return _group_rows(spark, groups.candidate_groups("flat", tests, columns, determinants, 1) + groups.candidate_groups("flat", tests, columns, determinants, 2))


_flat_sets = [(d,) for d in _FLAT] + list(combinations(_FLAT, 2))
_FLAT_SQL = f"""WITH flat AS (SELECT {', '.join(f'{x} AS {a}' for a, (x, _) in _FLAT.items())} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey),
    labelled AS ({' UNION ALL '.join(_profile_sql('flat', a, k) for a, (_, k) in _FLAT.items())}), {_shape_ctes('SELECT * FROM labelled')},
    d AS ({' UNION ALL '.join(f"""SELECT {_list(d)} AS ds, '{c}' AS dependent, count(*) AS n, sum(n) AS of, count(*) FILTER (v > 1) AS violations
      FROM (SELECT count(*) n, count(DISTINCT {c}) v FROM flat WHERE {' AND '.join(f'{x} IS NOT NULL' for x in d)} GROUP BY {_same(d)})""" for d in _flat_sets for c in _FLAT if c not in d)}),
    may AS (SELECT * FROM s WHERE null_ratio <= 0.05 AND distinct_count > 1 AND uniqueness_ratio < 0.95 AND (NOT (kind = 'temporal' OR t) OR k) AND ms < 0.4),
    tells AS (SELECT * FROM s WHERE (distinct_count > 1 OR l) AND NOT k AND NOT g AND NOT t AND kind <> 'temporal' AND ms < 0.4 AND uniqueness_ratio < 0.95),
    part AS (SELECT ds, dependent, n, of, unnest(ds) AS name FROM d WHERE violations = 0 AND n < of AND n / of < 0.999999999),
    lookup AS (SELECT *, CASE WHEN null_ratio > 0.05 OR distinct_count <= 1 OR t OR kind = 'temporal' OR ms >= 0.4 OR g THEN 0.0
        ELSE least(0.55 * k::INT + 0.25 * (uniqueness_ratio >= 0.01 AND uniqueness_ratio < 0.95)::INT + 0.25 * identifiability_score, 1.0) END >= 0.5 AS names_rows FROM may),
    rank AS (SELECT *, row_number() OVER (ORDER BY names_rows DESC, identifiability_score DESC, uniqueness_ratio DESC, distinct_count DESC, column_name) AS pos FROM lookup),
    fits AS (SELECT part.ds, dependent, n, of, array_to_string(list(name ORDER BY pos), ',') AS determinants, avg(rank.identifiability_score) AS ident
      FROM part JOIN rank ON name = column_name JOIN tells ON dependent = tells.column_name
      GROUP BY part.ds, dependent, n, of, tells.distinct_count HAVING count(*) = len(part.ds) AND product(greatest(rank.distinct_count, 1)) >= tells.distinct_count)"""
_register("group_candidates", _group_candidates, f"""{_FLAT_SQL}
    SELECT determinants, string_agg(dependent, ',' ORDER BY dependent) AS dependents, round(least(0.95, 0.5 + 0.25 * any_value(ident) + 0.03 * count(*)), 4)::DOUBLE AS confidence,
      any_value(n) AS "distinct", round(any_value(n) / any_value(of), 6)::DOUBLE AS uniqueness, (any_value(of) - any_value(n))::BIGINT AS repeated FROM fits GROUP BY determinants""")


def _functional_groups(spark, sf):
    source, flat = _evidence(spark, sf, STAR)
    evidence = {t: sorted((c for c in flat if c.table == t), key=lambda c: c.column) for t in source}
    found = [k for k in keys.simple_keys(flat)]
    links = joins.discover(source, flat, found)
    built = groups.build(source, evidence, structure.structures(source, found, links))
    return _rows(spark, "table_name string, group_name string, determinants string, dependents string, role string, confidence double",
                 [(g.table, g.name, ",".join(g.determinants), ",".join(g.dependents), g.role, g.confidence) for g in built])


_register("functional_groups", _functional_groups)


def _analysis(spark: SparkSession, sf: str) -> Pipeline:
    """Parquet tables are read by column as fast as a cache, which would first be filled with whole tables."""
    return Pipeline(spark, read_star(spark, sf), cache=False)


def _logical_plans(spark, sf):
    p = _analysis(spark, sf).run("logical_tables")
    p.close()
    return _rows(spark, "name string, source string, role string, columns string, is_distinct boolean", [(x.name, x.source, x.role, ",".join(x.columns), x.distinct) for x in p.plans])


_register("logical_plans", _logical_plans)


def _run_all(spark, sf):
    p = _analysis(spark, sf).run()
    p.close()
    rep = report.report(p.certifications, p.plans, p._flat(p.evidence), p.roles) if p.certifications else {"models": []}
    return _rows(spark, "model_id string, model_type string, status string, certification_score double, parsimony_score double, facts string, dimensions string, failed_rules string, warning_rules string",
                 [(m["model_id"], m["model_type"], m["status"], m["certification_score"], m["parsimony_score"], ",".join(m["fact_tables"]), ",".join(m["dimension_tables"]),
                   ",".join(m["failed_rules"]), ",".join(m["warning_rules"])) for m in rep["models"]])


_register("run_all", _run_all)


def _model_coverage(spark, sf):
    """Columns of the sources that no logical table of a fixed plan holds."""
    evidence = profile.evidence_of(profile.profile_all(spark, {t: _read(spark, sf, t) for t in ("part", "nation")}).collect())
    plans = [_PLANS[t] for t in ("part", "nation")]
    found = report.coverage({"fact_tables": [], "dimension_tables": [p.name for p in plans]}, plans, evidence)
    return _rows(spark, "table_name string, column_name string", [(c["source_table"], c["column_name"]) for c in found["uncovered_columns"]])


_register("model_coverage", _model_coverage, "SELECT table_name, column_name FROM " + _sql_values(
    [(t, c) for t in ("part", "nation") for c in COLUMNS[t] if (t, c) not in {("part", "p_brand"), ("part", "p_type"), ("nation", "n_name")}], "table_name, column_name"))
