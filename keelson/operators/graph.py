"""The table graph: edges with name evidence, degrees and table roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.similarity import hybrid, name_similarity
from ..types import ColumnEvidence, Edge, Join, Role
from .logical import DIMENSION, FACT, UNKNOWN

FEW_ROWS, LOOKUP_ROWS = 5, 100


def edges(joins: list[Join]) -> list[Edge]:
    out = []
    for j in joins:
        mean, score, label = hybrid(j.ratio, [name_similarity(a, b) for a, b in zip(j.source_columns, j.target_columns)])
        out.append(Edge(j.source, j.target, j.source_columns, j.target_columns, j.ratio, mean, score, label))
    return out


def confirmed(all_edges: list[Edge]) -> list[Edge]:
    return [e for e in all_edges if e.evidence == "CONFIRMED"]


def evidence_column(ratio: Column, similarity: Column) -> tuple[Column, Column]:
    """(hybrid score, label) over a DataFrame of edges."""
    from ..functions.similarity import CONFIRMED, COVERAGE, NAMES, WEAK

    score = F.round(COVERAGE * ratio + NAMES * similarity, 6)
    return score, F.when(score >= CONFIRMED, "CONFIRMED").when(score <= WEAK, "WEAK").otherwise("COINCIDENCE")


def matrix_table(tables, edge_rows: DataFrame) -> DataFrame:
    """(table_name, a column for each table): the highest score of the confirmed edges (source_table, target_table, evidence, score) of each pair, else 0."""
    order = sorted(tables)
    spark = edge_rows.sparkSession
    wide = edge_rows.filter("evidence = 'CONFIRMED'").groupBy(F.col("source_table").alias("table_name")).pivot("target_table", order).agg(F.max("score"))
    return spark.createDataFrame([(t,) for t in order], "table_name string").join(wide, "table_name", "left").fillna(0.0, order).select("table_name", *order)


def matrix(spark: SparkSession, tables, all_edges: list[Edge]) -> dict[str, dict[str, float]]:
    """The same from records, by rows and columns."""
    rows = spark.createDataFrame([(e.source, e.target, e.evidence, float(e.hybrid or e.ratio)) for e in all_edges], "source_table string, target_table string, evidence string, score double")
    return {r["table_name"]: {t: r[t] for t in sorted(tables)} for r in matrix_table(tables, rows).orderBy("table_name").collect()}


def binary_matrix(m: dict[str, dict[str, float]]) -> str:
    """The matrix as text: tables are T1, T2, ..."""
    order = list(m)
    lines = [f"T{i} = {t}" for i, t in enumerate(order, 1)] + ["    " + " ".join(f"T{i}" for i in range(1, len(order) + 1))]
    lines += [f"T{i:<3}" + " ".join(str(int(m[a].get(b, 0) > 0)).rjust(len(str(j)) + 1) for j, b in enumerate(order, 1)) for i, a in enumerate(order, 1)]
    return "\n".join(lines)


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(table_name, outgoing, incoming): distinct neighbours over rows (source_table, target_table)."""
    out = edge_rows.groupBy(F.col("source_table").alias("table_name")).agg(F.count_distinct("target_table").alias("outgoing"))
    into = edge_rows.groupBy(F.col("target_table").alias("table_name")).agg(F.count_distinct("source_table").alias("incoming"))
    return out.join(into, "table_name", "full").select("table_name", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def additive_measure(c: ColumnEvidence) -> bool:
    return (not names.key_like(c.column) and c.numeric and c.distinct > 1 and c.uniqueness < 0.95
            and (c.entropy_ratio >= 0.05 or abs(c.variation) >= 0.05))


def additive_column() -> Column:
    """``additive_measure`` over rows of profiles."""
    c = F.col
    return (~names.key_like_col(c("column_name")) & c("kind").isin("integer", "continuous") & (c("distinct_count") > 1) & (c("uniqueness_ratio") < 0.95)
            & ((c("entropy_ratio") >= 0.05) | (F.abs("variation_coefficient") >= 0.05)))


#: Conditions of a table by name, as SQL over rows, outgoing, incoming (neighbours), has_key, numeric, text
#: (columns), measures (additive ones; null where they aren't counted), grain and small_lookup.
CONDITIONS = {
    "linked": "outgoing + incoming > 0",
    "refers": "outgoing >= 1",
    "refers to several": "outgoing >= 2",
    "is referred to": "incoming >= 1",
    "is not referred to": "incoming = 0",
    "has a key": "has_key",
    "has a grain": "grain",
    "has rows enough": f"rows >= {FEW_ROWS}",
    "is mostly numbers": "numeric > text",
    "is not mostly numbers": "numeric <= text",
    "has measures": "coalesce(measures, 0) > 0",
    "may have measures": "coalesce(measures, 1) <> 0",
    "is no lookup": "not small_lookup",
}
_FACT = ("refers", "may have measures", "is no lookup")
#: The decision list of roles, first match first: role, confidence, conditions that all hold.
RULES = (
    ("FACT", 0.8, (*_FACT, "has a key", "has a grain", "has measures")),
    ("FACT", 0.85, (*_FACT, "refers to several", "has rows enough", "is mostly numbers")),
    ("FACT", 0.8, (*_FACT, "refers to several", "has rows enough", "has a grain", "has measures")),
    ("FACT", 0.8, (*_FACT, "is not referred to", "has a key", "has rows enough", "is mostly numbers")),
    ("DIMENSION", 0.75, ("refers", "has a key", "is not mostly numbers")),
    ("DIMENSION", 0.85, ("has a key", "is referred to")),
)
SMALL_LOOKUP = f"has_key and coalesce(measures, 1) = 0 and rows < {LOOKUP_ROWS} and incoming >= 1 and numeric <= text + outgoing"


def role_columns(tables: DataFrame) -> DataFrame:
    """``tables`` (rows, outgoing, incoming, has_key, numeric, text, measures, grain) with role, confidence and reason."""
    known = tables.withColumn("small_lookup", F.expr(SMALL_LOOKUP))
    found = F.when(~F.expr(CONDITIONS["linked"]), F.struct(F.lit("ISOLATED").alias("role"), F.lit(0.9).alias("confidence"), F.lit("not linked").alias("reason")))
    for role, confidence, names_ in RULES:
        found = found.when(F.expr(" and ".join(f"({CONDITIONS[c]})" for c in names_)),
                           F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.lit(", ".join(names_)).alias("reason")))
    found = found.otherwise(F.struct(F.lit("UNKNOWN").alias("role"), F.lit(0.4).alias("confidence"), F.lit("no rule applies").alias("reason")))
    return known.withColumn("__found", found).select(*tables.columns, "__found.role", "__found.confidence", "__found.reason")


def roles(evidence: dict[str, list[ColumnEvidence]], keyed: set[str], all_edges: list[Edge], logical: dict[str, str]) -> list[Role]:
    """The role of each table; a logical fact or dimension keeps the role it was built for."""
    good = confirmed(all_edges)
    rows = []
    for t in sorted(evidence):
        columns, key = evidence[t], t in keyed
        count = lambda *kinds: sum(c.kind in kinds for c in columns)  # noqa: B023, E731
        rows.append((t, max((c.rows for c in columns), default=0), len({e.target for e in good if e.source == t}), len({e.source for e in good if e.target == t}),
                     key, sum(c.numeric for c in columns), count("text"), sum(map(additive_measure, columns)), key, count("temporal")))
    if not rows:
        return []
    tables = SparkSession.active().createDataFrame(rows, "t string, rows long, outgoing int, incoming int, has_key boolean, numeric int, text int, measures int, grain boolean, temporal int")
    out = []
    for r in sorted(role_columns(tables).collect()):  # a row for each table
        given = {FACT: "FACT", DIMENSION: "DIMENSION"}.get(logical.get(r.t, UNKNOWN))
        role = (given, 0.9, "built as a logical table of this role") if given else (r.role, r.confidence, r.reason)
        out.append(Role(r.t, *role, r.rows, r.outgoing, r.incoming, r.numeric, r.text, r.temporal, r.has_key))
    return out
