"""Analysis views of a certified model: each fact left-joined with its dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalized
from ..types import Edge, Model
from .models import SNOWFLAKE


def best_certified(certifications: list[dict]) -> dict:
    """The best model that is valid or has warnings only; ValueError if there is none."""
    good = [c for c in certifications if c["status"] in ("VALID", "WARNING")]
    if not good:
        raise ValueError("no certified model")
    return min(good, key=lambda c: (c["status"] != "VALID", -c["certification_score"], -c["parsimony_score"], c["model_id"]))


def edges_for(m: Model, fact: str) -> list[Edge]:
    """Direct edges to dimensions; for a snowflake, those reachable through dimensions too. One for each pair of tables."""
    order = sorted(m.edges, key=lambda e: (e.depth, e.source, e.target))
    if m.kind == SNOWFLAKE:
        reached, chosen = {fact}, []
        for e in order:
            if e.source in reached:
                chosen.append(e)
                reached.add(e.target)
    else:
        chosen = [e for e in order if e.source == fact and e.depth == 1]
    best: dict[tuple[str, str], Edge] = {}
    for e in chosen:
        rank = (e.ratio, sum(normalized(a) == normalized(b) for a, b in zip(e.source_columns, e.target_columns)))
        old = best.get((e.source, e.target))
        if old is None or rank > (old.ratio, sum(normalized(a) == normalized(b) for a, b in zip(old.source_columns, old.target_columns))):
            best[e.source, e.target] = e
    return list(best.values())


def build_view(tables: dict[str, DataFrame], fact: str, edges: list[Edge]) -> DataFrame:
    """``fact_<column>`` and ``<dimension>_<column>`` of the chain of left joins; a dimension is joined once."""
    def prefixed(table: str, prefix: str) -> DataFrame:
        df = tables[table]
        return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"{prefix}_{c}") for c in sorted(df.columns) if not c.startswith("__")])

    prefix, out = {fact: "fact"}, prefixed(fact, "fact")
    for e in edges:
        if e.target in prefix or e.source not in prefix:
            continue
        prefix[e.target] = e.target
        right = prefixed(e.target, e.target)
        q = lambda c: "`" + c.replace("`", "``") + "`"
        on = [out[q(f"{prefix[e.source]}_{a}")] == right[q(f"{e.target}_{b}")] for a, b in zip(e.source_columns, e.target_columns)]
        out = out.join(right, reduce(lambda x, y: x & y, on), "left")
    return out


def view_name(fact: str, kind: str) -> str:
    return f"view_{fact}_{kind.lower()}"


def create_views(spark: SparkSession, tables: dict[str, DataFrame], m: Model) -> dict[str, DataFrame]:
    """A temporary view for each fact of the model."""
    out = {}
    for fact in m.facts:
        edges = edges_for(m, fact)
        if edges:
            out[view_name(fact, m.kind)] = build_view(tables, fact, edges)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def view_sql(columns: dict[str, list[str]], fact: str, edges: list[Edge], database: str) -> str:
    """The same view as a SELECT over the tables of a database (``columns``: those of each table)."""
    q = lambda *names: ".".join("`" + n.replace("`", "``") + "`" for n in names)
    alias, shown, joined = {fact: "fact"}, [], []
    for e in edges:
        if e.target not in alias and e.source in alias:
            on = " AND ".join(f"{q(alias[e.source], a)} = {q(e.target, b)}" for a, b in zip(e.source_columns, e.target_columns))
            alias[e.target] = e.target
            joined.append(f"LEFT JOIN {q(database, e.target)} AS {q(e.target)} ON {on}")
    for t, a in alias.items():
        shown += [f"{q(a, c)} AS {q(f'{a}_{c}')}" for c in sorted(columns[t]) if not c.startswith("__")]
    return f"SELECT {', '.join(shown)} FROM {q(database, fact)} AS `fact` {' '.join(joined)}"


def create_lasting_views(spark: SparkSession, tables: dict[str, DataFrame], m: Model, database: str) -> dict[str, DataFrame]:
    """A view of the database's catalog for each fact of the model, over its tables there."""
    out = {}
    for fact in m.facts:
        if edges := edges_for(m, fact):
            name = f"`{database}`.`{view_name(fact, m.kind)}`"
            spark.sql(f"CREATE OR REPLACE VIEW {name} AS {view_sql({t: df.columns for t, df in tables.items()}, fact, edges, database)}")
            out[view_name(fact, m.kind)] = spark.table(name)
    return out
