"""Candidate decision models (star, snowflake, constellation) and their ranking."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..types import ColumnEvidence, Edge, Model, Role

STAR, SNOWFLAKE, CONSTELLATION = "STAR", "SNOWFLAKE", "CONSTELLATION"
# Weights of the parsimony score.
TABLE, ATTRIBUTE, NUMERIC, DIMENSION, MORE_FACTS, SHARED, COVERAGE = -1.0, -0.05, 2.0, 8.0, 15.0, 10.0, 30.0


def model_id(kind: str, facts, dimensions, edges) -> str:
    def key(e: Edge):
        return (e.source, e.target, e.source_columns, e.target_columns, e.depth)

    parts = [kind, ",".join(sorted(facts)), ",".join(sorted(dimensions))]
    parts += ["|".join((e.source, e.target, ",".join(e.source_columns), ",".join(e.target_columns), str(e.depth))) for e in sorted(edges, key=key)]
    digest = hashlib.sha1("::".join(parts).encode()).hexdigest()[:8]
    return f"{kind.lower()}_{'_'.join(facts).lower() or 'model'}_{digest}"


class Builder:
    def __init__(self, roles: list[Role], edges: list[Edge], evidence: dict[str, list[ColumnEvidence]]):
        self.role = {r.table: r.role for r in roles}
        if not self.role:
            raise ValueError("no table roles: infer them first")
        self.facts = sorted(t for t, r in self.role.items() if r == "FACT")
        self.edges, self.evidence = [replace(e, depth=1) for e in edges], evidence

    def _into_dimensions(self, sources) -> list[Edge]:
        return [e for e in self.edges if e.source in sources and self.role.get(e.target) == "DIMENSION"]

    def _model(self, kind: str, facts, dimensions, edges) -> Model:
        columns = [c for t in {*facts, *dimensions} for c in self.evidence.get(t, ()) if not c.column.startswith("__")]
        total = len(self.facts)
        facts, dimensions, edges = tuple(facts), tuple(sorted(dimensions)), tuple(edges)
        return Model(kind, facts, dimensions, edges, len({*facts, *dimensions}), len(columns), sum(c.numeric for c in columns), len(facts), total,
                     round(len(facts) / total, 6) if total else 1.0, id=model_id(kind, facts, dimensions, edges))

    def stars(self) -> list[Model]:
        return [self._model(STAR, (f,), {e.target for e in own}, own) for f in self.facts if (own := self._into_dimensions({f}))]

    def snowflakes(self) -> list[Model]:
        """Stars whose dimensions point at dimensions of their own, one step further."""
        out = []
        for f in self.facts:
            own = self._into_dimensions({f})
            near = {e.target for e in own}
            far = [replace(e, depth=2) for d in sorted(near) for e in self._into_dimensions({d})]
            if near and {e.target for e in far} - near:
                out.append(self._model(SNOWFLAKE, (f,), near | {e.target for e in far}, own + far))
        return out

    def constellation(self) -> list[Model]:
        """All facts that share a dimension with another, and every dimension reachable from them."""
        users = defaultdict(set)
        for e in self._into_dimensions(set(self.facts)):
            users[e.target].add(e.source)
        facts = sorted({f for own in users.values() if len(own) >= 2 for f in own})
        if not facts:
            return []
        found = self._into_dimensions(set(facts))
        ring, seen, depth = {e.target for e in found}, set(), 2
        while ring - seen:
            step = [replace(e, depth=depth) for e in self._into_dimensions(ring - seen)]
            seen |= ring
            known = {(e.source, e.target, e.source_columns) for e in found}
            found += [e for e in step if (e.source, e.target, e.source_columns) not in known]
            ring, depth = ring | {e.target for e in step}, depth + 1
        dimensions = {e.target for e in found} | {e.source for e in found if self.role.get(e.source) == "DIMENSION"}
        return [self._model(CONSTELLATION, facts, dimensions, found)]

    def build(self) -> list[Model]:
        return self.stars() + self.snowflakes() + self.constellation()


def raw_score(m: Model) -> float:
    d, f = len(m.dimensions), len(m.facts)
    score = TABLE * m.tables + ATTRIBUTE * m.attributes + NUMERIC * m.numeric_attributes + DIMENSION * d + COVERAGE * m.coverage
    if m.kind == CONSTELLATION and f > 1:
        score += MORE_FACTS * (f - 1) + SHARED * d * (f - 1)
    return round(score, 2)


def ranked(models: list[Model]) -> list[Model]:
    """Best first, with scores between 0 and 1 (all 1 if they are equal)."""
    raw = [raw_score(m) for m in models]
    if not raw:
        return []
    low, span = min(raw), max(raw) - min(raw)
    scored = [replace(m, raw_score=r, score=round((r - low) / span, 4) if span else 1.0) for m, r in zip(models, raw)]
    return sorted(scored, key=lambda m: (-m.score, m.id))


def score_table(models: DataFrame) -> DataFrame:
    """Scores over rows (model_id, model_type, facts, dimensions, tables, attributes, numeric_attributes, coverage_ratio)."""
    c = F.col
    several = (c("model_type") == CONSTELLATION) & (c("facts") > 1)
    raw = F.round(TABLE * c("tables") + ATTRIBUTE * c("attributes") + NUMERIC * c("numeric_attributes") + DIMENSION * c("dimensions")
                  + COVERAGE * c("coverage_ratio") + F.when(several, (c("facts") - 1) * (MORE_FACTS + SHARED * c("dimensions"))).otherwise(0.0), 2)
    every = Window.partitionBy()
    low, high = F.min("raw_score").over(every), F.max("raw_score").over(every)
    return models.withColumn("raw_score", raw).withColumn(
        "score", F.when(high == low, 1.0).otherwise(F.round((c("raw_score") - low) / F.nullif(high - low, F.lit(0.0)), 4)))
