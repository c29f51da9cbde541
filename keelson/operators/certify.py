"""Certification of models from what the validators found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import Model
from .validate import Issue

# The score and its penalties.
START, ERROR, WARNING, LEAST = 100.0, 35.0, 10.0, 0.0
RULES = ("MODEL_COVERAGE", "PARSIMONY_RANKING", "STRUCTURAL_VALIDATION", "DETERMINISTIC_GRANULARITY", "SEMANTIC_HOMOGENEITY", "AGGREGATION_STABILITY")


def status_of(issues: list[Issue]) -> str:
    kinds = {i.severity for i in issues}
    return "INVALID" if "ERROR" in kinds else "WARNING" if "WARNING" in kinds else "VALID"


def score_of(issues: list[Issue]) -> float:
    errors, warnings = (sum(i.severity == s for i in issues) for s in ("ERROR", "WARNING"))
    return round(max(LEAST, START - ERROR * errors - WARNING * warnings), 2)


def issues_of(m: Model, score: float | None, structure: dict | None, grains: list[dict] | None, purity: dict[str, dict], stability: list[dict] | None) -> list[Issue]:
    out = []
    if m.coverage < 0.999999:
        out.append(Issue("MODEL_COVERAGE", "WARNING", f"Model covers {m.covered_facts} of {m.total_facts} inferred fact tables ({m.coverage:.2%})."))
    if score is None:
        out.append(Issue("PARSIMONY_RANKING", "WARNING", "No parsimony score for this model."))
    if structure is None:
        out.append(Issue("STRUCTURAL_VALIDATION", "WARNING", "No structural validation of this model."))
    elif not structure["is_valid"]:
        out.append(Issue("STRUCTURAL_VALIDATION", "ERROR", f"{structure['issue_count']} structural issue(s), {structure['orphan_count']} orphan value(s)."))
    if not grains:
        out.append(Issue("DETERMINISTIC_GRANULARITY", "WARNING", "No granularity validation of this model."))
    out += [Issue("DETERMINISTIC_GRANULARITY", "ERROR", g["reason"], g["fact_table"]) for g in grains or () if not g["is_valid"]]
    for t in m.facts + m.dimensions:
        if t not in purity:
            out.append(Issue("SEMANTIC_HOMOGENEITY", "WARNING", "No semantic homogeneity result for this table.", t))
        elif not purity[t]["is_valid"]:
            out.append(Issue("SEMANTIC_HOMOGENEITY", "ERROR", purity[t]["reason"], t))
    if not stability:
        out.append(Issue("AGGREGATION_STABILITY", "WARNING", "No aggregation stability result of this model."))
    out += [Issue("AGGREGATION_STABILITY", "ERROR", f"{s['fact_table']} -> {s['dimension_table']} is unstable for measure {s['measure_column']}: {s['reason']}.", s["fact_table"])
            for s in stability or () if not s["is_stable"]]
    return out


def certify(m: Model, issues: list[Issue]) -> dict:
    status = status_of(issues)
    return {"model_id": m.id, "model_type": m.kind, "status": status, "is_certified": status == "VALID", "certification_score": score_of(issues),
            "parsimony_score": m.score, "coverage_ratio": m.coverage, "covered_fact_count": m.covered_facts, "total_fact_count": m.total_facts,
            "fact_tables": list(m.facts), "dimension_tables": list(m.dimensions), "issues": issues}


def order(c: dict) -> tuple:
    """Best first: valid, then with warnings, then invalid; by scores; by id."""
    return (("VALID", "WARNING", "INVALID").index(c["status"]), -c["certification_score"], -c["parsimony_score"], c["model_id"])


def certification(issues: DataFrame) -> DataFrame:
    """(model_id, errors, warnings, status, certification_score) over rows (model_id, severity); severity null: no issue."""
    e, w = F.count_if(F.col("severity") == "ERROR"), F.count_if(F.col("severity") == "WARNING")
    return issues.groupBy("model_id").agg(e.alias("errors"), w.alias("warnings")).withColumns({
        "status": F.when(F.col("errors") > 0, "INVALID").when(F.col("warnings") > 0, "WARNING").otherwise("VALID"),
        "certification_score": F.round(F.greatest(F.lit(LEAST), START - ERROR * F.col("errors") - WARNING * F.col("warnings")), 2)})
