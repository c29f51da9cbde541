"""Command line: ``python -m keelson COMMAND FOLDER [options]``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from .plans.pipeline import Pipeline
from .sources import csv_folder
from .sources.evidence import Store

#: Command -> (last stage it needs, what it prints).
COMMANDS = {
    "profile-basic": ("profile_sources", lambda p: [asdict(c) for cs in p.evidence.values() for c in cs]),
    "score-identifiability": ("profile_sources", lambda p: {f"{c.table}.{c.column}": c.identifiability for cs in p.evidence.values() for c in cs}),
    "infer-source-keys": ("source_keys", lambda p: [asdict(k) for k in p.keys]),
    "infer-source-joins": ("source_joins", lambda p: [asdict(j) for j in p.joins]),
    "infer-functional-groups": ("functional_groups", lambda p: [asdict(g) for g in p.groups]),
    "build-logical-tables": ("logical_tables", lambda p: [asdict(x) for x in p.plans]),
    "profile-logical-tables": ("profile_logical", lambda p: [asdict(c) for cs in p.logical_evidence.values() for c in cs]),
    "infer-pk": ("logical_keys", lambda p: [asdict(k) for k in p.official]),
    "infer-joins": ("logical_joins", lambda p: [asdict(j) for j in p.links]),
    "build-adjacency": ("adjacency", lambda p: {"edges": [asdict(e) for e in p.edges], "matrix": p.adjacency_matrix().splitlines()}),
    "infer-table-roles": ("table_roles", lambda p: [asdict(r) for r in p.roles]),
    "build-model-candidates": ("candidate_models", lambda p: [asdict(m) for m in p.models]),
    "rank-models": ("rank_models", lambda p: {m.id: [m.raw_score, m.score] for m in p.models}),
    "validate-structure": ("validate_structure", lambda p: {k: {x: y for x, y in v.items() if x != "issues"} for k, v in p.structure.items()}),
    "validate-granularity": ("validate_granularity", lambda p: p.grains),
    "validate-semantic-homogeneity": ("validate_homogeneity", lambda p: p.purity),
    "validate-aggregation-stability": ("validate_stability", lambda p: p.stability),
    "certify-models": ("certify_models", lambda p: [c | {"issues": [asdict(i) for i in c["issues"]]} for c in p.certifications]),
    "generate-sql-views": ("certify_models", None),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="keelson")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest-csv")
    one.add_argument("path")
    one.add_argument("target")
    one.add_argument("--if-exists", choices=("replace", "append", "fail"), default="append")
    many = sub.add_parser("ingest-folder")
    many.add_argument("folder")
    many.add_argument("target")
    stages = [sub.add_parser(c) for c in COMMANDS]
    j, e, r = (sub.add_parser(c) for c in ("evaluate-join", "export-certification-report", "run-all"))
    for p in (*stages, j, e, r):
        p.add_argument("folder", help="folder of CSV files, or catalog:DATABASE")
        p.add_argument("--database", help="logical tables and views are saved there; the session uses Hive's catalog")
        p.add_argument("--max-key-width", type=int, help="widest composite key that is looked for")
    for p in (one, many, *stages, j, e, r):
        p.add_argument("--store", help="folder of the evidence: a command leaves its own there and starts from what is there (run-all starts anew)")
    c = sub.add_parser("clear")
    c.add_argument("store")
    c.add_argument("--scope", choices=("SOURCE", "LOGICAL", "ALL"))
    for a in ("source", "columns", "target", "target_columns"):
        j.add_argument(a)
    for r in (e, r):
        r.add_argument("--report", default="certification_report.json")
        r.add_argument("--skip-sql-views", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("keelson").config("spark.sql.session.timeZone", "UTC")
        lasting = getattr(a, "database", None) or getattr(a, "folder", "").startswith("catalog:")
        spark = (builder.enableHiveSupport() if lasting else builder).getOrCreate()
    split = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    store = Store(spark, a.store) if getattr(a, "store", None) else None
    if a.command == "ingest-csv":
        out = csv_folder.import_file(spark, a.path, a.target, a.if_exists, store)
    elif a.command == "ingest-folder":
        out = csv_folder.import_folder(spark, a.folder, a.target, store)
    elif a.command == "clear":
        Store(spark, a.store).clear(scope=a.scope)
        out = {"cleared": a.scope or "all scopes"}
    else:
        options = {"store": store, "resume": store is not None and a.command != "run-all", "max_key_width": a.max_key_width}
        p = Pipeline.from_catalog(spark, a.folder.split(":", 1)[1], **options) if a.folder.startswith("catalog:") else Pipeline.from_folder(spark, a.folder, **options)
        if a.command == "evaluate-join":
            out = asdict(p.run("source_keys").evaluate_join(a.source, split(a.columns), a.target, split(a.target_columns)))
        elif a.command in ("export-certification-report", "run-all"):
            p.run()
            if a.command == "run-all" and not a.skip_sql_views:
                try:
                    p.create_views(a.database)
                except ValueError as e:  # no certified model: the report tells why
                    print(f"no views: {e}")
            out = p.write_report(a.report)
        else:
            stage, show = COMMANDS[a.command]
            p.run(stage)
            if a.command == "build-logical-tables" and a.database:
                p.save_logical(a.database)
            out = show(p) if show else {k: v.columns for k, v in p.create_views(a.database).items()}
        p.close()
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
