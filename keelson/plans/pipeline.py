"""The whole analysis over a set of tables, one method for each stage.

Tables stay DataFrames; what stages learn is small and goes through the evidence
store.  Stages may be called one by one or all at once with :meth:`Pipeline.run`.
"""

from __future__ import annotations

import json
import time
from collections import defaultdict
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..operators import certify, graph, groups, joins, keys, logical, models, profile, report, structure, validate, views
from ..sources import catalog
from ..sources.csv_folder import read_folder
from ..sources.evidence import Store
from ..types import ColumnEvidence, Edge, Group, Join, Key, LogicalPlan, Model, Role, Structure, analysed

#: Scopes of evidence.
SOURCE, LOGICAL = "SOURCE", "LOGICAL"


class Pipeline:
    STAGES = ("profile_sources", "source_keys", "source_joins", "functional_groups", "logical_tables", "profile_logical", "logical_keys",
              "logical_joins", "adjacency", "table_roles", "candidate_models", "rank_models", "validate_structure", "validate_granularity",
              "validate_homogeneity", "validate_stability", "certify_models")

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], store: Store | str | None = None, cache: bool = True, resume: bool = False, max_key_width: int | None = None):
        """``resume``: stages take what an earlier run left in the store, as long as it has the tables' columns."""
        self.spark, self.sources, self.cache, self._anew = spark, dict(tables), cache, True
        self.store = store if isinstance(store, Store) else Store(spark, store)
        self.resume, self.max_key_width, self.run_ts = resume, max_key_width, time.time_ns() // 1000
        self.logical: dict[str, DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.evidence: dict[str, list[ColumnEvidence]] = {}
        self.logical_evidence: dict[str, list[ColumnEvidence]] = {}

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **options) -> Pipeline:
        """CSV files of a folder as sources."""
        return cls(spark, read_folder(spark, folder), **options)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str = "default", **options) -> Pipeline:
        """Tables of a database of the session's catalog as sources."""
        return cls(spark, catalog.read_tables(spark, database), **options)

    def _hold(self, df: DataFrame) -> DataFrame:
        """Tables are read many times; the cache spills to disk and can be dropped any time."""
        if self.cache:
            self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return self.kept[-1]
        return df

    def close(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()

    def _profiled(self, tables: dict[str, DataFrame], scope: str, like: dict[str, str] | None = None) -> dict[str, list[ColumnEvidence]]:
        """``like``: tables with the rows of a source, whose columns' profiles they share."""
        rows, like = self._known_profiles(tables, scope), like or {}
        if rows is None:
            rows = profile.profile_all(self.spark, {t: df for t, df in tables.items() if t not in like}).withColumns({"scope": F.lit(scope), "run_ts": F.lit(self.run_ts)}).collect()  # a row for each column
            rows += [Row(**(r.asDict() | {"table_name": t, "scope": scope, "run_ts": self.run_ts})) for t, source in like.items()
                     for r in self.profiles if r.table_name == source and r.column_name in tables[t].columns]
            done = self.spark.createDataFrame(rows, T.StructType([*profile.PROFILE.fields, T.StructField("scope", T.StringType()), T.StructField("run_ts", T.LongType())]))
            self.store.put("column_profiles", done, scope)
            self.store.put_records("identifiability_scores", [{"scope": scope, "run_ts": self.run_ts, "table": r.table_name, "column": r.column_name, "identifiability": r.identifiability_score} for r in rows], scope)
        if scope == SOURCE:
            self.profiles = rows
        out: dict[str, list[ColumnEvidence]] = {t: [] for t in tables}
        for c in sorted(profile.evidence_of(rows), key=lambda c: (c.table, c.column)):
            out[c.table].append(c)
        return out

    def _known_profiles(self, tables: dict[str, DataFrame], scope: str) -> list | None:
        """The latest stored profiles if they have exactly the columns of the tables."""
        if not (self.resume and self.store.has("column_profiles", scope)):
            return None
        rows = [r for r in self.store.get("column_profiles", scope).collect() if r.table_name in tables]
        want = {(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in analysed(df)}
        return rows if {(r.table_name, r.column_name, r.column_type) for r in rows} == want else None

    def _stored(self, kind: str, make: type, compute, scope: str = "ALL", extra: dict | None = None) -> list:
        """Records of a stage: those of the store where they may be used, else computed and stored."""
        if self.resume and not self._anew and self.store.has(kind, scope):
            names = [f.name for f in fields(make)]
            return [make(**{n: tuple(v) if isinstance(v := r[n], list) else v for n in names if n in r}) for r in map(lambda r: r.asDict(), self.store.get(kind, scope).collect())]
        self._anew = True  # what follows rests on it
        found = compute()
        self.store.put_records(kind, [vars(x) | (extra or {}) | {"scope": scope} for x in found], scope)
        return found

    @staticmethod
    def _flat(evidence: dict[str, list[ColumnEvidence]]) -> list[ColumnEvidence]:
        return [c for cs in evidence.values() for c in cs]

    # -- sources ------------------------------------------------------------

    def profile_sources(self) -> dict[str, list[ColumnEvidence]]:
        self.sources = {t: self._hold(df) for t, df in self.sources.items()}
        self._anew = self._known_profiles(self.sources, SOURCE) is None
        self.evidence = self._profiled(self.sources, SOURCE)
        return self.evidence

    def source_keys(self) -> list[Key]:
        self.keys = self._stored("primary_keys", Key, lambda: keys.infer_keys(self.sources, self._flat(self.evidence), self.max_key_width), SOURCE, {"official": False})
        return self.keys

    def source_joins(self) -> list[Join]:
        self.coverages: dict[tuple, Join] = {}
        self.joins = self._stored("joins", Join, lambda: joins.discover(self.sources, self._flat(self.evidence), self.keys, known=self.coverages), SOURCE)
        return self.joins

    def functional_groups(self) -> list[Group]:
        self.structures: dict[str, Structure] = structure.structures(self.sources, self.keys, self.joins)
        self.groups = self._stored("groups", Group, lambda: groups.build(self.sources, self.evidence, self.structures))
        return self.groups

    # -- logical tables -----------------------------------------------------

    def logical_tables(self) -> list[LogicalPlan]:
        self.plans = self._stored("logical_tables", LogicalPlan, lambda: logical.plans(self.groups, self.evidence, self.structures))
        self.like = {p.name: p.source for p in self.plans if logical.keeps_rows(p, self.keys)}
        self.logical = {p.name: logical.materialize(p, self.sources[p.source], self.keys) for p in self.plans}
        self.logical |= {t: self._hold(df) for t, df in self.logical.items() if t not in self.like}  # sources are held
        return self.plans

    def _keys_of_sources(self) -> dict[str, list[tuple[str, ...]]]:
        """For each logical table with the rows of its source the source's proven keys whose columns it has."""
        columns = {p.name: set(p.columns) for p in self.plans}
        return {t: [k.columns for k in self.keys if k.table == source and k.exact and set(k.columns) <= columns[t]] for t, source in self.like.items()}

    def save_logical(self, database: str = "default") -> list[str]:
        """Logical tables as tables of a database; later stages read these."""
        for name, df in self.logical.items():
            self.logical[name] = catalog.save_table(df, database, name)
        return sorted(self.logical)

    def profile_logical(self) -> dict[str, list[ColumnEvidence]]:
        self._anew = self._anew or self._known_profiles(self.logical, LOGICAL) is None
        self.logical_evidence = self._profiled(self.logical, LOGICAL, self.like)
        return self.logical_evidence

    def logical_keys(self) -> list[Key]:
        determinants = {p.name: p.determinants for p in self.plans if p.role == logical.DIMENSION}
        self.official = self._stored("primary_keys", Key, lambda: keys.logical_keys(self.logical, self._flat(self.logical_evidence), determinants, self._keys_of_sources()), LOGICAL, {"official": True})
        return self.official

    def logical_joins(self) -> list[Join]:
        made = defaultdict(list)
        for t, source in self.like.items():
            made[source].append(t)
        known = {(a, c, b, k): replace(j, source=a, target=b) for (s, c, t, k), j in self.coverages.items() for a in made[s] for b in made[t]}
        self.links = self._stored("joins", Join, lambda: joins.discover(self.logical, self._flat(self.logical_evidence), self.official, known=known), LOGICAL)
        return self.links

    # -- models -------------------------------------------------------------

    def adjacency(self) -> list[Edge]:
        self.edges = graph.edges(self.links)
        self.store.put_records("edges", self.edges)
        return self.edges

    def adjacency_matrix(self) -> str:
        """Which logical tables confirmed edges join, as a matrix of 0 and 1."""
        return graph.binary_matrix(graph.matrix(self.spark, self.logical, self.edges))

    def table_roles(self) -> list[Role]:
        self.roles = graph.roles(self.logical_evidence, {k.table for k in self.official}, self.edges, {p.name: p.role for p in self.plans})
        self.store.put_records("roles", self.roles)
        return self.roles

    def candidate_models(self) -> list[Model]:
        self.models = models.Builder(self.roles, graph.confirmed(self.edges), self.logical_evidence).build()
        self.store.put_records("model_edges", [vars(e) | {"model_id": m.id} for m in self.models for e in m.edges])
        return self.models

    def rank_models(self) -> list[Model]:
        self.models = models.ranked(self.models)
        self.store.put_records("models", self.models)
        return self.models

    # -- validation ---------------------------------------------------------

    def validate_structure(self) -> dict[str, dict]:
        known = {(j.source, j.source_columns, j.target, j.target_columns): 0 for j in self.links if j.rows == j.matched}  # all were tested
        self.structure = {m.id: validate.structure(m, self.logical, known) for m in self.models}
        self.store.put_records("structure", self.structure.values())
        return self.structure

    def validate_granularity(self) -> dict[str, list[dict]]:
        """The grain of each fact, from its foreign keys and its most trusted key of any scope."""
        best: dict[str, Key] = {}
        for k in sorted(self.keys + self.official, key=lambda k: (-k.confidence, -k.identifiability, k.columns)):
            best.setdefault(k.table, k)
        proven = self._keys_of_sources()
        counter = validate.Grains(self.logical, {t: [*proven.get(t, ()), *(k.columns for k in self.official if k.table == t and k.exact)] for t in self.logical})
        self.grains = {m.id: [counter.validate(m, f, best.get(f)) for f in m.facts] for m in self.models}
        self.store.put_records("grains", [g for gs in self.grains.values() for g in gs])
        return self.grains

    def validate_homogeneity(self) -> dict[str, dict]:
        structural: dict[str, set[str]] = defaultdict(set)
        for m in self.models:
            for e in m.edges:
                structural[e.source].update(e.source_columns)
        for g in (g for gs in self.grains.values() for g in gs if g["is_valid"]):
            structural[g["fact_table"]].update(g["grain_columns"])
        found = [validate.homogeneity(r, self.logical_evidence[r.table], structural[r.table]) for r in self.roles]
        self.purity = {h["table_name"]: h for h in found if h}
        self.store.put_records("homogeneity", self.purity.values())
        return self.purity

    def validate_stability(self) -> dict[str, list[dict]]:
        known: dict = {}
        self.stability = {m.id: validate.check_stability(m, self.logical, self.logical_evidence, known) for m in self.models}
        self.store.put_records("stability", [s for ss in self.stability.values() for s in ss])
        return self.stability

    def certify_models(self) -> list[dict]:
        issues = {m.id: certify.issues_of(m, m.score, self.structure.get(m.id), self.grains.get(m.id), self.purity, self.stability.get(m.id)) for m in self.models}
        self.certifications = sorted((certify.certify(m, issues[m.id]) for m in self.models), key=certify.order)
        self.store.put_records("certifications", self.certifications)
        self.store.put_records("issues", [vars(i) | {"model_id": k} for k, own in issues.items() for i in own])
        return self.certifications

    # -- results ------------------------------------------------------------

    def create_views(self, database: str | None = None) -> dict[str, DataFrame]:
        """Views of the best certified model, temporary ones or, over saved logical tables, those of a database; ValueError if none is certified."""
        best = views.best_certified(self.certifications)
        model = next(m for m in self.models if m.id == best["model_id"])
        if not database:
            return views.create_views(self.spark, self.logical, model)
        self.save_logical(database)
        return views.create_lasting_views(self.spark, self.logical, model, database)

    def report(self) -> dict:
        return report.report(self.certifications, self.plans, self._flat(self.evidence), self.roles)

    def diagram(self, rep: dict | None = None) -> str:
        rep = rep or self.report()
        best = next(m for m in self.models if m.id == rep["best_model"]["model_id"])
        return report.mermaid(rep, list(best.edges), self.logical_evidence)

    def write_report(self, path: str) -> dict:
        """The report as JSON, and beside it the diagram (.mmd)."""
        rep, target = self.report(), Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(rep, indent=2, ensure_ascii=False), encoding="utf-8")
        target.with_suffix(".mmd").write_text(self.diagram(rep), encoding="utf-8")
        return rep

    def evaluate_join(self, source: str, columns, target: str, target_columns) -> Join:
        """The coverage of a known source key by columns of another table."""
        if not hasattr(self, "keys"):
            self.run("source_keys")
        return joins.evaluate_named(self.sources, self.keys, source, columns, target, target_columns)

    def run(self, until: str | None = None) -> Pipeline:
        """All stages in order, or those up to ``until``."""
        for stage in self.STAGES:
            getattr(self, stage)()
            if stage == until:
                break
        return self
