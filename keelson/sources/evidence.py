"""The evidence store: Parquet tables by kind, scope (SOURCE, LOGICAL or ALL) and run."""

from __future__ import annotations

import time
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds that keep every run; of the others a new run replaces the last.
HISTORY = ("ingestion_runs", "column_profiles")
COMPUTED = (
    "column_profiles", "identifiability_scores", "primary_keys", "joins", "groups", "logical_tables", "edges", "roles", "models", "model_edges", "structure", "grains",
    "homogeneity", "stability", "certifications", "issues",
)

SCHEMAS = {
    "ingestion_runs": "run_ts long, source_file string, target string, status string, rows long, skipped_dirty_rows long, encoding string, delimiter string, "
                      "columns string, error string",
    "primary_keys": "scope string, official boolean, table string, columns array<string>, types array<string>, kinds array<string>, low_cardinality long, rows long, null_ratio double, "
                    "uniqueness double, identifiability double, confidence double",
    "joins": "scope string, source string, source_columns array<string>, target string, target_columns array<string>, rows long, matched long, ratio double",
    "groups": "table string, name string, determinants array<string>, dependents array<string>, confidence double, reason string, role string, score double, "
              "distinct long, uniqueness double, repeated long",
    "logical_tables": "name string, source string, determinants array<string>, columns array<string>, role string, distinct boolean",
    "edges": "source string, target string, source_columns array<string>, target_columns array<string>, ratio double, similarity double, hybrid double, "
             "evidence string, depth int",
    "identifiability_scores": "scope string, run_ts long, table string, column string, identifiability double",
    "roles": "table string, role string, confidence double, reason string, rows long, outgoing long, incoming long, numeric long, text long, date long, has_key boolean",
    "models": "id string, kind string, facts array<string>, dimensions array<string>, tables long, attributes long, numeric_attributes long, "
              "covered_facts long, total_facts long, coverage double, raw_score double, score double",
    "model_edges": "model_id string, source string, target string, source_columns array<string>, target_columns array<string>, ratio double, depth int",
    "structure": "model_id string, is_valid boolean, issue_count long, orphan_count long",
    "grains": "model_id string, fact_table string, grain_columns array<string>, duplicate_count long, is_valid boolean, reason string",
    "homogeneity": "table_name string, role string, is_valid boolean, homogeneity_score double, columns array<string>, issue_count long, reason string",
    "stability": "model_id string, fact_table string, dimension_table string, measure_column string, group_column string, fine_sum double, agg_sum double, "
                 "fine_count long, agg_count long, fine_avg double, agg_avg double, fine_min double, agg_min double, fine_max double, agg_max double, "
                 "is_stable boolean, reason string",
    "certifications": "model_id string, model_type string, status string, is_certified boolean, certification_score double, parsimony_score double, "
                      "coverage_ratio double, covered_fact_count long, total_fact_count long, fact_tables array<string>, dimension_tables array<string>",
    "issues": "model_id string, rule string, severity string, message string, table string, target string",
}


def frame(spark: SparkSession, kind: str, records) -> DataFrame:
    """Records (dataclasses or dicts) in the fixed schema of their kind; fields it lacks are left out."""
    schema = spark.createDataFrame([], SCHEMAS[kind]).schema
    rows = []
    for r in records:
        d = asdict(r) if is_dataclass(r) else r
        rows.append(tuple(list(d[f]) if isinstance(d.get(f), tuple) else d.get(f) for f in schema.names))
    return spark.createDataFrame(rows, schema)


def latest_run(df: DataFrame, *by: str, run_col: str = "run_ts") -> DataFrame:
    """The rows of the latest run of each group of ``by``."""
    last = df.groupBy(*by).agg(F.max(run_col).alias(run_col))
    return df.join(last, [*by, run_col], "left_semi").select(df.columns)


class Store:
    """Evidence below a folder (any that Spark writes), or in memory only if there is none.

    A write goes to a new folder, ``kind/of=scope/run=number``, and counts once Spark has marked it as whole; only
    then older runs of the scope go, so a failed write leaves what was there, and a frame that was
    read from the store can be written to it.  Kinds of HISTORY keep all their runs.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.frames: dict[str, dict[str, list[DataFrame]]] = {}

    def put(self, kind: str, df: DataFrame, scope: str = "ALL") -> DataFrame:
        if self.root:
            old = self._runs(kind, scope)
            last = int(old[-1].rsplit("=", 1)[-1]) if old else 0
            df.write.parquet(f"{self.root}/{kind}/of={scope}/run={max(time.time_ns(), last + 1):020d}")
            for path in old if kind not in HISTORY else ():
                self._delete(path)
        else:
            runs = self.frames.setdefault(kind, {}).setdefault(scope, [])
            runs[:] = [*runs, df] if kind in HISTORY else [df]
        found = self.get(kind)
        found.createOrReplaceTempView(f"evidence_{kind}")
        return found

    def put_records(self, kind: str, records, scope: str = "ALL") -> DataFrame:
        return self.put(kind, frame(self.spark, kind, records), scope)

    def get(self, kind: str, scope: str | None = None) -> DataFrame:
        """What is known of a kind, of one scope or of all; of profiles the latest run of each table. ValueError if there is nothing."""
        if self.root:
            paths = [p for s in self.scopes(kind) if scope in (None, s) for p in self._runs(kind, s)]
            df = self.spark.read.parquet(*paths) if paths else None
        else:
            found = [f for s, runs in self.frames.get(kind, {}).items() if scope in (None, s) for f in runs]
            df = reduce(DataFrame.unionByName, found) if found else None
        if df is None:
            raise ValueError(f"no {kind} yet" + (f" of scope {scope}" if scope else ""))
        return latest_run(df, "scope", "table_name") if kind == "column_profiles" else df

    def has(self, kind: str, scope: str | None = None) -> bool:
        return any(scope in (None, s) and (not self.root or self._runs(kind, s)) for s in self.scopes(kind))

    def scopes(self, kind: str) -> list[str]:
        return [n.removeprefix("of=") for n in self._names(f"{self.root}/{kind}")] if self.root else list(self.frames.get(kind, {}))

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, system = self._fs(path)
        return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []

    def _runs(self, kind: str, scope: str) -> list[str]:
        """Whole runs, old ones first; the last alone for kinds without history."""
        whole = [p for r in self._names(f"{self.root}/{kind}/of={scope}") if "_SUCCESS" in self._names(p := f"{self.root}/{kind}/of={scope}/{r}")]
        return whole if kind in HISTORY else whole[-1:]

    def _delete(self, path: str) -> None:
        at, system = self._fs(path)
        system.delete(at, True)

    def clear(self, *kinds: str, scope: str | None = None) -> None:
        """Forget these kinds, their files too, of one scope or of all; all computed ones if none is named."""
        for k in kinds or COMPUTED:
            for s in self.scopes(k):
                if scope in (None, s):
                    if self.root:
                        self._delete(f"{self.root}/{k}/of={s}")
                    self.frames.get(k, {}).pop(s, None)
            if not self.scopes(k):
                self.spark.catalog.dropTempView(f"evidence_{k}")
