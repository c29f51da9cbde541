"""Searches over columns against plain ones: keys, grains, dependencies, joins, stability."""

import logging
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from keelson.operators import dependencies, groups, joins, keys, pairs, profile, validate
from keelson.operators.pairs import Pairs


def table(spark, rows, kinds):
    return spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))


def unique(rows, at, nulls_equal=True):
    seen = [tuple(r[i] for i in at) for r in rows]
    if not nulls_equal:
        seen = [x for x in seen if None not in x]
    return len(seen) == len(set(seen))


def first_of(rows, n, narrowest=2):
    return next((c for w in range(narrowest, n + 1) for c in combinations(range(n), w) if unique(rows, c)), ())


@pytest.mark.parametrize("seed", range(6))
def test_first_unique_is_that_of_all_combinations(spark, seed):
    r = random.Random(seed)
    n = r.randint(3, 7)
    sizes = [r.choice([2, 3, 6, 20]) for _ in range(n)]
    rows = [tuple(None if r.random() < 0.05 else str(r.randrange(s)) if i % 2 else r.randrange(s) for i, s in enumerate(sizes)) for _ in range(r.choice([30, 120]))]
    rows = list(dict.fromkeys(rows)) if seed % 3 else rows
    names = [f"c{i}" for i in range(n)]
    found = Pairs(table(spark, rows, ["string" if i % 2 else "long" for i in range(n)]).repartition(3), names).first_unique()
    assert tuple(int(c[1:]) for c in found) == first_of(rows, n)


def test_pairs_without_a_sample_and_clashing_hashes(spark, monkeypatch):
    rows = [(i // 6, i % 6 // 2, i % 2, "x") for i in range(60)]
    df = table(spark, rows, ["long", "long", "long", "string"])
    monkeypatch.setattr(Pairs, "sample", lambda self: None)
    p = Pairs(df, df.columns)
    assert p.first_unique() == ("c0", "c1", "c2") and p.seen
    assert p.undetermined(("c0", "c3"), "c1") and not p.undetermined(("c0", "c1", "c2"), "c3")
    monkeypatch.setattr(Pairs, "_hashes", lambda self, g: (F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(True)))
    clash = Pairs(df, df.columns)
    assert clash.prove([("c0", "c1", "c2"), ("c0", "c1")]) == [True, False]  # values decide


def test_wide_table_takes_few_scans_and_width_is_logged(spark, caplog):
    r = random.Random(1)
    rows = [tuple(r.randrange(4) for _ in range(38)) + (i // 50, i % 50) for i in range(1000)]
    df = table(spark, rows, ["long"] * 40)
    p = Pairs(df, df.columns)
    best = p.first_unique({f"c{i}": 4 if i < 38 else 50 for i in range(40)}, len(rows))
    assert best == ("c38", "c39") and p.scans <= 8
    with caplog.at_level(logging.WARNING):
        three = table(spark, [(i // 100, i // 10 % 10, i % 10) for i in range(1000)], ["long"] * 3)
        assert Pairs(three, three.columns).first_unique(widest=2) == () and "wider ones" in caplog.text
    evidence = profile.evidence_of(profile.profile(three, "t").collect())
    assert keys.infer_keys({"t": three}, evidence, max_width=2) == [] and len(keys.infer_keys({"t": three}, evidence)[0].columns) == 3


def test_the_first_guess_that_stands_is_proven_alone(spark, monkeypatch):
    df = table(spark, [(i, i % 7, i // 7, i % 2) for i in range(400)], ["long"] * 4)
    asked = []
    monkeypatch.setattr(Pairs, "prove", lambda self, guesses, share=1, real=Pairs.prove: asked.append((len(guesses), share)) or real(self, guesses, share))
    assert Pairs(df.drop("c0"), ["c1", "c2", "c3"]).first_unique(rows=400) == ("c1", "c2")
    assert asked[-1] == (1, 1) and sum(share == 1 for _, share in asked) == 1  # one shuffle of all keys
    assert Pairs(df.union(df), df.columns).first_unique(rows=800) == () and Pairs(df.limit(0), df.columns).rows == 0


@pytest.mark.parametrize("seed", range(4))
def test_least_grain(spark, seed):
    r = random.Random(seed)
    rows = [tuple(None if r.random() < 0.1 else r.randrange(s) for s in (3, 40, 5, 2)) for _ in range(80)]
    df = table(spark, rows, ["long"] * 4)

    def plain(at):
        if not unique(rows, at, False):
            return None
        while len(at) > 1:
            less = next((x for c in at if unique(rows, x := tuple(y for y in at if y != c), False)), None)
            if less is None:
                break
            at = less
        return at

    for at in ((0, 1, 2, 3), (1, 2), (3, 2, 1)):
        p = Pairs(df, [f"c{i}" for i in at], nulls_equal=False)
        want = plain(at)
        assert p.least([f"c{i}" for i in at]) == (want and tuple(f"c{i}" for i in want))


def test_grain_is_counted_only_where_it_fails(spark, monkeypatch):
    f = spark.createDataFrame([(i, i // 3, i % 3) for i in range(30)], "id long, a long, b long")
    counted = []
    monkeypatch.setattr(validate, "count_duplicate_grains", lambda *a, real=validate.count_duplicate_grains: counted.append(a[1]) or real(*a))
    g = validate.Grains({"f": f})
    assert g.minimal("f", ("a", "b", "id")) == ("id",) and g.minimal("f", ("a",)) is None and not counted
    assert g.duplicates("f", ("a",)) == 10 and g.duplicates("f", ("a",)) == 10 and counted == [("a",)]


def test_dependencies_of_many_determinants_by_one_scan(spark, monkeypatch):
    r = random.Random(2)
    rows = [(a := r.choice([None, 1, 2, 3]), b := r.randrange(3), None if a is None else str(a * 7), f"{a}{b}", r.choice([None, "x"]), r.random() if r.random() < 0.9 else None) for _ in range(80)]
    df = table(spark, rows, ["long", "long", "string", "string", "string", "double"])
    names = df.columns
    sets = [(x,) for x in names] + list(combinations(names, 2))
    got = {x.determinant: x for x in dependencies.dependency_sets(df, sets, names).collect()}
    for d in sets:
        at = [names.index(c) for c in d]
        by = {}
        for x in rows:
            if all(x[i] is not None for i in at):
                by.setdefault(tuple(x[i] for i in at), []).append(x)
        n = sum(map(len, by.values()))
        x = got[",".join(d)]
        assert (x.distinct, x.repeated, x.uniqueness) == (len(by), n - len(by), pytest.approx(len(by) / n if n else 1.0))
        for i, c in enumerate(names):
            assert x.violations[c] == sum(len({y[i] for y in g if y[i] is not None}) > 1 for g in by.values()), (d, c)
    with_pairs = groups.Tests(df, names)
    asked = [(d, [c for c in names if c not in d]) for d in sets]
    for (d, dep), (_, _, _, told), (_, _, _, plain) in zip(asked, with_pairs.all(asked), groups.Tests(df).all(asked)):
        assert told == plain == dependencies.determined(df, d, dep)
    monkeypatch.setattr(dependencies, "SETS", 4)
    monkeypatch.setattr(dependencies, "GROUPED", 3)
    assert groups.Tests(df).all(asked) == groups.Tests(df, names[:0]).all(asked) == [(got[",".join(d)].distinct, got[",".join(d)].uniqueness, got[",".join(d)].repeated,
                                                                                     [c for c in dep if not got[",".join(d)].violations[c]]) for d, dep in asked]
    empty = {x.determinant: x for x in dependencies.dependency_sets(df.limit(0), [("c0",)], ["c1"]).collect()}
    assert (empty["c0"].distinct, empty["c0"].uniqueness, empty["c0"].violations) == (0, 1.0, {"c1": 0})
    assert sum("Scan" in line and "Existing" in line for line in dependencies.dependency_sets(df, sets, names)._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 1


def test_determinants_of_many_values_are_grouped_one_after_another(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i // 2 if r.random() < 0.9 else None, i % 3, f"t{i % 5}", r.choice([None, "x", "y"]), r.random()) for i in range(300)]
    df = table(spark, rows, ["long", "long", "string", "string", "double"])
    sets = [(c,) for c in df.columns] + list(combinations(df.columns, 2))
    plain = sorted(map(str, dependencies.dependency_sets(df, sets, df.columns).collect()))
    alone = []
    monkeypatch.setattr(dependencies, "LARGE", 0)
    monkeypatch.setattr(dependencies, "_one_set", lambda df, d, *a, real=dependencies._one_set: alone.append(d) or real(df, d, *a))
    assert sorted(map(str, dependencies.dependency_sets(df, sets, df.columns).collect())) == plain
    assert ("c0",) in alone and ("c4",) in alone and ("c1",) not in alone and ("c1", "c2") not in alone


def test_coverage_of_all_pairs_by_one_pass(spark, monkeypatch):
    r = random.Random(3)
    tables = {t: spark.createDataFrame([(i, r.choice([None, *range(m)]), str(r.randrange(9)), i % 3) for i in range(n)], "id long, ref long, code string, part long")
              for t, n, m in (("a", 40, 60), ("b", 25, 30), ("c", 12, 500))}
    ks = [keys.make_key(profile.evidence_of(profile.profile(tables[t].select(*c), t).collect()), 1, 0.0, 1.0) for t in tables for c in (("id",), ("id", "part"), ("code",))]
    jobs = [(t, c, k) for k in ks for t in tables if t != k.table for c in (("ref",), ("id",), ("part", "id"), ("ref", "part"), ("code",))
            if len(c) == len(k.columns) and tuple(dict(tables[t].dtypes)[x] for x in c) == k.types]
    plain = [tuple(joins.coverage(tables[t], c, tables[k.table], k.columns).first()) for t, c, k in jobs]
    for sources, marks in ((48, 60), (2, 1)):
        monkeypatch.setattr(joins, "SOURCES", sources)
        monkeypatch.setattr(joins, "MARKS", marks)
        got = joins.covered(tables, jobs)
        assert [(j.rows, j.matched, j.ratio) for j in got] == plain and [(j.source, j.source_columns, j.target) for j in got] == [(t, c, k.table) for t, c, k in jobs]
    assert all(j.rows <= 5 for j in joins.covered(tables, jobs, limit=5))
    assert joins.covered(tables, []) == []


def test_stability_sums_before_the_join(spark):
    f = spark.createDataFrame([(i % 5, float(i)) for i in range(100)] + [(None, 3.0), (99, None)], "k long, x double")
    d = spark.createDataFrame([(i, f"g{i % 2}") for i in range(5)], "k long, g string")
    df = validate.stability(f, d, ("k",), ("k",), "x", "g")
    ok = df.first()
    assert ok.is_stable and (ok.fine_sum, ok.agg_count) == (4953.0, 101)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert any("Aggregate [k0" in x for x in lines[join + 1:join + 4])  # the fact's side of the join
    twice = validate.stability(f, d.union(d.filter("k = 3")), ("k",), ("k",), "x", "g").first()
    assert not twice.is_stable and twice.agg_count == 121


def test_logical_tables_with_the_rows_of_their_source_share_its_evidence(spark, tmp_path):
    from keelson.operators import logical
    from keelson.plans.pipeline import Pipeline
    from test_data import SHOP, write

    for name, text in SHOP.items():
        write(tmp_path / "shop" / f"{name}.csv", text)
    p = Pipeline.from_folder(spark, str(tmp_path / "shop")).run()
    flat = p._flat(p.logical_evidence)
    assert p.like and any(x.distinct for x in p.plans if x.name in p.like)
    for t in p.like:
        assert p.logical[t].count() == p.sources[p.like[t]].count() == (p.logical[t].distinct().count() if next(x for x in p.plans if x.name == t).distinct else p.logical[t].count())
        assert sorted(profile.evidence_of(profile.profile(p.logical[t], t).collect()), key=lambda c: c.column) == p.logical_evidence[t]
    determinants = {x.name: x.determinants for x in p.plans if x.role == logical.DIMENSION}
    assert keys.logical_keys(p.logical, flat, determinants) == p.official and joins.discover(p.logical, flat, p.official) == p.links
    plain = {m.id: validate.structure(m, p.logical, {}) for m in p.models}
    assert plain == p.structure
    p.close()


def test_parquet_tables_are_not_copied_to_the_cache(spark):
    from keelson.plans import catalogue

    p = catalogue._analysis(spark, "/root/testdata/sf0.001")
    assert p._hold(p.sources["nation"]) is p.sources["nation"] and not p.kept


# -- evidence and catalog ---------------------------------------------------

def test_store_swaps_scopes_and_keeps_history(spark, tmp_path):
    from keelson.sources.evidence import Store

    key = {"table": "t", "columns": ("a",), "types": ("long",), "kinds": ("integer",), "rows": 1}
    for root in (str(tmp_path / "e"), None):
        s = Store(spark, root)
        s.put_records("primary_keys", [key | {"scope": "SOURCE"}], "SOURCE")
        s.put_records("primary_keys", [key | {"scope": "LOGICAL"}] * 2, "LOGICAL")
        s.put_records("primary_keys", [key | {"scope": "SOURCE", "rows": 5}], "SOURCE")
        assert sorted((r.scope, r.rows) for r in s.get("primary_keys").collect()) == [("LOGICAL", 1), ("LOGICAL", 1), ("SOURCE", 5)]
        s.put("primary_keys", s.get("primary_keys", "SOURCE").withColumn("rows", F.col("rows") + 1), "SOURCE")  # read from where it is written
        assert [r.rows for r in s.get("primary_keys", "SOURCE").collect()] == [6]
        if root:
            with pytest.raises(Exception):
                s.put("primary_keys", spark.range(3).select(F.raise_error(F.lit("no")).alias("rows")), "SOURCE")
            assert [r.rows for r in Store(spark, root).get("primary_keys", "SOURCE").collect()] == [6]
        runs = lambda ts, n: spark.createDataFrame([("SOURCE", ts, "t", n)], "scope string, run_ts long, table_name string, n int")
        s.put("column_profiles", runs(1, 10), "SOURCE"), s.put("column_profiles", runs(2, 20), "SOURCE")
        assert [r.n for r in s.get("column_profiles").collect()] == [20]  # the latest run
        s.clear(scope="SOURCE")
        assert not s.has("column_profiles") and not s.has("primary_keys", "SOURCE") and s.get("primary_keys").count() == 2
        s.clear()
        with pytest.raises(ValueError):
            s.get("primary_keys")


def test_commands_start_from_what_is_stored(spark, tmp_path, monkeypatch, capsys):
    from keelson import __main__ as cli
    from keelson.plans import pipeline
    from test_data import SHOP, write

    for name, text in SHOP.items():
        write(tmp_path / "shop" / f"{name}.csv", text)
    folder, store = str(tmp_path / "shop"), str(tmp_path / "evidence")
    first = cli.main(["infer-pk", folder, "--store", store], spark)
    plain = cli.main(["infer-joins", folder], spark)
    calls = []
    for module, name in ((pipeline.profile, "profile_all"), (pipeline.keys, "infer_keys"), (pipeline.keys, "logical_keys"), (pipeline.groups, "build"), (pipeline.logical, "plans"), (pipeline.joins, "discover")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: calls.append(n) or f(*a, **k))
    assert cli.main(["infer-joins", folder, "--store", store], spark) == plain and calls == ["discover"]
    assert cli.main(["infer-pk", folder, "--store", store], spark) == first and calls == ["discover"]
    again = cli.main(["build-adjacency", folder, "--store", store], spark)
    assert calls == ["discover"] and any(x.startswith("T1 ") for x in again["matrix"]) and again["edges"]
    write(tmp_path / "shop" / "days.csv", SHOP["days"].replace("month_name", "month_label"))  # other columns: all anew
    cli.main(["infer-pk", folder, "--store", store], spark)
    assert calls.count("profile_all") == 2 and "infer_keys" in calls
    cli.main(["clear", store, "--scope", "LOGICAL"], spark)
    del calls[:]
    cli.main(["infer-source-keys", folder, "--store", store], spark)
    assert calls == []
    capsys.readouterr()


def test_views_of_the_catalog_outlive_the_session(spark, tmp_path):
    from keelson.plans.pipeline import Pipeline
    from keelson.sources import catalog
    from test_data import SHOP, write

    for name, text in SHOP.items():
        write(tmp_path / "shop" / f"{name}.csv", text)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/db'")
    try:
        for t, df in Pipeline.from_folder(spark, str(tmp_path / "shop")).sources.items():
            df.withColumn("nested", F.array(F.lit(1))).write.saveAsTable(f"shop.{t}")
        p = Pipeline.from_catalog(spark, "shop").run()
        assert sorted(p.sources) == sorted(SHOP) and "nested" not in p.sources["sales"].columns
        lasting = p.create_views("shop")
        p.close()
        (name, view), = lasting.items()
        other = spark.newSession()
        assert sorted(map(str, other.table(f"shop.{name}").collect())) == sorted(map(str, next(iter(p.create_views().values())).collect())) != []
        assert catalog.source_tables(other, "shop") == sorted(SHOP)  # logical tables and views are not sources
        assert ("sales", "sale_id", "bigint") in catalog.columns(other, "shop") and not any(c == "nested" for _, c, _ in catalog.columns(other, "shop"))
    finally:
        spark.sql("DROP DATABASE shop CASCADE")
