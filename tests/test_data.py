"""Data operators on small tables worked out by hand."""

import math

import pytest

from keelson.operators import dependencies, joins, keys, profile, validate, views
from keelson.plans.pipeline import Pipeline
from keelson.sources import csv_folder
from keelson.sources.evidence import Store, latest_run
from keelson.types import Edge


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", 1.0, [1]), (2, "a", 2.0, [2]), (2, "b", 10.0, [3]), (None, None, None, None)], "k long, v string, x double, nested array<int>")


def test_profile(spark, t):
    rows = {r.column_name: r for r in profile.profile(t, "t").collect()}
    assert set(rows) == {"k", "v", "x"}
    k = rows["k"]
    assert (k.rows, k.non_null_rows, k.null_rows, k.null_ratio, k.distinct_count, k.uniqueness_ratio, k.min_value, k.max_value) == (4, 3, 1, 0.25, 2, 0.666667, "1", "2")
    h = -(1 / 3 * math.log2(1 / 3) + 2 / 3 * math.log2(2 / 3))
    assert k.entropy == pytest.approx(h, abs=1e-6) and k.entropy_ratio == pytest.approx(h / math.log2(3), abs=1e-6)
    m = 13 / 3
    s = math.sqrt(((1 - m) ** 2 + (2 - m) ** 2 + (10 - m) ** 2) / 3)
    skew = sum(((v - m) / s) ** 3 for v in (1, 2, 10)) / 3
    x = rows["x"]
    assert x.variation_coefficient == pytest.approx(s / m / (1 + s / m), abs=1e-6) and x.skewness_score == pytest.approx(skew / (1 + skew), abs=1e-6)
    assert rows["v"].variation_coefficient == 0 and rows["v"].identifiability_score == pytest.approx(0.5 * 2 / 4 + 0.3 * rows["v"].entropy_ratio + 0.2 * 0.75, abs=1e-5)
    again = {r.column_name: r for r in profile.profile_all(spark, {"t": t}).collect()}
    assert again == rows


def test_profile_of_nothing(spark):
    r = profile.profile(spark.createDataFrame([], "a long, b string"), "e").collect()
    assert [(x.rows, x.distinct_count, x.uniqueness_ratio, x.entropy, x.min_value) for x in r] == [(0, 0, 0.0, 0.0, "")] * 2
    one = profile.profile(spark.createDataFrame([(5.0,)] * 3, "a double"), "c").first()
    assert (one.entropy, one.entropy_ratio, one.variation_coefficient, one.skewness_score) == (0.0, 0.0, 0.0, 0.0)


def test_uniqueness_and_shapes(spark, t):
    assert dependencies.is_unique(t, ["k", "v"]) and not dependencies.is_unique(t, ["k"])
    assert not dependencies.is_unique(spark.createDataFrame([(None,), (None,)], "a long"), ["a"])  # nulls are equal
    shape = dependencies.key_shape(t, "t", [("k", "v"), ("k",)]).collect()
    assert [(s.rows, s.null_ratio, s.uniqueness_ratio) for s in shape] == [(4, 0.25, 1.0), (4, 0.25, 0.75)]
    assert tuple(dependencies.determinant_shape(t, ("k",)).first()) == (2, pytest.approx(2 / 3), 1)
    assert tuple(dependencies.determinant_shape(t.filter("false"), ("k",)).first()) == (0, 1.0, 0)


def test_dependencies(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", "p"), (2, "y", "q"), (2, "z", "q"), (None, "w", "r")], "d long, bad string, good string")
    assert {r.dependent: r.violations for r in dependencies.dependency_test(df, ("d",), ["bad", "good"]).collect()} == {"bad": 1, "good": 0}
    assert dependencies.determined(df, ("d",), ["bad", "good"]) == ["good"] and dependencies.determined(df, ("d",), ["bad"], 1) == ["bad"]


def test_composite_key(spark):
    df = spark.createDataFrame([(i // 4, i % 4, i % 3, 0) for i in range(24)], "a long, b long, c long, same long")
    found = keys.composite_keys({"t": df}, profile.evidence_of(profile.profile(df, "t").collect()), ["t"])
    assert [set(k.columns) for k in found] == [{"a", "b"}]
    none = spark.createDataFrame([(1, 1), (1, 1)], "a long, b long")
    assert keys.composite_keys({"n": none}, profile.evidence_of(profile.profile(none, "n").collect()), ["n"]) == []


def test_joins(spark):
    s = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "fk long")
    d = spark.createDataFrame([(1,), (2,), (3,), (None,)], "pk long")
    assert tuple(joins.coverage(s, ("fk",), d, ("pk",)).first()) == (4, 3, 0.75)
    assert tuple(joins.coverage(s.filter("false"), ("fk",), d, ("pk",)).first()) == (0, 0, 0.0)
    assert [r[0] for r in joins.orphans(s, ("fk",), d, ("pk",)).collect()] == [9]
    k = keys.make_key(profile.evidence_of(profile.profile(d.dropna(), "d").collect()), 3, 0.0, 1.0)
    assert joins.evaluate({"s": s, "d": d}, "s", ("fk",), k).ratio == 0.75
    with pytest.raises(ValueError):
        joins.evaluate_named({"s": s, "d": d}, [k], "s", ("fk",), "d", ("nope",))


def test_grain_and_stability(spark):
    f = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, None, 4.0), (2, None, 5.0), (7, 3, None)], "c long, l long, x double")
    assert validate.count_duplicate_grains(f, ("c", "l")).first()[0] == 0 and validate.count_duplicate_grains(f, ("c",)).first()[0] == 2
    assert validate.Grains({"f": f}).minimal("f", ("c", "l")) == ("l",)
    d = spark.createDataFrame([(1, "g"), (2, "h")], "c long, s string")
    ok = validate.stability(f, d, ("c",), ("c",), "x", "s").first()
    assert ok.is_stable and (ok.fine_sum, ok.agg_count, ok.agg_min, ok.agg_max) == (14.0, 4, 2.0, 5.0)
    fan = validate.stability(f, d.union(d), ("c",), ("c",), "x", "s").first()
    assert not fan.is_stable and fan.reason == "sum differs, count differs"


def test_view(spark):
    f = spark.createDataFrame([(1, 10), (2, 99)], "id long, d_id long")
    d = spark.createDataFrame([(10, "x")], "d_id long, name string")
    v = views.build_view({"f": f, "d": d}, "f", [Edge("f", "d", ("d_id",), ("d_id",), 1.0), Edge("f", "d", ("id",), ("d_id",), 1.0)])
    assert v.columns == ["fact_d_id", "fact_id", "d_d_id", "d_name"]
    assert sorted((r.fact_id, r.d_name) for r in v.collect()) == [(1, "x"), (2, None)]


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def test_csv_looks(spark, tmp_path):
    known = lambda name, *args: csv_folder.detect_encoding(spark, write(tmp_path / name, *args))
    assert [known(f"{e}.csv", "ab\né", e) for e in ("cp1252", "utf-16", "utf-8-sig")] == ["cp1252", "utf-16", "utf-8-sig"]
    assert known("u.csv", "é€") == "utf-8-sig" and known("l.csv", "a\x81\né", "latin-1") == "latin-1" and known("none.csv", "") == "utf-8-sig"
    spans = lambda text: csv_folder.look_at_lines(spark, write(tmp_path / "q.csv", text)).spans
    assert spans('a,b\n"x\ny",1\n') and not spans('a,b\n"x""é",1\n"",2\n')
    assert csv_folder.detect_delimiter("key;town;rank\n7;Ulm;2\n") == ";"
    assert csv_folder.steadiest_delimiter('key;town;rank\n7;"Ulm,W";2\n8;a,b,c;3\n') == ";"
    assert [csv_folder.clean_identifier(x) for x in ("Unit price", "4th floor", "x.y", None)] == ["Unit_price", "col_4th_floor", "x_y", "column"]
    assert csv_folder.dedupe(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert csv_folder.table_name("tickets/p1.csv") == "tickets" and csv_folder.table_name("data/p1.csv") == "p1"


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252", "utf-16"])
def test_csv_table(spark, tmp_path, encoding):
    p = write(tmp_path / "x.csv", 'id;when;"q;q";note\n1;2024-01-31;1,5;"a\nb"\n---;---;---;---\n2;1/2/2024;null;é\n3;2024-02-03\nSource: x;;;\n', encoding)
    df, types = csv_folder.read_table(spark, [p])
    assert types == {"id": "long", "when": "date", "q_q": "double", "note": "string"}
    assert sorted((r.id, str(r.when), r.q_q, r.note) for r in df.collect()) == [(1, "2024-01-31", 1.5, "a\nb"), (2, "2024-02-01", None, "é"), (3, "2024-02-03", None, None)]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        csv_folder.read_table(spark, [write(tmp_path / "long.csv", "a,b\n1,2,3\n")])
    with pytest.raises(Exception):
        csv_folder.import_file(spark, write(tmp_path / "e.csv", ""), str(tmp_path / "out"))
    ok = write(tmp_path / "ok.csv", "a,b\n1,2\n")
    assert csv_folder.import_file(spark, ok, str(tmp_path / "t"), "replace")["rows"] == 1
    csv_folder.import_file(spark, ok, str(tmp_path / "t"), "append")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(Exception):
        csv_folder.import_file(spark, ok, str(tmp_path / "t"), "fail")


def test_csv_without_line_breaks_in_values(spark, tmp_path):
    p = write(tmp_path / "x.csv", 'a;b\n1;"x;""€"""\n\n2;é\n--;--\n', "cp1252")
    df, types, facts = csv_folder.read_files(spark, [p])
    assert not csv_folder.layout(spark, p).spans and types == {"a": "long", "b": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, 'x;"€"'), (2, "é")]
    assert facts == {"skipped_dirty_rows": 1, "encoding": "cp1252", "delimiter": ";"}


def test_csv_rules_and_history(spark, tmp_path):
    rules = csv_folder.Rules(null_tokens=("", "?"), dates=(r"^(?<d>\d+)[.](?<m>\d+)[.](?<y>\d{4})$",))
    df, types = csv_folder.read_table(spark, [write(tmp_path / "r.csv", "d,n\n3.2.2024,?\n4.2.2024,null\n")], rules=rules)
    assert types == {"d": "date", "n": "string"} and sorted(map(str, (r.d for r in df.collect()))) == ["2024-02-03", "2024-02-04"]
    folder = tmp_path / "in"
    write(folder / "a.csv", "k\n1\n--\n2\n"), write(folder / "b.csv", "k\n1,2\n")
    store = Store(spark, str(tmp_path / "evidence"))
    with pytest.raises(ValueError):
        csv_folder.import_folder(spark, str(folder), str(tmp_path / "out"), store)
    runs = sorted(Store(spark, str(tmp_path / "evidence")).get("ingestion_runs").collect(), key=lambda r: r.run_ts)
    assert [(r.status, r.rows, r.skipped_dirty_rows, bool(r.error)) for r in runs] == [("success", 2, 1, False), ("failed", 0, 0, True)]
    store.clear("ingestion_runs")
    with pytest.raises(ValueError):
        store.get("ingestion_runs")


def test_csv_errors_name_their_line(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")  # several splits
    try:
        p = write(tmp_path / "n.csv", "a;b\n" + "".join(f"{i};x{i}\n" + "--;--\n" * (i % 9 == 0) for i in range(60)) + "7;é;more\n8;y\n", "cp1252")
        assert [tuple(r) for r in csv_folder.numbered_lines(spark, p).filter("line in (1, 2, 3, 40)").orderBy("line").collect()] == [(1, "a;b"), (2, "0;x0"), (3, "--;--"), (40, "34;x34")]
        with pytest.raises(ValueError, match=r"n\.csv, line 69: more values.*'b': 'é'"):
            csv_folder.read_table(spark, [p])
        late = write(tmp_path / "late.csv", "k,d\n" + "".join(f"{i},2024-01-0{i % 9 + 1}\n" for i in range(50)) + "51,soon\n")
        with pytest.raises(ValueError, match=r"late\.csv, line 52, column d: 'soon' is no non-null date"):
            csv_folder.read_files(spark, [late], sample_size=10)
        spans = write(tmp_path / "s.csv", 'k,d\n1,"x\ny"\n2,z\n3,z,4\n')
        with pytest.raises(ValueError, match="row 3: more values"):
            csv_folder.read_table(spark, [spans])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_review_is_a_result(spark, tmp_path):
    write(tmp_path / "in/a.csv", "k\n1\nx\n3\n"), write(tmp_path / "in/b.csv", "k\n1\n2\n")
    store = Store(spark, str(tmp_path / "evidence"))
    runs = csv_folder.import_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), store, sample_size=1)
    assert [r["status"] for r in runs] == ["needs_human_review", "success"] and not (tmp_path / "out/a").exists()
    assert {r.status for r in store.get("ingestion_runs").collect()} == {"needs_human_review", "success"}


def test_csv_folder_takes_a_job_for_each_way_of_writing(spark, tmp_path):
    for i in range(40):
        write(tmp_path / f"t {i:02d}.csv", f"id{i};when\n{i};2024-01-31\n--;--\n{i + 1};\n" if i % 2 else f'id,"no te"\n{i},"a\nb"\n', "cp1252" if i % 2 else "utf-8")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many", "many")
    counts = csv_folder.survey(spark, [f"{tmp_path}/{p}" for p in csv_folder.csv_files(spark, tmp_path)])
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(counts) == 40 and len(tracker.getJobIdsForGroup("many")) < 12
    tables = csv_folder.read_folder(spark, tmp_path)
    assert len(tables) == 40 and [tuple(r) for r in tables["t_04"].collect()] == [(4, "a\nb")]
    assert tables["t_05"].dtypes == [("id5", "bigint"), ("when", "date")] and tables["t_05"].count() == 2


def test_latest_run(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (1, "b", 7)], "run_ts long, table_name string, x int")
    assert sorted(map(tuple, latest_run(df, "table_name").collect())) == [(1, "b", 7), (2, "a", 6)]
    assert dependencies.unique_only(df, [("x",), ("run_ts",), ("run_ts", "table_name")]) == [("x",), ("run_ts", "table_name")]


SHOP = {
    "sales": "sale_id;customer_id;product_id;day_id;quantity;revenue\n" + "\n".join(f"{1000 + i};{i % 4 + 1};{i % 3 + 10};2026-01-0{i % 5 + 1};{i % 3 + 1};{10.5 + i * i % 7}" for i in range(12)),
    "customers": "customer_id;customer_name;segment\n1;Ann;retail\n2;Bob;retail\n3;Cid;pro\n4;Dee;pro",
    "products": "product_id;product_name;category\n10;Pen;office\n11;Ink;office\n12;Cup;home",
    "days": "day_id;month_name\n" + "\n".join(f"2026-01-0{i};January" for i in range(1, 6)),
}


def test_whole_run(spark, tmp_path):
    for name, text in SHOP.items():
        write(tmp_path / f"shop/{name}.csv", text)
    p = Pipeline.from_folder(spark, str(tmp_path / "shop"), store=Store(spark, str(tmp_path / "evidence"))).run()
    assert {r.table: r.role for r in p.roles} == {"logical_sales_fact": "FACT", "logical_customers_customer_id": "DIMENSION",
                                                   "logical_products_product_id": "DIMENSION", "logical_days_day_id": "DIMENSION"}
    assert [(c["model_type"], c["status"], c["certification_score"]) for c in p.certifications] == [("STAR", "VALID", 100.0)]
    (view,) = p.create_views().values()
    assert view.count() == 12 and "logical_customers_customer_id_segment" in view.columns
    rep = p.write_report(str(tmp_path / "out/report.json"))
    assert rep["best_model"]["passed_rules"] and (tmp_path / "out/report.mmd").read_text().startswith("erDiagram")
    assert p.evaluate_join("sales", ("customer_id",), "customers", ("customer_id",)).ratio == 1.0
    assert p.store.get("roles").count() == 4 and spark.read.parquet(str(tmp_path / "evidence/grains")).first().grain_columns == ["sale_id"]
    p.close()


def test_entry_point(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and e.entry(spark).count() == 11


def test_registered_queries_call_their_operators(spark, tmp_path, monkeypatch):
    from keelson.plans import catalogue

    spark.createDataFrame([(1, "b", "t", 3), (2, "b", "t", 4)], "p_partkey long, p_brand string, p_type string, p_new int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "n")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 2, 3, 1, 4.0, 5.0)] * 2, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    called = []
    for module, name in ((catalogue.logical, "materialize"), (catalogue.report, "coverage")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: called.append(n) or f(*a))
    run = lambda q: sorted(map(tuple, catalogue.QUERIES[q](spark, str(tmp_path)).collect()))
    assert run("logical_dimension_part") == [("b", "t")] and run("logical_fact_lineitem") == [(1, 2, 3, 4.0, 5.0)] * 2
    assert run("model_coverage") == [("nation", "n_nationkey"), ("part", "p_new"), ("part", "p_partkey")]
    assert called == ["materialize", "materialize", "coverage"]


def test_keys_and_joins_of_the_fact_table(spark):
    from keelson.plans import catalogue

    run = lambda q: list(map(tuple, catalogue.QUERIES[q](spark, "/root/testdata/sf0.001").collect()))
    assert {x[1] for x in run("key_ranking")} == set(catalogue.STAR)
    assert {("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")} <= {(x[0], x[2]) for x in run("join_discovery")}
    assert {("lineitem", "order_key"), ("lineitem", "part_key"), ("lineitem", "supplier_key")} <= set(run("fk_prefilter_star"))
