"""Rules over names, shapes, edges, roles and models: no data is scanned."""

import pytest

from keelson.functions import names, shapes
from keelson.functions.similarity import common_subsequence, hybrid, name_similarity
from keelson.operators import certify, graph, groups, keys, logical, models, structure, validate, views
from keelson.types import ColumnEvidence, Edge, Group, Join, Key, Model, Role, Structure


def col(name, table="t", **more):
    base = dict(rows=100, distinct=10, uniqueness=0.1, identifiability=0.5)
    return ColumnEvidence(table, name, **(base | more))


def key(table, *columns, kinds=None, ident=0.9):
    return Key(table, columns, ("bigint",) * len(columns), kinds or ("integer",) * len(columns), 10, 0.0, 1.0, ident, 0.9)


def edge(a, b, c="k", depth=1, ratio=1.0):
    return Edge(a, b, (c,), (c,), ratio, 1.0, 1.0, "CONFIRMED", depth)


@pytest.mark.parametrize("name,expected", [
    ("customer_id", ("customer", "id")), ("CustomerID", ("customer", "id")), ("orderNo", ("order", "no")), ("Sub-Category name", ("sub", "category", "name")), ("", ()), (None, ())])
def test_tokens(name, expected):
    assert names.tokens(name) == expected


@pytest.mark.parametrize("rule,yes,no", [
    (names.key_like, ["id", "customer_id", "ProductKey", "SALESORDERID", "invoice_no", "country_code"], ["valid", "rapid", "monkey", "paid", None]),
    (names.measure_like, ["amount", "unit_price", "corporate", "NETAMOUNT"], ["city", "name", None]),
    (names.grain_like, ["line_number", "SALESORDERITEM", "payment_sequence"], ["online", "name", None]),
    (names.time_like, ["order_date", "DELIVERYDATE", "CREATEDAT", "year"], ["update", "yearly", None]),
    (names.place_like, ["city", "postal_code", "ShipCountry"], ["capacity", None])])
def test_name_rules(rule, yes, no):
    assert all(map(rule, yes)) and not any(map(rule, no))


def test_concepts():
    assert names.same_concept("customer_id", "id") and names.same_concept("ship_customer_id", "customer_key")
    assert not names.same_concept("customer_id", "product_id")
    assert names.describes("customer_id", "segment") and names.describes("postal_code", "city") and not names.describes("product_id", "segment")
    assert names.yearly_parts("sales_2020", "sales_2021") and not names.yearly_parts("sales_2020", "sales") and not names.yearly_parts("a_2020", "b_2021")


def test_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    every = ["customer_id", "CustomerID", "SALESORDERITEM", "DELIVERYDATE", "CREATEDAT", "orderNo", "unit price", "city", "", "A", "ship-customer_id", "ID", None]
    n = F.col("n")
    rows = spark.createDataFrame([(x,) for x in every], "n string").select(
        "n", names.tokens_col(n).alias("t"), names.key_like_col(n).alias("k"), names.measure_like_col(n).alias("m"), names.grain_like_col(n).alias("g"),
        names.time_like_col(n).alias("d"), names.place_like_col(n).alias("p"), names.same_concept_col(n, F.lit("customer_id")).alias("s")).collect()
    for r in rows:
        assert tuple(r.t) == names.tokens(r.n)
        assert (r.k, r.m, r.g, r.d, r.p, r.s) == (names.key_like(r.n), names.measure_like(r.n), names.grain_like(r.n), names.time_like(r.n), names.place_like(r.n),
                                                 names.same_concept(r.n, "customer_id")), r.n


def test_similarity():
    assert common_subsequence("kitten", "sitting") == 4 and common_subsequence("", "a") == 0
    assert name_similarity("customer_id", "customer_key") == 1.0 and name_similarity("id", "customer_id") == 0.0 and name_similarity("id", "key") == 1.0
    assert name_similarity("cust", "customer") == round(8 / 12, 4)
    assert hybrid(1.0, [1.0]) == (1.0, 1.0, "CONFIRMED") and hybrid(1.0, [0.0])[1:] == (0.34, "COINCIDENCE") and hybrid(0.5, [0.0])[2] == "WEAK"


def test_shapes():
    revenue = col("revenue", kind="continuous", distinct=80, uniqueness=0.8, entropy_ratio=0.9, variation=0.4)
    assert shapes.is_measure(revenue) and not shapes.is_grain(revenue) and not shapes.is_descriptive(revenue)
    assert shapes.measure_score(revenue) == pytest.approx(0.3 + 0.03 + 0.18 + 0.12 + 0.1 + 0.15)
    assert shapes.is_grain(col("order_id", kind="integer")) and shapes.is_lookup_key(col("order_id", kind="integer"))
    assert shapes.is_descriptive(col("segment")) and not shapes.is_descriptive(col("name", uniqueness=1.0))
    assert shapes.measure_score(col("count", kind="integer", distinct=1)) == 0


def test_key_ranking():
    one, two, text = key("t", "id"), key("t", "a", "b"), key("t", "name", kinds=("text",))
    assert keys.ranked([two, text, one]) == [one, text, two]
    assert keys.best_by_table([two, one])["t"] == one and keys.tables_without([one], ["t", "u"]) == ["u"]
    found = keys.simple_keys([col("id", kind="integer", distinct=100, uniqueness=1.0), col("x", kind="continuous", distinct=100, uniqueness=1.0),
                              col("n", distinct=99, uniqueness=1.0, null_rows=1)])
    assert [k.columns for k in found] == [("id",)]


def test_structures():
    j = Join("sales", ("customer_id",), "customers", ("customer_id",), 5, 5, 1.0)
    s = structure.structures(["sales", "customers"], [key("customers", "customer_id"), key("customers", "customer_name", ident=1.0), key("sales", "sale_id")], [j, j])
    assert s["customers"].key.columns == ("customer_id",) and s["customers"].normalized and s["customers"].sources == 1
    assert s["sales"].targets == 1 and not s["sales"].normalized and len(s["sales"].outgoing) == 1


def test_logical_plans():
    sales = [col("client_id", "s", kind="integer"), col("client_name", "s"), col("invoice_no", "s", kind="integer"), col("amount", "s", kind="continuous", uniqueness=.2, entropy_ratio=.5, variation=.5)]
    g = Group("s", "logical_s_client_id", ("client_id",), ("client_name",), 0.8, "", groups.CANDIDATE, uniqueness=.1)
    plans = {p.name: p for p in logical.plans([g], {"s": sales}, {})}
    assert plans["logical_s_client_id"].distinct and plans["logical_s_fact"].columns == ("client_id", "invoice_no", "amount")
    kept = logical.plans([], {"notes": [col("note", "notes")]}, {})
    assert kept[0].role == logical.UNKNOWN and kept[0].columns == ("note",)
    entity = Structure("o", key("o", "order_id"), (Join("i", ("order_id",), "o", ("order_id",), 1, 1, 1.0),))
    g = Group("o", "logical_o_order_id", ("order_id",), ("status",), 1.0, "", groups.NORMALIZED)
    assert logical.is_dimension(g, {"order_id": col("order_id", "o", uniqueness=1.0), "status": col("status", "o")}, entity)


@pytest.mark.parametrize("given,role", [
    (dict(rows=9, outgoing=0, incoming=0, has_key=True, numeric=3, text=0), "ISOLATED"),
    (dict(rows=2, outgoing=1, incoming=0, has_key=True, numeric=1, text=5, measures=1, grain=True), "FACT"),
    (dict(rows=9, outgoing=2, incoming=0, has_key=False, numeric=3, text=1), "FACT"),
    (dict(rows=9, outgoing=2, incoming=0, has_key=False, numeric=3, text=1, measures=0), "UNKNOWN"),
    (dict(rows=9, outgoing=1, incoming=0, has_key=True, numeric=3, text=1, measures=1), "FACT"),
    (dict(rows=9, outgoing=1, incoming=0, has_key=True, numeric=1, text=1, measures=0), "DIMENSION"),
    (dict(rows=9, outgoing=0, incoming=1, has_key=True, numeric=3, text=1, measures=0), "DIMENSION"),
    (dict(rows=9, outgoing=0, incoming=1, has_key=False, numeric=3, text=1, measures=0), "UNKNOWN")])
def test_roles(spark, given, role):
    row = dict(measures=None, grain=False) | given
    table = spark.createDataFrame([tuple(row[k] for k in sorted(row))], ", ".join(f"{k} {'boolean' if k in ('grain', 'has_key') else 'long'}" for k in sorted(row)))
    assert graph.role_columns(table).first().role == role


def test_additive_measures_of_records_and_rows_agree(spark):
    cases = [col(n, "t", kind=k, uniqueness=u, distinct=d, entropy_ratio=e, variation=v) for n in ("amount", "client_id") for k in ("integer", "continuous", "text")
             for u in (0.2, 0.99) for d in (1, 9) for e in (0.0, 0.2) for v in (0.0, 0.3)]
    rows = spark.createDataFrame([(i, c.column, c.kind, c.distinct, c.uniqueness, c.entropy_ratio, c.variation) for i, c in enumerate(cases)],
                                 "i long, column_name string, kind string, distinct_count long, uniqueness_ratio double, entropy_ratio double, variation_coefficient double")
    got = {r.i: r.yes for r in rows.select("i", graph.additive_column().alias("yes")).collect()}
    assert got == {i: graph.additive_measure(c) for i, c in enumerate(cases)}


def test_models_and_scores():
    roles = [Role("f", "FACT", 1, ""), Role("g", "FACT", 1, ""), Role("d", "DIMENSION", 1, ""), Role("e", "DIMENSION", 1, ""), Role("h", "DIMENSION", 1, "")]
    b = models.Builder(roles, [edge("f", "d"), edge("g", "d"), edge("d", "e"), edge("e", "h"), edge("f", "g")], {})
    assert [(m.facts, m.dimensions) for m in b.stars()] == [(("f",), ("d",)), (("g",), ("d",))]
    assert [m.dimensions for m in b.snowflakes()] == [("d", "e"), ("d", "e")]
    (c,) = b.constellation()
    assert c.facts == ("f", "g") and c.dimensions == ("d", "e", "h") and {e.target: e.depth for e in c.edges} == {"d": 1, "e": 2, "h": 3}
    ranked = models.ranked(b.build())
    assert ranked[0].kind == "CONSTELLATION" and ranked[0].score == 1.0 and ranked[-1].score == 0.0
    assert models.raw_score(c) == round(-5 + 24 + 30 + 15 + 30, 2)
    with pytest.raises(ValueError):
        models.Builder([], [], {})


def test_topology():
    assert validate.cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [("a", "b", "c", "a")]
    assert validate.cycles([(str(i), str(i + 1)) for i in range(5000)]) == []
    m = Model("STAR", ("f",), ("d",), (edge("f", "d"), edge("f", "f"), edge("d", "x")))
    assert sorted(i.rule for i in validate.topology(m)) == ["NO_CYCLE", "NO_SELF_LOOP", "STAR_DIRECT_TO_DIMENSION", "STAR_DIRECT_TO_DIMENSION"]


def test_homogeneity_and_choices():
    odd = col("spread", kind="continuous", entropy_ratio=1.0, variation=1.0, skewness=3.0)
    assert validate.impurity(odd) > 0.7 and not validate.homogeneity(Role("d", "DIMENSION", 1, ""), [odd], set())["columns"]
    bad = validate.homogeneity(Role("f", "FACT", 1, ""), [col("client_name"), col("status_id"), col("order_status")], {"order_status"})
    assert bad["columns"] == ["client_name"] and bad["homogeneity_score"] == 0.8
    assert validate.homogeneity(Role("x", "ISOLATED", 1, ""), [], set()) is None
    assert validate.best_measure([col("a", kind="integer", variation=.2), col("b", kind="integer", variation=.3), col("c_id", kind="integer", variation=.9)]) == "b"
    assert validate.best_grouping([col("n", kind="integer", entropy_ratio=.01), col("segment", entropy_ratio=.5), col("city", entropy_ratio=.3)]) == "city"


def test_certification():
    I = validate.Issue  # noqa: E741
    assert certify.status_of([]) == "VALID" and certify.score_of([I("a", "ERROR", ""), I("b", "WARNING", "")]) == 55.0
    assert certify.score_of([I("a", "ERROR", "")] * 4) == 0.0
    m = Model("STAR", ("f",), ("d",), (edge("f", "d"),), coverage=0.5, covered_facts=1, total_facts=2, id="m")
    rules = [i.rule for i in certify.issues_of(m, 1.0, None, None, {}, None)]
    assert rules == ["MODEL_COVERAGE", "STRUCTURAL_VALIDATION", "DETERMINISTIC_GRANULARITY", "SEMANTIC_HOMOGENEITY", "SEMANTIC_HOMOGENEITY", "AGGREGATION_STABILITY"]
    with pytest.raises(ValueError):
        views.best_certified([{"status": "INVALID"}])


def test_view_edges():
    m = Model("SNOWFLAKE", ("f",), ("d", "e"), (edge("f", "d"), edge("d", "e", depth=2), edge("x", "y", depth=2), edge("f", "d", c="other", ratio=0.97)))
    assert [(e.source, e.target, e.source_columns) for e in views.edges_for(m, "f")] == [("f", "d", ("k",)), ("d", "e", ("k",))]
