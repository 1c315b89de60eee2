import json
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.functions import similar, text
from starloom.operators import aggregate, audit, cdc, dedup, dims, fact, late, lookup, scd, screens, survivorship
from starloom.operators.components import components
from starloom.operators.dedup import scored_pairs
from starloom.operators.screens import Rule
from starloom.operators.standardize import ENTITY_TRANSFORMS, geography, standardize
from starloom.operators.surrogate import KeySequence, assign_keys
from starloom.sources.sinks import DimensionStore, PublishError, insert_ignore_jdbc, write_jdbc
from starloom.sources.readers import max_key, read_csv, read_jdbc


# ---- change data capture

def test_crc_counts_nulls_and_order(spark):
    df = spark.createDataFrame([("A", None), ("A", "nan")], "a string, b string")
    assert len({r[0] for r in df.select(cdc.row_crc(["a", "b"])).collect()}) == 1
    assert df.select(cdc.row_crc(["a", "b"]) == cdc.row_crc(["b", "a"])).first()[0] is False


def test_diff_without_old_is_all_inserts(spark):
    new = spark.createDataFrame([("A1", "HCM"), ("A2", "HN")], "id string, city string")
    assert [r.change_type for r in cdc.diff(None, new, ["id"]).collect()] == ["insert", "insert"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.sampled_from(["x", "y", None])), st.dictionaries(st.integers(0, 9), st.sampled_from(["x", "y", None])))
def test_applying_the_difference_gives_the_new_table(spark, rows, a, b):
    kind = "id int, v string"
    old, new = spark.createDataFrame(list(a.items()), kind), spark.createDataFrame(list(b.items()), kind)
    assert rows(cdc.apply_changes(old, cdc.diff(old, new, ["id"]), ["id"])) == rows(new)


# ---- screens

def found(df, *rules, key=None, references=None):
    return screens.violations(screens.screen(df, list(rules), key, references)).collect()


def test_column_screens(spark):
    df = spark.createDataFrame([(None, "12!34", "-1.0", "2099-01-01", "Neverland"), ("A2", "56789", "N/A", "2020-06-15", "France")], "ID string, PostalCode string, Price string, OrderDate string, Country string")
    assert len(found(df, Rule("not_null", "id", "FATAL"))) == 1
    assert len(found(df, Rule("regex", "PostalCode", value=r"^[A-Za-z0-9 \-]+$"))) == 1
    assert len(found(df, Rule("numeric_range", "Price", low=0))) == 1
    assert len(found(df, Rule("date_range", "OrderDate", high="today"))) == 1
    assert len(found(df, Rule("in_list", "Country", items=("France", "Germany")))) == 1
    assert found(df, Rule("not_null", "absent")) == []


def test_unique_flags_all_or_all_but_the_first(spark):
    df = spark.createDataFrame([("DUP", 1), ("DUP", 2), ("UNI", 3), (None, 4), (None, 5)], "k string, n int")
    assert len(found(df, Rule("unique", "k"))) == 4
    assert len(found(df, Rule("unique", "k", keep_first=True))) == 2


def test_references(spark):
    o = spark.createDataFrame([(7001, "KORVA"), (7002, "GHOST"), (7003, None)], "OrderID long, CustomerID string")
    c = spark.createDataFrame([("KORVA",), (None,)], "CustomerID string")
    v = found(o, Rule("referential", "CustomerID", "ERROR", references="customers.CustomerID"), key="OrderID", references={"customers": c})
    assert [(x.record_id, x.actual) for x in v] == [("7002", "GHOST")]
    assert found(o, Rule("referential", "CustomerID", references="nobody.id"), references={}) == []


def test_routing_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("A", None), (None, None), ("B", "x")], "id string, v string")
    s = screens.screen(df, [Rule("not_null", "v", "ERROR")], "id")
    assert screens.quarantined_rows(s).count() == 1 and screens.clean_rows(s).count() == 2
    assert not screens.has_fatal(s)


@pytest.mark.parametrize("errors,warns,n,score", [(5, 0, 10, 0.5), (0, 10, 10, 0.7), (2, 3, 10, 0.71), (20, 0, 5, 0.0), (0, 0, 0, 1.0)])
def test_quality_score(spark, errors, warns, n, score):
    v = spark.createDataFrame([("ERROR",)] * errors + [("WARN",)] * warns, "severity string")
    row = audit.build_audit(v, n, "b", "s", "f").first()
    assert float(row.quality_score) == score and row.reject_row_count == errors


# ---- standard forms

def test_standard_forms(spark):
    df = spark.createDataFrame([("Germany ", "berlin", "kelly's d.f.", "030-0074321"), ("USA", "new york", "x", "(503) 555-7555"), ("Freedonia", None, "", "none"), (None, "", None, None)], "country string, city string, companyName string, phone string")
    out = [tuple(r) for r in standardize(df, ENTITY_TRANSFORMS["customers"]).select("country_code", "city", "companyName", "phone").collect()]
    assert out == [("DE", "Berlin", "Kelly'S D.F.", "+49-0300074321"), ("US", "New York", "X", "+1-5035557555"), ("Freedonia", None, "", "none"), (None, "", None, None)]


def test_jaro_winkler():
    assert round(text.jaro_winkler_one("martha", "marhta"), 4) == 0.9611
    assert round(text.jaro_winkler_one("dixon", "dicksonx"), 4) == 0.8133
    assert text.jaro_winkler_one("", "a") == 0.0 and text.jaro_winkler_one("", "") == 1.0


texts = st.text("abcé ", max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=30))
def test_batches_and_bounds_of_jaro_winkler(pairs):
    both = similar.Field([x for p in pairs for x in p])
    x, y = both.of[::2], both.of[1::2]
    one = [text.jaro_winkler_one(a, b) for a, b in pairs]
    assert both.similarity(x, y).tolist() == [1.0 if a == b else s for (a, b), s in zip(pairs, one)]
    assert (both.bound(x, y).diagonal() >= np.array(one) - 1e-12).all()
    some = [(a, b) for a, b in pairs if a and b]
    assert similar.jaro_winkler_many([a for a, _ in some], [b for _, b in some]).tolist() == [text.jaro_winkler_one(a, b) for a, b in some]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=2, max_size=30), st.sampled_from([0.3, 0.6, 0.85]), st.booleans())
def test_no_pair_above_the_threshold_is_lost(rows, threshold, sided):
    side = np.arange(len(rows)) % 2 if sided else None
    a, b, score = similar.scored([[r[0] for r in rows], [r[1] for r in rows]], [0.7, 0.3], side, threshold)
    got = {(min(i, j), max(i, j)): s for i, j, s in zip(a.tolist(), b.tolist(), score.tolist())}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            want = 0.0 + text.jaro_winkler_one(rows[i][0], rows[j][0]) * 0.7 + text.jaro_winkler_one(rows[i][1], rows[j][1]) * 0.3
            if (side is None or side[i] != side[j]) and want >= threshold:
                assert got[i, j] == want
            elif want < threshold - 1e-5 or side is not None and side[i] == side[j]:
                assert (i, j) not in got


def test_column_similarity_and_long_texts(spark):
    df = spark.createDataFrame([("ab" * 400, "ab" * 399 + "ba"), (" Martha", "marhta "), (None, ""), ("x", None), ("日本𠀀語", "日本語𠀀")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [text.jaro_winkler_one("ab" * 400, "ab" * 399 + "ba"), text.jaro_winkler_one("martha", "marhta"), 1.0, 0.0, text.jaro_winkler_one("日本𠀀語", "日本語𠀀")]


@pytest.mark.parametrize("chunk", [8192, 3])
def test_scored_pairs_in_chunks_and_blocks(spark, rows, chunk):
    names = ["anna", "anne", "hanna", "bob", "bobby", "", "", "robert", "rob", "annabel"]
    df = spark.createDataFrame([(i, n, ["x", None, "y"][i % 3]) for i, n in enumerate(names)], "_ord int, name string, block string")
    want = lambda same: sorted((i, j, round(text.jaro_winkler_one(a, b), 6)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and same(i, j) and round(text.jaro_winkler_one(a, b), 6) >= 0.8)
    assert rows(scored_pairs(df, {"name": 1.0}, 0.8, chunk=chunk)) == sorted(want(lambda i, j: True), key=repr)
    assert rows(scored_pairs(df, {"name": 1.0}, 0.8, ["block"], chunk=chunk)) == sorted(want(lambda i, j: i % 3 == j % 3), key=repr)


# ---- clusters and golden records

def test_clusters(spark, rows):
    df = spark.createDataFrame(
        [("KORVA", "Korva Feinkost", "Berlin"), ("KORVA2", " korva feinkost", "Berlin"), ("MIRLO", "Taberna Mirlo", "México"), ("X1", "Completely Other", "Rome"), ("X2", "Completely Othr", "Rome"), ("Z1", "", ""), ("Z2", None, "Oslo")],
        "customerID string, companyName string, city string",
    )
    got = dict((n, c) for c, n in rows(dedup.find_clusters(df, "customers", fields={"companyName": 0.8, "city": 0.2})))
    assert got["KORVA"] == got["KORVA2"] and got["X1"] == got["X2"] and got["MIRLO"] != got["KORVA"] and got["Z1"] != got["Z2"]
    assert got["KORVA"] == "cluster_000001" and len(got) == 7


def test_golden_records(spark, rows):
    df = spark.createDataFrame(
        [("c1", 1, "Korva", 9.99, "2024-01-01", "crm"), ("c1", 2, "Korva Feinkost", 12.5, "2024-06-01", "northwind"), ("c2", 3, None, None, "2024-01-01", "crm")],
        "cluster_id string, _ord int, name string, price double, _extract_ts string, _source string",
    )
    assert rows(survivorship.golden_records(df), "cluster_id", "name", "price") == [("c1", "Korva Feinkost", 9.99), ("c2", None, None)]
    recent = {"price": {"rule": "most_recent"}, "name": {"rule": "prefer_source", "priority": ["crm", "northwind"]}}
    assert rows(survivorship.golden_records(df, recent), "cluster_id", "name", "price") == [("c1", "Korva", 12.5), ("c2", None, None)]


def test_components_of_a_long_chain(spark, rows):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(rows(components(links)))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


# ---- history

DIM = "customer_sk long, customer_nk string, company_name string, contact_name string, effective_date date, expiration_date date, is_current boolean"


def dim_rows(spark, *r):
    return spark.createDataFrame([(a, b, c, d, date.fromisoformat(e), date.fromisoformat(x) if x else None, y) for a, b, c, d, e, x, y in r], DIM)


def run_scd(spark, new, old, day="2024-06-01"):
    source = spark.createDataFrame(new, "customer_nk string, company_name string, contact_name string")
    return scd.apply_scd(source, old, "customer_nk", "customer_sk", ["company_name"], ["contact_name"], day)


def test_type2_and_type1(spark, rows):
    old = dim_rows(spark, (-1, "UNKNOWN", "Unknown", None, "1900-01-01", None, True), (1, "A", "a", "x", "2024-01-01", None, True), (2, "B", "b", "y", "2024-01-01", None, True), (3, "G", "g", None, "2024-01-01", None, True))
    dim, log = run_scd(spark, [("A", "renamed", "x2"), ("B", " b ", "y2"), ("N", "n", None)], old)
    got = {r.customer_sk: r for r in dim.collect()}
    assert got[1].expiration_date == date(2024, 5, 31) and not got[1].is_current and got[1].contact_name == "x2"
    assert got[2].contact_name == "y2" and got[2].is_current and got[-1].is_current
    assert not got[3].is_current and (got[4].customer_nk, got[5].customer_nk) == ("A", "N")
    assert rows(log, "nk", "action") == [("A", "UPDATE_T2_EXPIRE"), ("A", "UPDATE_T2_NEW"), ("B", "UPDATE_T1"), ("G", "EXPIRE"), ("N", "INSERT")]
    again, none = run_scd(spark, [("A", "renamed", "x2"), ("B", "b", "y2"), ("N", "n", None)], dim, "2024-07-01")
    assert none.count() == 0 and rows(again) == rows(dim)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("ABC"), st.tuples(st.sampled_from("pq"), st.sampled_from("rs")), max_size=3), min_size=2, max_size=3))
def test_history_invariants(spark, loads):
    dim = dim_rows(spark, (-1, "UNKNOWN", "Unknown", None, "1900-01-01", None, True))
    for k, load in enumerate(loads):
        dim, _ = run_scd(spark, [(n, a, b) for n, (a, b) in load.items()], dim, f"2024-0{k + 1}-01")
    assert scd.version_faults(dim, "customer_nk", "customer_sk").filter("fault = 'overlap'").count() == 0
    keys = [r.customer_sk for r in dim.collect()]
    assert len(keys) == len(set(keys))
    assert {r.customer_nk for r in dim.filter("is_current and customer_sk > 0").collect()} == set(loads[-1])


def test_point_in_time(spark):
    dim = dim_rows(spark, (1, "KORVA", "", "", "2020-01-01", "2022-12-31", False), (2, "KORVA", "", "", "2023-01-01", None, True))
    facts = spark.createDataFrame([("KORVA", "2021-06-01"), ("KORVA", "2022-12-31"), ("KORVA", "2024-01-01"), ("GHOST", "2021-01-01"), (None, "2021-01-01"), ("KORVA", "2019-01-01")], "nk string, d string")
    x = lookup.Lookup("c", "nk", "customer_nk", "customer_sk", "sk", "d")
    assert [r.sk for r in lookup.resolve_point_in_time(facts, dim, x).orderBy("d", "nk").collect()] == [-1, -1, -1, 1, 1, 2]
    twice = dim.unionByName(dim_rows(spark, (7, "KORVA", "", "", "2021-01-01", "2025-01-01", False)))
    out = lookup.resolve_point_in_time(facts, twice, x)
    assert out.count() == 6 and out.filter("d = '2021-06-01'").first().sk == 1
    with pytest.raises(lookup.OverlapError):
        lookup.resolve_point_in_time(facts, twice, x, "error")
    assert lookup.resolve_point_in_time(facts, None, x).filter("sk <> -1").count() == 0


def test_keys(spark, tmp_path, rows):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "n string")
    assert rows(assign_keys(df, "sk", ["n"], 100)) == [(101, "a"), (102, "b"), (103, "c")]
    seq = KeySequence(spark, f"file://{tmp_path}/seq.json")
    assert seq.next("d") == 1 and list(seq.reserve("d", 3)) == [2, 3, 4] and seq.current("d") == 4
    (tmp_path / "bad.json").write_text("{")
    assert KeySequence(spark, f"file://{tmp_path}/bad.json").next("d") == 1


def test_late_dimension_splits_and_repoints(spark, rows):
    dim = dim_rows(spark, (1, "A", "old", "", "2020-01-01", "2022-12-31", False), (2, "A", "new", "", "2023-01-01", None, True))
    changes = spark.createDataFrame([("A", "2021-06-01", "mid")], "customer_nk string, effective_date string, company_name string")
    out, moved = late.late_dimension(dim, changes, "customer_nk", "customer_sk")
    assert rows(out, "customer_sk", "company_name", "expiration_date") == [(1, "old", date(2021, 5, 31)), (2, "new", None), (3, "mid", date(2022, 12, 31))]
    facts = spark.createDataFrame([(1, date(2021, 1, 1)), (1, date(2022, 1, 1)), (2, date(2024, 1, 1))], "sk long, d date")
    assert [r.sk for r in late.repoint(facts, moved, "sk", "d").orderBy("d").collect()] == [1, 3, 2]


# ---- facts

def test_fact(spark):
    o = spark.createDataFrame([(7001, "VINET", 5, "1996-07-04", "1996-08-01", None, 3, 32.38, "France"), (7002, "TOMSP", 6, "1996-07-05", "1996-08-16", "1996-07-10", 1, 11.61, "Germany")], "orderID long, customerID string, employeeID long, orderDate string, requiredDate string, shippedDate string, shipVia long, freight double, shipCountry string")
    d = spark.createDataFrame([(7001, 11, 14.0, 12, 0.0), (7001, 42, 9.8, 10, 1.5), (7002, 14, 18.6, 9, 0.0), (7002, 51, 42.4, 0, 0.0)], "orderID long, productID long, unitPrice double, quantity long, discount double")
    f = fact.build_fact_sales(o, d, {"dim_geography": geography(spark)}).orderBy("order_id", "line_number").collect()
    assert len(f) == 3 and [x.line_number for x in f] == [1, 2, 1]
    assert abs(sum(float(x.freight_allocated) for x in f if x.order_id == 7001) - 32.38) < 0.02
    assert f[0].order_date_sk == 19960704 and f[0].shipped_date_sk == 19000101 and max(float(x.discount) for x in f) <= 1
    assert f[0].customer_sk == -1 and f[2].ship_geography_sk == 8
    assert all(x.net_amount == x.extended_price - x.discount_amount for x in f)
    assert fact.build_fact_sales(o.limit(0), d, {}).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9), st.integers(1, 999)), min_size=1, max_size=8), st.integers(0, 5000))
def test_freight_is_conserved(spark, lines, cents):
    o = spark.createDataFrame([(k, cents / 100) for k in (1, 2, 3)], "orderID long, freight double")
    d = spark.createDataFrame([(k, q, p / 100) for k, q, p in lines], "orderID long, quantity long, unitPrice double")
    got = fact.build_fact_sales(o, d, {}).groupBy("order_id").agg(F.sum("freight_allocated").alias("f"), F.count("*").alias("n")).collect()
    assert {r.order_id for r in got} == {k for k, _, _ in lines}
    assert all(abs(float(r.f) - cents / 100) <= 0.005 * r.n + 1e-9 for r in got)


def test_monthly_aggregate(spark):
    f = spark.createDataFrame([(1, 20240105, 1, 1, 2, 10.0), (2, 20240210, 1, 1, 1, 5.0), (3, 20240310, 1, 2, 1, 5.0)], "order_id long, order_date_sk int, product_sk long, customer_sk long, quantity int, net_amount double")
    c = spark.createDataFrame([(1, "DE", True), (2, "FR", False)], "customer_sk long, country_code string, is_current boolean")
    got = aggregate.agg_sales_monthly(f, dims.dim_date(spark, 2024, 2024), c).orderBy("year_month").collect()
    assert [(r.year_month, r.customer_country) for r in got] == [(202401, "DE"), (202402, "DE"), (202403, "ZZ")]
    assert aggregate.navigate({"total_quantity"}, "month", {"product_sk"}) == "agg_sales_monthly"
    assert aggregate.navigate({"total_quantity"}, "day", {"product_sk"}) == "fact_sales"


def test_dates(spark):
    d = dims.dim_date(spark, 2020, 2020).orderBy("date_sk").collect()
    assert len(d) == 366 and d[0].date_sk == 20200101 and d[-1].date_sk == 20201231 and d[3].is_weekend
    assert dims.dim_date(spark, 1990, 2030, sentinel=True).count() == 14976


# ---- storage

def test_published_versions(spark, tmp_path):
    store = DimensionStore(spark, f"file://{tmp_path}")
    with pytest.raises(PublishError):
        store.publish("d", spark.range(0), "b0")
    store.publish("d", spark.range(3), "b1")
    store.publish("d", spark.range(5), "b2")
    assert store.versions("d") == ["b1", "b2"] and store.latest("d").count() == 5 and store.version("d", "b1").count() == 3
    with pytest.raises(PublishError):
        store.latest("none")


def test_late_changes_within_one_version(spark, rows):
    dim = dim_rows(spark, (1, "A", "x", "", "2020-01-01", None, True), (2, "B", "x", "", "2020-03-01", "2021-01-01", False))
    changes = spark.createDataFrame([("A", "2020-06-01", "late"), ("A", "2020-03-01", "early"), ("A", "2020-03-01", "eager"), ("B", "2020-03-01", "b")], "customer_nk string, effective_date string, company_name string")
    out, moved = late.late_dimension(dim, changes, "customer_nk", "customer_sk")
    got = sorted((r.customer_nk, str(r.effective_date), str(r.expiration_date), r.company_name, r.is_current) for r in out.collect())
    assert got == [("A", "2020-01-01", "2020-02-29", "x", False), ("A", "2020-03-01", "2020-05-31", "early", False), ("A", "2020-06-01", "None", "late", True), ("B", "2020-03-01", "2021-01-01", "b", False)]
    assert out.count() == out.select("customer_sk").distinct().count()
    assert scd.version_faults(out.filter("customer_nk = 'A'"), "customer_nk", "customer_sk").count() == 0
    assert sorted((r.old_sk, str(r.first_day), str(r.last_day)) for r in moved.collect()) == [(1, "2020-03-01", "2020-05-31"), (1, "2020-06-01", "None"), (2, "2020-03-01", "2021-01-01")]


def test_jdbc(spark):
    url, props = "jdbc:derby:memory:t;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), url, "dim", props, "overwrite")
    insert_ignore_jdbc(spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string"), url, "dim", ["id"], props)
    assert sorted(r.v for r in read_jdbc(spark, url, "dim", props, key="id").collect()) == ["a", "b", "c"]
    assert max_key(spark, url, "dim", "id", props) == 3 and max_key(spark, url, "nothing", "id", props) == 0
    assert read_jdbc(spark, url, "nothing", props, "id int").count() == 0


def test_csv_skips_malformed_rows_and_reads_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,NULL\n2,3,4\n5,6\n")
    assert [tuple(r) for r in read_csv(spark, f"file://{tmp_path}/x.csv").orderBy("a").collect()] == [("1", None), ("5", "6")]
