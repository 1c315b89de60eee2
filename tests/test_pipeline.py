import io
import json
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from starloom.plans.warehouse import PipelineError, Settings, clean, run_pipeline, runs
from starloom.sources.config import ConfigError, load_sources
from starloom.sources.fetch import CsvExtractor, ExtractError, JsonExtractor, latest_snapshot, with_retry
from starloom.sources.sinks import produce_files, produce_paced, restore_table, write_table
from starloom.storage import children, drop_written, locked, settled, shared_dir, written
from starloom.streaming.events import encode_orders
from starloom.streaming.ingest import ingest, latest_windows, once_each, read_lines, save_windows, tumbling_counts

CUSTOMERS = (
    "customerID,companyName,contactName,contactTitle,address,city,region,postalCode,country,phone,fax\n"
    "KORVA,Korva Feinkost,Ilse,Buyer,Am Kanal 4,leipzig,NULL,04109,Germany,0341-555010,NULL\n"
    "KORVA2,korva feinkost,Ilse Brandt,Buyer,Am Kanal 4,Leipzig,NULL,04109,Germany,0341-555010,NULL\n"
    "MIRLO,Taberna Mirlo,Pau,Cook,Calle Nueva 9,toledo,NULL,45001,Spain,(9) 555-0177,NULL\n"
)
ORDERS = (
    "orderID,customerID,employeeID,orderDate,requiredDate,shippedDate,shipVia,freight,shipName,shipAddress,shipCity,shipRegion,shipPostalCode,shipCountry\n"
    "7001,KORVA,1,1996-05-02,1996-06-01,1996-05-11,1,20.25,x,x,x,NULL,1,France\n"
    "7002,GHOST,1,1996-05-03,1996-06-02,NULL,1,8.10,x,x,x,NULL,1,Germany\n"
)
DETAILS = "orderID,productID,unitPrice,quantity,discount\n7001,1,11.50,4,0.0\n7001,2,3.20,25,0.1\n7002,1,11.50,7,0.0\n"
PRODUCTS = (
    "productID,productName,supplierID,categoryID,quantityPerUnit,unitPrice,unitsInStock,unitsOnOrder,reorderLevel,discontinued\n"
    "1,Birch Tea,1,1,20 bags,11.50,60,0,15,0\n2,Plum Jam,1,2,6 jars,3.20,44,12,10,1\n"
)
EMPLOYEES = (
    "employeeID,lastName,firstName,title,titleOfCourtesy,birthDate,hireDate,address,city,region,postalCode,country,homePhone,extension,photo,notes,reportsTo,photoPath\n"
    "1,Lindqvist,Oskar,Clerk,Dr.,1961-01-09,1994-02-01,x,leeds,NULL,1,UK,1,1,x,x,NULL,x\n"
)
SHIPPERS = "shipperID,companyName,phone\n1,Swift Cargo,(503) 555-0142\n"
RULES = "screens:\n  customers:\n    column_property:\n      - {column: CustomerID, rule: not_null, severity: FATAL}\n  orders:\n    structure:\n      - {column: CustomerID, references: customers.CustomerID, severity: ERROR}\n"
FILES = {"customers.csv": CUSTOMERS, "orders.csv": ORDERS, "order-details.csv": DETAILS, "products.csv": PRODUCTS, "employees.csv": EMPLOYEES, "shippers.csv": SHIPPERS}


def settings(tmp_path, **more):
    (tmp_path / "rules.yaml").write_text(RULES)
    (tmp_path / "sources.yaml").write_text("sources:\n  northwind:\n    type: http_csv\n    base_url: http://x\n    files: [" + ", ".join(FILES) + ", absent.csv]\n")
    return Settings(str(tmp_path / "data"), str(tmp_path / "rules.yaml"), sources=str(tmp_path / "sources.yaml"), first_year=1996, last_year=1997, **more)


def get(url):
    name = url.rpartition("/")[2]
    if name not in FILES:
        raise urllib.error.HTTPError(url, 404, "no", {}, io.BytesIO())
    return FILES[name].encode()


def test_whole_run(spark, tmp_path):
    s = settings(tmp_path)
    run = run_pipeline(spark, s, "b1", get=get)
    assert run.status == "SUCCESS", run
    read = lambda n: spark.read.parquet(s.path("warehouse", n))
    assert read("dim_customer").filter("customer_sk > 0").count() == 2  # the duplicate is one golden record
    facts = read("fact_sales").collect()
    assert len(facts) == 2 and all(f.product_sk > 0 and f.shipper_sk == 1 and f.audit_sk == 1 for f in facts)  # GHOST's order is in quarantine
    assert read("agg_sales_monthly").count() == 2
    assert read("dim_audit").filter("audit_sk = 1").first().reject_row_count == 1
    assert spark.read.parquet(s.path("error", "quarantine", "b1", "orders")).count() == 1
    assert read("dim_employee").filter("employee_sk = 1").first().full_name == "Dr. Oskar Lindqvist"
    assert run_pipeline(spark, s, "b1", get=get).status == "SKIPPED"
    assert run_pipeline(spark, s, "b2", get=get).status == "SUCCESS"
    assert read("fact_sales").count() == 2 and read("dim_customer").filter("customer_sk > 0").count() == 2
    assert [r["status"] for r in runs(spark, s)] == ["SUCCESS", "SUCCESS"]


def test_errors_of_an_entity_without_a_key_lose_no_row(spark, tmp_path):
    s = settings(tmp_path)
    (tmp_path / "rules.yaml").write_text("screens:\n  order-details:\n    column_property:\n      - {column: Quantity, rule: numeric_range, min: 1, max: 1000, severity: ERROR}\n")
    bad = DETAILS + "7002,2,3.20,5000,0.0\n"
    run_pipeline(spark, s, "b1", get=lambda u: bad.encode() if u.endswith("order-details.csv") else get(u))
    kept = spark.read.parquet(s.path("staging", "cleaned", "order-details"))
    assert sorted(r.quantity for r in kept.collect()) == ["25", "4", "5000", "7"]  # clean + quarantine = input
    assert not (tmp_path / "data/error/quarantine/b1/order-details").exists()
    assert spark.read.parquet(s.path("warehouse", "fact_sales")).filter("quantity = 5000").count() == 1
    assert spark.read.parquet(s.path("error", "events")).filter("actual_value = '5000'").count() == 1
    assert spark.read.parquet(s.path("warehouse", "dim_audit")).filter("audit_sk = 1").first().reject_row_count == 1


def test_drift_from_the_baseline(spark, tmp_path):
    s = settings(tmp_path)
    (tmp_path / "rules.yaml").write_text(
        "screens:\n  shippers:\n    reasonability:\n      - {metric: row_count, tolerance_pct: 20, severity: WARN}\n      - {metric: column_mean, column: Weight, tolerance_pct: 10, severity: ERROR}\n"
        "  products:\n    reasonability:\n      - {metric: row_count, baseline: 2, severity: FATAL}\n"
    )

    def go(batch, n, weight, products=2):
        rows = lambda k: spark.createDataFrame([(str(i), f"{weight}.5", "x1" if i else "7") for i in range(k)], "shipperID string, weight string, name string").coalesce(1)
        return clean(spark, s, batch, {"shippers": rows(n), "products": rows(products).withColumnRenamed("shipperID", "productID")})

    seen = lambda b: {(r.source_table, r.screen_name, r.screen_severity, r.column_name, r.actual_value) for r in spark.read.parquet(s.path("error", "events")).filter(F.col("etl_batch_id") == b).collect()}
    audit = lambda b: spark.read.parquet(s.path("warehouse", "dim_audit_batch", b)).first()
    go("b1", 10, 1)
    kept = json.loads((tmp_path / "data/staging/_baselines/shippers.json").read_text())
    assert kept["row_count"] == 10 and kept["column_stats"]["weight"] == {"mean": 1.5, "std": 0.0, "min": 1.5, "max": 1.5} and "name" not in kept["column_stats"]
    assert not seen("b1") and audit("b1").quality_score == 1
    go("b2", 5, 2)  # fewer rows and another mean
    assert seen("b2") == {("shippers", "reasonability.row_count", "WARN", None, "5"), ("shippers", "reasonability.column_mean", "ERROR", "weight", "2.5000")}
    assert audit("b2").reject_row_count == 1 and audit("b2").has_anomalies and float(audit("b2").quality_score) == 0.8143
    assert go("b3", 5, 2, products=3) == {"status": "FATAL", "stopped_at": "products", "rows": {"shippers": 5}}
    assert seen("b3") == {("products", "reasonability.row_count", "FATAL", None, "3")}


def test_fatal_stops_the_run(spark, tmp_path):
    s = settings(tmp_path)
    bad = {**FILES, "customers.csv": CUSTOMERS + "NULL,No Key,x,x,x,x,x,x,x,x,x\n"}
    with pytest.raises(PipelineError, match="FATAL"):
        run_pipeline(spark, s, "b1", get=lambda u: bad[u.rpartition("/")[2]].encode() if u.rpartition("/")[2] in bad else get(u))
    assert runs(spark, s)[0]["status"] == "FAILED"
    with pytest.raises(PipelineError):
        run_pipeline(spark, s, only="nothing")


def test_error_events_reach_a_database_and_its_failure_stops_nothing(spark, tmp_path):
    url, props = "jdbc:derby:memory:e;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    s = settings(tmp_path, error_database=(url, props))
    assert run_pipeline(spark, s, "b1", get=get).status == "SUCCESS"
    assert spark.read.jdbc(url, "error_events", properties=props).count() == spark.read.parquet(s.path("error", "events")).count() == 1
    s.error_database = ("jdbc:nothing:x", {})
    assert run_pipeline(spark, s, "b2", get=get).status == "SUCCESS"


def test_keys_are_never_given_twice(spark, tmp_path):
    s = settings(tmp_path)
    run_pipeline(spark, s, "b1", get=get)
    dim = spark.read.parquet(s.path("warehouse", "dim_customer"))
    first = {r.customer_sk for r in dim.collect()} - {-1}
    write_table(dim.filter("customer_sk < 0"), s.path("warehouse", "dim_customer"))  # all versions are gone
    run_pipeline(spark, s, "b2", get=get)
    assert not first & {r.customer_sk for r in spark.read.parquet(s.path("warehouse", "dim_customer")).collect()}


def test_tables_survive_a_crash_between_renames(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_table(spark.range(3), path)
    write_table(spark.read.parquet(path).filter("id > 0"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t").rename(tmp_path / ".old-t")
    restore_table(spark, path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t" / ".keep").write_text("")
    write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_scratch_removes_all_but_what_is_kept(spark):
    before = set(children(spark, shared_dir(spark)))
    out = settled(spark, lambda: written(written(spark.range(4), "a").filter("id > 1"), "b"), "kept")
    left = set(children(spark, shared_dir(spark))) - before
    assert out.count() == 2 and len(left) == 1
    drop_written(out)
    assert set(children(spark, shared_dir(spark))) == before


def test_locks_wait_and_time_out(spark, tmp_path):
    path = f"file://{tmp_path}/k.json"
    with locked(spark, path), pytest.raises(TimeoutError), locked(spark, path, 0.2):
        pass
    with locked(spark, path, 0.2):
        pass


def test_paced_producer_counts_and_pauses(spark, tmp_path):
    o = spark.createDataFrame([(k, "A") for k in range(10)], "orderID long, customerID string")
    pauses = []
    sent = produce_paced(encode_orders(o), lambda b: produce_files(b, f"file://{tmp_path}/p"), 4, 0.3, pauses.append)
    assert sent == 10 and pauses == [0.3, 0.3] and spark.read.text(f"file://{tmp_path}/p").count() == 10


def test_windows_as_of_their_last_batch(spark, tmp_path):
    out, state, src = (f"file://{tmp_path}/{x}" for x in ("out", "state", "src"))
    rows = lambda *r: spark.createDataFrame(r, "ts timestamp_ntz, event_type string")
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    for part in (rows((at(1, 0), "a"), (at(1, 5), "a")), rows((at(1, 7), "a"), (at(5, 0), "b")), rows((at(1, 8), "a"), (at(5, 1), "b"))):  # the last 1:08 is late
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        save_windows(tumbling_counts(stream, "ts"), out, state).awaitTermination()
    got = {(r.window_start.hour, r.event_type): r.n for r in latest_windows(spark, out, ["window_start", "event_type"]).collect()}
    assert got == {(1, "a"): 3, (5, "b"): 2}


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return b"ok"

    assert with_retry(flaky, sleep=lambda s: None) == b"ok" and len(calls) == 3

    def gone():
        calls.append(1)
        raise urllib.error.HTTPError("u", 404, "no", {}, io.BytesIO())

    calls.clear()
    with pytest.raises(ExtractError):
        with_retry(gone, sleep=lambda s: None)
    assert len(calls) == 1


def test_extractors(spark, tmp_path):
    e = CsvExtractor("n", str(tmp_path / "raw"), get=lambda u: b"a,b\n1,2\n")
    out = e.land("http://x/a.csv", "a.csv", "2024-01-01-000000")
    assert out.rows == 1 and json.loads((tmp_path / "raw/2024-01-01-000000/_manifest.json").read_text())["files"]["a.csv"]["sha256"] == out.sha256
    assert latest_snapshot(tmp_path / "raw").name == "2024-01-01-000000"
    shared = CsvExtractor("n", f"file://{tmp_path}/shared", get=lambda u: b"a,b\n1,2\n", spark=spark)  # through Hadoop's file systems
    assert shared.land("http://x/a.csv", "a.csv", "2024-01-01-000000").sha256 == out.sha256 and shared.land("http://x/b.csv", "b.csv", "2024-01-01-000000").rows == 1
    assert sorted(json.loads((tmp_path / "shared/2024-01-01-000000/_manifest.json").read_text())["files"]) == ["a.csv", "b.csv"]
    assert (tmp_path / "shared/2024-01-01-000000/a.csv").read_bytes() == b"a,b\n1,2\n"
    with pytest.raises(ExtractError):
        CsvExtractor("n", str(tmp_path), get=lambda u: b"  ").land("u", "x.csv")
    (tmp_path / "seed.json").write_text("[1, 2]")
    j = JsonExtractor("n", str(tmp_path / "raw"), get=lambda u: b"{").land("u", "x.json", fallback=str(tmp_path / "seed.json"))
    assert j.from_fallback and j.rows == 2
    with pytest.raises(ConfigError):
        load_sources(tmp_path / "none.yaml")


def test_stream_is_exactly_once_over_a_restart(spark, tmp_path):
    o = spark.createDataFrame([(7001, "A", None), (7002, "B", 1.5)], "orderID long, customerID string, freight double")
    src, out, dead, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "dead", "state"))
    encode_orders(o).select("value").write.mode("append").text(src)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(src)

    def go():
        for q in ingest(read_lines(spark, src), out, state, ["OrderID", "Freight"], dead):
            q.awaitTermination()

    go()
    go()
    assert sorted((r.OrderID, r.Freight) for r in spark.read.parquet(out).collect()) == [("7001", None), ("7002", "1.5")]
    assert spark.read.parquet(dead).count() == 1
    encode_orders(o.limit(1)).select("value").write.mode("append").text(src)
    go()
    got = spark.read.parquet(out)
    assert got.count() == 3 and once_each(got.unionByName(got)).count() == 3


def test_command_line(spark, tmp_path, capsys):
    from starloom.__main__ import main

    assert main(["run", "--root", str(tmp_path), "--phase", "deliver", "--batch-id", "b1"]) == 0
    assert main(["run", "--root", str(tmp_path), "--phase", "clean", "--batch-id", "b2"]) == 1
    assert main(["status", "--root", str(tmp_path)]) == 0
    assert "b1 SUCCESS" in capsys.readouterr().out
