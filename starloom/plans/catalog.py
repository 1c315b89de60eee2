"""The registered queries of the warehouse operators, each with its SQL oracle.

A query applies an operator of the library to whole tables; its SQL computes the same by other means. Where an operator
is about changes, arrivals or defects, the tables have none, so a query derives them from keys (every row is in, as one
case or another): say, customers ending in 8 leave, those ending in 9 arrive.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import text
from starloom.functions.dates import date_to_sk
from starloom.operators import aggregate, audit, cdc, dedup, dims, fact, late, lookup, scd, screens, serve, survivorship, upsert
from starloom.operators.screens import Rule
from starloom.operators.standardize import Transform, geography, standardize, transforms_from_yaml
from starloom.operators.surrogate import KeySequence, assign_keys
from starloom.plans import warehouse
from starloom.plans.star import SQL_CUSTOMERS, SQL_FACT, customer_history, dimensions, order_details, orders, table
from starloom.sources.readers import latest_in, read_csv, read_json
from starloom.sources.sinks import DimensionStore, load_crc_index, produce_files, produce_paced, save_crc_index, write_table
from starloom.storage import new_path
from starloom.streaming.events import decode, encode_orders, flatten
from starloom.streaming.ingest import ingest, latest_windows, read_lines, save_windows, sessions, tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, short integers as integers: types that both engines share."""
    kinds = {"smallint": "int", "tinyint": "int"}
    return df.select(*(F.col(c).cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(c) for c, t in df.dtypes))


def the_fact(spark: SparkSession, sf: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    return fact.build_fact_sales(orders(spark, sf), order_details(spark, sf), stored or dimensions(spark, sf))


# ---- facts and aggregates

MONTHLY = """a AS (
  SELECT (order_date_sk // 100)::INT AS year_month, f.product_sk, coalesce(c.country_code, 'ZZ') AS customer_country, sum(quantity)::BIGINT AS total_quantity,
    sum(net_amount::DECIMAL(14, 2))::DOUBLE AS total_net_amount, count(DISTINCT order_id)::BIGINT AS order_count
  FROM f LEFT JOIN (SELECT * FROM dc WHERE is_current) c USING (customer_sk) GROUP BY 1, 2, 3
)"""


@query(f"WITH {SQL_FACT}, {MONTHLY} SELECT * FROM a")
def agg_sales_monthly(spark, sf):
    days, stored = dims.dim_date(spark, 1990, 2030), dimensions(spark, sf)
    return plain(aggregate.agg_sales_monthly(the_fact(spark, sf, stored), days, stored["dim_customer"]).drop("audit_sk"))


@query(f"WITH {SQL_FACT}, {MONTHLY.replace('WHERE is_current', '')} SELECT * FROM a")
def agg_sales_monthly_all_versions(spark, sf):
    days, stored = dims.dim_date(spark, 1990, 2030), dimensions(spark, sf)
    return plain(aggregate.agg_sales_monthly(the_fact(spark, sf, stored), days, stored["dim_customer"], all_versions=True).drop("audit_sk"))


@query(f"WITH {SQL_FACT} SELECT * FROM f")
def fact_sales(spark, sf):
    return plain(the_fact(spark, sf).drop("audit_sk"))


@query(f"WITH {SQL_FACT} SELECT order_id, count(*)::BIGINT AS lines, sum(freight_allocated::DECIMAL(12, 2))::DOUBLE AS freight FROM f GROUP BY order_id")
def freight_allocation(spark, sf):
    return plain(the_fact(spark, sf).groupBy("order_id").agg(F.count("*").alias("lines"), F.sum("freight_allocated").alias("freight")))


CUBE = """SELECT year, quarter, month, category_name, country_code, sum(net_amount::DECIMAL(14, 2))::DOUBLE AS revenue, sum(quantity)::BIGINT AS units, count(DISTINCT order_id)::BIGINT AS orders
FROM (SELECT f.*, (order_date_sk // 10000)::INT AS year, ((order_date_sk // 100 % 100 + 2) // 3)::INT AS quarter, (order_date_sk // 100 % 100)::INT AS month, p_type AS category_name, country_code
  FROM f JOIN part ON p_partkey + 1 = f.product_sk JOIN dc USING (customer_sk))
GROUP BY GROUPING SETS ((year), (year, quarter), (year, quarter, month), (year, category_name), (year, country_code), (year, category_name, country_code))"""


@query(f"WITH {SQL_FACT} {CUBE}")
def olap_grouping_sets(spark, sf):
    d = dimensions(spark, sf)
    days = dims.dim_date(spark).select("date_sk", "year", "quarter", "month")
    rows = the_fact(spark, sf, d).join(days, F.col("order_date_sk") == F.col("date_sk")).join(d["dim_product"].select("product_sk", "category_name"), "product_sk")
    rows = rows.join(d["dim_customer"].select("customer_sk", "country_code"), "customer_sk")
    return plain(aggregate.olap_cube(rows))


@query(f"WITH {SQL_FACT}, {MONTHLY} SELECT year_month, sum(total_quantity)::BIGINT AS total_quantity FROM a GROUP BY year_month")
def aggregate_navigator(spark, sf):
    chosen = aggregate.navigate({"total_quantity"}, "month", {"product_sk"})
    if chosen == "agg_sales_monthly":
        return agg_sales_monthly(spark, sf).groupBy("year_month").agg(F.sum("total_quantity").alias("total_quantity"))
    return the_fact(spark, sf).groupBy((F.col("order_date_sk") / 100).cast("int").alias("year_month")).agg(F.sum("quantity").cast("long").alias("total_quantity"))


# ---- dates, dimensions, keys


@query("""SELECT strftime(d, '%Y%m%d')::INT AS date_sk, d AS full_date, isodow(d)::INT - 1 AS day_of_week, dayname(d) AS day_name, day(d)::INT AS day_of_month, dayofyear(d)::INT AS day_of_year,
week(d)::INT AS week_of_year, month(d)::INT AS month, monthname(d) AS month_name, quarter(d)::INT AS quarter, year(d)::INT AS year, isodow(d) >= 6 AS is_weekend, year(d)::INT AS fiscal_year, quarter(d)::INT AS fiscal_quarter
FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d UNION ALL SELECT DATE '1900-01-01')""")
def dim_date(spark, sf):
    return plain(dims.dim_date(spark, 1990, 2030, sentinel=True))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 19000101 ELSE strftime(o_orderdate, '%Y%m%d')::INT END AS date_sk FROM orders", "date_to_sk")
def q_date_to_sk(spark, sf):
    shown = F.when(F.col("o_orderkey") % 97 == 0, F.lit("no date")).otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", date_to_sk(shown).alias("date_sk"))


@query("""SELECT row_number() OVER (ORDER BY c_custkey::VARCHAR)::BIGINT AS customer_sk, c_custkey::VARCHAR AS customer_nk, c_name AS company_name, CASE c_nationkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'BR' ELSE 'Freedonia' END AS country_code,
CASE c_nationkey % 3 WHEN 0 THEN 'Europe' WHEN 1 THEN 'Americas' END AS region_name, DATE '1900-01-01' AS effective_date, true AS is_current FROM customer""")
def dim_customer(spark, sf):
    country = F.element_at(F.array(F.lit(" Germany "), F.lit("Brasil"), F.lit("Freedonia")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("customerID"), F.col("c_name").alias("companyName"), country.alias("country"))
    out = dims.dim_customer(standardize(c, [Transform("country", "standardize_country", "country_code")]), geography(spark))
    return out.select("customer_sk", "customer_nk", "company_name", "country_code", "region_name", "effective_date", "is_current")


@query("""SELECT row_number() OVER (ORDER BY p_partkey)::BIGINT AS product_sk, p_partkey::INT AS product_nk, p_name AS product_name, p_type AS category_name, s_name AS supplier_name, CASE WHEN s_suppkey IS NOT NULL THEN 'US' END AS supplier_country,
p_retailprice::DECIMAL(10, 2)::DOUBLE AS unit_price, p_size::INT AS units_in_stock, p_partkey % 10 = 0 AS discontinued FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 90""")
def dim_product(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("productID"), F.col("p_name").alias("productName"), (F.col("p_partkey") % 90).alias("supplierID"), F.col("p_type").alias("categoryID"), F.col("p_retailprice").alias("unitPrice"),
        F.col("p_size").alias("unitsInStock"), F.when(F.col("p_partkey") % 10 == 0, "1").otherwise("0").alias("discontinued"),
    )
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("categoryID"), F.col("p_type").alias("categoryName")).distinct()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplierID"), F.col("s_name").alias("companyName"), F.lit("USA").alias("country"))
    out = dims.dim_product(p, kinds, s)
    return plain(out.select("product_sk", "product_nk", "product_name", "category_name", "supplier_name", "supplier_country", "unit_price", "units_in_stock", "discontinued"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey)::BIGINT AS shipper_sk, s_suppkey::INT AS shipper_nk, s_name AS company_name FROM supplier")
def dim_shipper(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shipperID"), F.col("s_name").alias("companyName"))
    return dims.dim_shipper(s).select("shipper_sk", "shipper_nk", "company_name")


@query("""SELECT row_number() OVER (ORDER BY s_suppkey)::BIGINT AS employee_sk, s_suppkey::INT AS employee_nk, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'Dr. ' || s_name END AS full_name,
CASE WHEN s_suppkey % 7 <> 0 THEN 'Clerk' END AS title, CASE WHEN s_suppkey > 0 THEN (s_suppkey // 2)::INT END AS reports_to_nk, 'New York' AS city, 'GB' AS country_code FROM supplier""")
def dim_employee(spark, sf):
    k = F.col("s_suppkey")
    e = table(spark, sf, "supplier").select(
        k.alias("employeeID"), F.when(k % 5 == 0, "null").otherwise("Dr. ").alias("titleOfCourtesy"), F.lit("").alias("firstName"), F.col("s_name").alias("lastName"), F.when(k % 7 == 0, "NULL").otherwise("Clerk").alias("title"),
        F.when(k > 0, F.floor(k / 2)).cast("string").alias("reportsTo"), F.lit(" new yORK").alias("city"), F.lit("UK").alias("country"),
    )
    return dims.dim_employee(e).select("employee_sk", "employee_nk", "full_name", "title", "reports_to_nk", "city", "country_code")


@query("SELECT (100 + row_number() OVER (ORDER BY c_name, c_custkey))::BIGINT AS sk, c_custkey FROM customer")
def surrogate_keys(spark, sf):
    return assign_keys(table(spark, sf, "customer"), "sk", ["c_name", "c_custkey"], 100).select("sk", "c_custkey")


# ---- lookups

PIT = lookup.Lookup("dim_customer", "o_custkey", "customer_nk", "customer_sk", "customer_sk", "o_orderdate")


@query(f"""WITH {SQL_CUSTOMERS} SELECT o_orderkey, coalesce(dc.customer_sk, -1)::BIGINT AS customer_sk FROM orders LEFT JOIN dc
ON dc.customer_nk = o_custkey::VARCHAR AND o_orderkey % 50 <> 0 AND effective_date <= o_orderdate::DATE AND (expiration_date IS NULL OR expiration_date >= o_orderdate::DATE)""")
def lookup_point_in_time(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")))
    return lookup.resolve_point_in_time(o, customer_history(spark, sf), PIT).select("o_orderkey", "customer_sk")


@query("SELECT l_orderkey, l_partkey, (CASE WHEN l_suppkey % 11 = 0 THEN -1 ELSE l_suppkey + 7 END)::BIGINT AS supplier_sk, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def lookup_type1(spark, sf):
    s = table(spark, sf, "supplier").filter("s_suppkey % 11 <> 0").select((F.col("s_suppkey") + 7).alias("sk"), F.col("s_suppkey").alias("nk"))
    out = lookup.resolve_type1(table(spark, sf, "lineitem"), s.union(s.selectExpr("sk + 1000", "nk")), lookup.Lookup("s", "l_suppkey", "nk", "sk", "supplier_sk"))
    return out.groupBy("l_orderkey", "l_partkey", "supplier_sk").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_FACT} SELECT order_id, line_number, customer_sk, employee_sk, product_sk, shipper_sk, ship_geography_sk FROM f")
def lookup_batch(spark, sf):
    return plain(the_fact(spark, sf).select("order_id", "line_number", "customer_sk", "employee_sk", "product_sk", "shipper_sk", "ship_geography_sk"))


# ---- changes over time: customers ending in 8 leave, in 9 arrive, in 1 change a type 2 attribute, in 2 a type 1


def _versions(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey % 10 <> 9")
    return c.select(
        (F.col("c_custkey") + 1).alias("customer_sk"), F.col("c_custkey").cast("string").alias("customer_nk"), F.col("c_mktsegment").alias("city"), F.col("c_name").alias("phone"),
        F.lit("1995-01-01").cast("date").alias("effective_date"), F.lit(None).cast("date").alias("expiration_date"), F.lit(True).alias("is_current"),
    )


def _source(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").filter("c_custkey % 10 <> 8")
    return c.select(k.cast("string").alias("customer_nk"), F.when(k % 10 == 1, "MOVED").otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("city"), F.when(k % 10 == 2, "NEW").otherwise(F.col("c_name")).alias("phone"))


def _scd(spark, sf):
    return scd.apply_scd(_source(spark, sf), _versions(spark, sf), "customer_nk", "customer_sk", ["city"], ["phone"], "2000-06-01", first_key=10_000_000)


NEW_KEYS = "k AS (SELECT c_custkey, 9999999 + row_number() OVER (ORDER BY c_custkey::VARCHAR) AS sk FROM customer WHERE c_custkey % 10 IN (1, 9))"


@query(f"""WITH {NEW_KEYS} SELECT c_custkey + 1 AS customer_sk, c_custkey::VARCHAR AS customer_nk, c_mktsegment AS city, CASE WHEN c_custkey % 10 = 2 THEN 'NEW' ELSE c_name END AS phone, DATE '1995-01-01' AS effective_date,
CASE WHEN c_custkey % 10 IN (1, 8) THEN DATE '2000-05-31' END AS expiration_date, c_custkey % 10 NOT IN (1, 8) AS is_current FROM customer WHERE c_custkey % 10 <> 9
UNION ALL SELECT sk, c_custkey::VARCHAR, CASE WHEN c_custkey % 10 = 1 THEN 'MOVED' ELSE c_mktsegment || ' ' END, c_name, DATE '2000-06-01', NULL, true FROM k JOIN customer USING (c_custkey)""")
def scd_type2(spark, sf):
    return _scd(spark, sf)[0]


@query("SELECT c_custkey::VARCHAR AS customer_nk, 'NEW' AS phone FROM customer WHERE c_custkey % 10 = 2")
def scd_type1(spark, sf):
    return _scd(spark, sf)[0].filter("phone = 'NEW'").select("customer_nk", "phone")


@query("SELECT c_custkey::VARCHAR AS customer_nk, DATE '2000-05-31' AS expiration_date FROM customer WHERE c_custkey % 10 = 8")
def scd_vanished(spark, sf):
    log = _scd(spark, sf)
    return log[0].join(log[1].filter("action = 'EXPIRE'").select("nk"), F.col("customer_nk") == F.col("nk"), "left_semi").select("customer_nk", "expiration_date")


@query(f"""WITH {NEW_KEYS} SELECT c_custkey::VARCHAR AS nk, 'INSERT' AS action, NULL::BIGINT AS old_sk, sk::BIGINT AS new_sk FROM k WHERE c_custkey % 10 = 9
UNION ALL SELECT c_custkey::VARCHAR, 'UPDATE_T2_EXPIRE', c_custkey + 1, NULL FROM k WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey::VARCHAR, 'UPDATE_T2_NEW', c_custkey + 1, sk FROM k WHERE c_custkey % 10 = 1
UNION ALL SELECT c_custkey::VARCHAR, 'UPDATE_T1', c_custkey + 1, NULL FROM customer WHERE c_custkey % 10 = 2 UNION ALL SELECT c_custkey::VARCHAR, 'EXPIRE', c_custkey + 1, NULL FROM customer WHERE c_custkey % 10 = 8""")
def scd_change_log(spark, sf):
    return _scd(spark, sf)[1]


@query("SELECT row_number() OVER (ORDER BY c_custkey::VARCHAR)::BIGINT AS customer_sk, c_custkey::VARCHAR AS customer_nk, DATE '1900-01-01' AS effective_date, true AS is_current FROM customer")
def scd_initial_load(spark, sf):
    empty = _versions(spark, sf).limit(0)
    new = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_nk"), F.col("c_mktsegment").alias("city"), F.col("c_name").alias("phone"))
    return scd.apply_scd(new, empty, "customer_nk", "customer_sk", ["city"], ["phone"], "1900-01-01")[0].select("customer_sk", "customer_nk", "effective_date", "is_current")


def _changes(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    old = c.filter(k % 10 != 9)
    new = c.filter(k % 10 != 8).withColumn("c_acctbal", F.when(k % 10 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 10 != 3, F.col("c_mktsegment")))
    return cdc.diff(old, new, ["c_custkey"])


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 9")
def cdc_inserts(spark, sf):
    return _changes(spark, sf).filter("change_type = 'insert'").drop("change_type")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 IN (1, 3)")
def cdc_updates(spark, sf):
    return _changes(spark, sf).filter("change_type = 'update'").drop("change_type")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 8")
def cdc_deletes(spark, sf):
    return _changes(spark, sf).filter("change_type = 'delete'").drop("change_type")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 8")
def cdc_apply(spark, sf):
    return cdc.apply_changes(table(spark, sf, "customer").filter("c_custkey % 10 <> 9"), _changes(spark, sf), ["c_custkey"])


# ---- screens: orders with injected defects

DEFECTS = """d AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN 999999999 ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 83 = 0 THEN 'XX' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 79 = 0 THEN 'n/a' WHEN o_orderkey % 73 = 0 THEN '-1' ELSE '100' END AS price,
    CASE WHEN o_orderkey % 71 = 0 THEN '2099-01-01' WHEN o_orderkey % 67 = 0 THEN 'never' ELSE o_orderdate::DATE::VARCHAR END AS day, o_orderpriority, o_orderkey // 2 AS half, o_orderkey AS id FROM orders
)"""


def _defects(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.when(k % 97 != 0, k).alias("o_orderkey"), F.when(k % 89 == 0, 999999999).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(k % 83 == 0, "XX").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 79 == 0, "n/a").when(k % 73 == 0, "-1").otherwise("100").alias("price"), F.when(k % 71 == 0, "2099-01-01").when(k % 67 == 0, "never").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("day"),
        "o_orderpriority", F.floor(k / 2).alias("half"), k.alias("id"),
    )


def _screen_query(name: str, rule: Rule, where: str, actual: str, references: Callable | None = None, sql: str | None = None):
    def run(spark, sf):
        refs = references(spark, sf) if references else None
        found = screens.violations(screens.screen(_defects(spark, sf), [rule], "id", refs))
        return found.select(F.col("record_id").cast("long").alias("record_id"), "screen_name", "severity", "actual")

    sql = sql or f"WITH {DEFECTS} SELECT id AS record_id, '{rule.name}' AS screen_name, '{rule.severity}' AS severity, ({actual})::VARCHAR AS actual FROM d WHERE {where}"
    query(sql, name)(run)


_screen_query("screen_not_null", Rule("not_null", "O_ORDERKEY", "FATAL"), "o_orderkey IS NULL", "NULL")
_screen_query("screen_unique", Rule("unique", "half", "ERROR"), "half IN (SELECT half FROM d GROUP BY half HAVING count(*) > 1)", "half")
_screen_query("screen_unique_first", Rule("unique", "half", "ERROR", keep_first=True), "", "", sql=f"WITH {DEFECTS}, r AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY o_orderkey NULLS FIRST, o_custkey, o_orderstatus, price, day, o_orderpriority, id) AS n FROM d) SELECT id AS record_id, 'unique_half' AS screen_name, 'ERROR' AS severity, half::VARCHAR AS actual FROM r WHERE n > 1")
_screen_query("screen_max_length", Rule("max_length", "o_orderstatus", "ERROR", 1), "length(o_orderstatus) > 1", "o_orderstatus")
_screen_query("screen_min_length", Rule("min_length", "o_orderpriority", "WARN", 6), "length(o_orderpriority) < 6", "o_orderpriority")
_screen_query("screen_regex", Rule("regex", "o_orderpriority", "WARN", "[1-3]-|4"), "NOT regexp_matches(o_orderpriority, '^(?:[1-3]-|4)')", "o_orderpriority")
_screen_query("screen_numeric_range", Rule("numeric_range", "price", "ERROR", low=0, high=99), "TRY_CAST(price AS DOUBLE) < 0 OR TRY_CAST(price AS DOUBLE) > 99", "price")
_screen_query("screen_date_range", Rule("date_range", "day", "ERROR", low="1990-01-01", high="today"), "TRY_CAST(day AS DATE) > current_date OR TRY_CAST(day AS DATE) < DATE '1990-01-01'", "day")
_screen_query("screen_in_list", Rule("in_list", "o_orderstatus", "WARN", items=("O", "F", "P")), "o_orderstatus NOT IN ('O', 'F', 'P')", "o_orderstatus")
_screen_query("screen_expression", Rule("expression", "o_custkey", "ERROR", "o_custkey < 999999999"), "o_custkey = 999999999", "o_custkey")
_screen_query("screen_referential", Rule("referential", "o_custkey", "ERROR", references="customer.C_CUSTKEY"), "o_custkey NOT IN (SELECT c_custkey FROM customer)", "o_custkey", lambda spark, sf: {"customer": table(spark, sf, "customer")})


@query("""SELECT c_custkey AS record_id, CASE WHEN c_custkey % 2 = 0 THEN '12 45' ELSE '1' END AS actual FROM customer WHERE c_custkey % 5 <> 0 AND (c_nationkey % 3 = 0 OR c_nationkey % 3 = 1)""")
def screen_postal_country(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    c = table(spark, sf, "customer").select(k, F.when(n == 0, "Germany").when(n == 1, " France").otherwise("Atlantis").alias("Country"), F.when(k % 5 == 0, " 12345 ").when(k % 2 == 0, "12 45").otherwise("1").alias("PostalCode"))
    found = screens.violations(screens.screen(c, [Rule("postal_country", "postalcode", other="country")], "c_custkey"))
    return found.select(F.col("record_id").cast("long").alias("record_id"), "actual")


RULES = [
    Rule("not_null", "o_orderkey", "ERROR"), Rule("max_length", "o_orderstatus", "ERROR", 1), Rule("numeric_range", "price", "WARN", low=0),
    Rule("date_range", "day", "WARN", high="2030-01-01"), Rule("referential", "o_custkey", "ERROR", references="customer.c_custkey"), Rule("in_list", "o_orderpriority", "INFO", items=("1-URGENT",)),
]
FOUND = f"""{DEFECTS}, v AS (
  SELECT id, 'not_null_o_orderkey' AS screen_name, 'ERROR' AS severity FROM d WHERE o_orderkey IS NULL
  UNION ALL SELECT id, 'max_length_o_orderstatus', 'ERROR' FROM d WHERE length(o_orderstatus) > 1
  UNION ALL SELECT id, 'numeric_range_price', 'WARN' FROM d WHERE price = '-1'
  UNION ALL SELECT id, 'date_range_day', 'WARN' FROM d WHERE day = '2099-01-01'
  UNION ALL SELECT id, 'referential_o_custkey', 'ERROR' FROM d WHERE o_custkey = 999999999
  UNION ALL SELECT id, 'in_list_o_orderpriority', 'INFO' FROM d WHERE o_orderpriority <> '1-URGENT'
)"""


def _screened(spark, sf) -> DataFrame:
    return screens.screen(_defects(spark, sf), RULES, "id", {"customer": table(spark, sf, "customer")})


@query(f"WITH {FOUND} SELECT id AS record_id, screen_name, severity FROM v WHERE severity <> 'INFO'")
def error_events(spark, sf):
    events = screens.error_events(screens.violations(_screened(spark, sf)), "b1", "tests", "orders")
    return events.select(F.col("source_record_pk").cast("long").alias("record_id"), "screen_name", F.col("screen_severity").alias("severity"))


@query(f"WITH {FOUND} SELECT id, id IN (SELECT id FROM v WHERE severity = 'ERROR') AS quarantined FROM d")
def quarantine_split(spark, sf):
    s = _screened(spark, sf)
    return screens.clean_rows(s).select("id", F.lit(False).alias("quarantined")).unionByName(screens.quarantined_rows(s).select("id", F.lit(True).alias("quarantined")))


@query(f"WITH {FOUND} SELECT coalesce(severity, 'TOTAL') AS severity, count(*)::BIGINT AS n FROM v GROUP BY ROLLUP (severity)")
def severity_summary(spark, sf):
    return screens.severity_summary(screens.violations(_screened(spark, sf)))


@query(f"""WITH {FOUND}, c AS (SELECT count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARN') AS w, (SELECT count(*) FROM d) AS n FROM v)
SELECT n::BIGINT AS extract_row_count, e::BIGINT AS reject_row_count, round(greatest(0, 1 - (10 * e + 3 * w)::DOUBLE / (10 * greatest(n, 1))), 4) AS quality_score, e + w > 0 AS has_anomalies FROM c""")
def audit_quality_score(spark, sf):
    s = _screened(spark, sf)
    return plain(audit.build_audit(screens.violations(s), s, "b1", "tests", "orders").select("extract_row_count", "reject_row_count", "quality_score", "has_anomalies"))


@query("SELECT count(*)::BIGINT AS current, 50000.0::DOUBLE AS expected, abs(count(*) - 50000.0::DOUBLE) / 50000 * 100 AS drift_pct, abs(count(*) - 50000.0::DOUBLE) / 50000 * 100 > 10 AS violated FROM lineitem")
def screen_row_count_drift(spark, sf):
    return screens.row_count_drift(table(spark, sf, "lineitem"), 50000, 10)


@query("SELECT round(avg(l_quantity), 6) AS current, 20.0::DOUBLE AS expected, round(abs(avg(l_quantity) - 20) / 20 * 100, 6) AS drift_pct, abs(avg(l_quantity) - 20) / 20 * 100 > 10 AS violated FROM lineitem")
def screen_mean_drift(spark, sf):
    return screens.mean_drift(table(spark, sf, "lineitem"), "l_quantity", 20, 10).withColumns({c: F.round(c, 6) for c in ("current", "drift_pct")})


@query(" UNION ALL ".join(f"SELECT count(*)::BIGINT AS rows, '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def column_baseline(spark, sf):
    out = screens.column_baseline(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


# ---- conformance

@query(f"""WITH {SQL_CUSTOMERS} SELECT 'dim_customer' AS dim, 'null_key' AS "check", 0::BIGINT AS n UNION ALL SELECT 'dim_customer', 'duplicate_nk', 0 UNION ALL SELECT 'dim_geography', 'null_key', 0 UNION ALL SELECT 'dim_geography', 'duplicate_nk', 0
UNION ALL SELECT 'dim_customer', 'orphan_country_code', count(*) FROM dc""")
def qa_conformed(spark, sf):
    keys = {"dim_customer": ("customer_sk", "customer_nk"), "dim_geography": ("geography_sk", "country_code")}
    return serve.conformance_faults(dimensions(spark, sf), keys, [("dim_customer", "country_code", "dim_geography", "country_code")])


@query("SELECT c_custkey::VARCHAR AS nk, 'current_count' AS fault FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'overlap' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 = 0")
def qa_scd_invariants(spark, sf):
    k = F.col("customer_nk").cast("long")
    broken = customer_history(spark, sf).withColumn("is_current", F.when(k % 4 == 0, True).otherwise(F.col("is_current"))).withColumn("expiration_date", F.when(k % 5 == 0, F.lit("1999-01-01").cast("date")).otherwise(F.col("expiration_date")))
    return scd.version_faults(broken, "customer_nk", "customer_sk")


PHONE = "CASE c_custkey % 4 WHEN 0 THEN '(503) 555-' || c_custkey WHEN 1 THEN 'none' WHEN 2 THEN '030.' || c_custkey END"
COUNTRY = "CASE c_nationkey % 4 WHEN 0 THEN ' Germany' WHEN 1 THEN 'UK' WHEN 2 THEN 'Ruritania ' END"


def _contacts(spark, sf) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    return table(spark, sf, "customer").select(k, F.when(k % 4 == 0, F.concat(F.lit("(503) 555-"), k)).when(k % 4 == 1, "none").when(k % 4 == 2, F.concat(F.lit("030."), k)).alias("phone"), F.when(n == 0, " Germany").when(n == 1, "UK").when(n == 2, "Ruritania ").alias("country"))


@query(f"SELECT c_custkey, CASE trim({COUNTRY}) WHEN 'Germany' THEN 'DE' WHEN 'UK' THEN 'GB' ELSE trim({COUNTRY}) END AS country_code FROM customer")
def standardize_country(spark, sf):
    return standardize(_contacts(spark, sf), [Transform("Country", "standardize_country", "country_code")]).select("c_custkey", "country_code")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN p WHEN c_nationkey % 4 = 0 THEN '+49-' || g WHEN c_nationkey % 4 = 1 THEN '+44-' || g ELSE g END AS phone
FROM (SELECT *, {PHONE} AS p, regexp_replace({PHONE}, '[^0-9]', '', 'g') AS g FROM customer)""")
def standardize_phone(spark, sf):
    rules = [Transform("country", "standardize_country", "country_code"), Transform("phone", "standardize_phone", country="country_code")]
    return standardize(_contacts(spark, sf), rules).select("c_custkey", "phone")


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' D.F. O''Neil' AS title FROM part")
def title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_case(F.concat(F.col("p_name"), F.lit(" d.F. o'NEIL "))).alias("title"))


# ---- clusters: suppliers with names from a hash, two of a kind

NAMES = "n AS (SELECT s_suppkey, substr(md5((s_suppkey // 2)::VARCHAR), 1, 14) || CASE WHEN s_suppkey % 2 = 1 THEN 'x' ELSE '' END AS name, 'city' || (s_suppkey // 10) AS city FROM supplier)"
PAIRS = f"{NAMES}, s AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(0.7 * jaro_winkler_similarity(a.name, b.name) + 0.3 * jaro_winkler_similarity(a.city, b.city), 6) AS score FROM n a JOIN n b ON a.s_suppkey < b.s_suppkey)"
FIELDS = {"name": 0.7, "city": 0.3}


def _suppliers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.substring(F.md5(F.floor(k / 2).cast("string")), 1, 14), F.when(k % 2 == 1, "x").otherwise(""))
    return table(spark, sf, "supplier").select(k, name.alias("name"), F.concat(F.lit("city"), F.floor(k / 10)).alias("city"))


@query(f"WITH {PAIRS} SELECT a, b, score FROM s WHERE score >= 0.85")
def match_score(spark, sf):
    rows = _suppliers(spark, sf).withColumn("_ord", F.col("s_suppkey"))
    return dedup.scored_pairs(rows, FIELDS, 0.85)


@query(f"WITH {NAMES} SELECT format('cluster_{{:06d}}', dense_rank() OVER (ORDER BY s_suppkey // 20)) AS cluster_id, s_suppkey AS nk FROM n")
def dedup_exact(spark, sf):
    rows = _suppliers(spark, sf).withColumn("group", F.concat(F.lit(" G"), F.floor(F.col("s_suppkey") / 20)))
    return dedup.find_clusters(rows, "x", key="s_suppkey", fields={"group": 1.0})


@query(f"""WITH RECURSIVE {PAIRS}, l AS (SELECT a, b FROM s WHERE score >= 0.85 UNION ALL SELECT b, a FROM s WHERE score >= 0.85), r AS (SELECT s_suppkey AS id, s_suppkey AS o FROM n UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a),
m AS (SELECT id, min(o) AS first FROM r GROUP BY id) SELECT format('cluster_{{:06d}}', dense_rank() OVER (ORDER BY first)) AS cluster_id, id AS nk FROM m""")
def dedup_clusters(spark, sf):
    return dedup.find_clusters(_suppliers(spark, sf), "x", key="s_suppkey", fields=FIELDS)


# ---- golden records: events of a user are a cluster

def _members(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("_ord"), "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.col("ts").cast("string").alias("_extract_ts"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("_source"))


@query("SELECT user_id AS cluster_id, arg_max(event_type, length(event_type) * 1000000000 - event_id) AS event_type, arg_min(value, event_id) FILTER (event_id % 3 <> 0) AS value FROM events GROUP BY user_id")
def survivor_longest(spark, sf):
    return survivorship.golden_records(_members(spark, sf)).select("cluster_id", "event_type", "value")


@query("SELECT user_id AS cluster_id, first(CASE WHEN event_id % 3 <> 0 THEN value END ORDER BY ts DESC, event_id) AS value FROM events GROUP BY user_id")
def survivor_recent(spark, sf):
    return survivorship.golden_records(_members(spark, sf), {"value": {"rule": "most_recent"}}).select("cluster_id", "value")


@query("""WITH m AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, event_id % 4 AS s FROM events), f AS (SELECT user_id, s, arg_min(struct_pack(x := v), event_id).x AS v FROM m GROUP BY user_id, s)
SELECT user_id AS cluster_id, coalesce((SELECT v FROM f WHERE f.user_id = m.user_id AND s = 2), (SELECT v FROM f WHERE f.user_id = m.user_id AND s = 0), arg_min(v, event_id) FILTER (v IS NOT NULL)) AS value FROM m GROUP BY user_id""")
def survivor_source(spark, sf):
    return survivorship.golden_records(_members(spark, sf), {"value": {"rule": "prefer_source", "priority": ["s2", "s0"]}}).select("cluster_id", "value")


@query("SELECT user_id AS cluster_id, arg_max(event_type, length(event_type) * 1000000000 - event_id) AS event_type FROM events GROUP BY user_id")
def survivor_unknown_rule(spark, sf):
    """A rule that does not exist is the longest value, with a warning."""
    return survivorship.golden_records(_members(spark, sf), {"event_type": {"rule": "no such rule"}}).select("cluster_id", "event_type")


# ---- rules from files

def _config(content: str) -> str:
    """A file that only the driver reads."""
    with tempfile.NamedTemporaryFile("w", suffix=".yaml", delete=False) as f:
        f.write(content)
    return f.name


@query(f"""SELECT c_custkey, CASE trim({COUNTRY}) WHEN 'Germany' THEN 'DE' WHEN 'UK' THEN 'GB' ELSE trim({COUNTRY}) END AS code,
CASE WHEN c_custkey % 4 = 1 THEN p WHEN c_nationkey % 4 = 0 THEN '+49-' || g WHEN c_nationkey % 4 = 1 THEN '+44-' || g ELSE g END AS phone
FROM (SELECT *, {PHONE} AS p, regexp_replace({PHONE}, '[^0-9]', '', 'g') AS g FROM customer)""")
def standardize_by_rules(spark, sf):
    rules = _config("entities:\n  people:\n    - {column: country, transform: standardize_country, output_column: code}\n    - {column: phone, transform: standardize_phone, country_column: code}\n    - {column: absent, transform: title_case}\n")
    return standardize(_contacts(spark, sf), transforms_from_yaml(rules, "people")).select("c_custkey", "code", "phone")


@query(f"WITH {FOUND} SELECT id AS record_id, screen_name, severity FROM v WHERE screen_name IN ('not_null_o_orderkey', 'numeric_range_price', 'referential_o_custkey')")
def screens_by_rules(spark, sf):
    rules = _config(
        "screens:\n  orders:\n    column_property:\n      - {column: o_orderkey, rule: not_null, severity: ERROR}\n      - {column: price, rule: numeric_range, min: 0}\n"
        "    structure:\n      - {column: o_custkey, references: customer.c_custkey}\n"
    )
    found = screens.violations(screens.screen(_defects(spark, sf), screens.rules_from_yaml(rules, "orders"), "id", {"customer": table(spark, sf, "customer")}))
    return found.select(F.col("record_id").cast("long").alias("record_id"), "screen_name", "severity")


FEWER = "l_linenumber <= 3"
DRIFTED = f"""SELECT 'reasonability.row_count' AS screen_name, 'WARN' AS severity, a || ' ± 20.0%' AS expected, b::VARCHAR AS actual FROM (SELECT count(*) AS a, count(*) FILTER ({FEWER}) AS b FROM lineitem)
UNION ALL SELECT 'reasonability.column_mean', 'ERROR', printf('mean ≈ %.4f ± 10.0%%', a), printf('%.4f', b) FROM (SELECT round(avg(l_linenumber), 6) AS a, avg(l_linenumber) FILTER ({FEWER}) AS b FROM lineitem)"""


@query(DRIFTED)
def reasonability_events(spark, sf):
    """Lines 1 to 3 of all orders against all lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    baseline, _ = screens.profile(lines)
    rules = [screens.Drift("row_count"), screens.Drift("column_mean", "ERROR", None, 10.0, "L_LINENUMBER"), screens.Drift("column_mean", "ERROR", None, 10.0, "l_quantity")]
    found = screens.drift_violations(baseline, *screens.profile(lines.filter(FEWER)), rules)
    return spark.createDataFrame(found, "record_id string, screen_name string, severity string, column_name string, expected string, actual string").select("screen_name", "severity", "expected", "actual")


@query(DRIFTED)
def baseline_round_trip(spark, sf):
    """The same through the stored baseline and rules from a file: one run over all lines, the next over lines 1 to 3."""
    rules = _config("screens:\n  lines:\n    reasonability:\n      - {metric: row_count}\n      - {metric: column_mean, column: l_linenumber, tolerance_pct: 10, severity: ERROR}\n")
    s = warehouse.Settings(new_path(spark, "baselines"), rules=rules)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    warehouse.drift(spark, s, "lines", lines)
    found = warehouse.drift(spark, s, "lines", lines.filter(FEWER))
    return spark.createDataFrame(found, "record_id string, screen_name string, severity string, column_name string, expected string, actual string").select("screen_name", "severity", "expected", "actual")


# ---- loading

OLD_NEW = "a AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 3 = 0)"


def _old_new(spark, sf):
    c = table(spark, sf, "customer")
    return c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))


@query(f"WITH {OLD_NEW} SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def upsert_insert_ignore(spark, sf):
    return upsert.insert_ignore(*_old_new(spark, sf), ["k"])


@query(f"WITH {OLD_NEW} SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b)")
def upsert_replace(spark, sf):
    return upsert.insert_replace(*_old_new(spark, sf), ["k"])


# ---- late data, bridges, currencies

@query(f"""WITH {SQL_CUSTOMERS} SELECT o_orderkey, dc.customer_sk::BIGINT AS customer_sk FROM orders JOIN dc ON dc.customer_nk = o_custkey::VARCHAR AND effective_date <= o_orderdate::DATE AND (expiration_date IS NULL OR expiration_date >= o_orderdate::DATE)""")
def late_arriving_fact(spark, sf):
    return late.late_facts(table(spark, sf, "orders"), customer_history(spark, sf), PIT).select("o_orderkey", "customer_sk")


LATE_NEW = "z AS (SELECT c_custkey, (SELECT max(c_custkey * 2 + CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) FROM customer) + row_number() OVER (ORDER BY c_custkey::VARCHAR) AS sk FROM customer WHERE c_custkey % 20 = 7)"


def _late(spark, sf):
    changes = table(spark, sf, "customer").filter("c_custkey % 20 = 7").select(F.col("c_custkey").cast("string").alias("customer_nk"), F.lit("1996-07-01").alias("effective_date"), F.lit("Renamed").alias("company_name"))
    return late.late_dimension(customer_history(spark, sf), changes, "customer_nk", "customer_sk")


@query(f"""WITH {SQL_CUSTOMERS}, {LATE_NEW}, h AS (SELECT dc.*, z.sk FROM dc LEFT JOIN z ON z.c_custkey::VARCHAR = dc.customer_nk AND effective_date <= DATE '1996-07-01' AND (expiration_date IS NULL OR expiration_date >= DATE '1996-07-01'))
SELECT customer_sk, customer_nk, company_name, effective_date, CASE WHEN sk IS NOT NULL THEN DATE '1996-06-30' ELSE expiration_date END AS expiration_date, is_current AND sk IS NULL AS is_current FROM h
UNION ALL SELECT sk, customer_nk, 'Renamed', DATE '1996-07-01', expiration_date, is_current FROM h WHERE sk IS NOT NULL""")
def late_arriving_dimension(spark, sf):
    return _late(spark, sf)[0].select("customer_sk", "customer_nk", "company_name", "effective_date", "expiration_date", "is_current")


@query(f"""WITH {SQL_CUSTOMERS}, {LATE_NEW} SELECT o_orderkey, coalesce(CASE WHEN o_orderdate::DATE >= DATE '1996-07-01' AND (dc.expiration_date IS NULL OR o_orderdate::DATE <= dc.expiration_date) AND dc.effective_date <= DATE '1996-07-01' THEN z.sk END, dc.customer_sk)::BIGINT AS customer_sk
FROM orders JOIN dc ON dc.customer_nk = o_custkey::VARCHAR AND effective_date <= o_orderdate::DATE AND (expiration_date IS NULL OR expiration_date >= o_orderdate::DATE) LEFT JOIN z ON z.c_custkey = o_custkey""")
def late_arriving_repoint(spark, sf):
    facts = lookup.resolve_point_in_time(table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date")), customer_history(spark, sf), PIT)
    return late.repoint(facts, _late(spark, sf)[1], "customer_sk", "day").select("o_orderkey", "customer_sk")


SEVERAL = ("1995-01-01", "1996-07-01", "1998-01-01", "1999-05-05")


def _several(spark, sf):
    """Customers ending in 7 change four times: within the first version, on the day the second one starts, and after it."""
    days = F.explode(F.array(*map(F.lit, SEVERAL)))
    changes = table(spark, sf, "customer").filter("c_custkey % 10 = 7").select(F.col("c_custkey").cast("string").alias("customer_nk"), days.alias("effective_date"))
    return late.late_dimension(customer_history(spark, sf), changes.withColumn("company_name", F.concat(F.lit("from "), "effective_date")), "customer_nk", "customer_sk")


@query(f"""WITH {SQL_CUSTOMERS}, z AS (SELECT c_custkey::VARCHAR AS nk, d::DATE AS d FROM customer, (VALUES {', '.join(f"('{d}')" for d in SEVERAL)}) t(d) WHERE c_custkey % 10 = 7),
b AS (SELECT customer_nk, company_name, effective_date FROM dc WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.nk = dc.customer_nk AND z.d = dc.effective_date) UNION ALL SELECT nk, 'from ' || d, d FROM z),
e AS (SELECT *, lead(effective_date) OVER (PARTITION BY customer_nk ORDER BY effective_date) - 1 AS expiration_date FROM b) SELECT *, expiration_date IS NULL AS is_current FROM e""")
def late_arriving_several(spark, sf):
    return _several(spark, sf)[0].select("customer_nk", "company_name", "effective_date", "expiration_date", "is_current")


@query("SELECT 0::BIGINT AS faults, 0::BIGINT AS repeated")
def late_arriving_keys(spark, sf):
    """Versions still follow each other and no surrogate key is given twice."""
    dim = _several(spark, sf)[0]
    faults = scd.version_faults(dim, "customer_nk", "customer_sk").agg(F.count("*").alias("faults"))
    return faults.crossJoin(dim.agg((F.count("*") - F.count_distinct("customer_sk")).alias("repeated")))  # one row each


@query("SELECT l_orderkey, l_suppkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def bridge_weights(spark, sf):
    return late.bridge(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN (((o_totalprice * 100)::DECIMAL(18, 0)::HUGEINT * 8 * 2 + 10) // 20)::BIGINT / 100.0::DOUBLE END AS usd FROM orders""")
def fx_conform(spark, sf):
    rates = spark.sql("SELECT map('USD', 1.0D, 'EUR', 1.25D) AS rates")
    o = table(spark, sf, "orders").withColumn("cur", F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("XXX")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return plain(late.to_currency(o, late.rates_from_json(rates), "o_totalprice", "cur", "usd").select("o_orderkey", "usd"))


# ---- serving

def _marts(spark, sf) -> dict[str, DataFrame]:
    """The warehouse's tables with padded codes and unknown members; every fifth product and supplier is an old version."""
    k, s = F.col("s_suppkey"), table(spark, sf, "supplier")
    customers = customer_history(spark, sf).withColumn("country_code", F.rpad("country_code", 20, " "))
    products = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("product_sk"), F.col("p_partkey").alias("product_nk"), F.col("p_name").alias("product_name"), F.rpad(F.lit("US"), 5, " ").alias("supplier_country"),
        F.col("p_retailprice").alias("unit_price"), (F.col("p_partkey") % 5 != 0).alias("is_current"),
    )
    employees = s.select((k + 1).alias("employee_sk"), k.alias("employee_nk"), F.col("s_name").alias("full_name"), F.floor(k / 2).alias("reports_to_nk"), F.lit("GB ").alias("country_code"), (k % 5 != 0).alias("is_current"))
    return {
        "dim_customer": customers.unionByName(spark.sql("SELECT -1L AS customer_sk, 'UNKNOWN' AS customer_nk, 'ZZ' AS country_code, true AS is_current"), allowMissingColumns=True),
        "dim_product": products.unionByName(spark.sql("SELECT -1L AS product_sk, true AS is_current"), allowMissingColumns=True),
        "dim_employee": employees.unionByName(spark.sql("SELECT -1L AS employee_sk, true AS is_current"), allowMissingColumns=True),
        "dim_shipper": s.select((k + 1).alias("shipper_sk"), k.alias("shipper_nk"), F.col("s_name").alias("company_name")).unionByName(spark.sql("SELECT -1L AS shipper_sk"), allowMissingColumns=True),
        "dim_geography": dims.with_unknown(geography(spark), "dim_geography").withColumn("country_code", F.rpad("country_code", 4, " ")),
        "dim_date": dims.dim_date(spark, 1995, 1996, sentinel=True),
        "fact_sales": the_fact(spark, sf),
    }


def _staged(name: str, columns: str, sql: str):
    def run(spark, sf):
        serve.register_views(spark, _marts(spark, sf))
        return plain(spark.sql(f"SELECT {columns} FROM {name}"))

    query(sql, "staging_views" if name == "stg_customers" else name.replace("stg_", "staging_"))(run)


_staged("stg_customers", "customer_sk, customer_code, country_code", f"WITH {SQL_CUSTOMERS} SELECT customer_sk, customer_nk AS customer_code, trim(country_code) AS country_code FROM dc WHERE is_current")
_staged("stg_products", "product_sk, product_code, supplier_country_code, unit_price", "SELECT p_partkey + 1 AS product_sk, p_partkey AS product_code, 'US' AS supplier_country_code, p_retailprice AS unit_price FROM part WHERE p_partkey % 5 <> 0")
_staged("stg_employees", "employee_sk, employee_code, reports_to_code, country_code", "SELECT s_suppkey + 1 AS employee_sk, s_suppkey AS employee_code, s_suppkey // 2 AS reports_to_code, 'GB' AS country_code FROM supplier WHERE s_suppkey % 5 <> 0")
_staged("stg_shippers", "shipper_sk, shipper_code, company_name", "SELECT s_suppkey + 1 AS shipper_sk, s_suppkey AS shipper_code, s_name AS company_name FROM supplier")
_staged("stg_geography", "geography_sk, country_code, primary_currency", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{c[0]}', '{c[4]}')" for i, c in enumerate(sorted(text.COUNTRIES), 1)) + ") t(geography_sk, country_code, primary_currency)")
_staged("stg_dates", "date_sk, full_date", "SELECT strftime(d, '%Y%m%d')::INT AS date_sk, d::DATE AS full_date FROM generate_series(DATE '1995-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(d)")
_staged("stg_sales", "order_id, line_number, net_amount", f"WITH {SQL_FACT} SELECT order_id, line_number, net_amount FROM f")


@query(f"""WITH {SQL_FACT}, c AS (SELECT count(*) FILTER (order_id % 50 = 0) AS n, count(*) FILTER (order_id % 40 = 0) AS s, count(*) FILTER (order_id % 60 = 0) AS q FROM f)
SELECT * FROM (SELECT 'fact_sales' AS table_name, 'not_null_customer_sk' AS screen_name, 'customer_sk' AS column_name, n FROM c UNION ALL SELECT 'stg_sales', 'not_null_customer_sk', 'customer_sk', n FROM c
UNION ALL SELECT 'fact_sales', 'referential_shipper_sk', 'shipper_sk', s FROM c UNION ALL SELECT 'stg_sales', 'expression_quantity', 'quantity', q FROM c
UNION ALL SELECT 'dim_shipper', 'unique_shipper_sk', 'shipper_sk', 2) WHERE n > 0""")
def mart_tests(spark, sf):
    """Facts with injected defects and a shipper that is there twice, against the rules of the delivered tables."""
    k, f = F.col("order_id"), the_fact(spark, sf)
    broken = f.withColumns({"customer_sk": F.when(k % 50 != 0, F.col("customer_sk")), "shipper_sk": F.when(k % 40 == 0, 99).otherwise(F.col("shipper_sk")), "quantity": F.when(k % 60 == 0, -1).otherwise(F.col("quantity"))})
    shippers = spark.sql("SELECT * FROM VALUES (-1L, -1), (1L, 1), (2L, 2), (3L, 3), (3L, 4) t(shipper_sk, shipper_nk)")
    return serve.mart_faults({"dim_customer": customer_history(spark, sf), "dim_shipper": shippers, "fact_sales": broken}, {n: r for n, r in serve.mart_rules().items() if n != "stg_shippers"})


@query("SELECT c_custkey AS customer_sk, c_name AS company_name, '***-****' AS phone_masked FROM customer")
def masked_customer(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_sk"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("phone"), F.lit("hidden").alias("address"))
    return serve.masked_customer(c)


ASSIGNED = "SELECT o_orderkey, o_custkey AS customer_sk FROM orders"


@query(f"{ASSIGNED} WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2'))")
def row_level_filter(spark, sf):
    return _rows_for(spark, sf, "ana")


@query(ASSIGNED)
def row_level_unrestricted(spark, sf):
    return _rows_for(spark, sf, "nobody")


def _rows_for(spark, sf, user):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_sk"), F.concat(F.col("n_name"), F.lit("  ")).alias("country_code"))
    given = spark.sql("SELECT * FROM VALUES ('ana', 'NATION_1'), ('ana', 'NATION_2'), ('bob', 'NATION_3') t(username, country_code)")
    return serve.rows_for(user, table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_sk")), c, given)


@query("SELECT event_id, ts AS started_at FROM events ORDER BY ts DESC, event_id LIMIT 5")
def recent_runs_topk(spark, sf):
    return serve.recent_runs(table(spark, sf, "events").select("event_id", F.col("ts").alias("started_at")), 5)


# ---- files

TYPED = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0")
def source_csv(spark, sf):
    """Customers through CSV, with NULL texts, and every thirteenth line one field too long (so skipped)."""
    path, k = new_path(spark, "csv"), F.col("c_custkey")
    shown = [F.when(k % 7 == 0, "NULL").otherwise(F.col(c)).alias(c) if c == "c_mktsegment" else F.col(c).cast("string").alias(c) for c in table(spark, sf, "customer").columns]
    c = table(spark, sf, "customer").select(k.alias("_k"), *shown)
    line = F.concat(F.concat_ws(",", *(n for n in c.columns if n != "_k")), F.when(F.col("_k") % 13 == 0, ",more").otherwise(""))
    c.select(line.alias("value")).write.text(path)
    return read_csv(spark, path, TYPED, header=False)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def source_csv_strings(spark, sf):
    """The later of two snapshots, without a schema: all strings, and a header with blanks around its names."""
    folder, c = new_path(spark, "raw"), table(spark, sf, "customer")
    lines = spark.sql("SELECT 0 AS k, ' c_custkey , c_name' AS value").unionByName(c.select((F.col("c_custkey") + 1).alias("k"), F.concat_ws(",", "c_custkey", "c_name").alias("value")))
    lines.limit(0).select("value").write.text(f"{folder}/2024-01-01-000000/customers.csv")
    lines.repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(f"{folder}/2024-01-02-000000/customers.csv")
    return read_csv(spark, f"{latest_in(spark, folder)}/customers.csv")


@query("SELECT n_nationkey, n_name FROM nation")
def source_json(spark, sf):
    """The nations as one JSON array, as a REST source would send them."""
    path = new_path(spark, "json")
    table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    return read_json(spark, path, "n_nationkey INT, n_name STRING")


@query("SELECT format('cluster_{:06d}', dense_rank() OVER (ORDER BY s_suppkey // 20)) AS cluster_id, s_suppkey AS nk FROM supplier")
def cluster_map(spark, sf):
    """Clusters stored twice at one place, the second time from what is there, and read back."""
    path = f"{new_path(spark, 'clusters')}/suppliers"
    write_table(dedup_exact(spark, sf), path)
    write_table(spark.read.parquet(path), path)
    return spark.read.parquet(path)


@query("SELECT * FROM (VALUES ('first', 1::BIGINT), ('block', 2), ('after', 7), ('noted', 101), ('other', 1)) t(step, sk)")
def key_sequence(spark, sf):
    keys = KeySequence(spark, f"{new_path(spark, 'keys')}.json")
    steps = [("first", keys.next("d")), ("block", keys.reserve("d", 5)[0]), ("after", keys.next("d"))]
    keys.at_least("d", 100)
    keys.at_least("d", 50)
    return spark.createDataFrame([*steps, ("noted", keys.next("d")), ("other", keys.next("e"))], "step string, sk long")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'Unknown'")
def publish_dimension(spark, sf):
    store = DimensionStore(spark, new_path(spark, "published"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    store.publish("customer", c, "b1")
    store.publish("customer", c.unionByName(spark.sql("SELECT -1L AS c_custkey, 'Unknown' AS c_name")), "b2")
    return store.latest("customer")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1")
def crc_index(spark, sf):
    """Yesterday's table through the saved index, against today's."""
    folder, c = new_path(spark, "crc"), table(spark, sf, "customer")
    save_crc_index(cdc.with_crc(c), folder, "customer")
    today = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return cdc.diff(load_crc_index(spark, folder, "customer"), today, ["c_custkey"]).select("c_custkey")


# ---- streams


def _stream(spark, sf) -> tuple[str, str]:
    """Orders as events, with every tenth line broken, through a stream to Parquet. (good, dead letters)"""
    o = orders(spark, sf)
    lines = encode_orders(o).withColumn("value", F.when(F.col("key").cast("long") % 10 == 0, F.substring("value", 1, 20)).otherwise(F.col("value")))
    folder = new_path(spark, "stream-in")
    produce_files(lines, folder)
    good, dead, state = (new_path(spark, f"stream-{x}") for x in ("good", "dead", "state"))
    for q in ingest(read_lines(spark, folder), good, state, ["OrderID", "CustomerID", "ShipCountry"], dead):
        q.awaitTermination()
    return good, dead


@query("""SELECT o_orderkey::VARCHAR AS "OrderID", o_custkey::VARCHAR AS "CustomerID", CASE o_orderkey % 6 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' WHEN 2 THEN 'USA' WHEN 3 THEN 'Brasil' WHEN 4 THEN 'Holland' ELSE 'Freedonia' END AS "ShipCountry", 'ORDER_CREATED' AS event_type FROM orders WHERE o_orderkey % 10 <> 0""")
def stream_ingest(spark, sf):
    return spark.read.parquet(_stream(spark, sf)[0]).select("OrderID", "CustomerID", "ShipCountry", "event_type")


@query("SELECT 'not an event' AS problem, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 10 = 0")
def stream_dead_letter(spark, sf):
    return spark.read.parquet(_stream(spark, sf)[1]).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey::VARCHAR AS \"OrderID\", 'ORDER_UPDATED' AS event_type FROM orders")
def event_envelope(spark, sf):
    return flatten(decode(encode_orders(orders(spark, sf), event_type="ORDER_UPDATED")), ["OrderID"]).select("OrderID", "event_type")


@query("SELECT o_orderkey::VARCHAR AS key FROM orders ORDER BY o_orderkey LIMIT 7")
def stream_limit(spark, sf):
    return encode_orders(orders(spark, sf).orderBy("orderID"), limit=7).select("key")


@query("SELECT o_orderkey::VARCHAR AS \"OrderID\" FROM orders WHERE o_orderkey % 4 = 0")
def stream_paced(spark, sf):
    """A quarter of the orders sent in four batches, read back as a table."""
    folder, o = new_path(spark, "paced"), orders(spark, sf).filter("orderID % 4 = 0")
    n = o.count()
    sent = produce_paced(encode_orders(o), lambda batch: produce_files(batch, folder), -(-n // 4), 0.0)
    if sent != n:
        raise ValueError(f"{sent} of {n} events were sent")
    return flatten(decode(spark.read.text(folder)), ["OrderID"]).select("OrderID")


@query("SELECT o_orderkey::VARCHAR AS orderid, o_custkey::VARCHAR AS customerid FROM orders")
def stream_reaches_clean(spark, sf):
    """Even orders from a raw snapshot, odd ones from the stream's table, through the clean phase."""
    s, o = warehouse.Settings(new_path(spark, "etl")), orders(spark, sf).select("orderID", "customerID")
    lines = spark.sql("SELECT -1L AS k, 'orderID,customerID' AS value").unionByName(o.filter("orderID % 2 = 0").select(F.col("orderID").alias("k"), F.concat_ws(",", "orderID", "customerID").alias("value")))
    lines.repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(s.path("raw", s.system, "2024-01-01-000000", "orders.csv"))
    streamed = flatten(decode(encode_orders(o.filter("orderID % 2 = 1"))), ["OrderID", "CustomerID"]).select("OrderID", "CustomerID")
    warehouse.run_pipeline(spark, s, "b1", only="clean", streamed_orders=streamed)
    out = warehouse.cleaned(spark, s)["orders"]
    return out.toDF(*(c.lower() for c in out.columns)).select("orderid", "customerid")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf)
    out = new_path(spark, "windows")
    save_windows(tumbling_counts(stream, "ts", "event_type", "1 hour"), out, new_path(spark, "windows-state")).awaitTermination()
    latest = latest_windows(spark, out, ["window_start", "event_type"])
    return latest.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts))::BIGINT AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return sessions(table(spark, sf, "events"), "user_id", "ts").select("user_id", F.unix_micros("session_start").alias("session_start"), "n")
