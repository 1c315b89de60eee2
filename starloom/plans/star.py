"""The star schema over the TPC-H-like test tables: which table plays which entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.standardize import geography
from starloom.storage import written

#: Country names that orders are shipped to, by key.
SHIP_COUNTRIES = ("Germany", "France", "USA", "Brasil", "Holland", "Freedonia")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    country = F.element_at(F.array(*map(F.lit, SHIP_COUNTRIES)), (F.col("o_orderkey") % len(SHIP_COUNTRIES) + 1).cast("int"))
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("orderID"), F.col("o_custkey").alias("customerID"), F.lit(None).cast("int").alias("employeeID"), day.alias("orderDate"), F.date_add(day, 7).alias("requiredDate"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(day, 3)).alias("shippedDate"), (F.col("o_orderkey") % 4 + 1).alias("shipVia"), F.col("o_totalprice").alias("freight"), country.alias("shipCountry"),
    )


def order_details(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderID"), F.col("l_partkey").alias("productID"), F.col("l_extendedprice").alias("unitPrice"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")
    )


def customer_history(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with c_custkey % 3 = 0 have a second version from 1998-01-01."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.withColumn("v", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    two = F.col("c_custkey") % 3 == 0
    return v.select(
        (F.col("c_custkey") * 2 + F.col("v")).alias("customer_sk"), F.col("c_custkey").cast("string").alias("customer_nk"), F.col("c_name").alias("company_name"), F.col("n_name").alias("country_code"),
        F.when(F.col("v") == 2, F.lit("1998-01-01")).otherwise(F.lit("1900-01-01")).cast("date").alias("effective_date"),
        F.when(two & (F.col("v") == 1), F.lit("1997-12-31").cast("date")).alias("expiration_date"), (~two | (F.col("v") == 2)).alias("is_current"),
    )


def dimensions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("product_sk"), F.col("p_partkey").cast("string").alias("product_nk"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_name"),
        F.lit("1900-01-01").cast("date").alias("effective_date"), F.lit(None).cast("date").alias("expiration_date"), F.lit(True).alias("is_current"),
    )
    shippers = spark.range(1, 4).select(F.col("id").alias("shipper_sk"), F.col("id").cast("string").alias("shipper_nk"))
    made = {"dim_customer": customer_history(spark, sf), "dim_product": part, "dim_shipper": shippers, "dim_geography": geography(spark)}
    return {name: written(df, name) for name, df in made.items()}  # stored, as a warehouse's dimensions are


#: The same in DuckDB's SQL, as common table expressions.
SQL_CUSTOMERS = """
dc AS (
  SELECT c_custkey * 2 + v AS customer_sk, c_custkey::VARCHAR AS customer_nk, c_name AS company_name, n_name AS country_code,
    CASE WHEN v = 2 THEN DATE '1998-01-01' ELSE DATE '1900-01-01' END AS effective_date,
    CASE WHEN c_custkey % 3 = 0 AND v = 1 THEN DATE '1997-12-31' END AS expiration_date,
    c_custkey % 3 <> 0 OR v = 2 AS is_current
  FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2)) t(v) WHERE v = 1 OR c_custkey % 3 = 0
)"""
SQL_FACT = (
    SQL_CUSTOMERS
    + """, o AS (
  SELECT o_orderkey AS k, o_custkey::VARCHAR AS nk, o_orderdate::DATE AS d, o_totalprice::DECIMAL(12, 2) AS freight,
    o_orderdate::DATE + 7 AS req, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 3 END AS ship, o_orderkey % 4 + 1 AS via, o_orderkey % 6 AS ctry
  FROM orders
), l AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_quantity::INT AS quantity, l_extendedprice::DECIMAL(10, 2) AS unit_price, l_discount::DECIMAL(4, 3) AS discount,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey::VARCHAR, l_quantity, l_extendedprice, l_discount) AS line_number
  FROM lineitem
), m AS (SELECT *, (quantity * unit_price)::DECIMAL(12, 2) AS ext FROM l),
n AS (SELECT *, round(ext * discount, 2)::DECIMAL(12, 2) AS off FROM m),
x AS (
  SELECT n.*, o.*, (ext - off)::DECIMAL(12, 2) AS net, sum((ext * 100)::HUGEINT) OVER (PARTITION BY n.k) AS whole
  FROM n JOIN o USING (k)
), f AS (
  SELECT k::INT AS order_id, line_number::INT AS line_number, strftime(d, '%Y%m%d')::INT AS order_date_sk, strftime(req, '%Y%m%d')::INT AS required_date_sk,
    coalesce(strftime(ship, '%Y%m%d')::INT, 19000101) AS shipped_date_sk,
    coalesce(dc.customer_sk, -1)::BIGINT AS customer_sk, (-1)::BIGINT AS employee_sk, (p + 1)::BIGINT AS product_sk, (CASE WHEN via <= 3 THEN via ELSE -1 END)::BIGINT AS shipper_sk,
    (CASE ctry WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 5 WHEN 4 THEN 18 ELSE -1 END)::BIGINT AS ship_geography_sk,
    quantity, unit_price::DOUBLE AS unit_price, discount::DOUBLE AS discount, ext::DOUBLE AS extended_price, off::DOUBLE AS discount_amount, net::DOUBLE AS net_amount,
    (((2 * (freight * 100)::HUGEINT * (ext * 100)::HUGEINT + whole) // (2 * whole))::BIGINT / 100.0)::DOUBLE AS freight_allocated
  FROM x LEFT JOIN dc ON dc.customer_nk = x.nk AND dc.effective_date <= x.d AND (dc.expiration_date IS NULL OR dc.expiration_date >= x.d)
  WHERE quantity > 0
)"""
)
