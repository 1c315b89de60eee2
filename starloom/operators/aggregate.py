"""Aggregates over the fact, and the choice between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agg_sales_monthly(fact: DataFrame, dim_date: DataFrame, dim_customer: DataFrame, audit_sk: int = -1, all_versions: bool = False, approximate: bool = False) -> DataFrame:
    """By month, product and customer country: quantity, net amount, distinct orders. No date: month 0; no country: ZZ.

    Only current customer versions have a country, unless all_versions.
    """
    dates = dim_date.groupBy(F.col("date_sk").alias("_d")).agg(F.min(F.col("year") * 100 + F.col("month")).alias("_ym"))
    customers = dim_customer if all_versions else dim_customer.filter("is_current")
    customers = customers.groupBy(F.col("customer_sk").alias("_c")).agg(F.min("country_code").alias("_country"))
    rows = fact.join(dates, fact["order_date_sk"] == F.col("_d"), "left").join(customers, fact["customer_sk"] == F.col("_c"), "left")
    orders = F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")
    out = rows.groupBy(F.coalesce("_ym", F.lit(0)).cast("int").alias("year_month"), "product_sk", F.coalesce("_country", F.lit("ZZ")).alias("customer_country")).agg(
        F.sum("quantity").cast("long").alias("total_quantity"), F.round(F.sum("net_amount"), 2).cast("decimal(14,2)").alias("total_net_amount"), orders.alias("order_count")
    )
    return out.withColumn("audit_sk", F.lit(audit_sk).cast("long"))


SETS = [("year",), ("year", "quarter"), ("year", "quarter", "month"), ("year", "category_name"), ("year", "country_code"), ("year", "category_name", "country_code")]


def olap_cube(rows: DataFrame, sets: list[tuple[str, ...]] = SETS) -> DataFrame:
    """Revenue, units and distinct orders for each grouping set. rows: the set columns, net_amount, quantity, order_id."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = rows.select(*columns, "net_amount", "quantity", "order_id")
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.sum("net_amount").alias("revenue"), F.sum("quantity").alias("units"), F.count_distinct("order_id").alias("orders"))


def navigate(measures: set[str], grain: str, dims: set[str]) -> str:
    """The cheapest table that answers: the monthly aggregate from month up, by product and country; else the fact."""
    fits = grain in ("month", "quarter", "year") and dims <= {"product_sk", "customer_country"} and measures <= {"total_quantity", "total_net_amount"}
    return "agg_sales_monthly" if fits else "fact_sales"
