"""The sales fact: one row an order line, measures in decimals, freight shared by line value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.dates import date_to_sk
from starloom.functions.text import standardize_country
from starloom.operators.dims import pick
from starloom.operators.lookup import Lookup, resolve_batch

ORDER_LOOKUPS = [
    Lookup("dim_customer", "customer_nk", "customer_nk", "customer_sk", "customer_sk", "order_date"),
    Lookup("dim_employee", "employee_nk", "employee_nk", "employee_sk", "employee_sk", "order_date"),
    Lookup("dim_shipper", "shipper_nk", "shipper_nk", "shipper_sk", "shipper_sk"),
    Lookup("dim_geography", "ship_country", "country_code", "geography_sk", "ship_geography_sk"),
]
LINE_LOOKUPS = [Lookup("dim_product", "product_nk", "product_nk", "product_sk", "product_sk", "order_date")]


def measures(quantity: Column, price: Column, discount: Column) -> dict[str, Column]:
    """extended, discount and net amounts; every step is rounded to cents as a decimal."""
    money = "decimal(12,2)"
    p = price.cast("decimal(10,2)")
    d = F.greatest(F.lit(0).cast("decimal(4,3)"), F.least(F.lit(1).cast("decimal(4,3)"), F.coalesce(discount.cast("decimal(10,3)"), F.lit(0).cast("decimal(10,3)")))).cast("decimal(4,3)")
    extended = F.round(quantity.cast("int") * p, 2).cast(money)
    off = F.round(extended * d, 2).cast(money)
    return {"unit_price": p, "discount": d, "extended_price": extended, "discount_amount": off, "net_amount": F.round(extended - off, 2).cast(money)}


def line_number(order: str, *total_order: str) -> Column:
    return F.row_number().over(Window.partitionBy(order).orderBy(*total_order))


def allocate(amount: Column, part: Column, group: str) -> Column:
    """amount * part / sum of part over the group, to cents; a sum of 0 counts as 1. Shares its exchange with line_number."""
    whole = F.sum(part).over(Window.partitionBy(group))
    return F.round(amount.cast("decimal(12,2)") * part / F.when((whole == 0) | whole.isNull(), F.lit(1)).otherwise(whole), 2).cast("decimal(10,2)")


def build_fact_sales(orders: DataFrame, details: DataFrame, dims: dict[str, DataFrame], audit_sk: int = -1) -> DataFrame:
    """Orders join lines; keys by lookup (-1 where nothing fits, or the dimension is absent); lines without a positive
    quantity go, after freight has been shared.

    What an order decides (customer, employee, shipper, place, days) is looked up on orders, before lines multiply them.
    """
    o = orders.select(
        pick(orders, "orderID", "int").alias("order_id"), pick(orders, "customerID").alias("customer_nk"), pick(orders, "employeeID").alias("employee_nk"), pick(orders, "shipVia").alias("shipper_nk"),
        pick(orders, "orderDate").try_cast("date").alias("order_date"), pick(orders, "requiredDate").alias("_required"), pick(orders, "shippedDate").alias("_shipped"),
        standardize_country(pick(orders, "shipCountry")).alias("ship_country"), F.coalesce(pick(orders, "freight", "double"), F.lit(0.0)).alias("_freight"),
    )
    d = details.select(
        pick(details, "orderID", "int").alias("_order"), pick(details, "productID").alias("product_nk"), pick(details, "unitPrice", "double").alias("_price"),
        F.coalesce(pick(details, "quantity", "int"), F.lit(0)).alias("quantity"), pick(details, "discount", "double").alias("_discount"),
    )
    o = o.withColumns({"order_date_sk": date_to_sk("order_date"), "required_date_sk": date_to_sk("_required"), "shipped_date_sk": date_to_sk("_shipped")})
    o = resolve_batch(o, dims, ORDER_LOOKUPS).select(
        "order_id", "order_date", "_freight", "order_date_sk", "required_date_sk", "shipped_date_sk", "customer_sk", "employee_sk", "shipper_sk", "ship_geography_sk"
    )
    lines = d.join(o, d["_order"] == o["order_id"]).drop("_order")
    lines = lines.withColumn("line_number", line_number("order_id", "product_nk", "quantity", "_price", "_discount").cast("smallint"))
    lines = lines.withColumns(measures(F.col("quantity"), F.coalesce("_price", F.lit(0.0)), F.col("_discount")))
    lines = lines.withColumn("freight_allocated", allocate(F.col("_freight"), F.col("extended_price"), "order_id"))
    lines = lines.filter("quantity > 0").withColumn("audit_sk", F.lit(audit_sk).cast("long"))
    lines = resolve_batch(lines, dims, LINE_LOOKUPS)
    return lines.select(
        "order_id", "line_number", "order_date_sk", "required_date_sk", "shipped_date_sk", "customer_sk", "employee_sk", "product_sk", "shipper_sk", "ship_geography_sk", "audit_sk",
        "quantity", "unit_price", "discount", "extended_price", "discount_amount", "net_amount", "freight_allocated",
    )
