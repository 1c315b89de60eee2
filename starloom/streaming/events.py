"""The event envelope: id, time, type, payload, source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names on the wire.
TYPES = ("ORDER_CREATED", "ORDER_UPDATED", "ORDER_DELETED")
ENVELOPE = "event_id STRING, event_timestamp TIMESTAMP, event_type STRING, payload MAP<STRING, STRING>, source STRING"

# Payload names by column of the order table.
PAYLOAD_NAMES = {
    "orderID": "OrderID", "customerID": "CustomerID", "employeeID": "EmployeeID", "orderDate": "OrderDate", "requiredDate": "RequiredDate", "shippedDate": "ShippedDate",
    "shipVia": "ShipVia", "freight": "Freight", "shipName": "ShipName", "shipAddress": "ShipAddress", "shipCity": "ShipCity", "shipRegion": "ShipRegion",
    "shipPostalCode": "ShipPostalCode", "shipCountry": "ShipCountry",
}


def encode_orders(orders: DataFrame, source: str = "northwind", event_type: str = "ORDER_CREATED", limit: int | None = None) -> DataFrame:
    """Orders as (key, value): key the order id, value the JSON envelope. Nulls are left out of the payload."""
    if limit is not None:
        orders = orders.limit(limit)
    names = {c.lower(): n for c, n in PAYLOAD_NAMES.items()}
    fields = [F.col(c).cast("string").alias(names.get(c.lower(), c)) for c in orders.columns]
    key = next((c for c in orders.columns if c.lower() == "orderid"), orders.columns[0])
    envelope = F.struct(F.expr("uuid()").alias("event_id"), F.current_timestamp().alias("event_timestamp"), F.lit(event_type).alias("event_type"), F.struct(*fields).alias("payload"), F.lit(source).alias("source"))
    return orders.select(F.col(key).cast("string").alias("key"), F.to_json(envelope).alias("value"))


def decode(lines: DataFrame) -> DataFrame:
    """From value: value, the envelope, and `problem` (null for good events). Works on streams and tables."""
    e = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"})
    out = lines.select("value", e.alias("e"))
    problem = (
        F.when(F.col("e").isNull() | F.col("e.payload").isNull(), "not an event")
        .when(~F.coalesce(F.col("e.event_type").isin(*TYPES), F.lit(False)), "unknown type")
        .when(F.col("e.event_timestamp").isNull(), "no time")
    )
    return out.select("value", "e.*", problem.alias("problem"))


def flatten(events: DataFrame, columns: list[str]) -> DataFrame:
    """Good events with the payload's fields as columns."""
    return events.filter("problem is null").select("event_id", "event_timestamp", "event_type", *(F.try_element_at("payload", F.lit(c)).alias(c) for c in columns), F.coalesce("source", F.lit("unknown")).alias("source"))
