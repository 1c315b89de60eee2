"""Record clusters: equal first field, then similar singles, then components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.components import components
from starloom.operators.surrogate import assign_keys
from starloom.storage import written

# Fields that are compared and their weights.
MATCH_FIELDS = {
    "customers": {"companyName": 0.40, "phone": 0.20, "address": 0.20, "city": 0.10, "country": 0.10},
    "employees": {"lastName": 0.40, "firstName": 0.30, "city": 0.20, "country": 0.10},
    "products": {"productName": 0.70, "unitPrice": 0.30},
    "suppliers": {"companyName": 0.50, "city": 0.30, "country": 0.20},
}
# The natural key of each entity.
NATURAL_KEYS = {"customers": "customerID", "employees": "employeeID", "products": "productID", "suppliers": "supplierID", "categories": "categoryID", "shippers": "shipperID", "orders": "orderID"}
THRESHOLD = 0.85
CHUNK = 8192  # rows of one side of a task


def _bare(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def scored_pairs(rows: DataFrame, fields: dict[str, float], threshold: float, block_on: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, score) of pairs of rows (with _ord) whose score reaches the threshold, a < b.

    Rows are looked at within their block_on values where given (pairs across are then not looked at), else all together.
    A block is dealt in chunks of at most `chunk` rows, each pair of chunks to one task, which bounds the scores of its pairs from
    lengths, letters and prefixes, for whole tiles at a time, and scores the few that may reach the threshold. No pair is made before that.
    All rows against all is quadratic by the definition of the operator; chunks keep it in bounded tasks.
    """
    names = list(fields)
    key = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(block_on))), {"ignoreNullFields": "false"}) if block_on else F.lit("")
    plain = written(rows.select(F.col("_ord").cast("long").alias("_ord"), key.alias("_key"), *(_bare(F.col(c)).alias(f"f{i}") for i, c in enumerate(names))), "match-rows")
    least = 1 if block_on else max(1, int((2 * plain.sparkSession.sparkContext.defaultParallelism) ** 0.5))  # all cores have a task
    sizes = plain.groupBy("_key").agg(F.greatest(F.lit(least), F.ceil(F.count("*") / chunk)).cast("int").alias("_chunks")).filter("_chunks > 1")
    dealt = plain.join(sizes, "_key", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64("_ord"), "_chunks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    dealt = dealt.select("_key", F.least("_mine", "_other").alias("_x"), F.greatest("_mine", "_other").alias("_y"), side.alias("side"), "_ord", *(f"f{i}" for i in range(len(names))))
    weights = [float(w) for w in fields.values()]

    def score(group: pa.Table) -> pa.Table:
        from starloom.functions.similar import scored

        of, ids = group["side"].to_numpy(), group["_ord"].to_numpy()
        columns = [group[f"f{i}"].to_pylist() for i in range(len(weights))]
        a, b, value = scored(columns, weights, None if not of.any() else of - 1, threshold)
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64()), "score": pa.array(value, pa.float64())})

    found = dealt.groupBy("_key", "_x", "_y").applyInArrow(score, "a bigint, b bigint, score double")
    return found.select("a", "b", F.round("score", 6).alias("score")).filter(F.col("score") >= threshold)


def find_clusters(df: DataFrame, entity: str, threshold: float = THRESHOLD, key: str | None = None, fields: dict[str, float] | None = None, order: list[str] | None = None, block_on: list[str] | None = None) -> DataFrame:
    """(cluster_id, nk). Ids are cluster_000001... by first appearance in `order` (the key by default).

    Without fields every row is a cluster. Fields that are absent are left out. Rows of equal first values are one cluster,
    found by an aggregate; rows without a first value are compared like any other single row.
    """
    from starloom.operators.screens import find_column

    key = find_column(df, key or NATURAL_KEYS.get(entity, df.columns[0])) or df.columns[0]
    wanted = MATCH_FIELDS.get(entity, {}) if fields is None else fields
    fields = {found: w for c, w in wanted.items() if (found := find_column(df, c))}
    needed = list(dict.fromkeys([*fields, *(block_on or [])]))
    rows = df.select(F.col(key).alias("_nk"), *(F.col(c) for c in needed), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [key])))
    rows = assign_keys(rows, "_ord", [*(f"_o{i}" for i in range(len(order or [key]))), "_nk"])
    if fields:
        rows = written(rows.withColumn("_same", _bare(F.col(next(iter(fields))))), "dedup-rows")
        repeated = rows.filter("_same <> ''").groupBy(F.col("_same").alias("_value")).agg(F.min("_ord").alias("_lead"), F.count("*").alias("_n")).filter("_n > 1")
        named = rows.join(repeated, F.col("_same") == F.col("_value"))
        links = named.filter("_ord <> _lead").select(F.col("_ord").alias("a"), F.col("_lead").alias("b"))
        single = rows.join(repeated, F.col("_same") == F.col("_value"), "left_anti")
        links = links.union(scored_pairs(single, fields, threshold, block_on).select("a", "b"))
        found = components(links)
        rows = rows.join(found, rows["_ord"] == found["id"], "left").withColumn("_first", F.coalesce("component", "_ord"))
    else:
        rows = rows.withColumn("_first", F.col("_ord"))
    numbered = assign_keys(rows.select("_first").distinct(), "_number", ["_first"])
    return rows.join(numbered, "_first").select(F.format_string("cluster_%06d", "_number").alias("cluster_id"), F.col("_nk").alias("nk"))
