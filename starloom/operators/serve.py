"""What readers see: staging views, masked columns, rows by assignment, conformance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.screens import Rule, screen, violations
from starloom.operators.surrogate import UNKNOWN

MASK = "***-****"

#: Per view: its table, the rows it shows, names that it changes, and columns that are padded in the source.
STAGING = {
    "stg_customers": ("dim_customer", "customer_sk <> -1 and is_current", {"customer_nk": "customer_code"}, ["country_code"]),
    "stg_products": ("dim_product", "product_sk <> -1 and is_current", {"product_nk": "product_code", "supplier_country": "supplier_country_code"}, ["supplier_country"]),
    "stg_employees": ("dim_employee", "employee_sk <> -1 and is_current", {"employee_nk": "employee_code", "reports_to_nk": "reports_to_code"}, ["country_code"]),
    "stg_shippers": ("dim_shipper", "shipper_sk <> -1", {"shipper_nk": "shipper_code"}, []),
    "stg_geography": ("dim_geography", "trim(country_code) <> 'ZZ'", {}, ["country_code", "primary_currency"]),
    "stg_dates": ("dim_date", "date_sk <> 19000101", {}, []),
    "stg_sales": ("fact_sales", "true", {}, []),
}

# What delivered tables and views must satisfy.
KEYED = ["dim_customer customer_sk", "dim_product product_sk", "dim_employee employee_sk", "dim_shipper shipper_sk", "dim_geography geography_sk", "dim_geography country_code", "dim_date date_sk", "dim_date full_date"]
PRESENT = [
    "dim_customer customer_nk is_current", "dim_product product_nk is_current", "dim_employee employee_nk is_current", "dim_shipper shipper_nk",
    "fact_sales order_id line_number customer_sk product_sk employee_sk shipper_sk ship_geography_sk order_date_sk",
]
REFERS = [
    "fact_sales customer_sk dim_customer customer_sk", "fact_sales product_sk dim_product product_sk", "fact_sales employee_sk dim_employee employee_sk",
    "fact_sales shipper_sk dim_shipper shipper_sk", "fact_sales ship_geography_sk dim_geography geography_sk", "fact_sales order_date_sk dim_date date_sk",
]
VIEW_KEYED = [
    "stg_customers customer_sk customer_code", "stg_products product_sk product_code", "stg_employees employee_sk employee_code", "stg_shippers shipper_sk shipper_code",
    "stg_geography geography_sk country_code", "stg_dates date_sk full_date",
]
VIEW_PRESENT = [
    "stg_customers company_name country_code is_current", "stg_products product_name unit_price", "stg_employees full_name", "stg_shippers company_name", "stg_geography country_name",
    "stg_dates year month", "stg_sales order_id line_number quantity net_amount customer_sk product_sk",
]
VIEW_REFERS = ["stg_customers country_code stg_geography country_code"]
VIEW_POSITIVE = ["stg_sales quantity net_amount"]


def mart_rules() -> dict[str, list[Rule]]:
    """Rules by table or view."""
    out: dict[str, list[Rule]] = {}
    for line in [*KEYED, *VIEW_KEYED]:
        name, *columns = line.split()
        out.setdefault(name, []).extend(r for c in columns for r in (Rule("unique", c, "ERROR"), Rule("not_null", c, "ERROR")))
    for line in [*PRESENT, *VIEW_PRESENT]:
        name, *columns = line.split()
        out.setdefault(name, []).extend(Rule("not_null", c, "ERROR") for c in columns)
    for line in VIEW_POSITIVE:
        name, *columns = line.split()
        out.setdefault(name, []).extend(Rule("expression", c, "ERROR", f"{c} > 0") for c in columns)
    for line in [*REFERS, *VIEW_REFERS]:
        name, column, other, target = line.split()
        out.setdefault(name, []).append(Rule("referential", column, "ERROR", references=f"{other}.{target}"))
    return out


def mart_faults(tables: dict[str, DataFrame], rules: dict[str, list[Rule]] | None = None) -> DataFrame | None:
    """(table_name, screen_name, column_name, n) of the rules that rows break, over the tables and the views on them. Each is read once."""
    every = tables | {v: staging(v, tables) for v, (t, *_) in STAGING.items() if t in tables}
    out = None
    for name, own in (mart_rules() if rules is None else rules).items():
        if name not in every:
            continue
        own = [r for r in own if r.kind != "referential" or r.references.partition(".")[0] in every]
        broken = violations(screen(every[name], own, None, every)).groupBy("screen_name", "column_name").agg(F.count("*").alias("n"))
        broken = broken.select(F.lit(name).alias("table_name"), "screen_name", "column_name", "n")
        out = broken if out is None else out.unionByName(broken)
    return out


def staging(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    table, keep, names, padded = STAGING[name]
    df = tables[table]
    return df.filter(keep).select(*((F.trim(c) if c in padded else F.col(c)).alias(names.get(c, c)) for c in df.columns))


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    names = [n for n, (t, *_) in STAGING.items() if t in tables]
    for n in names:
        staging(n, tables).createOrReplaceTempView(n)
    return names


def masked(df: DataFrame, mask: dict[str, str], hidden: list[str] = ()) -> DataFrame:
    """mask: column -> name of the masked column; hidden columns go."""
    out = [F.lit(MASK).alias(mask[c]) if c in mask else F.col(c) for c in df.columns if c not in hidden]
    return df.select(*out)


def masked_customer(dim: DataFrame) -> DataFrame:
    return masked(dim, {"phone": "phone_masked"}, ["address", "audit_sk"])


def rows_for(user: str, fact: DataFrame, dim_customer: DataFrame, assignments: DataFrame) -> DataFrame:
    """Facts of customers in the user's countries; a user without any assignment sees all. assignments: username, country_code."""
    mine = assignments.filter(F.col("username") == user).select(F.trim("country_code").alias("_code"))
    seen = dim_customer.join(mine, F.trim("country_code") == F.col("_code"), "left_semi").select(F.col("customer_sk").alias("_sk")).distinct()
    free = assignments.agg(F.count(F.when(F.col("username") == user, 1)).alias("_n"))  # one row
    return fact.join(seen.withColumn("_in", F.lit(True)), F.col("customer_sk") == F.col("_sk"), "left").crossJoin(F.broadcast(free)).filter("_n = 0 or _in").select(*fact.columns)


def conformance_faults(dims: dict[str, DataFrame], keys: dict[str, tuple[str, str]], closures: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(dim, check, n) of null keys, natural keys that repeat among current rows, and codes outside a reference dimension.

    closures: (dim, column, reference dim, reference column).
    """
    out = None
    for dim, (sk, nk) in keys.items():
        if dim not in dims:
            continue
        df = dims[dim]
        now = df.filter("is_current") if "is_current" in df.columns else df
        now = now.filter(F.col(sk) != UNKNOWN)
        rows = df.agg(F.count(F.when(F.col(sk).isNull() | F.col(nk).isNull(), 1)).alias("n")).select(F.lit(dim).alias("dim"), F.lit("null_key").alias("check"), "n")
        rows = rows.unionByName(now.agg((F.count(nk) - F.count_distinct(nk)).alias("n")).select(F.lit(dim).alias("dim"), F.lit("duplicate_nk").alias("check"), "n"))
        out = rows if out is None else out.unionByName(rows)
    for dim, column, other, target in closures:
        if dim in dims and other in dims:
            valid = dims[other].select(F.col(target).alias("_t")).distinct()
            orphans = dims[dim].filter(F.col(column).isNotNull()).join(valid, F.col(column) == F.col("_t"), "left_anti")
            rows = orphans.agg(F.count("*").alias("n")).select(F.lit(dim).alias("dim"), F.lit(f"orphan_{column}").alias("check"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n runs that started last; of equal starts those that come first by their other columns."""
    others = [c for c in runs.columns if c != "started_at"]
    return runs.orderBy(F.col("started_at").desc(), *others).limit(n)
