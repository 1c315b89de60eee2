"""Dimension builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.dates import as_date, date_to_sk
from starloom.functions.text import full_name, standardize_country, title_case
from starloom.operators.screens import find_column
from starloom.operators.surrogate import assign_keys
from starloom.schemas import SCHEMAS, UNKNOWN

FIRST_DAY = "1900-01-01"


def dim_date(spark: SparkSession, start_year: int = 1990, end_year: int = 2030, sentinel: bool = False) -> DataFrame:
    """One row a day; weekday 0 is Monday, weeks are ISO, the fiscal year is the calendar year. sentinel adds 19000101."""
    days = spark.sql(f"SELECT explode(sequence(date'{start_year}-01-01', date'{end_year}-12-31', interval 1 day)) AS d")
    if sentinel:
        days = days.union(spark.sql(f"SELECT date'{FIRST_DAY}' AS d"))
    d = F.col("d")
    short = lambda c: c.cast("smallint")
    return days.select(
        date_to_sk("d").alias("date_sk"), d.alias("full_date"), short(F.weekday(d)).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), short(F.dayofmonth(d)).alias("day_of_month"),
        short(F.dayofyear(d)).alias("day_of_year"), short(F.weekofyear(d)).alias("week_of_year"), short(F.month(d)).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        short(F.quarter(d)).alias("quarter"), short(F.year(d)).alias("year"), (F.weekday(d) >= 5).alias("is_weekend"), short(F.year(d)).alias("fiscal_year"), short(F.quarter(d)).alias("fiscal_quarter"),
    )


def pick(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column by name without regard to case, or nulls."""
    found = find_column(df, name)
    return (F.col(found) if found else F.lit(None)).try_cast(kind) if found else F.lit(None).cast(kind)


def unknown_member(spark: SparkSession, dim: str) -> DataFrame:
    row = UNKNOWN[dim]
    fields = spark.createDataFrame([], SCHEMAS[dim]).schema.fields
    return spark.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in fields))


def with_unknown(df: DataFrame, dim: str) -> DataFrame:
    return unknown_member(df.sparkSession, dim).unionByName(df, allowMissingColumns=True)


def _finish(df: DataFrame, dim: str) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], SCHEMAS[dim]).schema.fields
    return df.select(*(pick(df, f.name, f.dataType.simpleString()).alias(f.name) for f in fields))


def _versioned(df: DataFrame, effective: str, audit_sk: int) -> DataFrame:
    return df.withColumns({"effective_date": F.lit(effective).cast("date"), "expiration_date": F.lit(None).cast("date"), "is_current": F.lit(True), "audit_sk": F.lit(audit_sk).cast("long")})


def dim_customer(customers: DataFrame, geography: DataFrame, effective: str = FIRST_DAY, audit_sk: int = -1) -> DataFrame:
    """Renamed to the warehouse's names, with the region of the country code."""
    code = pick(customers, "country_code")
    rows = customers.select(
        pick(customers, "customerID").alias("customer_nk"), pick(customers, "companyName").alias("company_name"), pick(customers, "contactName").alias("contact_name"),
        pick(customers, "contactTitle").alias("contact_title"), pick(customers, "address").alias("address"), pick(customers, "city").alias("city"), pick(customers, "postalCode").alias("postal_code"),
        F.coalesce(code, standardize_country(pick(customers, "country"))).alias("country_code"), pick(customers, "phone").alias("phone"),
    )
    regions = geography.select(F.col("country_code").alias("_code"), F.col("region").alias("region_name"))
    rows = rows.join(regions, F.col("country_code") == F.col("_code"), "left")
    return _finish(_versioned(assign_keys(rows, "customer_sk", ["customer_nk"]), effective, audit_sk), "dim_customer")


def dim_product(products: DataFrame, categories: DataFrame | None, suppliers: DataFrame | None, effective: str = FIRST_DAY, audit_sk: int = -1) -> DataFrame:
    """Denormalised with category and supplier; numbers that do not parse are null, discontinued is not 0."""
    rows = products.select(
        pick(products, "productID", "int").alias("product_nk"), pick(products, "productName").alias("product_name"), pick(products, "categoryID").alias("_cat"), pick(products, "supplierID").alias("_sup"),
        pick(products, "quantityPerUnit").alias("quantity_per_unit"), pick(products, "unitPrice", "decimal(10,2)").alias("unit_price"), pick(products, "unitsInStock", "int").alias("units_in_stock"),
        (F.coalesce(pick(products, "discontinued", "int"), F.lit(0)) != 0).alias("discontinued"),
    )
    if categories is not None:
        c = categories.select(pick(categories, "categoryID").alias("_c"), pick(categories, "categoryName").alias("category_name"))
        rows = rows.join(c, F.col("_cat") == F.col("_c"), "left")
    if suppliers is not None:
        s = suppliers.select(pick(suppliers, "supplierID").alias("_s"), pick(suppliers, "companyName").alias("supplier_name"), standardize_country(pick(suppliers, "country")).alias("supplier_country"))
        rows = rows.join(s, F.col("_sup") == F.col("_s"), "left")
    return _finish(_versioned(assign_keys(rows, "product_sk", ["product_nk"]), effective, audit_sk), "dim_product")


def dim_employee(employees: DataFrame, effective: str = FIRST_DAY, audit_sk: int = -1) -> DataFrame:
    title = pick(employees, "title")
    rows = employees.select(
        pick(employees, "employeeID", "int").alias("employee_nk"), full_name(pick(employees, "titleOfCourtesy"), pick(employees, "firstName"), pick(employees, "lastName")).alias("full_name"),
        F.when(title != "NULL", title).alias("title"), pick(employees, "reportsTo", "int").alias("reports_to_nk"), as_date(pick(employees, "hireDate")).alias("hire_date"),
        title_case(pick(employees, "city")).alias("city"), standardize_country(pick(employees, "country")).alias("country_code"),
    )
    return _finish(_versioned(assign_keys(rows, "employee_sk", ["employee_nk"]), effective, audit_sk), "dim_employee")


def dim_shipper(shippers: DataFrame, audit_sk: int = -1) -> DataFrame:
    rows = shippers.select(pick(shippers, "shipperID", "int").alias("shipper_nk"), pick(shippers, "companyName").alias("company_name"), pick(shippers, "phone").alias("phone"), F.lit(audit_sk).cast("long").alias("audit_sk"))
    return _finish(assign_keys(rows, "shipper_sk", ["shipper_nk"]), "dim_shipper")
