"""Target schemas as Spark DDL, and the rows that stand for unknown members."""

from __future__ import annotations

SCHEMAS = {
    "error_events": "etl_batch_id STRING, event_timestamp TIMESTAMP, source_system STRING, source_table STRING, source_record_pk STRING, screen_name STRING, screen_severity STRING, column_name STRING, expected_value STRING, actual_value STRING, message STRING",
    "dim_audit": "audit_sk BIGINT, etl_batch_id STRING, etl_run_timestamp TIMESTAMP, source_system STRING, source_file STRING, extract_row_count BIGINT, reject_row_count BIGINT, quality_score DECIMAL(5,4), has_anomalies BOOLEAN",
    "dim_geography": "geography_sk BIGINT, country_code STRING, country_name STRING, region STRING, subregion STRING, primary_currency STRING",
    "dim_customer": "customer_sk BIGINT, customer_nk STRING, company_name STRING, contact_name STRING, contact_title STRING, address STRING, city STRING, postal_code STRING, country_code STRING, region_name STRING, phone STRING, effective_date DATE, expiration_date DATE, is_current BOOLEAN, audit_sk BIGINT",
    "dim_product": "product_sk BIGINT, product_nk INT, product_name STRING, category_name STRING, supplier_name STRING, supplier_country STRING, quantity_per_unit STRING, unit_price DECIMAL(10,2), units_in_stock INT, discontinued BOOLEAN, effective_date DATE, expiration_date DATE, is_current BOOLEAN, audit_sk BIGINT",
    "dim_employee": "employee_sk BIGINT, employee_nk INT, full_name STRING, title STRING, reports_to_nk INT, hire_date DATE, city STRING, country_code STRING, effective_date DATE, expiration_date DATE, is_current BOOLEAN, audit_sk BIGINT",
    "dim_shipper": "shipper_sk BIGINT, shipper_nk INT, company_name STRING, phone STRING, audit_sk BIGINT",
    "fact_sales": "order_id INT, line_number SMALLINT, order_date_sk INT, required_date_sk INT, shipped_date_sk INT, customer_sk BIGINT, employee_sk BIGINT, product_sk BIGINT, shipper_sk BIGINT, ship_geography_sk BIGINT, audit_sk BIGINT, quantity INT, unit_price DECIMAL(10,2), discount DECIMAL(4,3), extended_price DECIMAL(12,2), discount_amount DECIMAL(12,2), net_amount DECIMAL(12,2), freight_allocated DECIMAL(10,2)",
    "agg_sales_monthly": "year_month INT, product_sk BIGINT, customer_country STRING, total_quantity BIGINT, total_net_amount DECIMAL(14,2), order_count BIGINT, audit_sk BIGINT",
    "etl_runs": "etl_batch_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, rows_extracted BIGINT, rows_loaded BIGINT, error STRING",
}

#: Members with key -1, for lookups that find nothing.
UNKNOWN = {
    "dim_audit": {"audit_sk": -1, "source_system": "UNKNOWN", "source_file": "UNKNOWN", "extract_row_count": 0, "reject_row_count": 0, "quality_score": "1.0", "has_anomalies": False},
    "dim_geography": {"geography_sk": -1, "country_code": "ZZ", "country_name": "Unknown", "region": "Unknown", "subregion": "Unknown", "primary_currency": "ZZZ"},
    "dim_customer": {"customer_sk": -1, "customer_nk": "UNKNOWN", "company_name": "Unknown", "country_code": "ZZ", "effective_date": "1900-01-01", "is_current": True, "audit_sk": -1},
    "dim_product": {"product_sk": -1, "product_nk": -1, "product_name": "Unknown", "unit_price": "0", "units_in_stock": 0, "discontinued": False, "effective_date": "1900-01-01", "is_current": True, "audit_sk": -1},
    "dim_employee": {"employee_sk": -1, "employee_nk": -1, "full_name": "Unknown", "country_code": "ZZ", "effective_date": "1900-01-01", "is_current": True, "audit_sk": -1},
    "dim_shipper": {"shipper_sk": -1, "shipper_nk": -1, "company_name": "Unknown", "audit_sk": -1},
}

#: Attributes whose change makes a new version (2) or overwrites all versions (1), by dimension.
TRACKED = {
    "dim_customer": (["company_name", "address", "city", "postal_code", "country_code"], ["contact_name", "contact_title", "phone"]),
    "dim_product": (["product_name", "unit_price", "discontinued", "category_name"], ["units_in_stock", "quantity_per_unit"]),
    "dim_employee": (["title", "city", "country_code"], ["reports_to_nk"]),
}

KEYS = {"dim_customer": ("customer_sk", "customer_nk"), "dim_product": ("product_sk", "product_nk"), "dim_employee": ("employee_sk", "employee_nk"), "dim_shipper": ("shipper_sk", "shipper_nk"), "dim_geography": ("geography_sk", "country_code")}
