"""The audit dimension: one row for each batch and source, with a quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_score(errors: Column, warnings: Column, rows: Column) -> Column:
    """1 - (errors + 0.3 warnings) / rows, at least 0, to four places."""
    lost = (errors.cast("decimal(20,1)") + warnings * F.lit("0.3").cast("decimal(2,1)")) / F.greatest(rows, F.lit(1)).cast("decimal(20,0)")
    return F.round(F.greatest(F.lit(0).cast("decimal(20,6)"), 1 - lost), 4).cast("decimal(5,4)")


def build_audit(found: DataFrame, total_rows: DataFrame | int, batch: str, system: str, file: str, audit_sk: int = 1) -> DataFrame:
    """One row. found: violations with severity; rejected counts violations, not rows."""
    by = {s: F.count(F.when(F.col("severity") == s, 1)) for s in ("ERROR", "WARN", "FATAL")}
    counts = found.agg((by["ERROR"] + by["FATAL"]).alias("_e"), by["WARN"].alias("_w"))
    if isinstance(total_rows, int):
        counts = counts.withColumn("_n", F.lit(total_rows))
    else:
        counts = counts.crossJoin(total_rows.agg(F.count("*").alias("_n")))  # one row each
    return counts.select(
        F.lit(audit_sk).cast("long").alias("audit_sk"), F.lit(batch).alias("etl_batch_id"), F.current_timestamp().alias("etl_run_timestamp"), F.lit(system).alias("source_system"),
        F.lit(file).alias("source_file"), F.col("_n").cast("long").alias("extract_row_count"), F.col("_e").alias("reject_row_count"),
        quality_score(F.col("_e"), F.col("_w"), F.col("_n")).alias("quality_score"), (F.col("_e") + F.col("_w") > 0).alias("has_anomalies"),
    )
