"""Golden records: for each cluster and column the surviving value, all in one aggregate."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

DEFAULT = "longest_non_null"


def _first(c: str, order: Column) -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))


def surviving(c: str, kind: str, rule: str, order: Column, has_time: bool, has_source: bool, priority: list[str]) -> Column:
    """Ties go to the first row in `order`."""
    if rule == "most_recent":
        # the value of the latest row, null or not; structs keep a null value apart from no row
        return F.max_by(F.struct(F.col(c)), F.when(F.col("_extract_ts").isNotNull(), F.struct(F.col("_extract_ts"), -order)))[c] if has_time else _first(c, order)
    if rule == "prefer_source":
        if not has_source or not priority:
            return _first(c, order)
        picks = [F.min_by(F.struct(F.col(c)), F.when(F.col("_source") == s, order))[c] for s in priority]  # first row of each source
        return F.coalesce(*picks, _first(c, order))
    if rule != DEFAULT:
        log.warning("unknown survivorship rule %s for %s", rule, c)
    if kind == "string":
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.length(c), -order)))
    return _first(c, order)


def golden_records(df: DataFrame, rules: dict[str, dict] | None = None, order: str = "_ord", default: str = DEFAULT) -> DataFrame:
    """One row per cluster_id. rules: column -> {"rule": ..., "priority": [...]}; `order` is an integer column that gives row order.

    Clusters of one row pass as they are, which every rule gives anyway: but for prefer_source and most_recent with a
    null value, where the only row's value is that null too.
    """
    if "cluster_id" not in df.columns:
        raise ValueError("no column cluster_id")
    columns = [c for c in df.columns if c not in ("cluster_id", order)]
    kinds = dict(df.dtypes)
    o = F.col(order).cast("long")
    out = []
    for c in columns:
        spec = (rules or {}).get(c, {})
        out.append(surviving(c, kinds[c], spec.get("rule", default), o, "_extract_ts" in df.columns, "_source" in df.columns, spec.get("priority", [])).alias(c))
    return df.groupBy("cluster_id").agg(*out)
