"""Data-quality screens: rules are data and compile to columns, one pass over an entity whatever the number of rules.

A screened frame carries _violations, an array of structs. Column rules add no exchange; `unique` adds a window on its
column, referential rules a join with the distinct reference keys. Events, quarantine and the clean rows are read off
that array. Columns are found without regard to case; rules on columns that are absent are skipped and reported.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.sources.config import load_yaml

log = logging.getLogger(__name__)

SEVERITIES = ("INFO", "WARN", "ERROR", "FATAL")

# Postal code forms by country name.
POSTAL_PATTERNS = {
    "USA": r"^\d{5}(-\d{4})?$",
    "United States": r"^\d{5}(-\d{4})?$",
    "UK": r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$",
    "United Kingdom": r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$",
    "Germany": r"^\d{5}$",
    "France": r"^\d{5}$",
    "Italy": r"^\d{5}$",
    "Spain": r"^\d{5}$",
    "Switzerland": r"^\d{4}$",
    "Austria": r"^\d{4}$",
    "Belgium": r"^\d{4}$",
    "Netherlands": r"^\d{4}\s?[A-Z]{2}$",
    "Sweden": r"^\d{5}$",
    "Norway": r"^\d{4}$",
    "Denmark": r"^\d{4}$",
    "Finland": r"^\d{5}$",
    "Canada": r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$",
    "Brazil": r"^\d{5}-?\d{3}$",
    "Argentina": r"^\d{4}$",
    "Mexico": r"^\d{5}$",
    "Portugal": r"^\d{4}-\d{3}$",
    "Ireland": r"^[A-Z]\d{2}\s?[A-Z\d]{4}$",
    "Poland": r"^\d{2}-\d{3}$",
    "Hungary": r"^\d{4}$",
    "Venezuela": r"^\d{4}$",
}

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, max_length, min_length, regex, numeric_range, date_range, in_list, referential, postal_country, expression."""

    kind: str
    column: str
    severity: str = "WARN"
    value: Any = None  # a length, a pattern, or an SQL expression that must hold
    low: Any = None
    high: Any = None
    items: tuple[str, ...] = ()
    references: str | None = None  # entity.column
    other: str | None = None  # the country column of a postal rule
    keep_first: bool = False  # unique: the first row (by all columns) of a value is no violation
    patterns: dict[str, str] = field(default_factory=lambda: POSTAL_PATTERNS, hash=False)

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"


@dataclass(frozen=True)
class Drift:
    """metric: row_count, column_mean. Against the entity's last run, or a row count given here."""

    metric: str
    severity: str = "WARN"
    baseline: float | None = None
    tolerance_pct: float = 20.0
    column: str | None = None


def find_column(df: DataFrame, name: str) -> str | None:
    return {c.lower(): c for c in reversed(df.columns)}.get(name.lower())


def _bound(value: Any) -> Column:
    return F.current_date() if value == "today" else F.lit(str(value)).cast("date")


def _checks(df: DataFrame, rule: Rule, column: str) -> list[tuple[Column, str, Column]]:
    """(violated, expected, actual) of the rules that look at one row."""
    c = F.col(column)
    text = c.cast("string")
    if rule.kind == "not_null":
        return [(c.isNull(), "not null", F.lit(None).cast("string"))]
    if rule.kind == "max_length":
        return [(F.length(text) > rule.value, f"at most {rule.value} characters", text)]
    if rule.kind == "min_length":
        return [(F.length(text) < rule.value, f"at least {rule.value} characters", text)]
    if rule.kind == "regex":  # anchored at the start only
        return [(~text.rlike(f"^(?:{rule.value})"), f"matches {rule.value}", text)]
    if rule.kind == "numeric_range":  # what is no number passes
        x = c.try_cast("double")
        out = [(x < float(rule.low), f">= {rule.low}", text)] if rule.low is not None else []
        return out + ([(x > float(rule.high), f"<= {rule.high}", text)] if rule.high is not None else [])
    if rule.kind == "date_range":
        x = c.try_cast("date")
        out = [(x < _bound(rule.low), f">= {rule.low}", text)] if rule.low is not None else []
        return out + ([(x > _bound(rule.high), f"<= {rule.high}", text)] if rule.high is not None else [])
    if rule.kind == "in_list":
        return [(c.isNotNull() & ~text.isin(list(rule.items)), f"one of {', '.join(rule.items)}", text)] if rule.items else []
    if rule.kind == "expression":
        return [(~F.expr(rule.value), str(rule.value), text)]
    if rule.kind == "postal_country":
        country = find_column(df, rule.other or "country")
        if country is None:
            return []
        bare, bad = F.trim(text), F.lit(False)
        for name, pattern in rule.patterns.items():
            bad = F.when(F.trim(F.col(country).cast("string")) == name, ~bare.rlike(pattern)).otherwise(bad)
        return [(c.isNotNull() & F.col(country).isNotNull() & bad, "a postal code of the country", text)]
    raise ValueError(f"no such rule: {rule.kind}")


def screen(df: DataFrame, rules: list[Rule], key: str | None = None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds _record_id (the key as text; null keys stay null) and _violations. Rows and their number stay as they are.

    Without a key the record id is a hash of all columns, which unlike a row number does not depend on partitioning.
    """
    names = df.columns
    key = find_column(df, key) if key else None
    out = df.withColumn("_record_id", F.col(key).cast("string") if key else F.xxhash64(*names).cast("string"))
    found: list[Column] = []
    for i, rule in enumerate(rules):
        column = find_column(df, rule.column)
        if column is None:
            log.warning("rule %s: no column %s", rule.name, rule.column)
            continue
        if rule.kind == "unique":
            if rule.keep_first:
                out = out.withColumn(f"_u{i}", F.row_number().over(Window.partitionBy(column).orderBy(*names)) > 1)
            else:  # counted before anything moves, so that a value with many rows, null say, stays spread
                repeated = df.groupBy(F.col(column).alias(f"_v{i}")).agg(F.count("*").alias(f"_n{i}")).filter(F.col(f"_n{i}") > 1)
                out = out.join(repeated, F.col(column).eqNullSafe(F.col(f"_v{i}")), "left").withColumn(f"_u{i}", F.col(f"_n{i}").isNotNull())
            checks = [(F.col(f"_u{i}"), "unique", F.col(column).cast("string"))]
        elif rule.kind == "referential":
            entity, _, target = (rule.references or "").partition(".")
            frame = (references or {}).get(entity)
            target = find_column(frame, target) if frame is not None else None
            if target is None:
                log.warning("rule %s: nothing to compare with (%s)", rule.name, rule.references)
                continue
            valid = frame.select(F.col(target).cast("string").alias(f"_k{i}")).filter(F.col(f"_k{i}").isNotNull()).distinct()
            out = out.join(valid, F.col(column).cast("string") == F.col(f"_k{i}"), "left")
            checks = [(F.col(column).isNotNull() & F.col(f"_k{i}").isNull(), f"in {rule.references}", F.col(column).cast("string"))]
        else:
            checks = _checks(df, rule, column)
        for violated, expected, actual in checks:
            event = F.struct(
                F.lit(rule.name).alias("screen_name"), F.lit(rule.severity).alias("severity"), F.lit(column).alias("column_name"),
                F.lit(expected).alias("expected"), actual.alias("actual"),
            )
            found.append(F.when(F.coalesce(violated, F.lit(False)), event))
    kind = "array<struct<screen_name:string,severity:string,column_name:string,expected:string,actual:string>>"
    every = F.filter(F.array(*found), lambda v: v.isNotNull()).cast(kind) if found else F.array().cast(kind)
    return out.withColumn("_violations", every).select(*names, "_record_id", "_violations")


def violations(screened: DataFrame) -> DataFrame:
    """One row per violation."""
    return screened.select("_record_id", F.explode("_violations").alias("v")).select(F.col("_record_id").alias("record_id"), "v.*")


def has(severity: str) -> Column:
    return F.exists("_violations", lambda v: v["severity"] == severity)


def clean_rows(screened: DataFrame, keyed: bool = True) -> DataFrame:
    """Rows without an ERROR; those whose key is null, and all rows of an entity without a key, are never quarantined."""
    kept = screened.filter(~(has("ERROR") & F.col("_record_id").isNotNull())) if keyed else screened
    return kept.drop("_violations", "_record_id")


def quarantined_rows(screened: DataFrame) -> DataFrame:
    return screened.filter(has("ERROR") & F.col("_record_id").isNotNull()).drop("_violations", "_record_id")


def has_fatal(screened: DataFrame) -> bool:
    return not screened.filter(has("FATAL")).limit(1).isEmpty()


def error_events(found: DataFrame, batch: str, system: str, table: str, with_info: bool = False) -> DataFrame:
    """Violations (all but INFO, unless asked for) as rows of the error event table."""
    rows = found if with_info else found.filter("severity <> 'INFO'")
    return rows.select(
        F.lit(batch).alias("etl_batch_id"), F.current_timestamp().alias("event_timestamp"), F.lit(system).alias("source_system"), F.lit(table).alias("source_table"),
        F.col("record_id").alias("source_record_pk"), "screen_name", F.col("severity").alias("screen_severity"), "column_name",
        F.col("expected").alias("expected_value"), F.col("actual").alias("actual_value"),
        F.concat_ws(" ", F.coalesce("column_name", "screen_name"), F.lit("is not"), "expected").alias("message"),
    )


def severity_summary(found: DataFrame) -> DataFrame:
    """Counts by severity, and TOTAL."""
    return found.rollup("severity").agg(F.count("*").alias("n")).select(F.coalesce("severity", F.lit("TOTAL")).alias("severity"), "n")


def row_count_drift(df: DataFrame, expected: float, tolerance_pct: float) -> DataFrame:
    """One row: current, expected, drift in percent, violated."""
    drift = F.abs(F.col("current") - expected) / max(expected, 1) * 100
    return df.agg(F.count("*").alias("current")).select("current", F.lit(float(expected)).alias("expected"), drift.alias("drift_pct"), (drift > tolerance_pct).alias("violated"))


def mean_drift(df: DataFrame, column: str, expected: float, tolerance_pct: float) -> DataFrame:
    drift = F.abs(F.col("current") - expected) / max(abs(expected), 1) * 100
    return df.agg(F.avg(F.col(column).try_cast("double")).alias("current")).select("current", F.lit(float(expected)).alias("expected"), drift.alias("drift_pct"), (drift > tolerance_pct).alias("violated"))


def column_baseline(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, sample deviation, least and most of each numeric column, to six places; and the row count. One scan."""
    numeric = columns or [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")]
    whole = df.agg(F.count("*").alias("rows"), *(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in numeric for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))
    one = [F.struct(F.lit(c).alias("column_name"), *(F.round(F.col(f"{c}__{n}"), 6).alias(n) for n in ("mean", "std", "min", "max"))) for c in numeric]
    return whole.select("rows", F.explode(F.array(*one)).alias("s")).select("rows", "s.*")


def profile(df: DataFrame) -> tuple[dict, dict[str, float]]:
    """The baseline of an entity, {row_count, column_stats of its numeric columns}, and the mean of what is a number in every column. One scan.

    Columns may be text: numeric is a column whose values all read as numbers. Figures are to six places.
    """
    one = []
    for i, c in enumerate(df.columns):
        text = F.trim(F.col(c).cast("string"))
        x = F.when(text.rlike(NUMBER), text.try_cast("double"))
        one += [F.count(c).alias(f"n{i}"), F.count(x).alias(f"k{i}")]
        one += [f(x).alias(f"{n}{i}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    got = df.agg(F.count("*").alias("rows"), *one).first()
    figures = {
        c: {n: None if (x := got[f"{n}{i}"]) is None else round(x, 6) for n in ("mean", "std", "min", "max")}
        for i, c in enumerate(df.columns) if got[f"n{i}"] and got[f"n{i}"] == got[f"k{i}"]
    }
    return {"row_count": got["rows"], "column_stats": figures}, {c: got[f"mean{i}"] for i, c in enumerate(df.columns)}


def drift_violations(baseline: dict, now: dict, means: dict[str, float], rules: list[Drift]) -> list[tuple]:
    """Violations of an entity as a whole, as (record_id, screen_name, severity, column_name, expected, actual).

    A rule's own row count goes before the stored one. Columns without a mean, now or in the baseline, are not compared.
    """
    names = {c.lower(): c for c in reversed(list(means))}
    stored = {c.lower(): v for c, v in baseline.get("column_stats", {}).items()}
    out: list[tuple] = []
    for r in rules:
        if r.metric == "row_count":
            expected, current, column = r.baseline or baseline.get("row_count"), now["row_count"], None
            said = (f"{expected} ± {r.tolerance_pct}%", str(current))
        elif r.metric == "column_mean":
            column = names.get((r.column or "").lower())
            expected, current = stored.get((r.column or "").lower(), {}).get("mean"), means.get(column)
            if column is None:
                log.warning("reasonability: no column %s", r.column)
        else:
            log.warning("reasonability: no such metric: %s", r.metric)
            continue
        if expected is None or current is None or abs(current - expected) / max(abs(expected), 1) * 100 <= r.tolerance_pct:
            continue
        if r.metric == "column_mean":
            said = (f"mean ≈ {expected:.4f} ± {r.tolerance_pct}%", f"{current:.4f}")
        out.append(("DATASET", f"reasonability.{r.metric}", r.severity, column, *said))
    return out


def rules_from_yaml(path: str, entity: str) -> list[Rule]:
    """Rules of an entity; no file or no entity gives none. Severity defaults to WARN, for references to ERROR."""
    from pathlib import Path

    if not Path(path).exists():
        return []
    spec = (load_yaml(path).get("screens") or {}).get(entity) or {}
    out = [
        Rule(r["rule"], r["column"], r.get("severity", "WARN"), r.get("value", r.get("pattern")), r.get("min"), r.get("max"), tuple(map(str, r.get("items", ()))))
        for r in spec.get("column_property", [])
    ]
    out += [Rule("referential", r["column"], r.get("severity", "ERROR"), references=r["references"]) for r in spec.get("structure", [])]
    out += [
        Rule("postal_country", r.get("postal_column", "PostalCode"), r.get("severity", "WARN"), other=r.get("country_column", "Country"))
        for r in spec.get("data_rule", []) if r.get("name") == "postal_country_consistency"
    ]
    return out


def drifts_from_yaml(path: str, entity: str) -> list[Drift]:
    """Drift rules of an entity (`reasonability`); no file or no entity gives none."""
    from pathlib import Path

    if not Path(path).exists():
        return []
    spec = (load_yaml(path).get("screens") or {}).get(entity) or {}
    return [Drift(r["metric"], r.get("severity", "WARN"), r.get("baseline"), float(r.get("tolerance_pct", 20)), r.get("column")) for r in spec.get("reasonability") or []]
