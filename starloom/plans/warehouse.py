"""The batch pipeline: extract, clean, conform, deliver. Each phase reads what the last one wrote."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import audit, dedup, dims, screens, serve, standardize, survivorship
from starloom.operators.aggregate import agg_sales_monthly
from starloom.operators.fact import build_fact_sales
from starloom.operators.scd import apply_scd
from starloom.operators.surrogate import KeySequence, max_key
from starloom.operators.upsert import insert_replace, new_rows
from starloom.schemas import KEYS, TRACKED
from starloom.sources.fetch import CsvExtractor, ExtractError, JsonExtractor, snapshot_name
from starloom.sources.readers import latest_in, read_csv, read_parquet_or_none
from starloom.sources.sinks import DimensionStore, append_error_events, append_error_events_jdbc, restore_table, write_run, write_table
from starloom.storage import children, exists, read_text, scratch, write_text, written

log = logging.getLogger(__name__)

PHASES = ("extract", "clean", "conform", "deliver")
# The entities of the data set and their keys.
ENTITIES = ("customers", "orders", "order-details", "products", "employees", "suppliers", "categories", "shippers", "territories", "employee-territories")
PRIMARY_KEYS = {
    "customers": "CustomerID", "orders": "OrderID", "order-details": None, "products": "ProductID", "employees": "EmployeeID", "suppliers": "SupplierID",
    "categories": "CategoryID", "shippers": "ShipperID", "territories": "TerritoryID", "employee-territories": None,
}


class PipelineError(Exception):
    """A phase failed."""


@dataclass
class Settings:
    root: str  # all folders lie below
    rules: str | None = None  # YAML of screens
    transforms: str | None = None  # YAML of standard forms
    survivorship: str | None = None  # YAML of golden record rules
    sources: str | None = None  # YAML of sources
    threshold: float = dedup.THRESHOLD
    effective_date: str = dims.FIRST_DAY
    first_year: int = 1990
    last_year: int = 2030
    system: str = "northwind"
    error_database: tuple[str, dict[str, str]] | None = None  # JDBC URL and properties; error events go there as well

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


@dataclass
class Phase:
    name: str
    status: str = "RUNNING"
    seconds: float = 0.0
    details: dict = field(default_factory=dict)
    error: str | None = None


@dataclass
class Run:
    batch: str
    status: str = "RUNNING"
    started_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    finished_at: str | None = None
    phases: list[Phase] = field(default_factory=list)


def new_batch_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("etl-%Y-%m-%d-%H%M%S")


class Logger(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        return f"[{self.extra['batch']}] {msg}", kwargs


@contextmanager
def phase(run: Run, name: str) -> Iterator[Phase]:
    p, began = Phase(name), time.time()
    run.phases.append(p)
    try:
        yield p
        p.status = p.details.pop("status", "SUCCESS")
    except Exception as e:
        p.status, p.error = "FAILED", f"{type(e).__name__}: {e}"
        raise PipelineError(f"{name}: {e}") from e
    finally:
        p.seconds = round(time.time() - began, 3)


def extract(spark: SparkSession, s: Settings, batch: str, get: Callable[[str], bytes] | None = None) -> dict:
    """All files of all sources into one snapshot each. A file that fails is reported, not fatal."""
    from starloom.sources.config import load_sources

    snapshot, rows, failed = snapshot_name(), 0, []
    for name, spec in load_sources(s.sources).items():
        kind = CsvExtractor if spec["type"] == "http_csv" else JsonExtractor
        e = kind(name, s.path("raw", name), spark=spark, **({"get": get} if get else {}))
        files = [(f"{spec['base_url'].rstrip('/')}/{f}", f) for f in spec["files"]] if spec["type"] == "http_csv" else [(spec["url"], f"{name}.json")]
        for url, file in files:
            try:
                rows += e.land(url, file, snapshot, spec.get("fallback")).rows
            except ExtractError as problem:
                log.warning("%s: %s", url, problem)
                failed.append(file)
    return {"rows": rows, "failed": failed, "snapshot": snapshot}


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {e: read_csv(spark, f"{folder}/{e}.csv") for e in ENTITIES if exists(spark, f"{folder}/{e}.csv")}


def clean(spark: SparkSession, s: Settings, batch: str, entities: dict[str, DataFrame]) -> dict:
    """Screens every entity in one pass each: clean rows, quarantine, error events, one audit row.

    Row counts and means are compared with the entity's baseline. Rows with an ERROR go to quarantine by their key; an entity without a key keeps them, and they show in the events and the audit.

    A FATAL violation stops the run: all violations found so far are kept, that entity has no clean file, there is no audit.
    """
    counts, found, total = {}, None, 0
    for name, df in entities.items():
        rules = screens.rules_from_yaml(s.rules, name) if s.rules else []
        key = screens.find_column(df, PRIMARY_KEYS.get(name) or "") if PRIMARY_KEYS.get(name) else None
        screened = written(screens.screen(df, rules, key, entities), f"screened-{name}")
        v = screens.violations(screened)
        drifts = drift(spark, s, name, screened.drop("_violations", "_record_id"))
        if drifts:
            v = v.unionByName(spark.createDataFrame(drifts, v.schema))
        fatal = screens.has_fatal(screened) or any(d[2] == "FATAL" for d in drifts)
        events = screens.error_events(v, batch, s.system, name, with_info=fatal)
        append_error_events(events, s.path("error", "events"))
        if s.error_database:
            append_error_events_jdbc(events, s.error_database[0], "error_events", s.error_database[1])
        if fatal:
            return {"status": "FATAL", "stopped_at": name, "rows": counts}
        write_table(screens.clean_rows(screened, keyed=key is not None), s.path("staging", "cleaned", name))
        if key and not (bad := screens.quarantined_rows(screened)).isEmpty():
            write_table(bad, s.path("error", "quarantine", batch, name))
        counts[name] = screened.count()
        total += counts[name]
        found = v if found is None else found.unionByName(v)
    if found is not None:
        write_table(audit.build_audit(found, total, batch, s.system, "all"), s.path("warehouse", "dim_audit_batch", batch))
    return {"rows": counts}


def drift(spark: SparkSession, s: Settings, name: str, df: DataFrame) -> list[tuple]:
    """Drift of an entity from its baseline, which then becomes what is seen now. The first run only makes the baseline."""
    path = s.path("staging", "_baselines", f"{name}.json")
    now, means = screens.profile(df)
    rules = screens.drifts_from_yaml(s.rules, name) if s.rules else []
    found = screens.drift_violations(json.loads(read_text(spark, path)), now, means, rules) if exists(spark, path) else []
    write_text(spark, path, json.dumps(now, indent=1))
    return found


def conform(spark: SparkSession, s: Settings, batch: str, entities: dict[str, DataFrame]) -> dict:
    """Standard forms, clusters and golden records for the mastered entities; published with the geography."""
    from starloom.sources.config import load_yaml

    store = DimensionStore(spark, s.path("staging", "conformed"))
    geography = standardize.geography(spark)
    store.publish("geography", geography, batch)
    spec = load_yaml(s.survivorship) if s.survivorship else {}
    default = ((spec.get("default") or {}).get("_default") or {}).get("rule", survivorship.DEFAULT)
    counts = {}
    for name in ("customers", "products", "employees", "suppliers", "categories", "shippers"):
        if name not in entities:
            continue
        rules = standardize.transforms_from_yaml(s.transforms, name) if s.transforms else standardize.ENTITY_TRANSFORMS.get(name, [])
        df = written(standardize.standardize(entities[name], rules), f"standard-{name}")
        key = screens.find_column(df, dedup.NATURAL_KEYS[name]) or df.columns[0]
        clusters = written(dedup.find_clusters(df, name, s.threshold), f"clusters-{name}")
        write_table(clusters, s.path("staging", "clusters", name))
        members = df.join(clusters, df[key] == clusters["nk"], "left").drop("nk")
        members = members.withColumn("_ord", F.row_number().over(_by(key)))
        golden = survivorship.golden_records(members, spec.get(name), default=default)
        golden = golden.withColumns({"effective_date": F.lit(s.effective_date), "is_current": F.lit(True)})
        store.publish(name, golden, batch)
        counts[name] = {"in": df.count(), "golden": store.latest(name).count()}
    return {"entities": counts}


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy("cluster_id").orderBy(key)


def deliver(spark: SparkSession, s: Settings, batch: str, entities: dict[str, DataFrame]) -> dict:
    """Dimensions with history, facts from the clean rows, the monthly aggregate. A step that fails makes the run PARTIAL."""
    store, errors, rows = DimensionStore(spark, s.path("staging", "conformed")), [], {}

    def conformed(name: str) -> DataFrame | None:
        return store.latest(name) if store.versions(name) else entities.get(name)

    def save(name: str, df: DataFrame) -> DataFrame:
        write_table(df, s.path("warehouse", name))
        stored = spark.read.parquet(s.path("warehouse", name))
        rows[name] = stored.count()
        return stored

    for name in (*KEYS, "dim_audit", "dim_date", "fact_sales", "agg_sales_monthly"):
        restore_table(spark, s.path("warehouse", name))
    sequence = KeySequence(spark, s.path("warehouse", "_meta", "keys.json"))  # a key is never given twice, whatever became of its row
    audits = read_parquet_or_none(spark, s.path("warehouse", "dim_audit"))
    mine = read_parquet_or_none(spark, s.path("warehouse", "dim_audit_batch", batch))
    audit_sk = 1 + max(0, (audits.agg(F.max("audit_sk")).first()[0] or 0) if audits is not None else 0)
    base = audits if audits is not None else dims.unknown_member(spark, "dim_audit")
    save("dim_audit", base.unionByName(mine.withColumn("audit_sk", F.lit(audit_sk).cast("long")), allowMissingColumns=True) if mine is not None else base)
    geography = standardize.geography(spark)
    tables = {"dim_geography": save("dim_geography", dims.with_unknown(geography, "dim_geography")), "dim_date": save("dim_date", dims.dim_date(spark, s.first_year, s.last_year, sentinel=True))}
    later = datetime.now(timezone.utc).date().isoformat()
    builders = {
        "dim_customer": ("customers", lambda d: dims.dim_customer(d, geography, s.effective_date, audit_sk)),
        "dim_product": ("products", lambda d: dims.dim_product(d, conformed("categories"), conformed("suppliers"), s.effective_date, audit_sk)),
        "dim_employee": ("employees", lambda d: dims.dim_employee(d, s.effective_date, audit_sk)),
        "dim_shipper": ("shippers", lambda d: dims.dim_shipper(d, audit_sk)),
    }
    for dim, (entity, build) in builders.items():
        try:
            source = conformed(entity)
            if source is None:
                continue
            sk, nk = KEYS[dim]
            fresh = build(source)
            old = read_parquet_or_none(spark, s.path("warehouse", dim))
            taken = sequence.at_least(dim, max_key(old, sk))
            if old is None:
                tables[dim] = save(dim, dims.with_unknown(fresh.withColumn(sk, F.col(sk) + taken), dim))
            elif dim in TRACKED:
                type2, type1 = TRACKED[dim]
                new, changes = apply_scd(fresh, old, nk, sk, type2, type1, later, first_key=taken + 1)
                changes.write.mode("append").parquet(s.path("warehouse", f"{dim}_log"))
                tables[dim] = save(dim, new)
            else:
                tables[dim] = save(dim, old.unionByName(new_rows(old, fresh.withColumn(sk, F.col(sk) + taken), [nk])))
            sequence.at_least(dim, max_key(tables[dim], sk))
        except Exception as e:
            log.exception("%s", dim)
            errors.append(f"{dim}: {e}")
    try:
        if {"orders", "order-details"} <= entities.keys():
            fact = build_fact_sales(entities["orders"], entities["order-details"], tables, audit_sk)
            old = read_parquet_or_none(spark, s.path("warehouse", "fact_sales"))
            fact = save("fact_sales", fact if old is None else old.unionByName(new_rows(old, fact, ["order_id", "line_number"])))
            agg = agg_sales_monthly(fact, tables["dim_date"], tables["dim_customer"], audit_sk)
            old = read_parquet_or_none(spark, s.path("warehouse", "agg_sales_monthly"))
            save("agg_sales_monthly", agg if old is None else insert_replace(old, agg, ["year_month", "product_sk", "customer_country"]))
    except Exception as e:
        log.exception("facts")
        errors.append(f"facts: {e}")
    faults = serve.conformance_faults(tables, {k: v for k, v in KEYS.items() if k in tables})
    bad = [f"{r['dim']}.{r['check']}: {r['n']}" for r in faults.filter("n > 0").collect()] if faults is not None else []
    stored = tables | {t: spark.read.parquet(s.path("warehouse", t)) for t in ("fact_sales",) if t in rows}
    tested = serve.mart_faults(stored)  # a handful of counts
    bad += [f"{r['table_name']}.{r['screen_name']}: {r['n']}" for r in tested.collect()] if tested is not None else []
    return {"rows": rows, "errors": errors, "faults": bad, "status": "PARTIAL" if errors else "SUCCESS"}


def cleaned(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    folder = s.path("staging", "cleaned")
    return {e: spark.read.parquet(f"{folder}/{e}") for e in children(spark, folder) if e in ENTITIES}


def runs(spark: SparkSession, s: Settings) -> list[dict]:
    folder = s.path("warehouse", "_meta", "runs")
    return [json.loads(read_text(spark, f"{folder}/{f}")) for f in children(spark, folder) if f.endswith(".json")]


def run_pipeline(spark: SparkSession, s: Settings, batch: str | None = None, only: str | None = None, streamed_orders: DataFrame | None = None, get: Callable[[str], bytes] | None = None) -> Run:
    """All phases, or one. A batch that has succeeded is not run again. Streamed orders join the clean phase's orders."""
    if only is not None and only not in PHASES:
        raise PipelineError(f"no such phase: {only}")
    batch = batch or new_batch_id()
    folder = s.path("warehouse", "_meta", "runs")
    if only is None and any(r["batch"] == batch and r["status"] == "SUCCESS" for r in runs(spark, s)):
        return Run(batch, "SKIPPED")
    run = Run(batch)
    said = Logger(log, {"batch": batch})
    try:
        for name in [only] if only else PHASES:
            if name == "extract" and not s.sources:
                continue
            with phase(run, name) as p, scratch(spark):  # all that a phase leaves is in its tables
                if name == "extract":
                    p.details = extract(spark, s, batch, get)
                elif name == "clean":
                    where = latest_in(spark, s.path("raw", s.system))
                    if where is None:
                        raise PipelineError("no raw snapshot")
                    raw = load_raw(spark, where)
                    if streamed_orders is not None:
                        names = {c.lower(): c for c in raw["orders"].columns} if "orders" in raw else {}
                        more = streamed_orders.select(*(F.col(c).cast("string").alias(names.get(c.lower(), c)) for c in streamed_orders.columns if not names or c.lower() in names))
                        raw["orders"] = raw["orders"].unionByName(more, allowMissingColumns=True) if "orders" in raw else more
                    p.details = clean(spark, s, batch, raw)
                elif name == "conform":
                    p.details = conform(spark, s, batch, cleaned(spark, s))
                else:
                    p.details = deliver(spark, s, batch, cleaned(spark, s))
            said.info("%s: %s", name, p.status)
            if p.status == "FATAL":
                raise PipelineError(f"{name}: FATAL at {p.details['stopped_at']}")
        run.status = "PARTIAL" if any(p.status == "PARTIAL" for p in run.phases) else "SUCCESS"
    except PipelineError:
        run.status = "FAILED"
        raise
    finally:
        run.finished_at = datetime.now(timezone.utc).isoformat()
        write_run(spark, folder, batch, asdict(run))
    return run
