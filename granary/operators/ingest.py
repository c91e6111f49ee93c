"""Control-table ingestion: routing, watermarks, run records and the loops that apply them."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.exprs import newer_than, stamp

from granary.sources.readers import split_audit_blobs
from granary.sources.schemas import partitions, schema

from .audit import SILVER_KEYS, flatten_audit, silver_audit
from .tables import Layout, Table


def active_control(control: DataFrame) -> DataFrame:
    return control.where("is_active").orderBy("control_id")


def plan_loads(control: DataFrame) -> DataFrame:
    """How each active row is loaded: reader by server, full or incremental."""
    reader = F.when(F.col("server_switch") == "GRAPH_API", "BLOB").when(
        F.col("server_switch").isin("SERVER1", "SERVER2"), "JDBC"
    ).otherwise("UNKNOWN_SERVER")
    mode = F.when(F.col("load_type") == "FULL", "REPLACE").otherwise("APPEND")
    return control.where("is_active").select(
        "control_id", "pipeline_name", reader.alias("reader"), "load_type", mode.alias("write_mode"),
        F.when(F.col("load_type") == "INCREMENTAL", F.col("source_cutoff_date")).alias("newer_than")
    )


def connection_for(server_switch: str, database: str, servers: dict[str, str]) -> dict[str, str]:
    """JDBC options of a server; an unknown one is an error."""
    if server_switch not in servers:
        raise ValueError(f"unknown server {server_switch!r}")
    return {"url": servers[server_switch].format(database=database)}


def match_loaders(control: DataFrame, registry: DataFrame) -> DataFrame:
    """Each active row with its loader; rows without one are skipped. registry: silver_table, loader."""
    return control.where("is_active").join(registry, "silver_table", "left").select(
        "control_id", "silver_table", "loader", F.when(F.col("loader").isNull(), "SKIP").otherwise("RUN").alias("action")
    )


def incremental_rows(source: DataFrame, watermark: str, cutoff, **stamps) -> DataFrame:
    return stamp(newer_than(source, watermark, cutoff), **stamps)


def full_rows(source: DataFrame, **stamps) -> DataFrame:
    return stamp(source, **stamps)


def load_status(rows: int) -> str:
    return "SUCCESS" if rows else "SUCCESS_NO_NEW_DATA"


def update_control(control: DataFrame, results: DataFrame) -> DataFrame:
    """Control rows after a run. results: control_id, status, rows_read, max_watermark; where they also have run_start, run_end, rows_written, updated_by or
    updated_at, the control columns of the last run are set from them. The cutoff moves only on success and only to the data's own maximum."""
    run = {"last_run_start": "run_start", "last_run_end": "run_end", "last_rows_written": "rows_written", "last_updated_by": "updated_by", "last_updated_at": "updated_at"}
    more = {c: r for c, r in run.items() if c in control.columns and r in results.columns}
    r = results.select("control_id", "status", "rows_read", "max_watermark", *(F.col(x).alias(f"__{x}") for x in more.values()))
    ok = F.col("status").startswith("SUCCESS")
    kept = {c: F.when(ok, F.col(f"__{x}")).otherwise(F.col(c)) if c == "last_rows_written" else F.coalesce(f"__{x}", c) for c, x in more.items()}
    return control.join(r, "control_id", "left").withColumns(
        {
            "source_cutoff_date": F.when(
                ok & (F.col("load_type") == "INCREMENTAL"), F.coalesce("max_watermark", "source_cutoff_date")
            ).otherwise(F.col("source_cutoff_date")),
            "last_run_status": F.coalesce("status", "last_run_status"),
            "last_rows_read": F.when(ok, F.col("rows_read")).otherwise(F.col("last_rows_read")), **kept
        }
    ).drop("status", "rows_read", "max_watermark", *(f"__{x}" for x in more.values()))


def audit_run(runs: DataFrame) -> DataFrame:
    """Run records with duration in seconds, partition date and default trigger. runs: at least run_start, run_end."""
    have = set(runs.columns)
    trigger = F.coalesce("triggered_by", F.lit("SYSTEM")) if "triggered_by" in have else F.lit("SYSTEM")
    return runs.withColumns(
        {
            "duration_seconds": (F.unix_timestamp("run_end") - F.unix_timestamp("run_start")).cast("int"),
            "audit_date": F.to_date("run_start"), "triggered_by": trigger
        }
    )


def short_audit(audit: DataFrame) -> DataFrame:
    return audit.where("status = 'SUCCESS'")


@dataclass
class Loaded:
    """What one control row's load did; error is None where it went well, else step tells where it broke off."""

    control_id: int
    began: dt.datetime
    ended: dt.datetime | None = None
    step: str = "read"
    rows: int = 0
    deleted: int = 0
    top: object = None
    error: BaseException | None = None

    @property
    def status(self) -> str:
        return load_status(self.rows) if self.error is None else f"FAILURE: {type(self.error).__name__}"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _load(row, source_of: Callable, table_of: Callable[[str], Table], watermark: str) -> Loaded:
    """Loads one control row. The source is read once; rows and their greatest watermark are observed while they're written."""
    out, full = Loaded(row["control_id"], _now()), row["load_type"] == "FULL"
    try:
        source, target = source_of(row), table_of(row["destination_table"])
        rows = full_rows(source, _load_type="FULL") if full else incremental_rows(source, watermark, row["source_cutoff_date"], _load_type="INCREMENTAL")
        out.step, top = "write", F.max(F.col(watermark).cast("timestamp"))
        staged = target.stage(rows, top=top) if full else target.stage_append(rows, top=top)
        out.step, out.deleted = "commit", target.n_rows() if full else 0
        if full:
            target.commit(staged, "REPLACE")
        elif staged.n:
            target.commit_append(staged)
        out.rows, out.top = staged.n, staged.figures["top"]
    except Exception as e:  # a source that can't be read must not stop the others
        out.error = e
    out.ended = _now()
    return out


def job_group(control_id: int) -> str:
    """The job group of a row's load, by which it can be cancelled alone."""
    return f"load-{control_id}"


def _run(control: DataFrame, source_of: Callable, table_of: Callable[[str], Table], watermark: str, parallel: int, after: Callable | None = None) -> list[Loaded]:
    """Loads up to `parallel` rows side by side, each in a job group and a scheduler pool of its own; after runs for one at a time."""
    context, guard = control.sparkSession.sparkContext, threading.Lock()

    def one(row) -> Loaded:
        context.setJobGroup(job_group(row["control_id"]), f"load {row['destination_table']}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", f"load-{threading.current_thread().name}")
        try:
            out = _load(row, source_of, table_of, watermark)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            context.setLocalProperty("spark.jobGroup.id", None)
        if after:
            with guard:
                after(row, out)
        return out

    rows = active_control(control).collect()  # a control table is as long as its list of pipelines
    with ThreadPoolExecutor(max_workers=max(1, parallel), thread_name_prefix="slot") as pool:
        return list(pool.map(one, rows))


_RESULT = "control_id int, status string, rows_read long, max_watermark timestamp"


def run_ingest(control: DataFrame, source_of: Callable, table_of: Callable[[str], Table], watermark: str, parallel: int = 4) -> DataFrame:
    """Loads every active row, `parallel` at a time; a failure is recorded and the others go on. Returns the results."""
    done = _run(control, source_of, table_of, watermark, parallel)
    return control.sparkSession.createDataFrame([(x.control_id, x.status, x.rows, x.top) for x in done], _RESULT)


def run_record(row: dict, done: Loaded, triggered_by: str = "SYSTEM") -> dict:
    """A run's record with all columns of pipeline_audit_log. Rows that a full load replaces count as deleted; a load updates none."""
    incremental = row["load_type"] != "FULL"
    cutoff = row.get("source_cutoff_date") if incremental else None
    return {c: row.get(c) for c in ("pipeline_name", "control_id", "source_table", "destination_table", "load_type", "connection_name", "source_database")} | {
        "audit_id": uuid.uuid4().hex, "notebook_name": row.get("notebook_name"), "destination_layer": row.get("destination_schema"),
        "run_start": done.began, "run_end": done.ended, "duration_seconds": int((done.ended - done.began).total_seconds()), "rows_read": done.rows,
        "rows_written": done.rows, "rows_updated": 0, "rows_deleted": done.deleted, "rows_skipped": 0,
        "run_status": "SUCCESS" if done.error is None else "FAILURE", "error_message": str(done.error)[:500] if done.error else None,
        "error_step": done.step if done.error else None, "watermark_start": cutoff, "watermark_end": done.top if incremental else None,
        "new_watermark_value": (done.top or cutoff) if incremental and done.error is None else cutoff, "triggered_by": triggered_by,
        "fabric_run_id": row.get("fabric_run_id"), "logged_at": _now(), "audit_date": done.began.date(),
    }


def run_controlled(
    control: Table, audit: Table, source_of: Callable, table_of: Callable[[str], Table], watermark: str, parallel: int = 4, triggered_by: str = "SYSTEM"
) -> DataFrame:
    """run_ingest over a control table: after each row, failures included, its control row is updated and a run record is
    appended to the audit table. Returns the run records of this call."""
    spark, records, kind = control.spark, [], schema("pipeline_audit_log")
    result = _RESULT + ", run_start timestamp, run_end timestamp, rows_written long, updated_by string, updated_at timestamp"

    def after(row, done: Loaded) -> None:
        values = (done.control_id, done.status, done.rows, done.top, done.began, done.ended, done.rows, triggered_by, _now())
        control.replace(update_control(control.read(), spark.createDataFrame([values], result)), "RUN")
        record = run_record(row.asDict(), done, triggered_by)
        records.append(tuple(record[c] for c in kind.names))
        audit.append(spark.createDataFrame(records[-1:], kind), partitions("pipeline_audit_log"))

    _run(control.read(), source_of, table_of, watermark, parallel, after)
    return spark.createDataFrame(records, kind)


def land_audit(
    spark: SparkSession, folder: str, silver: Table, quarantine: Table, record_type: int = 21, batch: tuple[str, int] | None = None
) -> dict:
    """Audit files into the silver table; broken files into quarantine with their name and reason. Returns what was done, rows_skipped counts the broken files."""
    good, bad = split_audit_blobs(spark, folder, record_type)
    return land_split(good, bad, silver, quarantine, batch)


def land_split(good: DataFrame, bad: DataFrame, silver: Table, quarantine: Table, batch: tuple[str, int] | None = None) -> dict:
    skipped = 0
    if not (batch and quarantine.applied(*batch)):
        staged = quarantine.stage_append(bad)
        if skipped := staged.n:
            quarantine.commit_append(staged, batch)
    bronze = flatten_audit(good).withColumn("_batch_date", F.to_date(F.try_to_timestamp("CreationTime")))
    done = Table(silver.spark, silver.root, Layout(("log_date",))).merge(silver_audit(bronze), SILVER_KEYS, "_row_hash", batch=batch)
    return done | {"rows_skipped": skipped}


# --- run-audit views ---------------------------------------------------------------------------------------------


def run_history(audit: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return audit.where(F.col("audit_date") >= F.date_sub(F.lit(as_of).cast("date"), days)).groupBy("audit_date", "pipeline").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.sum("rows_read").alias("rows_read")
    )


def run_failures(audit: DataFrame, n: int = 25) -> DataFrame:
    return audit.where("status = 'FAILURE'").orderBy(F.desc("run_start"), "run_id").limit(n)


def slowest_runs(audit: DataFrame, n: int = 15) -> DataFrame:
    return audit.orderBy(F.desc("duration_seconds"), "run_id").limit(n)


def daily_success(audit: DataFrame) -> DataFrame:
    return audit.groupBy("audit_date").agg(
        F.count("*").alias("runs"), F.round(100.0 * F.count_if(F.col("status") == "SUCCESS") / F.count("*"), 2).alias("success_pct")
    )


def run_alerts(audit: DataFrame, as_of: str, days: int = 7, more_than: int = 1) -> DataFrame:
    """Pipelines with more than one failure in the last days."""
    rows = audit.where((F.col("status") == "FAILURE") & (F.col("audit_date") > F.date_sub(F.lit(as_of).cast("date"), days)))
    return rows.groupBy("pipeline").agg(F.count("*").alias("failures")).where(F.col("failures") > more_than)
