"""Gold loads: staging rows get their hash and times and are merged into the gold table, which keeps the first load's time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.exprs import business, dedupe, row_hash
from granary.sources.schemas import STAGING, partitions, schema

from .logs import logs_parsed
from .tables import Layout, Table, conform, merge_upsert, staging_status

# The merge keys of each gold table. ModelMode is one wherever the summaries group by it.
KEYS = {
    "gold_model_health_scorecard": ("ItemName", "WorkspaceName", "ModelMode"),
    "gold_semantic_model_refresh_summary": ("log_date", "ItemName", "WorkspaceName", "ModelMode"),
    "gold_semantic_model_dax_performance": ("log_date", "ItemName", "WorkspaceName", "executing_user", "app_name"),
    "gold_audit_user_activity_summary": ("log_date", "UserId", "Operation", "WorkSpaceName"),
}
#: Gold tables without partitions keep their rows in so many buckets of their keys.
BUCKETS = 16
CREATED = "_dw_created_at"


def hashed(gold_table: str) -> list[str]:
    """The columns whose change is an update: all that are neither keys nor times of the load."""
    return business(schema(gold_table).names, KEYS[gold_table])


def layout(gold_table: str) -> Layout:
    """Partitions where the table declares them, else buckets of its keys: a merge touches only some folders either way."""
    return Layout(partitions(gold_table)) if partitions(gold_table) else Layout((), KEYS[gold_table], BUCKETS)


def enrich(staging: DataFrame, gold_table: str, at: Column) -> DataFrame:
    """Staging rows in the declared types with _row_hash (null is a value of its own), _dw_updated_at and _dw_created_at."""
    typed = conform(staging, schema(gold_table))
    return typed.withColumns({"_row_hash": row_hash(hashed(gold_table)), "_dw_updated_at": at, CREATED: at})


def merged_gold(gold: DataFrame, staging: DataFrame, gold_table: str, at: Column) -> DataFrame:
    """The gold rows after a load at a time; gold has the declared columns."""
    return merge_upsert(gold, enrich(staging, gold_table, at), list(KEYS[gold_table]), "_row_hash", (CREATED,))


def gold_load(spark: SparkSession, table_of: Callable[[str], Table], gold_table: str, at: Column | None = None) -> dict:
    """Merges a staging table into its gold table. A missing or empty staging table is skipped."""
    staging, gold = table_of(gold_table + STAGING), table_of(gold_table)
    rows = staging.read() if staging.exists() else None
    status = staging_status(rows)
    before = gold.n_rows()
    out = {"gold_table": gold_table, "staging_rows": 0, "inserted": 0, "updated": 0, "unchanged": 0, "gold_rows": before, "status": "SKIPPED"}
    if status != "READY":
        return out
    if not gold.exists():
        gold = Table(spark, gold.root, layout(gold_table))
        gold.ensure(schema(gold_table))
    source = enrich(rows, gold_table, F.current_timestamp() if at is None else at)
    result = gold.merge(source, list(KEYS[gold_table]), "_row_hash", (CREATED,))
    if before == 0 and result["status"] == "SUCCESS":
        result["status"] = "INITIAL_LOAD"
    return out | result | {"staging_rows": staging.n_rows(), "gold_rows": gold.n_rows()}


def gold_loads(spark: SparkSession, table_of: Callable[[str], Table], at: Column | None = None) -> DataFrame:
    """All gold loads, one after the other; a failure is recorded and the next goes on."""
    out = []
    for name in KEYS:
        try:
            r = gold_load(spark, table_of, name, at)
        except Exception as e:  # one broken staging table must not stop the others
            r = {
                "gold_table": name, "staging_rows": 0, "inserted": 0, "updated": 0, "unchanged": 0, "gold_rows": 0,
                "status": f"FAILURE: {type(e).__name__}"
            }
        out.append(tuple(r[k] for k in ("gold_table", "status", "staging_rows", "inserted", "updated", "unchanged", "gold_rows")))
    return spark.createDataFrame(
        out, "gold_table string, status string, staging_rows long, inserted long, updated long, unchanged long, gold_rows long"
    )


#: The day is a key: a merge reads and rewrites the days of its batch only.
LOG_KEYS = ["log_date", "OperationId", "Timestamp"]
LOG_LAYOUT = Layout(("log_date",))


def base_rows(raw: DataFrame) -> DataFrame:
    """Raw log rows, once for each (operation id, time), with their day and the hash of all else."""
    order = [F.col("DurationMs").desc_nulls_last(), F.col("ExecutingUser"), F.col("OperationName")]
    rows = dedupe(raw.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")), LOG_KEYS[1:], order).withColumn("log_date", F.to_date("Timestamp"))
    return rows.withColumn("_row_hash", row_hash(business(rows.columns, LOG_KEYS)))


def parsed_rows(raw: DataFrame) -> DataFrame:
    """Parsed log rows, once for each (operation id, time), with their day and the hash of all else."""
    rows = logs_parsed(raw.withColumn("Timestamp", F.col("Timestamp").cast("timestamp")))
    return rows.withColumn("_row_hash", row_hash(business(rows.columns, LOG_KEYS)))


def merged_logs(target: DataFrame, source: DataFrame) -> DataFrame:
    return merge_upsert(target, source, LOG_KEYS, "_row_hash")


def load_logs(raw: DataFrame, base: Table, parsed: Table, batch: tuple[str, int] | None = None) -> dict[str, dict]:
    """A batch of raw logs into the base table and the parsed table, which are made with LOG_LAYOUT where they don't exist. A replayed
    batch (a stream's name and its number) changes neither."""
    out = {}
    for name, table, rows in (("base", base, base_rows), ("parsed", parsed, parsed_rows)):
        out[name] = Table(raw.sparkSession, table.root, LOG_LAYOUT).merge(rows(raw), LOG_KEYS, "_row_hash", batch=batch)
    return out
