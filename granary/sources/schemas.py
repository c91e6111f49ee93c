"""Declared schemas, partition columns and literal rows of the platform's tables.

Names, types and values are fixed: other tools read these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_LOG = (
    "OperationId string, Timestamp timestamp, OperationName string, OperationDetailName string, Status string, StatusCode string, "
    "DurationMs long, CpuTimeMs long, ExecutingUser string"
)
_ITEM = "WorkspaceId string, WorkspaceName string, ModelMode string, _gold_loaded_at timestamp, _row_hash string"
_GOLD = "gold_loaded_at timestamp, _dw_created_at timestamp, _dw_updated_at timestamp, _row_hash string"

# Columns and types of each table.
_DDL = {
    "control_table": (
        "control_id int, pipeline_name string, connection_name string, source_schema string, source_table string, "
        "source_watermark_column string, destination_schema string, destination_table string, load_type string, "
        "source_cutoff_date timestamp, is_active boolean, server_switch string, source_database string, "
        "last_run_start timestamp, last_run_end timestamp, last_run_status string, last_rows_read long, "
        "last_rows_written long, last_updated_by string, last_updated_at timestamp"
    ),
    "pipeline_audit_log": (
        "audit_id string, pipeline_name string, notebook_name string, control_id int, source_table string, "
        "destination_table string, destination_layer string, load_type string, run_start timestamp, run_end timestamp, "
        "duration_seconds int, rows_read long, rows_written long, rows_updated long, rows_deleted long, rows_skipped long, "
        "run_status string, error_message string, error_step string, watermark_start timestamp, watermark_end timestamp, "
        "new_watermark_value timestamp, connection_name string, source_database string, triggered_by string, "
        "fabric_run_id string, logged_at timestamp, audit_date date"
    ),
    "silver_audit_logs": (
        "Id string, CreationTime timestamp, log_date date, RecordType int, Operation string, Activity string, Workload string, "
        "UserId string, UserKey string, UserType int, ClientIP string, UserAgent string, ItemName string, "
        "WorkSpaceName string, WorkspaceId string, DatasetName string, DatasetId string, ReportName string, ReportId string, "
        "ReportType string, ObjectId string, IsSuccess boolean, OrganizationId string, DistributionMethod string, "
        "ConsumptionMethod string, app_id string, capacity_id string, artifact_kind string, RequestId string, "
        "ActivityId string, _batch_date string, _silver_loaded_at timestamp, _row_hash string"
    ),
    "gold_semantic_model_logs": (
        f"{_LOG}, EventText string, Identity string, ApplicationContext string, ItemId string, ItemKind string, "
        f"ItemName string, {_ITEM}"
    ),
    "gold_semantic_model_logs_parsed": (
        f"{_LOG}, upn string, user_object_id string, tenant_id string, report_id string, report_name string, visual_id string, "
        "visual_name string, page_id string, page_name string, client_type string, activity_id string, dax_query_text string, "
        "event_operation_status string, event_error_message string, event_text_raw string, ItemId string, ItemName string, "
        f"{_ITEM}"
    ),
    "gold_model_health_scorecard": (
        "model_name string, ItemName string, WorkspaceName string, ModelMode string, avg_refresh_success_rate decimal(5,2), "
        "avg_refresh_duration_ms decimal(18,3), sla_breach_days int, total_refresh_days int, "
        "avg_dax_duration_ms decimal(18,3), max_dax_duration_ms long, total_dax_executions long, "
        f"pct_slow_queries decimal(5,2), health_score decimal(5,1), health_grade string, {_GOLD}"
    ),
    "gold_semantic_model_refresh_summary": (
        "log_date date, WorkspaceName string, ItemName string, ModelMode string, total_refresh_ops long, success_count long, "
        "failure_count long, avg_duration_ms decimal(18,3), max_duration_ms long, min_duration_ms long, "
        f"avg_cpu_ms decimal(18,3), success_rate_pct decimal(5,2), sla_status string, {_GOLD}"
    ),
    "gold_semantic_model_dax_performance": (
        "log_date date, WorkspaceName string, ItemName string, executing_user string, app_name string, "
        "dax_execution_count long, avg_duration_ms decimal(18,3), max_duration_ms long, p95_duration_ms long, "
        f"avg_cpu_ms decimal(18,3), failed_executions long, performance_tier string, {_GOLD}"
    ),
    "gold_audit_user_activity_summary": (
        "log_date date, WorkSpaceName string, UserId string, Operation string, user_tier string, total_events long, "
        f"success_events long, failure_events long, unique_items long, success_rate_pct decimal(5,2), {_GOLD}"
    ),
}
PARTITIONS = {
    n: ("log_date",) for n in _DDL if n.startswith("gold_") and _DDL[n].startswith("log_date")
} | {"silver_audit_logs": ("log_date",), "pipeline_audit_log": ("audit_date",)}
STAGING = "_staging"

# The first rows of the control table.
_CONTROL = (
    (
        1, "MasterPipeline", "SSMS_Server1", "dbo", "Customers", "ModifiedDate", "bronze", "bronze_customers", "INCREMENTAL",
        "2024-01-01 00:00:00", "SERVER1", "OperationsDB"
    ),
    (
        2, "MasterPipeline", "SSMS_Server1", "dbo", "Orders", "OrderDate", "bronze", "bronze_orders", "INCREMENTAL", "2024-01-01 00:00:00",
        "SERVER1", "OperationsDB"
    ),
    (3, "MasterPipeline", "SSMS_Server2", "dbo", "Products", None, "bronze", "bronze_products", "FULL", None, "SERVER2", "CatalogDB"),
    (
        4, "MasterPipeline", "SSMS_Server2", "dbo", "Inventory", "LastUpdated", "bronze", "bronze_inventory", "INCREMENTAL",
        "2024-01-01 00:00:00", "SERVER2", "CatalogDB"
    ),
    (
        5, "AuditLogPipeline", "O365_Graph_API", "api", "AuditLogs_PowerBI", "CreationTime", "bronze", "bronze_audit_logs_powerbi",
        "INCREMENTAL", "2024-01-01 00:00:00", "GRAPH_API", "O365"
    ),
)
# Model table, layer, lakehouse table, relationship.
_LINEAGE = (
    ("Customers", "GOLD", "gold_customers", "DirectFeed"), ("Orders", "GOLD", "gold_orders", "DirectFeed"),
    ("Products", "GOLD", "gold_products", "DirectFeed"), ("AuditEvents", "GOLD", "gold_audit_user_activity_summary", "Aggregated"),
    ("ModelHealth", "GOLD", "gold_model_health_scorecard", "Aggregated"),
    ("RefreshLog", "SILVER", "silver_semantic_model_logs_parsed", "DirectFeed"),
)
# Number, pipeline, time of day, frequency, activities.
_SCHEDULE = (
    ("1", "Master_Pipeline (Bronze + Silver)", "6:00 AM UTC", "Daily", "Bronze_Full_Refresh + Bronze_Incremental + Silver_Master_Notebook"),
    ("2", "Gold_SemanticModel_Master_Pipeline", "7:00 AM UTC", "Daily", "Gold_DDL → Dataflow_Gen2_Items → Gold_DML_Merge → SemanticModel_Refresh"),
    ("3", "AuditLog_Bronze_Pipeline", "2:00 AM UTC", "Daily", "Graph API ingestion of prior day O365 audit logs (RecordType=21)"),
)


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType()
}


def _decimal(kind: str) -> T.DecimalType:
    """decimal(precision,scale); declared here without a session."""
    return T.DecimalType(*(int(x) for x in kind.removeprefix("decimal(").rstrip(")").split(",")))


def schema(name: str) -> StructType:
    """The declared schema of a table; a staging twin has that of its table."""
    columns = (c.split(" ") for c in _DDL[name.removesuffix(STAGING)].split(", "))
    return StructType([StructField(c, _TYPES[kind] if kind in _TYPES else _decimal(kind)) for c, kind in columns])


def names() -> list[str]:
    """All declared tables; each gold summary also has a staging twin."""
    return [*_DDL, *(n + STAGING for n in _DDL if _DDL[n].endswith(_GOLD))]


def partitions(name: str) -> tuple[str, ...]:
    return PARTITIONS.get(name.removesuffix(STAGING), ())


def control_seed(spark: SparkSession) -> DataFrame:
    rows = [(*r[:9], r[9], True, *r[10:], None, None, None, None, None, "SEED", "2024-01-01 00:00:00") for r in _CONTROL]
    texts = spark.createDataFrame(
        rows,
        ", ".join(
            f"{f.name} {'int' if f.name == 'control_id' else 'boolean' if f.name == 'is_active' else 'string'}"
            for f in schema("control_table")
        )
    )
    return texts.select(*(texts[f.name].cast(f.dataType).alias(f.name) for f in schema("control_table")))


def lineage_map(spark: SparkSession, rows: tuple = _LINEAGE) -> DataFrame:
    return spark.createDataFrame(list(rows), "sem_table_name string, lh_layer string, lh_table_name string, relationship string")


def schedule(spark: SparkSession, rows: tuple = _SCHEDULE) -> DataFrame:
    return spark.createDataFrame(list(rows), "schedule_id string, pipeline_name string, trigger_time string, frequency string, activities string")
