"""Activity logs: parsing JSON payloads, gold rollups, and the ad-hoc log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import cpu_class, dedupe, distinct_counts, has_term, having, join_null_safe, latency_tier, not_empty, pct, recent

DAX_NAMES = ("EXECUTE DAX", "EXECUTEDAX", "QUERY")
MODEL = "SemanticModel"


def scan_logs(df: DataFrame, start: str, end: str, item_kind: str = MODEL) -> DataFrame:
    """Half-open window [start, end) of one item kind; both conditions reach the scan."""
    return df.where(
        (
            F.col("Timestamp") >= F.lit(start).cast("timestamp_ntz")
        ) & (F.col("Timestamp") < F.lit(end).cast("timestamp_ntz")) & (F.col("ItemKind") == item_kind)
    )


def _context(name: str) -> Column:
    """A field of the first source, or of the older flat form."""
    return F.coalesce(F.get_json_object("ApplicationContext", f"$.Sources[0].{name}"), F.get_json_object("ApplicationContext", f"$.{name}"))


def parse_logs(df: DataFrame) -> DataFrame:
    """Payload fields as columns; malformed JSON gives nulls. Status is normalised: upper case, FAILED is FAILURE."""
    names = {
        "report_id": "ReportId", "report_name": "ReportName", "visual_id": "VisualId", "visual_name": "VisualName", "page_id": "PageId",
        "page_name": "PageName"
    }
    status = F.upper(F.trim("Status"))
    return df.withColumns(
        {
            "upn": F.lower(
                F.trim(F.coalesce(F.get_json_object("Identity", "$.Upn"), F.get_json_object("Identity", "$.upn"), "ExecutingUser"))
            ),
            "user_object_id": F.get_json_object("Identity", "$.ObjectId"), "tenant_id": F.get_json_object("Identity", "$.TenantId"),
            **{k: _context(v) for k, v in names.items()}, "client_type": F.get_json_object("ApplicationContext", "$.ClientType"),
            "app_name": F.get_json_object("ApplicationContext", "$.Application"),
            "activity_id": F.get_json_object("ApplicationContext", "$.ActivityId"),
            "dax_text": F.when(
                F.upper(F.trim("OperationName")).isin(*DAX_NAMES),
                F.coalesce(F.get_json_object("EventText", "$.Text"), F.get_json_object("EventText", "$.QueryText"))
            ),
            "operation_status": F.get_json_object("EventText", "$.OperationStatus"),
            "error_message": F.coalesce(F.get_json_object("EventText", "$.ErrorMessage"), F.get_json_object("EventText", "$.Error")),
            "event_text_raw": F.col("EventText"), "Status": F.when(status == "FAILED", "FAILURE").otherwise(status),
            "log_date": F.to_date("Timestamp"),
        }
    )


def logs_parsed(df: DataFrame) -> DataFrame:
    """Parsed logs with one row for each (operation id, time)."""
    return dedupe(
        parse_logs(df), ["OperationId", "Timestamp"],
        [F.col("DurationMs").desc_nulls_last(), F.col("ExecutingUser"), F.col("OperationName")]
    )


def _ok() -> Column:
    return F.count_if(F.col("Status") == "SUCCESS")


def _bad() -> Column:
    return F.count_if(F.col("Status") == "FAILURE")


def _p95(c: str) -> Column:
    """The exact value at rank ceil(0.95 n) of a long column, for groups of any size; a group's state holds its distinct values with their counts."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})").cast("long")


def visual_usage(parsed: DataFrame) -> DataFrame:
    keys = [
        "log_date", "WorkspaceName", F.col("ItemName").alias("model_name"), "report_id", "report_name", "page_id", "page_name", "visual_id",
        "visual_name", "client_type"
    ]
    return parsed.where("report_id IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("total_renders"), F.count_distinct("upn").alias("distinct_users"),
        F.round(F.avg("DurationMs"), 2).alias("avg_render_ms"), F.max("DurationMs").alias("max_render_ms"),
        _p95("DurationMs").alias("p95_render_ms"), _ok().alias("success_count"), _bad().alias("failure_count"),
        pct(_ok(), F.count("*")).alias("success_rate_pct"), latency_tier(F.avg("DurationMs")).alias("render_performance_tier")
    )


def dax_performance(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("OperationName").contains("DAX") & F.col("DurationMs").isNotNull())
    keys = [
        "log_date", "WorkspaceName", F.col("ItemName").alias("model_name"), F.col("upn").alias("user_upn"), "report_name", "visual_name",
        "page_name", "client_type"
    ]
    cpu, ms = F.avg("CpuTimeMs"), F.avg("DurationMs")
    profile = F.when(cpu > ms * 0.8, "CPU_Bound").when(cpu < ms * 0.2, "IO_Bound").otherwise("Mixed")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("dax_execution_count"), F.round(ms, 2).alias("avg_duration_ms"), F.max("DurationMs").alias("max_duration_ms"),
        _p95("DurationMs").alias("p95_duration_ms"), F.round(cpu, 2).alias("avg_cpu_ms"), F.sum("CpuTimeMs").alias("total_cpu_ms"),
        _bad().alias("failed_executions"), profile.alias("execution_profile"), latency_tier(ms).alias("performance_tier")
    )


def engagement(n: Column) -> Column:
    return F.when(n >= 500, "Power User").when(n >= 100, "Active User").when(n >= 20, "Regular User").otherwise("Casual User")


def _few(c: str) -> Column:
    """Exact number of distinct values of a group that one user makes in a day, so that the set is small: one pass, without a row a column."""
    return F.size(F.collect_set(c)).cast("long")


def user_activity(parsed: DataFrame) -> DataFrame:
    keys = ["log_date", "WorkspaceName", F.col("ItemName").alias("model_name"), F.col("upn").alias("user_upn"), "client_type"]
    return parsed.where("upn IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("total_operations"), _few("report_id").alias("distinct_reports_accessed"),
        _few("visual_id").alias("distinct_visuals_triggered"), _few("page_id").alias("distinct_pages_visited"),
        _ok().alias("successful_ops"), _bad().alias("failed_ops"), pct(_ok(), F.count("*")).alias("success_rate_pct"),
        F.round(F.avg("DurationMs"), 2).alias("avg_op_duration_ms"), F.sum("CpuTimeMs").alias("total_cpu_ms"),
        engagement(F.count("*")).alias("engagement_tier")
    )


def model_summary(parsed: DataFrame) -> DataFrame:
    keys = ["log_date", "WorkspaceName", "model_name", "ModelMode"]
    rows = parsed.withColumn("model_name", F.col("ItemName"))
    users = distinct_counts(rows, keys, {"upn": "distinct_users", "report_id": "distinct_reports", "visual_id": "distinct_visuals"})
    figures = rows.groupBy(*keys).agg(
        F.count("*").alias("total_operations"), F.count_if(F.col("OperationName").contains("DAX")).alias("dax_ops"),
        F.count_if(F.col("OperationName").contains("Refresh")).alias("refresh_ops"),
        F.round(F.avg("DurationMs"), 2).alias("avg_duration_ms"), F.max("DurationMs").alias("max_duration_ms"),
        F.round(F.avg("CpuTimeMs"), 2).alias("avg_cpu_ms"), _ok().alias("success_count"), _bad().alias("failure_count"),
        pct(_ok(), F.count("*")).alias("overall_success_rate_pct")
    )
    return join_null_safe(figures, users, keys).select(*keys, "total_operations", *users.columns[len(keys) :], *figures.columns[len(keys) + 1 :])


def refresh_summary(parsed: DataFrame, sla_ms: int = 1_800_000) -> DataFrame:
    """Daily refreshes; a group without durations has the SLA status UNKNOWN."""
    avg = F.avg("DurationMs")
    return parsed.where(F.col("OperationName").contains("Refresh")).groupBy("log_date", "WorkspaceName", "ItemName", "ModelMode").agg(
        F.count("*").alias("total_refreshes"), _ok().alias("success_count"), _bad().alias("failure_count"),
        F.round(avg, 4).alias("avg_duration_ms"), F.max("DurationMs").alias("max_duration_ms"),
        F.min("DurationMs").alias("min_duration_ms"), F.round(F.avg("CpuTimeMs"), 4).alias("avg_cpu_ms"),
        pct(_ok(), F.count("*")).alias("success_rate_pct"),
        F.when(avg.isNull(), "UNKNOWN").when(avg > sla_ms, "SLA_BREACH").otherwise("OK").alias("sla_status")
    )


def reported_success(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_date", "ItemName", "OperationName").agg(
        F.count("*").alias("total_ops"), _ok().alias("success_ops"), _bad().alias("failed_ops"),
        pct(_ok(), F.count("*")).alias("success_rate_pct")
    )


def gold_dax_performance(parsed: DataFrame) -> DataFrame:
    """DAX performance at the declared grain and precision of the gold table."""
    rows = parsed.where(F.col("OperationName").contains("DAX") & F.col("DurationMs").isNotNull())
    ms = F.avg("DurationMs")
    return rows.groupBy(
        "log_date", F.col("WorkspaceName").alias("workspace_name"), F.col("ItemName").alias("model_name"),
        F.col("upn").alias("executing_user"), "app_name"
    ).agg(
        F.count("*").alias("dax_execution_count"), ms.cast("decimal(18,3)").alias("avg_duration_ms"), F.max("DurationMs").alias("max_duration_ms"),
        _p95("DurationMs").alias("p95_duration_ms"), F.avg("CpuTimeMs").cast("decimal(18,3)").alias("avg_cpu_ms"), _bad().alias("failed_executions"),
        latency_tier(ms).alias("performance_tier")
    )


# --- ad-hoc queries over raw logs; as_of stands for the clock ---------------------------------------------------

def _failed() -> Column:
    return F.trim(F.col("Status")).isin("Failure", "Failed")



_RAW = [
    "Timestamp", "OperationName", "OperationDetailName", "OperationId", "DurationMs", "ExecutingUser", "Status", "StatusCode", "CpuTimeMs",
    "ItemId", "ItemKind", "ItemName", "WorkspaceId", "WorkspaceName"
]


def _models(logs: DataFrame, as_of: str, interval: str = "7 DAYS") -> DataFrame:
    return recent(logs, "Timestamp", interval, as_of).where(F.col("ItemKind") == MODEL)


def kw1_all(logs: DataFrame, as_of: str) -> DataFrame:
    return recent(logs, "Timestamp", "7 DAYS", as_of).select(*_RAW).orderBy(F.desc("Timestamp"))


def kw2_failures(logs: DataFrame, as_of: str) -> DataFrame:
    keys = ["OperationName", "ItemName", "StatusCode"]
    rows = recent(logs, "Timestamp", "24 HOURS", as_of).where(_failed())
    users = distinct_counts(rows, keys, {"ItemId": "DistinctItems", "ExecutingUser": "DistinctUsers"})
    return join_null_safe(rows.groupBy(*keys).agg(F.count("*").alias("FailureCount")), users, keys).orderBy(F.desc("FailureCount"))


def kw3_models(logs: DataFrame, as_of: str) -> DataFrame:
    return _models(logs, as_of).select(
        "Timestamp", "OperationName", "OperationDetailName", "OperationId", "DurationMs", "CpuTimeMs", "ExecutingUser", "Status",
        "StatusCode", "EventText", "Identity", "ApplicationContext", "ItemId", "ItemName", "WorkspaceId", "WorkspaceName", "ModelMode"
    ).orderBy(F.desc("Timestamp"))


def kw4_slowest(logs: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    return recent(
        logs, "Timestamp", "7 DAYS", as_of
    ).where("DurationMs IS NOT NULL").orderBy(F.desc("DurationMs"), "Timestamp").limit(n).select("Timestamp", "OperationName", "ItemName", "DurationMs", "CpuTimeMs", "ExecutingUser", "Status")


def kw5_hourly(logs: DataFrame, as_of: str) -> DataFrame:
    return recent(logs, "Timestamp", "24 HOURS", as_of).groupBy(
        F.date_trunc("HOUR", "Timestamp").alias("hour"), "OperationName"
    ).agg(F.count("*").alias("OperationCount")).orderBy("hour")


def kw6_users(logs: DataFrame, as_of: str) -> DataFrame:
    return recent(logs, "Timestamp", "7 DAYS", as_of).groupBy("ExecutingUser").agg(
        F.count("*").alias("TotalOps"), F.round(F.avg("DurationMs"), 6).alias("AvgDurationMs"), F.count_if(_failed()).alias("FailedOps"),
        pct(F.count_if(_failed()), F.count("*")).alias("FailureRate")
    ).orderBy(F.desc("TotalOps"))


def kw7_item(logs: DataFrame, item: str, as_of: str) -> DataFrame:
    return recent(logs, "Timestamp", "7 DAYS", as_of).where(F.col("ItemName") == item).select(
        "Timestamp", "OperationName", "DurationMs", "CpuTimeMs", "Status", "StatusCode", "ExecutingUser", "EventText"
    ).orderBy(F.desc("Timestamp"))


def _refreshes(rows: DataFrame, *keys) -> DataFrame:
    ok = F.count_if(F.trim(F.col("Status")) == "Success")
    return rows.where(has_term(F.col("OperationName"), "refresh")).groupBy(*keys).agg(
        F.count("*").alias("TotalRefreshes"), ok.alias("Successes"), F.count_if(_failed()).alias("Failures"),
        F.round(F.avg("DurationMs"), 6).alias("AvgDurationMs"), F.max("DurationMs").alias("MaxDurationMs"),
        _p95("DurationMs").alias("P95DurationMs"), pct(ok, F.count("*")).alias("SuccessRate")
    )


def kw8_refresh(logs: DataFrame, as_of: str) -> DataFrame:
    return _refreshes(recent(logs, "Timestamp", "30 DAYS", as_of), "ItemName", "ModelMode").drop("P95DurationMs").orderBy(F.desc("TotalRefreshes"))


def ks2_refresh_daily(logs: DataFrame, as_of: str) -> DataFrame:
    return _refreshes(
        _models(logs, as_of, "30 DAYS"), "ItemName", "ModelMode", F.to_date("Timestamp").alias("day")
    ).orderBy(F.desc("day"), F.desc("Failures"))


def ks3_slow_dax(logs: DataFrame, as_of: str, n: int = 50, ms: int = 5000) -> DataFrame:
    rows = _models(logs, as_of).where(has_term(F.col("OperationName"), "dax") & (F.col("DurationMs") > ms))
    return rows.select(
        "Timestamp", "ItemName", "ExecutingUser", "DurationMs", "CpuTimeMs", F.get_json_object("EventText", "$.Text").alias("DaxText"),
        "Status"
    ).orderBy(F.desc("DurationMs"), "Timestamp").limit(n)


def ks4_identity(logs: DataFrame, as_of: str) -> DataFrame:
    parts = {"UserUPN": "Upn", "UserObjectId": "ObjectId", "TenantId": "TenantId"}
    return _models(logs, as_of).select(
        "Timestamp", "OperationName", "ItemName", *(F.get_json_object("Identity", f"$.{v}").alias(k) for k, v in parts.items()), "Status",
        "DurationMs"
    )


def ks5_apps(logs: DataFrame, as_of: str) -> DataFrame:
    app = F.get_json_object("ApplicationContext", "$.Application").alias("AppName")
    return _models(logs, as_of).groupBy(app, "OperationName").agg(
        F.count("*").alias("OpsCount"), F.round(F.avg("DurationMs"), 6).alias("AvgDurationMs")
    ).orderBy(F.desc("OpsCount"))


def ks6_model_day(logs: DataFrame, as_of: str) -> DataFrame:
    return _models(logs, as_of, "30 DAYS").groupBy("ItemName", F.to_date("Timestamp").alias("day")).agg(
        F.count("*").alias("OpCount"), F.count_if(_failed()).alias("FailCount")
    ).orderBy(F.desc("day"), "ItemName")


def ks7_duplicates(logs: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    rows = _models(logs, as_of).where(not_empty(F.col("OperationId")))
    return having(rows, ["OperationId"], 1).withColumnRenamed("n", "RecordCount").orderBy(F.desc("RecordCount"), "OperationId").limit(n)


def ks8_cpu_ratio(logs: DataFrame, as_of: str) -> DataFrame:
    rows = _models(logs, as_of).where("DurationMs > 0 AND CpuTimeMs > 0").withColumn("CpuRatio", F.round(F.col("CpuTimeMs") / F.col("DurationMs"), 3))
    return rows.groupBy("OperationName", cpu_class(F.col("CpuRatio")).alias("OpType")).agg(
        F.round(F.avg("CpuRatio"), 3).alias("AvgCpuRatio"), F.round(F.avg("DurationMs"), 0).alias("AvgDurationMs"),
        F.count("*").alias("OpCount")
    ).orderBy(F.desc("AvgDurationMs"))


def ks9_failed(logs: DataFrame, as_of: str, n: int = 200) -> DataFrame:
    return _models(logs, as_of).where(_failed()).select(
        "Timestamp", "ItemName", "OperationName", "OperationDetailName", "StatusCode", "EventText", "ExecutingUser"
    ).orderBy(F.desc("Timestamp")).limit(n)


def ks10_modes(logs: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("ItemId") if approximate else F.count_distinct("ItemId")
    return _models(logs, as_of).groupBy("ModelMode", "WorkspaceName").agg(
        distinct.alias("ModelCount"), F.count("*").alias("TotalOps")
    ).orderBy(F.desc("TotalOps"))


def ks11_count(logs: DataFrame, start: str, end: str) -> DataFrame:
    return scan_logs(logs, start, end).agg(F.count("*").alias("Count"))


def ks12_feed(logs: DataFrame, as_of: str) -> DataFrame:
    return _models(logs, as_of, "15 MINUTES").select(
        "Timestamp", "OperationName", "ItemName", "Status", "DurationMs", "ExecutingUser"
    ).orderBy(F.desc("Timestamp"))


# --- exploration ------------------------------------------------------------------------------------------------


def recent_renders(parsed: DataFrame, n: int = 20) -> DataFrame:
    return parsed.where("report_id IS NOT NULL").orderBy(F.desc("Timestamp"), "OperationId").limit(n).select(
        "Timestamp", "ItemName", "report_id", "visual_id", "upn", "DurationMs"
    )


def top_by(parsed: DataFrame, keys: list[str], n: int = 15) -> DataFrame:
    return parsed.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys).limit(n)


def population(parsed: DataFrame, cols=("upn", "report_id", "visual_id", "dax_text", "client_type")) -> DataFrame:
    """Share of non-null values of each column, in one aggregate."""
    wide = parsed.agg(*(pct(F.count(c), F.count("*"), 1).alias(c) for c in cols))
    return wide.unpivot([], list(cols), "field", "populated_pct")


def top_reports(parsed: DataFrame, n: int = 10) -> DataFrame:
    """Users are counted from the logs, not from daily counts."""
    return parsed.where("report_id IS NOT NULL").groupBy("report_id").agg(
        F.count("*").alias("total_renders"), F.count_distinct("upn").alias("users"), F.round(F.avg("DurationMs"), 2).alias("avg_ms")
    ).orderBy(F.desc("total_renders"), "report_id").limit(n)


def slow_visuals(usage: DataFrame, ms: int = 5000, n: int = 15) -> DataFrame:
    return usage.where(F.col("p95_render_ms") > ms).orderBy(
        F.desc("p95_render_ms"), "log_date", "WorkspaceName", "model_name", "report_id", "visual_id",
        F.col("report_name").asc_nulls_first(), F.col("page_id").asc_nulls_first(), F.col("client_type").asc_nulls_first()
    ).limit(n).select("log_date", "model_name", "report_id", "visual_id", "p95_render_ms", "total_renders")


def engagement_mix(activity: DataFrame) -> DataFrame:
    return activity.groupBy("engagement_tier").agg(F.count_distinct("user_upn").alias("users"), F.sum("total_operations").alias("total_ops"))


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def operation_stats(parsed: DataFrame, n: int = 20) -> DataFrame:
    return parsed.groupBy("OperationName").agg(
        F.count("*").alias("count"), F.round(F.avg("DurationMs"), 2).alias("avg_ms")
    ).orderBy(F.desc("count"), "OperationName").limit(n)


def item_stats(parsed: DataFrame, n: int = 20) -> DataFrame:
    """The items with most operations."""
    return parsed.groupBy("ItemName").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "ItemName").limit(n)


def slowest_operations(parsed: DataFrame, n: int = 20) -> DataFrame:
    """Operations by average duration, the slowest first."""
    return parsed.groupBy("OperationName").agg(
        F.round(F.avg("DurationMs"), 2).alias("avg_ms")
    ).orderBy(F.desc_nulls_last("avg_ms"), "OperationName").limit(n)
