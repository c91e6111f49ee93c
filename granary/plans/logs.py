"""Log queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import logs as L
from granary.operators import sketches as K
from granary.sources.fixtures import AS_OF, ctes, view

from .registry import register

_TIER = (
    "CASE WHEN avg(DurationMs) < 500 THEN 'Fast (<0.5s)' WHEN avg(DurationMs) < 2000 THEN 'Moderate (0.5-2s)' WHEN avg(DurationMs) "
    "< 10000 THEN 'Slow (2-10s)' ELSE 'Critical (>10s)' END"
)
_J = "CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{p}') END"
_CTX = (
    "CASE WHEN json_valid(ApplicationContext) THEN coalesce(json_extract_string(ApplicationContext, '$.Sources[0].{p}'), "
    "json_extract_string(ApplicationContext, '$.{p}')) END"
)


def _j(c: str, p: str) -> str:
    return _J.format(c=c, p=p)


PARSED = ctes("workspace_logs") + f""", parsed0 AS (SELECT * EXCLUDE (Status),
 lower(trim(coalesce({_j('Identity', 'Upn')}, {_j('Identity', 'upn')}, ExecutingUser))) AS upn,
 {_j('Identity', 'ObjectId')} AS user_object_id, {_j('Identity', 'TenantId')} AS tenant_id,
 {_CTX.format(p='ReportId')} AS report_id, {_CTX.format(p='ReportName')} AS report_name, {_CTX.format(p='VisualId')} AS visual_id,
 {_CTX.format(p='VisualName')} AS visual_name, {_CTX.format(p='PageId')} AS page_id, {_CTX.format(p='PageName')} AS page_name,
 {_j('ApplicationContext', 'ClientType')} AS client_type, {_j('ApplicationContext', 'Application')} AS app_name,
 {_j('ApplicationContext', 'ActivityId')} AS activity_id,
 CASE WHEN upper(trim(OperationName)) IN ('EXECUTE DAX', 'EXECUTEDAX', 'QUERY') THEN coalesce({_j('EventText', 'Text')},
 {_j('EventText', 'QueryText')}) END AS dax_text,
 {_j('EventText', 'OperationStatus')} AS operation_status, coalesce({_j('EventText', 'ErrorMessage')},
 {_j('EventText', 'Error')}) AS error_message, EventText AS event_text_raw,
 CASE WHEN upper(trim(Status)) = 'FAILED' THEN 'FAILURE' ELSE upper(trim(Status)) END AS Status, CAST(Timestamp AS DATE) AS log_date,
 row_number() OVER (PARTITION BY OperationId, Timestamp ORDER BY DurationMs DESC NULLS LAST, ExecutingUser, OperationName) AS rn FROM workspace_logs),
parsed AS (SELECT * EXCLUDE (rn) FROM parsed0 WHERE rn = 1)"""  # fmt: skip
RAW = ctes("workspace_logs")
_OK, _BAD = "count(*) FILTER (WHERE Status = 'SUCCESS')", "count(*) FILTER (WHERE Status = 'FAILURE')"
_RATE = f"round(100.0::DOUBLE * {_OK} / count(*), 2)"
_P95 = "quantile_disc(DurationMs, 0.95)"


def _mean2(c: str) -> str:
    """The mean of whole numbers, halves away from zero at two digits, in whole numbers: a rounded binary mean takes 8821.425 for less than it is."""
    return f"sign(sum({c})) * ((200 * abs(sum({c})) + count({c})) // nullif(2 * count({c}), 0)) / 100.0::DOUBLE"


A1 = (
    f"SELECT log_date, WorkspaceName, ItemName AS model_name, report_id, report_name, page_id, page_name, visual_id, visual_name, "
    f"client_type, count(*) AS total_renders, count(DISTINCT upn) AS distinct_users, round(avg(DurationMs), 2) AS avg_render_ms, "
    f"max(DurationMs) AS max_render_ms, {_P95} AS p95_render_ms, {_OK} AS success_count, {_BAD} AS failure_count, {_RATE} AS "
    f"success_rate_pct, {_TIER} AS render_performance_tier FROM parsed WHERE report_id IS NOT NULL GROUP BY ALL"
)
A2 = (
    f"SELECT log_date, WorkspaceName, ItemName AS model_name, upn AS user_upn, report_name, visual_name, page_name, client_type, "
    f"count(*) AS dax_execution_count, {_mean2('DurationMs')} AS avg_duration_ms, max(DurationMs) AS max_duration_ms, {_P95} AS "
    f"p95_duration_ms, {_mean2('CpuTimeMs')} AS avg_cpu_ms, sum(CpuTimeMs)::BIGINT AS total_cpu_ms, {_BAD} AS failed_executions, "
    f"CASE WHEN avg(CpuTimeMs) > avg(DurationMs) * 0.8::DOUBLE THEN 'CPU_Bound' WHEN avg(CpuTimeMs) < avg(DurationMs) * 0.2::DOUBLE "
    f"THEN 'IO_Bound' ELSE 'Mixed' END AS execution_profile, {_TIER} AS performance_tier FROM parsed WHERE OperationName LIKE "
    f"'%DAX%' AND DurationMs IS NOT NULL GROUP BY ALL"
)
A3 = (
    f"SELECT log_date, WorkspaceName, ItemName AS model_name, upn AS user_upn, client_type, count(*) AS total_operations, "
    f"count(DISTINCT report_id) AS distinct_reports_accessed, count(DISTINCT visual_id) AS distinct_visuals_triggered, "
    f"count(DISTINCT page_id) AS distinct_pages_visited, {_OK} AS successful_ops, {_BAD} AS failed_ops, {_RATE} AS "
    f"success_rate_pct, round(avg(DurationMs), 2) AS avg_op_duration_ms, sum(CpuTimeMs)::BIGINT AS total_cpu_ms, CASE WHEN count(*) "
    f">= 500 THEN 'Power User' WHEN count(*) >= 100 THEN 'Active User' WHEN count(*) >= 20 THEN 'Regular User' ELSE 'Casual User' "
    f"END AS engagement_tier FROM parsed WHERE upn IS NOT NULL GROUP BY ALL"
)
A4 = (
    f"SELECT log_date, WorkspaceName, ItemName AS model_name, ModelMode, count(*) AS total_operations, count(DISTINCT upn) AS "
    f"distinct_users, count(DISTINCT report_id) AS distinct_reports, count(DISTINCT visual_id) AS distinct_visuals, count(*) FILTER "
    f"(WHERE OperationName LIKE '%DAX%') AS dax_ops, count(*) FILTER (WHERE OperationName LIKE '%Refresh%') AS refresh_ops, "
    f"round(avg(DurationMs), 2) AS avg_duration_ms, max(DurationMs) AS max_duration_ms, round(avg(CpuTimeMs), 2) AS avg_cpu_ms, "
    f"{_OK} AS success_count, {_BAD} AS failure_count, {_RATE} AS overall_success_rate_pct FROM parsed GROUP BY ALL"
)
A5 = (
    f"SELECT log_date, WorkspaceName, ItemName, ModelMode, count(*) AS total_refreshes, {_OK} AS success_count, {_BAD} AS "
    f"failure_count, round(avg(DurationMs), 4) AS avg_duration_ms, max(DurationMs) AS max_duration_ms, min(DurationMs) AS "
    f"min_duration_ms, round(avg(CpuTimeMs), 4) AS avg_cpu_ms, {_RATE} AS success_rate_pct, CASE WHEN avg(DurationMs) IS NULL THEN "
    f"'UNKNOWN' WHEN avg(DurationMs) > 1800000 THEN 'SLA_BREACH' ELSE 'OK' END AS sla_status FROM parsed WHERE OperationName LIKE "
    f"'%Refresh%' GROUP BY ALL"
)
A10 = (
    f"SELECT log_date, ItemName, OperationName, count(*) AS total_ops, {_OK} AS success_ops, {_BAD} AS failed_ops, {_RATE} AS "
    f"success_rate_pct FROM parsed GROUP BY ALL"
)
A12 = (
    f"SELECT log_date, WorkspaceName AS workspace_name, ItemName AS model_name, upn AS executing_user, app_name, count(*) AS "
    f"dax_execution_count, avg(DurationMs)::DECIMAL(18,3) AS avg_duration_ms, max(DurationMs) AS max_duration_ms, {_P95} AS "
    f"p95_duration_ms, avg(CpuTimeMs)::DECIMAL(18,3) AS avg_cpu_ms, {_BAD} AS failed_executions, {_TIER} AS performance_tier FROM "
    f"parsed WHERE OperationName LIKE '%DAX%' AND DurationMs IS NOT NULL GROUP BY ALL"
)


def logs(s, d):
    return view(s, d, "workspace_logs")


def parsed(s, d):
    return L.logs_parsed(logs(s, d))


register(
    "s2_scan_logs", lambda s, d: L.scan_logs(logs(s, d), "2024-01-10", "2024-01-20"),
    RAW + " SELECT * FROM workspace_logs WHERE Timestamp >= TIMESTAMP '2024-01-10' AND Timestamp < TIMESTAMP '2024-01-20' AND ItemKind = "
    "'SemanticModel'"
)
register("p1_parse_logs", lambda s, d: parsed(s, d), PARSED + " SELECT * FROM parsed")
for _name, _f, _sql in (
    ("a1_visual_usage", L.visual_usage, A1), ("a2_dax_performance", L.dax_performance, A2), ("a3_user_activity", L.user_activity, A3),
    ("a4_model_summary", L.model_summary, A4), ("a5_refresh_summary", L.refresh_summary, A5),
    ("a10_reported_success", L.reported_success, A10), ("a12_gold_dax_performance", L.gold_dax_performance, A12)
):
    register(_name, lambda s, d, f=_f: f(parsed(s, d)), f"{PARSED} {_sql}")


def _since(interval: str, where: str = "true") -> str:
    return f"FROM workspace_logs WHERE Timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {interval} AND Timestamp < TIMESTAMP '{AS_OF}' AND {where}"


_M = "ItemKind = 'SemanticModel'"
_F = "trim(Status) IN ('Failure', 'Failed')"
_HAS = r"regexp_matches(OperationName, '(?i)(^|[^A-Za-z0-9]){t}([^A-Za-z0-9]|$)')"
_FREQ = (
    f"count(*) AS TotalRefreshes, count(*) FILTER (WHERE trim(Status) = 'Success') AS Successes, count(*) FILTER (WHERE {_F}) AS "
    f"Failures, round(avg(DurationMs), 6) AS AvgDurationMs, max(DurationMs) AS MaxDurationMs"
)
_FRATE = "round(100.0::DOUBLE * count(*) FILTER (WHERE trim(Status) = 'Success') / count(*), 2) AS SuccessRate"
_KQ = {
    "kw1_all": (
        lambda f: f(L.kw1_all),
        "SELECT Timestamp, OperationName, OperationDetailName, OperationId, DurationMs, ExecutingUser, Status, StatusCode, "
        "CpuTimeMs, ItemId, ItemKind, ItemName, WorkspaceId, WorkspaceName " + _since("7 DAYS")
    ),
    "kw2_failures": (
        lambda f: f(L.kw2_failures),
        "SELECT OperationName, ItemName, StatusCode, count(*) AS FailureCount, count(DISTINCT ItemId) AS DistinctItems, "
        "count(DISTINCT ExecutingUser) AS DistinctUsers " + _since("24 HOURS", _F) + " GROUP BY ALL"
    ),
    "kw3_models": (
        lambda f: f(L.kw3_models),
        "SELECT Timestamp, OperationName, OperationDetailName, OperationId, DurationMs, CpuTimeMs, ExecutingUser, Status, "
        "StatusCode, EventText, Identity, ApplicationContext, ItemId, ItemName, WorkspaceId, WorkspaceName, ModelMode " + _since("7 DAYS", _M)
    ),
    "kw4_slowest": (
        lambda f: f(L.kw4_slowest),
        "SELECT Timestamp, OperationName, ItemName, DurationMs, CpuTimeMs, ExecutingUser, Status " + _since(
            "7 DAYS", "DurationMs IS NOT NULL"
        ) + " ORDER BY DurationMs DESC, Timestamp LIMIT 20"
    ),
    "kw5_hourly": (
        lambda f: f(L.kw5_hourly),
        "SELECT date_trunc('hour', Timestamp) AS hour, OperationName, count(*) AS OperationCount " + _since("24 HOURS") + " GROUP BY ALL"
    ),
    "kw6_users": (
        lambda f: f(L.kw6_users),
        f"SELECT ExecutingUser, count(*) AS TotalOps, round(avg(DurationMs), 6) AS AvgDurationMs, count(*) FILTER (WHERE {_F}) AS "
        f"FailedOps, round(100.0::DOUBLE * count(*) FILTER (WHERE {_F}) / count(*), 2) AS FailureRate " + _since("7 DAYS") + " GROUP BY ALL"
    ),
    "kw7_item": (
        lambda f: f(lambda x, t: L.kw7_item(x, "Model3", t)),
        "SELECT Timestamp, OperationName, DurationMs, CpuTimeMs, Status, StatusCode, ExecutingUser, EventText " + _since(
            "7 DAYS", "ItemName = 'Model3'"
        )
    ),
    "kw8_refresh": (
        lambda f: f(L.kw8_refresh),
        f"SELECT ItemName, ModelMode, {_FREQ}, {_FRATE} " + _since("30 DAYS", _HAS.format(t="refresh")) + " GROUP BY ALL"
    ),
    "ks2_refresh_daily": (
        lambda f: f(L.ks2_refresh_daily),
        f"SELECT ItemName, ModelMode, CAST(Timestamp AS DATE) AS day, {_FREQ}, {_P95} AS P95DurationMs, {_FRATE} " + _since(
            "30 DAYS", _M + " AND " + _HAS.format(t="refresh")
        ) + " GROUP BY ALL"
    ),
    "ks3_slow_dax": (
        lambda f: f(L.ks3_slow_dax),
        f"SELECT Timestamp, ItemName, ExecutingUser, DurationMs, CpuTimeMs, {_j('EventText', 'Text')} AS DaxText, Status " + _since(
            "7 DAYS", f"{_M} AND {_HAS.format(t='dax')} AND DurationMs > 5000"
        ) + " ORDER BY DurationMs DESC, Timestamp LIMIT 50"
    ),
    "ks4_identity": (
        lambda f: f(L.ks4_identity),
        f"SELECT Timestamp, OperationName, ItemName, {_j('Identity', 'Upn')} AS UserUPN, {_j('Identity', 'ObjectId')} AS "
        f"UserObjectId, {_j('Identity', 'TenantId')} AS TenantId, Status, DurationMs " + _since("7 DAYS", _M)
    ),
    "ks5_apps": (
        lambda f: f(L.ks5_apps),
        f"SELECT {_j('ApplicationContext', 'Application')} AS AppName, OperationName, count(*) AS OpsCount, round(avg(DurationMs), "
        f"6) AS AvgDurationMs " + _since("7 DAYS", _M) + " GROUP BY ALL"
    ),
    "ks6_model_day": (
        lambda f: f(L.ks6_model_day),
        f"SELECT ItemName, CAST(Timestamp AS DATE) AS day, count(*) AS OpCount, count(*) FILTER (WHERE {_F}) AS FailCount "
        + _since("30 DAYS", _M) + " GROUP BY ALL"
    ),
    "ks7_duplicates": (
        lambda f: f(L.ks7_duplicates),
        "SELECT OperationId, count(*) AS RecordCount " + _since(
            "7 DAYS", _M + " AND OperationId <> ''"
        ) + " GROUP BY ALL HAVING count(*) > 1 ORDER BY RecordCount DESC, OperationId LIMIT 100"
    ),
    "ks8_cpu_ratio": (
        lambda f: f(L.ks8_cpu_ratio),
        "SELECT OperationName, CASE WHEN CpuRatio > 0.8 THEN 'CPU_Bound' WHEN CpuRatio < 0.2 THEN 'IO_Bound' ELSE 'Mixed' END AS "
        "OpType, round(avg(CpuRatio), 3) AS AvgCpuRatio, round(avg(DurationMs), 0) AS AvgDurationMs, count(*) AS OpCount FROM "
        "(SELECT *, round(CpuTimeMs / DurationMs, 3) AS CpuRatio " + _since("7 DAYS", _M + " AND DurationMs > 0 AND CpuTimeMs > 0") + ") GROUP BY ALL"
    ),
    "ks9_failed": (
        lambda f: f(L.ks9_failed),
        "SELECT Timestamp, ItemName, OperationName, OperationDetailName, StatusCode, EventText, ExecutingUser " + _since(
            "7 DAYS", f"{_M} AND {_F}"
        ) + " ORDER BY Timestamp DESC LIMIT 200"
    ),
    "ks10_modes": (
        lambda f: f(L.ks10_modes),
        "SELECT ModelMode, WorkspaceName, count(DISTINCT ItemId) AS ModelCount, count(*) AS TotalOps " + _since("7 DAYS", _M)
        + " GROUP BY ALL"
    ),
    "ks12_feed": (
        lambda f: f(lambda x, t: L.ks12_feed(x, "2024-01-30 12:00:00")),
        f"SELECT Timestamp, OperationName, ItemName, Status, DurationMs, ExecutingUser FROM workspace_logs WHERE Timestamp >= "
        f"TIMESTAMP '2024-01-30 11:45:00' AND Timestamp < TIMESTAMP '2024-01-30 12:00:00' AND {_M}"
    ),
}
for _name, (_call, _sql) in _KQ.items():
    register(_name, lambda s, d, call=_call: call(lambda f: f(logs(s, d), AS_OF)), f"{RAW} {_sql}")
register(
    "ks11_count", lambda s, d: L.ks11_count(logs(s, d), "2024-01-01", "2024-01-15"),
    RAW + f" SELECT count(*) AS Count FROM workspace_logs WHERE Timestamp >= TIMESTAMP '2024-01-01' AND Timestamp < TIMESTAMP "
    f"'2024-01-15' AND {_M}"
)

register(
    "e1_recent_renders", lambda s, d: L.recent_renders(parsed(s, d)),
    PARSED + " SELECT Timestamp, ItemName, report_id, visual_id, upn, DurationMs FROM parsed WHERE report_id IS NOT NULL ORDER BY Timestamp "
    "DESC, OperationId LIMIT 20"
)
for _name, _keys in (("e2_top_reports_by_count", ["report_id"]), ("e3_top_visuals", ["visual_id", "report_id"]), ("e4_top_users", ["upn"])):
    _k = ", ".join(_keys)
    register(
        _name, lambda s, d, k=_keys: L.top_by(parsed(s, d), k),
        f"{PARSED} SELECT {_k}, count(*) AS count FROM parsed WHERE {_keys[0]} IS NOT NULL GROUP BY ALL ORDER BY count DESC, {_k} LIMIT 15"
    )
register(
    "e5_population", lambda s, d: L.population(parsed(s, d)),
    PARSED + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS field, round(100.0::DOUBLE * count({c}) / count(*), 1) AS populated_pct FROM parsed" for c in (
            "upn", "report_id", "visual_id", "dax_text", "client_type"
        )
    )
)
register(
    "e11_top_reports", lambda s, d: L.top_reports(parsed(s, d)),
    PARSED + " SELECT report_id, count(*) AS total_renders, count(DISTINCT upn) AS users, round(avg(DurationMs), 2) AS avg_ms FROM parsed "
    "WHERE report_id IS NOT NULL GROUP BY ALL ORDER BY total_renders DESC, report_id LIMIT 10"
)
register(
    "e12_slow_visuals", lambda s, d: L.slow_visuals(L.visual_usage(parsed(s, d))),
    f"{PARSED} SELECT log_date, model_name, report_id, visual_id, p95_render_ms, total_renders FROM ({A1}) WHERE p95_render_ms > "
    f"5000 ORDER BY p95_render_ms DESC, log_date, WorkspaceName, model_name, report_id, visual_id, report_name NULLS FIRST, page_id "
    f"NULLS FIRST, client_type NULLS FIRST LIMIT 15"
)
register(
    "e13_engagement_mix", lambda s, d: L.engagement_mix(L.user_activity(parsed(s, d))),
    f"{PARSED} SELECT engagement_tier, count(DISTINCT user_upn) AS users, sum(total_operations)::BIGINT AS total_ops FROM ({A3}) "
    f"GROUP BY ALL"
)
register(
    "e14_row_counts", lambda s,
    d: L.row_counts(
        {
            "visual_usage": L.visual_usage(parsed(s, d)), "user_activity": L.user_activity(parsed(s, d)),
            "model_summary": L.model_summary(parsed(s, d))
        }
    ),
    f"{PARSED} SELECT 'visual_usage' AS table_name, count(*) AS rows FROM ({A1}) UNION ALL SELECT 'user_activity', count(*) FROM "
    f"({A3}) UNION ALL SELECT 'model_summary', count(*) FROM ({A4})"
)
register(
    "e15_operation_stats", lambda s, d: L.operation_stats(parsed(s, d)),
    PARSED + " SELECT OperationName, count(*) AS count, round(avg(DurationMs), 2) AS avg_ms FROM parsed GROUP BY ALL ORDER BY count DESC, "
    "OperationName LIMIT 20"
)
register(
    "e15_item_stats", lambda s, d: L.item_stats(parsed(s, d)),
    PARSED + " SELECT ItemName, count(*) AS count FROM parsed GROUP BY ALL ORDER BY count DESC, ItemName LIMIT 20"
)
register(
    "e15_slowest_operations", lambda s, d: L.slowest_operations(parsed(s, d)),
    PARSED + " SELECT OperationName, round(avg(DurationMs), 2) AS avg_ms FROM parsed GROUP BY ALL ORDER BY avg_ms DESC NULLS LAST, OperationName LIMIT 20"
)


def _by_sketch(s, d):
    """Each report's renders, and whether its users and its 95th percentile by merged daily sketches are within their stated errors of the exact ones.
    A percentile is held to the exact ones of 92 and 98 % by its rank: the rows below it and up to it are counted, which needs no quantile of the rows."""
    return within_errors(parsed(s, d).where("report_id IS NOT NULL"))


def within_errors(rows):
    got = K.over_days(K.daily_sketches(rows, ["report_id"]), ["report_id"])
    ms, p, n = F.col("DurationMs"), F.col("p_ms"), F.count("DurationMs")
    ranked = F.when(p.isNotNull(), (100 * F.count_if(ms <= p) >= 92 * n) & (100 * F.count_if(ms < p) < 98 * n))
    exact = rows.select("report_id", "upn", "DurationMs").join(F.broadcast(got), "report_id").groupBy("report_id", "operations", "users", "p_ms").agg(
        F.count_distinct("upn").alias("exact_users"), ranked.alias("p95_within"))
    users = F.abs(F.col("users") - F.col("exact_users")) <= 0.07 * F.col("exact_users") + 1
    return exact.select("report_id", F.col("operations").alias("renders"), users.alias("users_within"), "p95_within")


register(
    "e11_reports_from_days", _by_sketch,
    PARSED + " SELECT report_id, count(*) AS renders, true AS users_within, true AS p95_within FROM parsed WHERE report_id IS NOT NULL GROUP BY ALL"
)
