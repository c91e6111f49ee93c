"""Scans, filters, sorts and stamps as queries of their own, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import exprs as X
from granary.operators import jobs as J
from granary.sources.fixtures import AS_OF, ctes, view

from .logs import PARSED, RAW, logs, parsed
from .registry import register


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


register("s1_read_table", lambda s, d: _t(s, d, "orders"), "SELECT * FROM orders")
register("s16_read_job_runs", lambda s, d: view(s, d, "runs"), ctes("runs") + " SELECT * FROM runs")
for _name, _interval in (("f1_recent_15m", "15 MINUTES"), ("f1_recent_24h", "24 HOURS"), ("f1_recent_7d", "7 DAYS")):
    register(
        _name, lambda s, d, i=_interval: X.recent(logs(s, d), "Timestamp", i, "2024-01-29 00:00:00").select("OperationId", "Timestamp"),
        f"{RAW} SELECT OperationId, Timestamp FROM workspace_logs WHERE Timestamp >= TIMESTAMP '2024-01-29' - INTERVAL {_interval} "
        f"AND Timestamp < TIMESTAMP '2024-01-29'"
    )
register(
    "f2_where_eq", lambda s, d: X.where_eq(logs(s, d), "ItemName", "Model2").select("OperationId", "DurationMs"),
    RAW + " SELECT OperationId, DurationMs FROM workspace_logs WHERE ItemName = 'Model2'"
)
register(
    "f3_has_term", lambda s,
    d: logs(s, d).where(X.has_term(F.col("OperationName"), "dax")).groupBy("OperationName").agg(F.count("*").alias("n")),
    RAW + " SELECT OperationName, count(*) AS n FROM workspace_logs WHERE regexp_matches(OperationName, "
    "'(?i)(^|[^A-Za-z0-9])dax([^A-Za-z0-9]|$)') GROUP BY ALL"
)
register(
    "f4_contains", lambda s,
    d: logs(s, d).where(F.col("OperationName").contains("DAX")).groupBy("OperationName").agg(F.count("*").alias("n")),
    RAW + " SELECT OperationName, count(*) AS n FROM workspace_logs WHERE OperationName LIKE '%DAX%' GROUP BY ALL"
)
register(
    "f5_not_empty", lambda s, d: view(s, d, "audit_events").where(X.not_empty(F.col("IsSuccess"))).select("Id", "IsSuccess"),
    ctes("audit_events") + " SELECT Id, IsSuccess FROM audit_events WHERE IsSuccess IS NOT NULL AND IsSuccess <> ''"
)
register(
    "f6_isin", lambda s, d: _t(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
)
register(
    "f7_thresholds", lambda s, d: logs(s, d).where("DurationMs > 5000 AND CpuTimeMs > 0").select("OperationId", "DurationMs", "CpuTimeMs"),
    RAW + " SELECT OperationId, DurationMs, CpuTimeMs FROM workspace_logs WHERE DurationMs > 5000 AND CpuTimeMs > 0"
)
register(
    "f8_newer_than", lambda s, d: X.newer_than(_t(s, d, "orders"), "o_orderdate", "2001-01-01").select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'"
)
register(
    "f9_having", lambda s, d: X.having(logs(s, d), ["OperationId"], 1),
    RAW + " SELECT OperationId, count(*) AS n FROM workspace_logs GROUP BY ALL HAVING count(*) > 1"
)
register(
    "f13_running", lambda s, d: J.running(view(s, d, "activity")).select("run_id", "job_id"),
    ctes("activity") + " SELECT run_id, job_id FROM activity WHERE session_id = (SELECT max(session_id) FROM activity) AND start_execution_date IS "
    "NOT NULL AND stop_execution_date IS NULL"
)
register(
    "o1_multi_key_sort", lambda s,
    d: logs(s, d).select("OperationId", "CpuTimeMs", "Timestamp").orderBy(F.desc_nulls_last("CpuTimeMs"), "Timestamp"),
    RAW + " SELECT OperationId, CpuTimeMs, Timestamp FROM workspace_logs"
)
register(
    "o3_top_k", lambda s,
    d: X.top_k(
        _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"),
        [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 100
    ),
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100"
)
register(
    "p2_upn", lambda s, d: parsed(s, d).groupBy("upn").agg(F.count("*").alias("n")),
    PARSED + " SELECT upn, count(*) AS n FROM parsed GROUP BY ALL"
)
register(
    "p4_dax_text", lambda s, d: parsed(s, d).where("dax_text IS NOT NULL").groupBy("dax_text").agg(F.count("*").alias("n")),
    PARSED + " SELECT dax_text, count(*) AS n FROM parsed WHERE dax_text IS NOT NULL GROUP BY ALL"
)
register(
    "p14_to_date", lambda s,
    d: _t(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")),
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
)
register(
    "w2_rolling_average", lambda s,
    d: J.job_history(
        J.recency_rank(J.history_window(view(s, d, "runs"), AS_OF, None)), 5
    ).select("job_id", "step_id", "avg_duration_seconds"),
    ctes("runs") + ", h AS (SELECT *, (run_duration // 10000) * 3600 + ((run_duration % 10000) // 100) * 60 + run_duration % 100 AS sec, "
    "row_number() OVER (PARTITION BY job_id, step_id ORDER BY run_date DESC, run_time DESC, run_id DESC) AS rk FROM runs WHERE "
    "run_status IN (0, 1, 3) AND step_id <> 0) SELECT job_id, step_id, floor(avg(CASE WHEN run_status = 1 AND rk <= 5 THEN sec "
    "END))::BIGINT AS avg_duration_seconds FROM h GROUP BY ALL"
)
