"""Audit, table, ingest and validation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import exprs as X
from granary.operators import audit as A
from granary.operators import ingest as I
from granary.operators import tables as T
from granary.operators import validate as V
from granary.sources.fixtures import ctes, view

from .logs import A10, PARSED
from .logs import parsed as parsed_logs
from .registry import register

SILVER = ctes("audit_events") + r""", silver0 AS (SELECT Id, TRY_CAST(RecordType AS INT) AS RecordType,
 TRY_CAST(CreationTime AS TIMESTAMP) AS CreationTime, trim(Operation) AS Operation, lower(trim(UserId)) AS UserId,
 trim(ItemName) AS ItemName, trim(WorkSpaceName) AS WorkSpaceName,
 CASE upper(trim(IsSuccess)) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END AS IsSuccess, raw_json, _batch_date, event_ts,
 json_extract_string(raw_json, '$.AppId') AS AppId, json_extract_string(raw_json, '$.CapacityId') AS CapacityId,
 json_extract_string(raw_json, '$.ArtifactKind') AS ArtifactKind, CAST(TRY_CAST(CreationTime AS TIMESTAMP) AS DATE) AS log_date FROM audit_events),
silver AS (SELECT * EXCLUDE (rn), sha256(concat_ws('|', CAST(RecordType AS VARCHAR), CAST(CreationTime AS VARCHAR), Operation, UserId, coalesce(ItemName, '~'),
 WorkSpaceName, coalesce(CAST(IsSuccess AS VARCHAR), '~'), CAST(event_ts AS VARCHAR), AppId, CapacityId, ArtifactKind)) AS _row_hash
 FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY CreationTime DESC NULLS LAST, UserId, Operation) AS rn FROM silver0) WHERE rn = 1)"""


def bronze(s, d):
    return view(s, d, "audit_events")


def silver(s, d):
    return A.silver_audit(bronze(s, d))


SUMMARY = (
    "SELECT log_date, UserId, Operation, WorkSpaceName, count(*) AS total_events, count(*) FILTER (WHERE IsSuccess) AS "
    "success_events, count(*) FILTER (WHERE NOT IsSuccess) AS failure_events, count(DISTINCT ItemName) + max(CASE WHEN ItemName IS "
    "NULL THEN 1 ELSE 0 END) AS unique_items, round(100.0::DOUBLE * count(*) FILTER (WHERE IsSuccess) / count(*), 2) AS "
    "success_rate_pct, CASE WHEN count(*) >= 1000 THEN 'Heavy' WHEN count(*) >= 100 THEN 'Moderate' ELSE 'Light' END AS user_tier "
    "FROM silver GROUP BY ALL"
)
_EXP = "('ExportReport', 'ShareReport', 'DownloadReport')"
register("c6_silver_audit", lambda s, d: silver(s, d).drop("CreationTime"), SILVER + " SELECT * EXCLUDE (CreationTime) FROM silver")
register("a6_audit_user_summary", lambda s, d: A.audit_user_summary(silver(s, d)), f"{SILVER} {SUMMARY}")
register(
    "a11_max_batch", lambda s, d: A.max_batch(bronze(s, d)),
    ctes("audit_events") + " SELECT max(_batch_date) AS max_batch_date FROM audit_events"
)
register(
    "f15_export_events", lambda s, d: A.export_events(bronze(s, d)).select("Id", "UserId", "Operation"),
    ctes("audit_events") + f" SELECT Id, UserId, Operation FROM audit_events WHERE trim(Operation) IN {_EXP}"
)
register(
    "f14_visible_to", lambda s,
    d: A.visible_to(
        silver(s, d),
        s.read.parquet(f"{d}/nation.parquet").select(
            F.concat(F.lit("u"), (F.col("n_nationkey") % 3).cast("string")).alias("user"),
            F.concat(F.lit("WS"), (F.col("n_nationkey") % 5).cast("string")).alias("workspace")
        ).where("workspace IN ('WS1', 'WS3')"),
        "u1"
    ).select("Id", "WorkSpaceName"),
    SILVER + " SELECT Id, WorkSpaceName FROM silver WHERE WorkSpaceName IN (SELECT concat('WS', CAST(n_nationkey % 5 AS VARCHAR)) FROM "
    "nation WHERE n_nationkey % 3 = 1 AND n_nationkey % 5 IN (1, 3))"
)
register(
    "e27_batch_counts", lambda s, d: A.batch_counts(bronze(s, d)),
    ctes("audit_events") + " SELECT _batch_date, Operation, count(*) AS events FROM audit_events GROUP BY ALL"
)
register("e28_operations", lambda s, d: A.operations(silver(s, d)), SILVER + " SELECT Operation, count(*) AS events FROM silver GROUP BY ALL")
register(
    "e28_daily_volume", lambda s, d: A.daily_volume(silver(s, d)),
    SILVER + " SELECT log_date, count(*) AS events FROM silver GROUP BY ALL ORDER BY log_date DESC LIMIT 14"
)
register(
    "e28_top_users", lambda s, d: A.top_users(silver(s, d)),
    SILVER + " SELECT UserId, count(*) AS events FROM silver GROUP BY ALL ORDER BY events DESC, UserId LIMIT 15"
)
register(
    "r9_user_operation_matrix", lambda s, d: A.user_operation_matrix(silver(s, d), ["ViewReport", "ExportReport", "ShareReport"]),
    SILVER + " SELECT UserId, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE Operation = '{o}'), 0) AS {o}" for o in ("ViewReport", "ExportReport", "ShareReport")
    ) + " FROM silver GROUP BY ALL"
)
register(
    "r9_export_focus", lambda s, d: A.export_focus(silver(s, d)),
    SILVER + f" SELECT UserId, Operation, count(*) AS exports, count(DISTINCT ItemName) AS items FROM silver WHERE Operation IN {_EXP} GROUP "
    f"BY ALL"
)
register(
    "p16_flatten_audit", lambda s, d: A.flatten_audit(bronze(s, d)).select("Id", "RecordType", "UserType", "ItemName", "ClientIP"),
    ctes("audit_events") + " SELECT Id, RecordType, CAST(-1 AS INT) AS UserType, coalesce(ItemName, '') AS ItemName, '' AS ClientIP FROM audit_events"
)
register(
    "p8_to_bool", lambda s, d: bronze(s, d).groupBy(X.to_bool(F.col("IsSuccess")).alias("ok")).agg(F.count("*").alias("n")),
    ctes("audit_events") + " SELECT CASE upper(trim(IsSuccess)) WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END AS ok, count(*) AS n FROM audit_events "
    "GROUP BY ALL"
)

# --- tables and merges --------------------------------------------------------------------------------------------
_HASHED = ", sha256(concat_ws('|', CAST(round(balance * 100) AS BIGINT), label)) AS _row_hash"


def _hashed(df):
    cents = F.round(F.col("balance") * 100).cast("bigint").cast("string")
    return df.withColumn("_row_hash", F.sha2(F.concat_ws("|", cents, "label"), 256))


def gold_staging(s, d):
    return _hashed(view(s, d, "gold")), _hashed(view(s, d, "staging"))


_MERGE = (
    ctes("gold", "staging") + f", t AS (SELECT *{_HASHED} FROM gold), u AS (SELECT *{_HASHED} FROM staging), j AS (SELECT t.*, t._row_hash IS NOT NULL AS "
    f"in_t, u.k1 AS uk1, u.k2 AS uk2, u.balance AS ubalance, u.label AS ulabel, u._dw_created_at AS ucreated, u._row_hash AS uhash "
    f"FROM t FULL OUTER JOIN u ON t.k1 IS NOT DISTINCT FROM u.k1 AND t.k2 = u.k2)"
)
register(
    "k7_merge_upsert", lambda s, d: T.merge_upsert(*gold_staging(s, d), ["k1", "k2"], "_row_hash", ("_dw_created_at",)),
    _MERGE + " SELECT CASE WHEN in_t THEN k1 ELSE uk1 END AS k1, CASE WHEN in_t THEN k2 ELSE uk2 END AS k2, CASE WHEN in_t AND (uhash IS "
    "NULL OR uhash = _row_hash) THEN balance ELSE ubalance END AS balance, CASE WHEN in_t AND (uhash IS NULL OR uhash = _row_hash) "
    "THEN label ELSE ulabel END AS label, CASE WHEN in_t THEN _dw_created_at ELSE ucreated END AS _dw_created_at, CASE WHEN in_t "
    "AND (uhash IS NULL OR uhash = _row_hash) THEN _row_hash ELSE uhash END AS _row_hash FROM j"
)
register(
    "k10_merge_changes", lambda s, d: T.merge_changes(*gold_staging(s, d), ["k1", "k2"], "_row_hash"),
    _MERGE + " SELECT CASE WHEN in_t IS NOT TRUE THEN 'INSERT' WHEN uhash IS NULL THEN 'TARGET_ONLY' WHEN uhash = _row_hash THEN 'SAME' "
    "ELSE 'UPDATE' END AS change, count(*) AS n FROM j GROUP BY ALL"
)
register(
    "k11_post_merge_check", lambda s,
    d: T.post_merge_check(
        s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("name")).agg(
            F.count_if(F.col("o_orderstatus") == "O").alias("staging_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("gold_rows")
        )
    ),
    "SELECT *, CASE WHEN staging_rows > gold_rows THEN 'CHECK' ELSE 'OK' END AS \"check\" FROM (SELECT o_orderpriority AS name, "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS staging_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS gold_rows FROM "
    "orders GROUP BY ALL)"
)
register(
    "k2_append_rows", lambda s, d: T.append_rows(view(s, d, "gold").select("k1", "k2"), view(s, d, "staging").select("k1", "label")),
    ctes("gold", "staging") + " SELECT k1, k2, CAST(NULL AS VARCHAR) AS label FROM gold UNION ALL SELECT k1, NULL, label FROM staging"
)
register(
    "k4_conform", lambda s,
    d: T.conform(
        s.read.parquet(f"{d}/part.parquet"),
        s.createDataFrame([], "p_partkey string, p_retailprice decimal(5,1), p_name int, missing date").schema
    ),
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, TRY_CAST(p_retailprice AS DECIMAL(5,1)) AS p_retailprice, TRY_CAST(p_name AS "
    "INT) AS p_name, CAST(NULL AS DATE) AS missing FROM part"
)
register(
    "w7_dedupe", lambda s,
    d: X.dedupe(
        view(s, d, "workspace_logs"), ["OperationId"], [F.desc("Timestamp"), F.col("DurationMs")]
    ).select("OperationId", "Timestamp", "DurationMs"),
    ctes("workspace_logs") + " SELECT OperationId, Timestamp, DurationMs FROM (SELECT *, row_number() OVER (PARTITION BY OperationId ORDER BY Timestamp "
    "DESC, DurationMs) AS rn FROM workspace_logs) WHERE rn = 1"
)
register(
    "p12_row_hash", lambda s,
    d: s.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", X.row_hash(["c_custkey", "c_name", "c_mktsegment"], null="~").alias("h")
    ),
    "SELECT c_custkey, sha256(concat_ws('|', c_custkey, c_name, c_mktsegment)) AS h FROM customer"
)
register(
    "p13_stamp", lambda s, d: X.stamp(s.read.parquet(f"{d}/nation.parquet"), _source="files", _load_type="FULL"),
    "SELECT *, 'files' AS _source, 'FULL' AS _load_type FROM nation"
)
register(
    "p6_cleanse", lambda s,
    d: X.cleanse(
        bronze(s, d), trim=["Operation"], upper=["WorkSpaceName"], lower=["UserId"]
    ).select("Id", "Operation", "WorkSpaceName", "UserId"),
    ctes("audit_events") + " SELECT Id, trim(Operation) AS Operation, upper(trim(WorkSpaceName)) AS WorkSpaceName, lower(trim(UserId)) AS UserId FROM "
    "audit_events"
)
register(
    "p7_cast_cols", lambda s,
    d: X.cast_cols(view(s, d, "sys_storage"), {"dictionary_size": "bigint"}).groupBy("column_type").agg(
        F.sum("dictionary_size").alias("bytes"), F.count("dictionary_size").alias("known")
    ),
    ctes("sys_storage") + " SELECT column_type, sum(TRY_CAST(dictionary_size AS BIGINT))::BIGINT AS bytes, count(TRY_CAST(dictionary_size AS BIGINT)) AS "
    "known FROM sys_storage GROUP BY ALL"
)
register(
    "u1_union_typed", lambda s,
    d: X.union_typed(view(s, d, "sys_columns").select("id", "datatype"), view(s, d, "sys_measures").select("id", "expression")),
    ctes(
        "sys_columns", "sys_measures"
    ) + " SELECT id, datatype, CAST(NULL AS VARCHAR) AS expression FROM sys_columns UNION ALL SELECT id, NULL, expression FROM sys_measures"
)
register(
    "u5_distinct_with_null", lambda s, d: bronze(s, d).groupBy("Operation").agg(X.distinct_with_null("ItemName").alias("items")),
    ctes("audit_events") + " SELECT Operation, count(DISTINCT ItemName) + max(CASE WHEN ItemName IS NULL THEN 1 ELSE 0 END) AS items FROM audit_events "
    "GROUP BY ALL"
)

# --- ingest ---------------------------------------------------------------------------------------------------------
register(
    "s14_active_control", lambda s, d: I.active_control(view(s, d, "control")),
    ctes("control") + " SELECT * FROM control WHERE is_active ORDER BY control_id"
)
register(
    "c1_plan_loads", lambda s, d: I.plan_loads(view(s, d, "control")),
    ctes("control") + " SELECT control_id, pipeline_name, CASE WHEN server_switch = 'GRAPH_API' THEN 'BLOB' WHEN server_switch IN ('SERVER1', "
    "'SERVER2') THEN 'JDBC' ELSE 'UNKNOWN_SERVER' END AS reader, load_type, CASE WHEN load_type = 'FULL' THEN 'REPLACE' ELSE "
    "'APPEND' END AS write_mode, CASE WHEN load_type = 'INCREMENTAL' THEN source_cutoff_date END AS newer_than FROM control WHERE "
    "is_active"
)
register(
    "j17_match_loaders", lambda s,
    d: I.match_loaders(
        view(s, d, "control"),
        s.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 4 <> 1").select(
            F.concat(F.lit("silver_"), F.lower("n_name")).alias("silver_table"), F.concat(F.lit("load_"), "n_nationkey").alias("loader")
        )
    ),
    ctes("control") + " SELECT c.control_id, c.silver_table, r.loader, CASE WHEN r.loader IS NULL THEN 'SKIP' ELSE 'RUN' END AS action FROM control "
    "c LEFT JOIN (SELECT concat('silver_', lower(n_name)) AS silver_table, concat('load_', n_nationkey) AS loader FROM nation "
    "WHERE n_nationkey % 4 <> 1) r ON c.silver_table = r.silver_table WHERE c.is_active"
)
register(
    "c2_full_load", lambda s, d: I.full_rows(s.read.parquet(f"{d}/supplier.parquet"), _server="SERVER1", _load_type="FULL"),
    "SELECT *, 'SERVER1' AS _server, 'FULL' AS _load_type FROM supplier"
)
register(
    "c3_incremental_load", lambda s,
    d: I.incremental_rows(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "2001-06-30", _load_type="INCREMENTAL"),
    "SELECT *, 'INCREMENTAL' AS _load_type FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-30'"
)
register(
    "k12_update_control", lambda s, d: I.update_control(view(s, d, "control"), view(s, d, "run_results")),
    ctes("control", "run_results") + " SELECT c.control_id, pipeline_name, source_table, destination_table, load_type, silver_table, server_switch, is_active, CASE "
    "WHEN status LIKE 'SUCCESS%' AND load_type = 'INCREMENTAL' THEN coalesce(max_watermark, source_cutoff_date) ELSE "
    "source_cutoff_date END AS source_cutoff_date, coalesce(status, last_run_status) AS last_run_status, CASE WHEN status LIKE "
    "'SUCCESS%' THEN rows_read ELSE last_rows_read END AS last_rows_read FROM control c LEFT JOIN run_results r ON c.control_id = "
    "r.control_id"
)
_RUNS = (
    "runs_log AS (SELECT o_orderkey AS run_id, concat('pipeline_', CAST(o_custkey % 7 AS STRING)) AS pipeline, o_orderdate AS "
    "run_start, o_orderdate + (o_orderkey % 977) * INTERVAL '1' SECOND AS run_end, CASE WHEN o_orderkey % 13 = 0 OR (o_custkey % 7 < 3 AND "
    "o_orderdate >= TIMESTAMP '2001-07-10' AND o_orderdate < TIMESTAMP '2001-07-17') THEN 'FAILURE' ELSE 'SUCCESS' END AS status, o_custkey AS rows_read FROM orders)"
)
AUDIT = (
    f"WITH {_RUNS}, audit AS (SELECT *, CAST(date_diff('second', run_start, run_end) AS INT) AS duration_seconds, CAST(run_start AS "
    f"DATE) AS audit_date, 'SYSTEM' AS triggered_by FROM runs_log)"
)


def run_audit(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    start = F.col("o_orderdate").cast("timestamp")
    bad_week = F.expr("o_custkey % 7 < 3 AND o_orderdate >= '2001-07-10' AND o_orderdate < '2001-07-17'")
    runs = o.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("pipeline_"), (F.col("o_custkey") % 7).cast("string")).alias("pipeline"),
        start.alias("run_start"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("o_orderkey") % 977).alias("run_end"),
        F.when((F.col("o_orderkey") % 13 == 0) | bad_week, "FAILURE").otherwise("SUCCESS").alias("status"), F.col("o_custkey").alias("rows_read")
    )
    return I.audit_run(runs)


register("k13_audit_run", run_audit, AUDIT + " SELECT * FROM audit")
register(
    "k14_short_audit", lambda s, d: I.short_audit(run_audit(s, d)).select("run_id", "pipeline", "rows_read"),
    AUDIT + " SELECT run_id, pipeline, rows_read FROM audit WHERE status = 'SUCCESS'"
)
register(
    "e29_run_history", lambda s, d: I.run_history(run_audit(s, d), "2001-08-01"),
    AUDIT + " SELECT audit_date, pipeline, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS ok, sum(rows_read)::BIGINT AS "
    "rows_read FROM audit WHERE audit_date >= DATE '2001-07-18' GROUP BY ALL"
)
register(
    "e29_run_failures", lambda s, d: I.run_failures(run_audit(s, d)).select("run_id", "pipeline", "audit_date"),
    AUDIT + " SELECT run_id, pipeline, audit_date FROM audit WHERE status = 'FAILURE' ORDER BY run_start DESC, run_id LIMIT 25"
)
register(
    "e29_slowest_runs", lambda s, d: I.slowest_runs(run_audit(s, d)).select("run_id", "duration_seconds"),
    AUDIT + " SELECT run_id, duration_seconds FROM audit ORDER BY duration_seconds DESC, run_id LIMIT 15"
)
register(
    "e29_daily_success", lambda s, d: I.daily_success(run_audit(s, d)),
    AUDIT + " SELECT audit_date, count(*) AS runs, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'SUCCESS') / count(*), 2) AS "
    "success_pct FROM audit GROUP BY ALL"
)
register(
    "r10_run_alerts", lambda s, d: I.run_alerts(run_audit(s, d), "2001-07-16"),
    AUDIT + " SELECT pipeline, count(*) AS failures FROM audit WHERE status = 'FAILURE' AND audit_date > DATE '2001-07-09' GROUP BY ALL "
    "HAVING count(*) > 1"
)

# --- validation -----------------------------------------------------------------------------------------------------
_STATUS = (
    "CASE WHEN s = 0 AND t = 0 THEN 'NO_DATA' WHEN s = 0 THEN 'DEST_ONLY' WHEN t = 0 THEN 'CRITICAL_MISSING' WHEN t::DOUBLE / s < "
    "0.95 THEN 'WARN_SHORT_LOAD' WHEN t::DOUBLE / s > 1.05 THEN 'WARN_OVER_LOADED' ELSE 'PASS' END"
)
VALID = (
    ctes("src_rows", "dst_rows") + f", v0 AS (SELECT day, coalesce(a.n, 0) AS s, coalesce(b.n, 0) AS t, coalesce(a.k, 0) AS sk, coalesce(b.k, 0) AS tk FROM "
    f"(SELECT day, count(*) AS n, count(DISTINCT k) AS k FROM src_rows GROUP BY day) a FULL OUTER JOIN (SELECT day, count(*) AS n, "
    f"count(DISTINCT k) AS k FROM dst_rows GROUP BY day) b USING (day)), valid AS (SELECT day, s AS source_row_count, t AS "
    f"destination_row_count, sk AS source_distinct_keys, tk AS dest_distinct_keys, s - t AS row_diff, sk - tk AS key_diff, CASE "
    f"WHEN s > 0 THEN round(100.0::DOUBLE * t / s, 2) END AS pct_loaded, {_STATUS} AS validation_status FROM v0)"
)


def valid(s, d):
    return V.validate_load(view(s, d, "src_rows"), view(s, d, "dst_rows"))


register("v1_validate_load", valid, VALID + " SELECT * FROM valid")
register("v2_status_counts", lambda s, d: V.status_counts(valid(s, d)), VALID + " SELECT validation_status, count(*) AS days FROM valid GROUP BY ALL")
register(
    "v3_validate_all", lambda s,
    d: V.validate_all(
        [
            ("orders", view(s, d, "src_rows"), view(s, d, "dst_rows"), "day", "k"),
            ("back", view(s, d, "dst_rows"), view(s, d, "src_rows"), "day", "k")
        ]
    ).groupBy("pipeline", "validation_status").agg(F.count("*").alias("days"), F.sum("row_diff").alias("row_diff")),
    VALID + f" SELECT 'orders' AS pipeline, validation_status, count(*) AS days, sum(row_diff)::BIGINT AS row_diff FROM valid GROUP BY ALL "
    f"UNION ALL SELECT 'back', {_STATUS} AS validation_status, count(*), sum(s - t)::BIGINT FROM (SELECT t AS s, s AS t FROM v0) "
    f"GROUP BY ALL"
)
register(
    "v4_silent_failures", lambda s,
    d: V.silent_failures(
        view(s, d, "src_rows").groupBy("day").agg(
            (100.0 - F.count("*") % 9).cast("double").alias("success_rate_pct")
        ).withColumn("pipeline", F.lit("orders")),
        valid(s, d).withColumn("pipeline", F.lit("orders"))
    ),
    VALID + ", rep AS (SELECT day, (100.0 - count(*) % 9)::DOUBLE AS success_rate_pct FROM src_rows GROUP BY day) SELECT day, 'orders' AS "
    "pipeline, success_rate_pct, pct_loaded, validation_status FROM rep JOIN valid USING (day) WHERE success_rate_pct >= 95 AND "
    "destination_row_count < 0.95 * source_row_count"
)
register("e26_problems", lambda s, d: V.problems(valid(s, d)), VALID + " SELECT * FROM valid WHERE validation_status NOT IN ('PASS', 'NO_DATA')")
register(
    "a9_daily_counts", lambda s, d: V.daily_counts(view(s, d, "src_rows"), "day", "k"),
    ctes("src_rows") + " SELECT day, count(*) AS n, count(DISTINCT k) AS keys FROM src_rows GROUP BY ALL"
)
register(
    "v4_reported_days", lambda s,
    d: parsed_logs(s, d).transform(
        lambda df: df.groupBy("log_date").agg(
            F.round(100.0 * F.count_if(F.col("Status") == "SUCCESS") / F.count("*"), 2).alias("success_rate_pct")
        )
    ),
    f"{PARSED} SELECT log_date, round(100.0::DOUBLE * sum(success_ops) / sum(total_ops), 2) AS success_rate_pct FROM ({A10}) GROUP BY ALL"
)
