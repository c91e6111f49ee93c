"""Adapter views: the given tables in the shapes that the operators read.

Each text is the SELECT of one view. It runs unchanged on Spark and on an independent SQL engine, which
makes it the common ground of every query and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "workspace_logs": """
SELECT concat('op-', CAST(event_id - CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END AS STRING)) AS OperationId, ts AS Timestamp,
 CASE event_type WHEN 'view' THEN 'Execute DAX' WHEN 'click' THEN 'ExecuteDAX' WHEN 'purchase' THEN 'Refresh'
      WHEN 'signup' THEN 'Discover' ELSE 'Execute DAX' END AS OperationName,
 concat('detail', CAST(event_id % 3 AS STRING)) AS OperationDetailName,
 CASE WHEN event_type = 'error' OR event_id % 17 = 0 THEN 'Failure' ELSE ' Success' END AS Status,
 CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS StatusCode,
 CASE WHEN event_type = 'purchase' AND day(ts) = 5 AND user_id % 6 = 3 THEN CAST(floor(value * 100) AS BIGINT) + 1900000
      WHEN event_type = 'purchase' AND day(ts) = 6 AND user_id % 6 = 4 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS DurationMs,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * (event_id % 11) * 10) AS BIGINT) END AS CpuTimeMs,
 concat('User', CAST(user_id AS STRING), '@Example.com') AS ExecutingUser,
 CASE WHEN event_id % 5 = 0 THEN concat('{"Text":"EVALUATE t', CAST(event_id % 9 AS STRING), '"}')
      WHEN event_id % 5 = 1 THEN concat('{"QueryText":"EVALUATE q', CAST(event_id % 9 AS STRING), '"}')
      WHEN event_id % 5 = 2 THEN '{"OperationStatus":"Done","ErrorMessage":"none"}' WHEN event_id % 5 = 3 THEN '{bad' ELSE NULL END AS EventText,
 CASE WHEN event_id % 6 = 0 THEN concat('{"upn":" User', CAST(user_id AS STRING), '@Example.com"}') WHEN event_id % 6 = 1 THEN NULL
      ELSE concat('{"Upn":"User', CAST(user_id AS STRING), '@Example.com","ObjectId":"o', CAST(user_id AS STRING), '","TenantId":"t', CAST(user_id % 3 AS STRING), '"}') END AS Identity,
 CASE WHEN event_id % 4 = 0 THEN NULL
      WHEN event_id % 4 = 1 THEN concat('{"ReportId":"r', CAST(event_id % 13 AS STRING), '","VisualId":"v', CAST(event_id % 29 AS STRING), '","ClientType":"Excel","Application":"Excel"}')
      ELSE concat('{"Sources":[{"ReportId":"r', CAST(event_id % 13 AS STRING), '","ReportName":"Report ', CAST(event_id % 13 AS STRING), '","VisualId":"v', CAST(event_id % 29 AS STRING), '","PageId":"p', CAST(event_id % 5 AS STRING), '"}],"ClientType":"PBIClient","Application":"Service","ActivityId":"a', CAST(event_id % 97 AS STRING), '"}') END AS ApplicationContext,
 concat('item', CAST(user_id % 6 AS STRING)) AS ItemId,
 CASE WHEN user_id % 10 = 9 THEN 'Report' ELSE 'SemanticModel' END AS ItemKind,
 concat('Model', CAST(user_id % 6 AS STRING)) AS ItemName, concat('w', CAST(user_id % 2 AS STRING)) AS WorkspaceId, concat('WS',
 CAST(user_id % 2 AS STRING)) AS WorkspaceName,
 CASE WHEN user_id % 3 = 0 THEN 'DirectLake' WHEN user_id % 3 = 1 THEN 'Import' ELSE NULL END AS ModelMode
FROM (SELECT event_id, event_type, value,
 CASE WHEN event_id % 16 = 5 THEN 3 WHEN event_id % 64 = 6 THEN 4 WHEN event_id % 400 = 10 THEN 5 ELSE user_id END AS user_id,
 CASE WHEN event_id % 16 = 5 THEN ts + (8 - day(ts)) * INTERVAL '1' DAY WHEN event_id % 64 = 6 THEN ts + (9 - day(ts)) * INTERVAL '1' DAY
      WHEN event_id % 400 = 10 THEN ts + (10 - day(ts)) * INTERVAL '1' DAY ELSE ts END AS ts FROM events ) busy""",
    "audit_events": """
SELECT concat('id-', CAST(event_id - CASE WHEN event_id % 40 = 1 THEN 1 ELSE 0 END AS STRING)) AS Id,
 CAST(CASE WHEN event_id % 9 = 0 THEN 20 ELSE 21 END AS INT) AS RecordType,
 CAST(ts AS STRING) AS CreationTime, CASE event_type WHEN 'view' THEN 'ViewReport'
 WHEN 'click' THEN ' ExportReport' WHEN 'purchase' THEN 'ShareReport' WHEN 'signup' THEN 'DownloadReport' ELSE 'DeleteReport' END AS Operation,
 concat(' User', CAST(user_id AS STRING), '@Example.com ') AS UserId,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('Item', CAST(event_id % 23 AS STRING)) END AS ItemName, concat('WS',
 CAST(user_id % 4 AS STRING)) AS WorkSpaceName,
 CASE WHEN event_type = 'error' THEN 'false' WHEN event_id % 11 = 0 THEN '' ELSE 'True' END AS IsSuccess,
 concat('{"AppId":"app', CAST(event_id % 3 AS STRING), '","CapacityId":"cap', CAST(event_id % 2 AS STRING), '","ArtifactKind":"Report"}') AS raw_json,
 CAST(ts AS DATE) AS _batch_date, ts AS event_ts
FROM events""",
    "runs": """
SELECT o_orderkey AS run_id, o_orderpriority AS job_id, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INT) AS step_id,
 CAST(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01' THEN 0
  WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 23 = 0 THEN 3 WHEN o_orderkey % 29 = 0 THEN 2 ELSE 1 END AS INT) AS run_status,
 CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS run_date,
 CAST((o_orderkey % 24) * 10000 + (o_custkey % 60) * 100 + o_orderkey % 60 AS INT) AS run_time,
 CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) * 10000 + (CAST(floor(o_totalprice / 100) AS BIGINT) % 60) * 100 + CAST(floor(o_totalprice) AS BIGINT) % 60 AS INT) AS run_duration,
 concat('message ', CAST(o_orderkey AS STRING)) AS message
FROM orders""",
    "activity": """
SELECT o_orderpriority AS job_id, CAST(o_custkey % 3 AS INT) AS session_id,
 TIMESTAMP '2001-08-01 05:59:00' - (o_orderkey * 7919 % 30000 + CASE WHEN o_orderkey % 3 = 0 THEN 2592000 ELSE 0 END) * INTERVAL '1' SECOND AS start_execution_date,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS stop_execution_date,
 CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS INT) AS last_executed_step_id,
 TIMESTAMP '2001-08-01 06:00:00' - (o_orderkey * 7919 % 30000 + CASE WHEN o_orderkey % 3 = 0 THEN 2592000 ELSE 0 END) * INTERVAL '1' SECOND AS last_executed_step_date,
 o_orderkey AS run_id
FROM orders""",
    "flag_rows": """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 4 THEN NULL ELSE o_custkey END AS part_null,
 CASE WHEN o_orderkey % 10 <> 3 THEN NULL ELSE 'x' END AS mostly_null, 'same' AS one_value,
 CASE WHEN o_orderkey % 100 = 7 THEN 1000000 ELSE 1 END AS spread, o_totalprice AS price
FROM orders""",
    "control": """
SELECT CAST(n_nationkey AS INT) AS control_id, concat('pipeline_', CAST(n_nationkey AS STRING)) AS pipeline_name, concat('src_',
 lower(n_name)) AS source_table, concat('bronze_', lower(n_name)) AS destination_table,
 CASE WHEN n_nationkey % 2 = 0 THEN 'FULL' ELSE 'INCREMENTAL' END AS load_type,
 CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE concat('silver_', lower(n_name)) END AS silver_table,
 CASE n_regionkey WHEN 0 THEN 'SERVER1' WHEN 1 THEN 'SERVER2' WHEN 2 THEN 'GRAPH_API' ELSE 'SERVER3' END AS server_switch,
 n_nationkey % 5 <> 4 AS is_active, TIMESTAMP '1998-01-01 00:00:00' AS source_cutoff_date, CAST(NULL AS STRING) AS last_run_status,
 CAST(NULL AS BIGINT) AS last_rows_read
FROM nation""",
    "run_results": """
SELECT CAST(c_nationkey AS INT) AS control_id, max(CASE WHEN c_nationkey % 6 = 5 THEN 'FAILURE: timeout'
 WHEN c_nationkey % 6 = 4 THEN 'SUCCESS_NO_NEW_DATA' ELSE 'SUCCESS' END) AS status, count(*) AS rows_read,
 max(CASE WHEN c_nationkey % 6 = 4 THEN NULL ELSE TIMESTAMP '1999-06-01 00:00:00' END) AS max_watermark
FROM customer WHERE c_nationkey % 3 <> 2 GROUP BY c_nationkey""",
    "gold": """SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k1, c_mktsegment AS k2, c_acctbal AS balance,
 c_name AS label, TIMESTAMP '2023-01-01 00:00:00' AS _dw_created_at
 FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 50 <> 0 OR c_custkey = 50)""",
    "staging": """SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k1, c_mktsegment AS k2,
 CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, c_name AS label,
 TIMESTAMP '2024-01-01 00:00:00' AS _dw_created_at FROM customer WHERE c_custkey % 4 <> 1 AND (c_custkey % 50 <> 0 OR c_custkey = 50)""",
    "src_rows": "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) <> 28",
    "dst_rows": """SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) NOT IN (7,
 8) AND (day(o_orderdate) <> 9 OR o_orderkey % 5 <> 0) UNION ALL SELECT o_orderkey AS k,
 CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate) IN (11, 12)""",
    "sys_tables": """SELECT CAST(n_nationkey AS STRING) AS id, concat('Table ', CAST(n_nationkey AS STRING)) AS name,
 CASE WHEN n_nationkey % 6 = 0 THEN 'True' ELSE 'False' END AS ishidden,
 CASE WHEN n_nationkey % 4 <> 0 THEN concat('about ', lower(n_name)) END AS description FROM nation""",
    "sys_columns": """SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey % 27 AS STRING) AS tableid, concat('Col ',
 CAST(p_partkey AS STRING)) AS explicitname, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(' col_',
 CAST(p_partkey AS STRING)) END AS sourcecolumn, CASE WHEN p_size < 20 THEN 'Int64' ELSE 'String' END AS datatype,
 CASE WHEN p_partkey % 9 = 0 THEN 'True' ELSE 'False' END AS ishidden, CASE WHEN p_partkey % 31 = 0 THEN 'True'
 ELSE 'False' END AS iskey, CASE WHEN p_partkey % 7 = 0 THEN 'Calculated' ELSE 'Data' END AS columntype, CASE WHEN p_size < 20 THEN 'Value'
 WHEN p_size < 40 THEN 'Hash' END AS encodingtype, CASE WHEN p_partkey % 5 = 0 THEN 'false' ELSE 'true' END AS isavailableinmdx FROM part""",
    "sys_measures": """SELECT CAST(s_suppkey AS STRING) AS id, CAST(s_suppkey % 25 AS STRING) AS tableid, concat('Measure ',
 CAST(s_suppkey AS STRING)) AS name, concat('SUM(x', CAST(s_suppkey AS STRING), ')') AS expression,
 CASE WHEN s_suppkey % 5 = 0 THEN 'True' ELSE 'False' END AS ishidden FROM supplier""",
    "sys_storage": """SELECT upper(concat('table ', CAST(p_partkey % 27 AS STRING))) AS dimension_name, concat(upper(concat('col ',
 CAST(p_partkey AS STRING))), ' ') AS attribute_name, CASE WHEN p_partkey % 8 = 0 THEN 'HIERARCHY' ELSE 'BASIC_DATA' END AS column_type,
 CASE WHEN p_partkey % 12 = 1 THEN 'n/a' ELSE CAST(p_partkey * 1000 % 7919 AS STRING) END AS dictionary_size, CAST(p_size * 100 AS STRING) AS rows_count FROM part""",
    "sys_partitions": """SELECT CAST(c_custkey AS STRING) AS id, CAST(c_custkey % 25 AS STRING) AS tableid, concat('part-',
 CAST(c_custkey AS STRING)) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Import' ELSE 'DirectLake' END AS mode FROM customer""",
    "lineage_map": """SELECT concat('table ', CAST(n_nationkey AS STRING), ' ') AS sem_table_name,
 CASE WHEN n_nationkey % 2 = 0 THEN 'SILVER' ELSE 'GOLD' END AS lh_layer, concat('lh_', CAST(n_nationkey AS STRING)) AS lh_table_name,
 'DIRECT' AS relationship FROM nation WHERE n_nationkey % 5 <> 0""",
    "lake_catalog": """SELECT CASE WHEN (p_partkey % 27) % 2 = 0 THEN 'SILVER' ELSE 'GOLD' END AS layer, concat('LH_',
 CAST(p_partkey % 27 AS STRING)) AS table_name, concat('COL_', CAST(p_partkey AS STRING)) AS column_name,
 CASE WHEN p_size < 25 THEN 'bigint' ELSE 'string' END AS data_type, p_size * 10 AS table_row_count, CASE WHEN (p_partkey % 27) % 2 = 0 THEN 'lh_silver' ELSE 'lh_gold' END AS lakehouse_name,
 p_partkey % 2 = 0 AS is_nullable, p_partkey % 13 = 0 AS is_partition_col, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE '2024-01-15 06:00:00' END AS last_modified,
 CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE 'MERGE' END AS last_operation, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE 'svc' END AS last_modified_by
 FROM part WHERE p_partkey % 3 <> 0""",
    "facilities": """SELECT s_suppkey AS FacilityID, s_name AS FacilityName, CASE s_nationkey % 5 WHEN 0 THEN 'HOUSING'
 WHEN 1 THEN 'FOOD' WHEN 2 THEN 'LEGAL' WHEN 3 THEN 'HEALTHCARE' ELSE 'MENTAL_HEALTH' END AS PrimaryCategory,
 concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Walk-In|' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Emergency|' ELSE '' END,
 'Free-Service') AS SubCategories, CAST(10000 + s_nationkey AS STRING) AS ZipCode, concat('555-', CAST(s_suppkey AS STRING)) AS Phone,
 concat('Hours ', CAST(s_suppkey % 4 AS STRING)) AS Hours, CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS WalkInAvailable,
 CASE WHEN s_suppkey % 5 = 0 THEN 'Adults' ELSE 'All' END AS EligibilityCriteria, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2023-09-01'
 ELSE DATE '2024-01-15' END AS LastVerifiedDate FROM supplier""",
    "requests": """SELECT c_custkey AS request_id, CASE c_nationkey % 5 WHEN 0 THEN 'HOUSING'
 WHEN 1 THEN 'FOOD' WHEN 2 THEN 'LEGAL' WHEN 3 THEN 'HEALTHCARE' ELSE 'MENTAL_HEALTH' END AS category,
 CAST(10000 + c_nationkey AS STRING) AS zip, CASE WHEN c_custkey % 3 = 0 THEN 'Walk-In' WHEN c_custkey % 7 = 0 THEN 'Walk-In|Emergency'
 ELSE '' END AS needs FROM customer""",
    "observations": """SELECT s_suppkey AS FacilityID, 'Phone' AS field, CASE WHEN s_suppkey % 3 = 0 THEN concat('555-',
 CAST(s_suppkey AS STRING)) ELSE '555-0' END AS found_value, concat('http://a/', CAST(s_suppkey AS STRING)) AS source_url,
 'official' AS source_kind, DATE '2024-01-10' AS retrieved,
 s_suppkey % 11 = 0 AS reports_closed FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey AS FacilityID, 'Hours' AS field,
 concat('Hours ', CAST(s_suppkey % 3 AS STRING)) AS found_value, concat('http://b/', CAST(s_suppkey AS STRING)) AS source_url,
 CASE WHEN s_suppkey % 2 = 0 THEN 'directory' ELSE 'social' END AS source_kind, DATE '2024-01-12' AS retrieved,
 s_suppkey % 22 = 0 AS reports_closed FROM supplier WHERE s_suppkey % 5 <> 2""",
    "raw_scores": """SELECT o_orderkey AS nomination_id, concat('nominee', CAST(o_custkey % 200 AS STRING)) AS nominee_name,
 concat(CAST(year(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING)) AS nomination_period, d.dimension,
 CAST(2 * (((o_orderkey * 7 + d.k * 13) % 61) - 5) AS DOUBLE) / 100 AS raw_score FROM orders JOIN (SELECT 0 AS k,
 'impact' AS dimension UNION ALL SELECT 1, 'consistency' UNION ALL SELECT 2, 'collaboration' UNION ALL SELECT 3,
 'initiative' UNION ALL SELECT 4, 'values_alignment' UNION ALL SELECT 5, 'client_impact') d ON (o_orderkey + d.k) % 8 <> 0""",
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


_BASE = ("events", "orders", "nation", "customer", "supplier", "part", "lineitem")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter view as a DataFrame over the given tables."""
    text = VIEWS[name]
    tables(spark, sf_dir, *(t for t in _BASE if t in text.replace(",", " ").split()))
    return spark.sql(text)


def ctes(*names: str) -> str:
    """WITH clause of the views, for the SQL twins (`STRING` and `BIGINT` are known to both engines)."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
