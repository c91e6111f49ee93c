"""Profile, catalog, job, rule, scoring, report and stream queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import exprs as X
from granary.operators import catalog as C
from granary.operators import jobs as J
from granary.operators import logs as L
from granary.operators import profile as Q
from granary.operators import reports as R
from granary.operators import rules as U
from granary.operators import scoring as N
from granary.operators import validate as V
from granary.sources.fixtures import ctes, view
from granary.streaming import streams

from .audit import AUDIT, VALID, run_audit, valid
from .logs import A1, A2, A3, A5, PARSED, logs, parsed
from .registry import register

# --- profiles -------------------------------------------------------------------------------------------------------
_KIND = {
    "events": {"event_id": 1, "ts": 0, "user_id": 1, "event_type": 2, "value": 1, "props": 2},
    "part": {"p_partkey": 1, "p_name": 2, "p_brand": 2, "p_type": 2, "p_size": 1, "p_retailprice": 1},
    "lineitem": {
        "l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1,
        "l_tax": 1, "l_returnflag": 2, "l_linestatus": 2, "l_shipdate": 0
    },
    "documents": {"doc_id": 1, "text": 2, "lang": 2, "source": 2, "n_chars": 1},
    "orders": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 2, "o_totalprice": 1, "o_orderdate": 0, "o_orderpriority": 2},
    "flag_rows": {"k": 1, "part_null": 1, "mostly_null": 2, "one_value": 2, "spread": 1, "price": 1}
}


def _profile_sql(table: str, columns=None, layer: str = "BRONZE") -> str:
    out = []
    for c, kind in _KIND[table].items():
        if columns and c not in columns:
            continue
        n = f"CAST({c} AS DOUBLE)" if kind == 1 else "CAST(NULL AS DOUBLE)"
        ln = f"length({c})" if kind == 2 else "CAST(NULL AS BIGINT)"
        q = lambda p: f"quantile_disc({n}, {p})"  # noqa: B023, E731
        out.append(
            f"SELECT '{layer}' AS layer, '{table}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER "
            f"(WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS blank_count, "
            f"count(DISTINCT {c}) AS distinct_count, min({n}) AS min_num, max({n}) AS max_num, round(avg({n}), 4) AS avg_num, "
            f"round(stddev_samp({n}), 4) AS stddev_num, {q(.25)} AS p25, {q(.5)} AS p50, {q(.75)} AS p75, min({ln}) AS min_len, "
            f"max({ln}) AS max_len, round(avg({ln}), 2) AS avg_len, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / "
            f"count(*), 2) AS null_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') / count(*), "
            f"2) AS blank_pct, round(100.0::DOUBLE * count(DISTINCT {c}) / count(*), 2) AS cardinality_pct FROM {table}"
        )
    return " UNION ALL ".join(out)


def _table(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def _prof(t):
    return lambda s, d: Q.profile(_table(s, d, t), t, "BRONZE")


_FLAG = (
    "CASE WHEN null_pct > 80 THEN 'CRITICAL' WHEN null_pct > 30 OR distinct_count = 1 OR coalesce(stddev_num / "
    "nullif(abs(avg_num), 0) > 3, false) THEN 'WARN' ELSE 'OK' END"
)
_NOTES = (
    "concat_ws('; ', CASE WHEN null_pct > 80 THEN 'mostly null' END, CASE WHEN null_pct > 30 AND null_pct <= 80 THEN 'many nulls' "
    "END, CASE WHEN distinct_count = 1 THEN 'one value' END, CASE WHEN stddev_num / nullif(abs(avg_num), 0) > 3 THEN 'high "
    "variance' END, CASE WHEN distinct_count = total_rows AND total_rows > 1000 THEN 'all distinct' END)"
)
for _t in ("events", "part", "orders", "lineitem", "documents"):
    register(f"q2_profile_{_t}", _prof(_t), _profile_sql(_t))


def _flags(s, d):
    """Columns of every flag: nulls of 40 and 90 %, one value, a wide spread, none of these."""
    return Q.health_flags(Q.profile(view(s, d, "flag_rows"), "flag_rows", "BRONZE"))


_FLAGS = ctes("flag_rows") + f", flags AS (SELECT *, {_FLAG} AS health_flag, {_NOTES} AS notes FROM ({_profile_sql('flag_rows')}))"
register(
    "q3_health_flags", lambda s, d: _flags(s, d).select("table_name", "column_name", "health_flag", "notes"),
    _FLAGS + " SELECT table_name, column_name, health_flag, notes FROM flags"
)
register(
    "f11_flagged", lambda s, d: Q.flagged(_flags(s, d), "WARN", "CRITICAL").select("column_name", "health_flag"),
    _FLAGS + " SELECT column_name, health_flag FROM flags WHERE health_flag IN ('WARN', 'CRITICAL')"
)
register(
    "e21_flag_list", lambda s, d: Q.flag_list(_flags(s, d), "WARN").select("column_name", "null_pct"),
    _FLAGS + " SELECT column_name, null_pct FROM flags WHERE health_flag = 'WARN'"
)
_WIDE = "workspace_logs"
_COLS = ("CpuTimeMs", "EventText", "Identity", "ApplicationContext", "ModelMode", "ItemName")
register(
    "q1_null_profile", lambda s, d: Q.null_profile(logs(s, d).select(*_COLS), "logs", "BRONZE"),
    ctes(_WIDE) + " " + " UNION ALL ".join(
        f"SELECT 'BRONZE' AS layer, 'logs' AS table_name, '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {c} "
        f"IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS null_or_blank, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL OR "
        f"trim(CAST({c} AS VARCHAR)) = '') / count(*), 2) AS null_pct FROM workspace_logs" for c in _COLS
    )
)
register(
    "e25_high_null", lambda s,
    d: Q.null_profile(
        logs(s, d).select(*_COLS), "logs", "BRONZE"
    ).where("null_pct > 30").orderBy(F.desc("null_pct")).select("column_name", "null_pct"),
    ctes(_WIDE) + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') "
        f"/ count(*), 2) AS null_pct FROM workspace_logs" for c in _COLS
    ) + ") WHERE null_pct > 30"
)
register(
    "q5_profile_mapped", lambda s,
    d: Q.profile_mapped(
        _table(s, d, "nation").where("n_nationkey < 3").select(
            F.when(F.col("n_nationkey") == 0, "events").otherwise("part").alias("table_name"),
            F.when(F.col("n_nationkey") == 0, "value").when(F.col("n_nationkey") == 1, "p_size").otherwise("p_brand").alias("column_name")
        ),
        lambda t: _table(s, d, t)
    ),
    _profile_sql("events", ("value",), "MAPPED") + " UNION ALL " + _profile_sql("part", ("p_size", "p_brand"), "MAPPED")
)
register(
    "e22_numeric_stats", lambda s,
    d: _prof("part")(s, d).where("min_num IS NOT NULL").select("column_name", "min_num", "max_num", "avg_num"),
    f"SELECT column_name, min_num, max_num, avg_num FROM ({_profile_sql('part')}) WHERE min_num IS NOT NULL"
)
register(
    "e23_top_cardinality", lambda s,
    d: _prof("orders")(s, d).orderBy(F.desc("distinct_count"), "column_name").limit(10).select("column_name", "distinct_count"),
    f"SELECT column_name, distinct_count FROM ({_profile_sql('orders')}) ORDER BY distinct_count DESC, column_name LIMIT 10"
)
register(
    "e24_flag_mix", lambda s, d: _flags(s, d).groupBy("health_flag").agg(F.count("*").alias("columns")),
    _FLAGS + " SELECT health_flag, count(*) AS columns FROM flags GROUP BY ALL"
)

# --- catalog --------------------------------------------------------------------------------------------------------
_SYS = ("sys_tables", "sys_columns", "sys_measures", "sys_storage", "lineage_map", "lake_catalog")
_B = "CASE lower({c}) WHEN 'true' THEN true WHEN 'false' THEN false END"
MASTER = ctes(*_SYS) + f""", st AS (SELECT upper(trim(dimension_name)) AS st, upper(trim(attribute_name)) AS sc,
 max(TRY_CAST(dictionary_size AS BIGINT)) AS dictionary_size FROM sys_storage WHERE column_type = 'BASIC_DATA' GROUP BY ALL),
master AS (SELECT t.name AS table_name, explicitname AS object_name, 'COLUMN' AS object_type, sourcecolumn, datatype,
 {_B.format(c='c.ishidden')} AS is_hidden, {_B.format(c='iskey')} AS is_key, dictionary_size,
 CAST(NULL AS VARCHAR) AS expression FROM sys_columns c LEFT JOIN sys_tables t ON c.tableid = t.id LEFT
 JOIN st ON upper(trim(t.name)) = st.st AND upper(trim(explicitname)) = st.sc
 UNION ALL SELECT t.name, m.name, 'MEASURE', NULL, NULL, {_B.format(c='m.ishidden')}, NULL, NULL,
 expression FROM sys_measures m LEFT JOIN sys_tables t ON m.tableid = t.id)"""
FULL = MASTER + """, full0 AS (SELECT m.*, lh_layer, lh_table_name, relationship, c.data_type AS lh_data_type, c.table_row_count,
 l.sem_table_name IS NOT NULL AS has_lineage, c.column_name IS NOT NULL AS in_lakehouse,
 CASE WHEN object_type <> 'COLUMN' THEN NULL WHEN c.data_type IS NULL THEN 'NOT_IN_LAKEHOUSE'
 WHEN lower(c.data_type) = CASE datatype WHEN 'Int64' THEN 'bigint' WHEN 'String' THEN 'string' END THEN 'TYPE_MATCH'
 ELSE 'TYPE_MISMATCH' END AS alignment
 FROM master m LEFT JOIN lineage_map l ON upper(trim(m.table_name)) = upper(trim(l.sem_table_name)) LEFT
 JOIN lake_catalog c ON upper(trim(l.lh_table_name)) = upper(trim(c.table_name)) AND upper(trim(m.sourcecolumn)) = upper(trim(c.column_name)) AND l.lh_layer = c.layer),
full_ AS (SELECT *, sha256(concat_ws('|', coalesce(table_name, '~'), coalesce(object_name, '~'), object_type, coalesce(lh_table_name, '~'),
 coalesce(alignment, '~'))) AS _row_hash FROM full0)"""


def master(s, d):
    return C.metadata_master(*(view(s, d, v) for v in ("sys_columns", "sys_tables", "sys_measures", "sys_storage")))


def full(s, d):
    return C.metadata_full(master(s, d), view(s, d, "lineage_map"), view(s, d, "lake_catalog"))


register("m1_metadata_master", master, MASTER + " SELECT * FROM master")
register("m3_metadata_full", full, FULL + " SELECT * FROM full_")
_BUILT = "2024-01-31 00:00:00"
LINEAGE = ctes(*_SYS) + f""", st AS (SELECT upper(trim(dimension_name)) AS st, upper(trim(attribute_name)) AS sc, max(TRY_CAST(dictionary_size AS BIGINT)) AS bytes,
 max(TRY_CAST(rows_count AS BIGINT)) AS n FROM sys_storage WHERE column_type = 'BASIC_DATA' GROUP BY ALL),
sem AS (SELECT 'COLUMN' AS object_type, t.name AS sem_table_name, explicitname AS sem_column_name, datatype AS sem_data_type, columntype AS sem_column_type,
 encodingtype AS sem_encoding_type, {_B.format(c='c.ishidden')} AS sem_is_hidden, {_B.format(c='iskey')} AS sem_is_key, {_B.format(c='isavailableinmdx')} AS sem_is_mdx,
 description AS table_description, bytes AS sem_storage_bytes, n AS sem_storage_rows, sourcecolumn FROM sys_columns c LEFT JOIN sys_tables t ON c.tableid = t.id
 LEFT JOIN st ON upper(trim(t.name)) = st.st AND upper(trim(explicitname)) = st.sc
 UNION ALL SELECT 'MEASURE', t.name, m.name, 'MEASURE_EXPRESSION', 'Calculated', NULL, {_B.format(c='m.ishidden')}, NULL, NULL, NULL, NULL, NULL, NULL
 FROM sys_measures m LEFT JOIN sys_tables t ON m.tableid = t.id)
SELECT 'model' AS model_name, 'SemanticModel' AS source_system, sem.* EXCLUDE (sourcecolumn), lh_layer, lh_table_name, relationship, lakehouse_name,
 k.column_name AS lh_column_name, k.data_type AS lh_data_type, is_nullable AS lh_is_nullable, is_partition_col, table_row_count AS lh_table_row_count, last_modified,
 last_operation, last_modified_by, CASE WHEN object_type = 'MEASURE' THEN NULL WHEN k.column_name IS NULL THEN 'NOT_IN_LAKEHOUSE'
 WHEN lower(k.data_type) = CASE sem_data_type WHEN 'Int64' THEN 'bigint' WHEN 'String' THEN 'string' END THEN 'TYPE_MATCH' ELSE 'TYPE_MISMATCH' END AS data_type_alignment,
 k.column_name IS NOT NULL AS has_lakehouse_mapping, lh_table_name IS NOT NULL AS has_lineage_mapping, TIMESTAMP '{_BUILT}' AS _master_built_at,
 sha256(concat_ws('|', 'model', coalesce(sem.sem_table_name, '~'), sem_column_name, coalesce(lh_table_name, '~'))) AS _row_hash
FROM sem LEFT JOIN lineage_map l ON upper(trim(sem.sem_table_name)) = upper(trim(l.sem_table_name))
LEFT JOIN lake_catalog k ON upper(trim(lh_table_name)) = upper(trim(k.table_name)) AND upper(trim(sourcecolumn)) = upper(trim(k.column_name)) AND lh_layer = k.layer"""


def lineage_master(s, d):
    return C.lineage_master(*(view(s, d, v) for v in ("sys_columns", "sys_tables", "sys_measures", "sys_storage", "lineage_map", "lake_catalog")), "model",
                            F.lit(_BUILT).cast("timestamp"))


register("m3_lineage_master", lineage_master, LINEAGE)
register(
    "e16_table_list", lambda s, d: C.table_list(view(s, d, "lake_catalog")),
    ctes("lake_catalog") + " SELECT layer, table_name, count(*) AS columns, max(table_row_count) AS rows FROM lake_catalog GROUP BY ALL"
)
register(
    "f10_profile_targets", lambda s, d: C.profile_targets(full(s, d)),
    FULL + " SELECT DISTINCT lh_table_name, trim(sourcecolumn) AS column_name FROM full_ WHERE in_lakehouse AND object_type = 'COLUMN' "
    "AND lh_table_name IS NOT NULL AND sourcecolumn IS NOT NULL"
)
register(
    "e6_objects_by_type", lambda s, d: C.objects_by_type(master(s, d)),
    MASTER + " SELECT table_name, object_type, count(*) AS objects FROM master GROUP BY ALL"
)
register(
    "e7_measure_list", lambda s, d: C.measure_list(view(s, d, "sys_measures"), view(s, d, "sys_tables")),
    ctes(
        "sys_tables", "sys_measures"
    ) + " SELECT t.name AS table_name, m.name AS measure_name, expression FROM sys_measures m LEFT JOIN sys_tables t ON m.tableid = t.id"
)
register(
    "e8_largest_columns", lambda s, d: C.largest_columns(master(s, d)),
    MASTER + " SELECT table_name, object_name, dictionary_size FROM master WHERE object_type = 'COLUMN' ORDER BY dictionary_size DESC NULLS "
    "LAST, object_name LIMIT 20"
)
register(
    "e9_hidden_objects", lambda s, d: C.hidden_objects(master(s, d)),
    MASTER + " SELECT table_name, object_name, object_type FROM master WHERE is_hidden"
)
register(
    "e10_partition_list", lambda s, d: C.partition_list(view(s, d, "sys_partitions"), view(s, d, "sys_tables")),
    ctes(
        "sys_partitions", "sys_tables"
    ) + " SELECT t.name AS table_name, p.name AS partition_name, mode FROM sys_partitions p LEFT JOIN sys_tables t ON p.tableid = t.id"
)
register(
    "e16_catalog_summary", lambda s, d: C.catalog_summary(view(s, d, "lake_catalog")),
    ctes("lake_catalog") + " SELECT layer, count(DISTINCT table_name) AS tables, count(*) AS columns FROM lake_catalog GROUP BY ALL"
)
register(
    "e17_orphans", lambda s, d: C.orphans(full(s, d)),
    FULL + " SELECT table_name, object_name FROM full_ WHERE object_type = 'COLUMN' AND NOT has_lineage"
)
register(
    "e18_type_mismatches", lambda s, d: C.type_mismatches(full(s, d)),
    FULL + " SELECT table_name, object_name, datatype, lh_data_type FROM full_ WHERE alignment = 'TYPE_MISMATCH'"
)
register(
    "e19_coverage", lambda s, d: C.coverage(full(s, d)),
    FULL + " SELECT object_type, lh_layer, count(*) AS objects, count(*) FILTER (WHERE in_lakehouse) AS mapped FROM full_ GROUP BY ALL"
)
register(
    "e20_largest_tables", lambda s, d: C.largest_tables(master(s, d)),
    MASTER + " SELECT table_name, sum(dictionary_size)::BIGINT AS bytes FROM master GROUP BY ALL ORDER BY bytes DESC NULLS LAST, table_name "
    "LIMIT 15"
)


def _lined(s, d):
    m = full(s, d).where("alignment IS NOT NULL").groupBy(
        F.lit("part").alias("table_name"), F.when(F.col("is_key"), "p_partkey").otherwise("p_name").alias("column_name")
    ).agg(F.max("is_key").alias("is_key"), F.max("alignment").alias("alignment"))
    return Q.lineage_flags(Q.health_flags(_prof("part")(s, d)), m).select("column_name", "health_flag", "is_key", "alignment")


register(
    "q4_lineage_flags", _lined,
    FULL + f", lined AS (SELECT CASE WHEN is_key THEN 'p_partkey' ELSE 'p_name' END AS column_name, bool_or(is_key) AS is_key, "
    f"max(alignment) AS alignment FROM full_ WHERE alignment IS NOT NULL GROUP BY 1), pf AS (SELECT *, {_FLAG} AS hf FROM "
    f"({_profile_sql('part')})) SELECT column_name, CASE WHEN is_key AND null_count > 0 THEN 'CRITICAL' WHEN alignment = "
    f"'TYPE_MISMATCH' THEN CASE WHEN hf = 'CRITICAL' THEN 'CRITICAL' ELSE 'WARN' END ELSE hf END AS health_flag, is_key, alignment "
    f"FROM pf LEFT JOIN lined USING (column_name)"
)
register(
    "m6_impact", lambda s,
    d: Q.impact(
        Q.health_flags(_prof("events")(s, d)).withColumn("health_flag", F.when(F.col("distinct_count") < 10, "WARN").otherwise("OK")),
        master(s, d).where("object_type = 'MEASURE'").select(
            F.lit("events").alias("table_name"), F.lit("event_type").alias("column_name"), "object_name"
        )
    ),
    MASTER + " SELECT 'events' AS table_name, 'event_type' AS column_name, 'WARN' AS health_flag, object_name FROM master WHERE object_type "
    "= 'MEASURE' AND (SELECT count(DISTINCT event_type) FROM events) < 10"
)
register(
    "m7_release_gate", lambda s, d: Q.release_gate(Q.health_flags(_prof("orders")(s, d)), valid(s, d), run_audit(s, d)),
    VALID + AUDIT.replace("WITH ", ", ", 1)
    + f" SELECT *, critical = 0 AND not_passed = 0 AND failures = 0 AS open FROM (SELECT (SELECT count(*) FILTER (WHERE {_FLAG} = "
    f"'CRITICAL') FROM ({_profile_sql('orders')})) AS critical, (SELECT count(*) FROM valid WHERE validation_status NOT IN ('PASS', "
    f"'NO_DATA')) AS not_passed, (SELECT count(*) FROM audit WHERE status = 'FAILURE') AS failures)"
)

# --- jobs -----------------------------------------------------------------------------------------------------------
_SEC = "(({c} // 10000) * 3600 + (({c} % 10000) // 100) * 60 + {c} % 100)"
_HMS = (
    "(lpad(CAST(({c} % 86400) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({c} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST({c} % 60 AS VARCHAR), 2, '0'))"
)
RUNS = ctes("runs", "activity") + f""", hist AS (SELECT *, strptime(CAST(run_date AS VARCHAR),
 '%Y%m%d') + {_SEC.format(c='run_time')} * INTERVAL '1' SECOND AS run_start_datetime,
 {_SEC.format(c='run_duration')}::BIGINT AS run_duration_seconds FROM runs WHERE run_status IN (0, 1, 3) AND step_id <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, step_id ORDER BY run_date DESC, run_time DESC,
 run_id DESC) AS run_recency_rank FROM hist),
jh AS (SELECT job_id, step_id, count(*) AS total_historical_runs, count(*) FILTER (WHERE run_status = 1) AS successful_runs,
 count(*) FILTER (WHERE run_status = 0) AS failed_runs,
 floor(avg(CASE WHEN run_status = 1 AND run_recency_rank <= 30 THEN run_duration_seconds END))::BIGINT AS avg_duration_seconds,
 max(CASE WHEN run_status = 1 THEN run_duration_seconds END) AS max_duration_seconds,
 min(CASE WHEN run_status = 1 THEN run_duration_seconds END) AS min_duration_seconds,
 stddev_samp(CASE WHEN run_status = 1 AND run_recency_rank <= 30 THEN run_duration_seconds END) AS stddev_duration_seconds,
 max(run_start_datetime) AS last_run_datetime,
 max(CASE WHEN run_recency_rank = 1 THEN run_duration_seconds END) AS last_run_duration_seconds,
 max(CASE WHEN run_recency_rank = 1 THEN run_status END) AS last_run_status FROM ranked GROUP BY ALL)"""


def ranked(s, d):
    return J.recency_rank(J.history_window(view(s, d, "runs"), "2001-08-01", None))


def history(s, d):
    return J.job_history(ranked(s, d))


register(
    "p9_p10_history", lambda s,
    d: J.history_window(view(s, d, "runs"), "2001-08-01", 400).select("run_id", "run_start_datetime", "run_duration_seconds"),
    RUNS + " SELECT run_id, run_start_datetime, run_duration_seconds FROM hist WHERE run_start_datetime >= TIMESTAMP '2001-08-01' - "
    "INTERVAL 400 DAYS"
)
register(
    "p11_hhmmss_text", lambda s,
    d: view(s, d, "runs").select("run_id", X.hhmmss_text(X.hhmmss_to_seconds(F.col("run_duration")) * 7).alias("t")),
    RUNS + " SELECT run_id, " + _HMS.format(c=f"({_SEC.format(c='run_duration')} * 7)") + " AS t FROM runs"
)
register("w1_recency_rank", lambda s, d: ranked(s, d).select("run_id", "run_recency_rank"), RUNS + " SELECT run_id, run_recency_rank FROM ranked")
register(
    "w3_last_runs", lambda s, d: J.last_runs(ranked(s, d)).select("job_id", "step_id", "run_id"),
    RUNS + " SELECT job_id, step_id, run_id FROM ranked WHERE run_recency_rank <= 10"
)
register(
    "a8_job_history", lambda s, d: history(s, d).withColumn("stddev_duration_seconds", F.round("stddev_duration_seconds", 4)),
    RUNS + " SELECT * REPLACE (round(stddev_duration_seconds, 4) AS stddev_duration_seconds) FROM jh"
)
_ELAPSED = "date_diff('second', last_executed_step_date, TIMESTAMP '2001-08-01 06:00:00')"
register(
    "bj1_running_jobs", lambda s, d: J.running_jobs(view(s, d, "activity"), history(s, d), "2001-08-01 06:00:00"),
    RUNS + f", now_ AS (SELECT a.*, {_ELAPSED} AS e, successful_runs, avg_duration_seconds AS m FROM activity a LEFT JOIN jh ON a.job_id = "
    f"jh.job_id AND a.last_executed_step_id = jh.step_id WHERE session_id = (SELECT max(session_id) FROM activity) AND "
    f"stop_execution_date IS NULL) SELECT job_id, last_executed_step_id AS step_id, run_id, e AS elapsed_sec, {_HMS.format(c='e')} "
    f"AS elapsed_hhmmss, CASE WHEN coalesce(successful_runs >= 3, false) THEN e - m END AS overrun_seconds, CASE WHEN "
    f"successful_runs >= 3 AND m > 0 THEN round(100.0::DOUBLE * (e - m) / m, 1) END AS overrun_pct, CASE WHEN NOT "
    f"coalesce(successful_runs >= 3, false) THEN 'INSUFFICIENT_HISTORY' WHEN m IS NULL THEN 'NO_SUCCESS_HISTORY' WHEN e > m * 1.5 "
    f"THEN 'CRITICAL' WHEN e > m * 1.2 THEN 'WARNING' WHEN e < m THEN 'RUNNING_FAST' ELSE 'NORMAL' END AS overrun_status, CASE WHEN "
    f"successful_runs >= 3 AND m > 0 THEN start_execution_date + m * INTERVAL '1' SECOND END AS est_completion_time, CASE WHEN "
    f"successful_runs >= 3 AND m > 0 AND TIMESTAMP '2001-08-01 06:00:00' > start_execution_date + m * INTERVAL '1' SECOND THEN "
    f"'YES' ELSE 'NO' END AS past_estimated_completion FROM now_"
)
register(
    "bj2_run_anomalies", lambda s, d: J.run_anomalies(ranked(s, d), history(s, d)),
    RUNS + f" SELECT r.job_id, r.step_id, run_id, run_start_datetime, run_duration_seconds AS actual_duration_sec, "
    f"{_HMS.format(c='run_duration_seconds')} AS actual_hhmmss, avg_duration_seconds, run_duration_seconds - avg_duration_seconds "
    f"AS overrun_seconds, round(100.0::DOUBLE * (run_duration_seconds - avg_duration_seconds) / avg_duration_seconds, 1) AS "
    f"overrun_pct, CASE run_status WHEN 1 THEN 'Success' WHEN 0 THEN 'Failed' WHEN 3 THEN 'Cancelled' ELSE 'Other' END AS "
    f"run_outcome FROM ranked r JOIN jh ON r.job_id = jh.job_id AND r.step_id = jh.step_id WHERE run_recency_rank <= 10 AND "
    f"successful_runs >= 3 AND avg_duration_seconds > 0 AND run_duration_seconds > avg_duration_seconds * 1.2"
)
_HEALTH = (
    "SELECT job_id, step_id, total_historical_runs, successful_runs, failed_runs, round(100.0::DOUBLE * failed_runs / "
    "total_historical_runs, 1) AS failure_rate_pct, avg_duration_seconds, round(stddev_duration_seconds, 1) AS stddev_sec, "
    "round(stddev_duration_seconds / nullif(avg_duration_seconds, 0), 3) AS coeff_of_variation, CASE WHEN stddev_duration_seconds "
    "/ nullif(avg_duration_seconds, 0) > 0.5 THEN 'HIGH_VARIANCE' ELSE 'STABLE' END AS run_time_stability, CASE last_run_status "
    "WHEN 0 THEN 'Failed' WHEN 1 THEN 'Success' WHEN 3 THEN 'Cancelled' ELSE 'Unknown' END AS last_run_status FROM jh"
)
register("bj3_job_health", lambda s, d: J.job_health(history(s, d)), f"{RUNS} {_HEALTH}")


def _open_audit(s, d):
    """Run records of which the newest few have not ended."""
    open_ = F.col("run_start") >= F.lit("2001-07-25").cast("timestamp")
    gone = lambda c: F.when(~open_, F.col(c)).alias(c)
    return run_audit(s, d).select("run_id", "pipeline", "run_start", "status", gone("run_end"), gone("duration_seconds"))


_OPEN = AUDIT + """, o AS (SELECT run_id, pipeline, run_start, status, CASE WHEN run_start < TIMESTAMP '2001-07-25' THEN run_end END AS run_end,
 CASE WHEN run_start < TIMESTAMP '2001-07-25' THEN duration_seconds END AS duration_seconds FROM audit),
pr AS (SELECT *, status LIKE 'SUCCESS%' AS ok, row_number() OVER (PARTITION BY pipeline ORDER BY run_start DESC, run_id DESC) AS rk FROM o WHERE duration_seconds IS NOT NULL),
ph AS (SELECT pipeline, count(*) FILTER (WHERE ok) AS n_ok, floor(avg(CASE WHEN ok AND rk <= 30 THEN duration_seconds END))::BIGINT AS m FROM pr GROUP BY pipeline)"""
_AT = "2001-07-25 00:10:00"
register(
    "bj4_running_pipelines", lambda s, d: J.running_pipelines(_open_audit(s, d), _AT).select(
        "job_id", "run_id", "elapsed_sec", "overrun_seconds", "overrun_pct", "overrun_status", "past_estimated_completion"),
    _OPEN + f""", e AS (SELECT o.*, n_ok, m, date_diff('second', run_start, TIMESTAMP '{_AT}') AS e FROM o LEFT JOIN ph ON o.pipeline = ph.pipeline WHERE run_end IS NULL)
SELECT pipeline AS job_id, run_id, e AS elapsed_sec, CASE WHEN n_ok >= 3 THEN e - m END AS overrun_seconds,
 CASE WHEN n_ok >= 3 AND m > 0 THEN round(100.0::DOUBLE * (e - m) / m, 1) END AS overrun_pct,
 CASE WHEN NOT coalesce(n_ok >= 3, false) THEN 'INSUFFICIENT_HISTORY' WHEN m IS NULL THEN 'NO_SUCCESS_HISTORY' WHEN e > m * 1.5 THEN 'CRITICAL' WHEN e > m * 1.2 THEN 'WARNING'
 WHEN e < m THEN 'RUNNING_FAST' ELSE 'NORMAL' END AS overrun_status,
 CASE WHEN n_ok >= 3 AND m > 0 AND TIMESTAMP '{_AT}' > run_start + m * INTERVAL '1' SECOND THEN 'YES' ELSE 'NO' END AS past_estimated_completion FROM e"""
)
register(
    "bj4_pipeline_anomalies", lambda s, d: J.pipeline_anomalies(run_audit(s, d)).select("job_id", "run_id", "actual_duration_sec", "overrun_seconds", "run_outcome"),
    AUDIT + """, pr AS (SELECT *, status LIKE 'SUCCESS%' AS ok, row_number() OVER (PARTITION BY pipeline ORDER BY run_start DESC, run_id DESC) AS rk FROM audit),
ph AS (SELECT pipeline, count(*) FILTER (WHERE ok) AS n_ok, floor(avg(CASE WHEN ok AND rk <= 30 THEN duration_seconds END))::BIGINT AS m FROM pr GROUP BY pipeline)
SELECT pr.pipeline AS job_id, run_id, duration_seconds::BIGINT AS actual_duration_sec, duration_seconds - m AS overrun_seconds, CASE WHEN ok THEN 'Success' ELSE 'Failed' END AS run_outcome
FROM pr JOIN ph ON pr.pipeline = ph.pipeline WHERE rk <= 10 AND n_ok >= 3 AND m > 0 AND duration_seconds > m * 1.2"""
)
register(
    "bj4_pipeline_health", lambda s, d: J.pipeline_health(run_audit(s, d)),
    AUDIT + f", r AS (SELECT pipeline AS job_id, 1 AS step_id, CASE WHEN status LIKE 'SUCCESS%' THEN 1 ELSE 0 END AS run_status, "
    f"duration_seconds::BIGINT AS run_duration_seconds, row_number() OVER (PARTITION BY pipeline ORDER BY run_start DESC, run_id "
    f"DESC) AS rk FROM audit), jh AS (SELECT job_id, step_id, count(*) AS total_historical_runs, count(*) FILTER (WHERE run_status "
    f"= 1) AS successful_runs, count(*) FILTER (WHERE run_status = 0) AS failed_runs, floor(avg(CASE WHEN run_status = 1 AND rk <= "
    f"30 THEN run_duration_seconds END))::BIGINT AS avg_duration_seconds, stddev_samp(CASE WHEN run_status = 1 AND rk <= 30 THEN "
    f"run_duration_seconds END) AS stddev_duration_seconds, max(CASE WHEN rk = 1 THEN run_status END) AS last_run_status FROM r "
    f"GROUP BY ALL) {_HEALTH}"
)

# --- rules ----------------------------------------------------------------------------------------------------------
_LOW = "lower(coalesce(text, ''))"


def _hit_sql(cat: str) -> str:
    words = "[" + ", ".join(f"CASE WHEN contains({_LOW}, '{w}') THEN '{w}' END" for w in U.KEYWORDS[cat]) + "]"
    return f"list_filter({words}, lambda x: x IS NOT NULL)"


_ORD = {c: i for i, c in enumerate(U.KEYWORDS)}
HITS = ("WITH kw AS (SELECT doc_id, text, " + ", ".join(
    f"{_hit_sql(c)} AS {c}" for c in U.KEYWORDS
) + " FROM documents), hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, {i} AS ordinal, {c} AS kws FROM kw WHERE len({c}) > 0" for c, i in _ORD.items()
) + ""
    "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(kws) DESC, ordinal) AS rn "
    "FROM hits), top AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN category END) AS one, "
    "max(CASE WHEN rn = 2 THEN category END) AS two, count(*) AS n, "
    "list_sort(flatten(list(kws))) AS all_kws, bool_or(category = 'LGBTQ') AS lgbtq "
    "FROM r GROUP BY doc_id), cat AS (SELECT d.doc_id, d.text, "
    "coalesce(lgbtq, false) AS lgbtq, "
    "CASE WHEN n IS NULL THEN 'GENERAL' WHEN n = 1 THEN one ELSE CASE least(one, two) || '|' || greatest(one, two) " + " ".join(f"WHEN '{'|'.join(sorted(k))}' THEN '{v}'" for k, v in U.CONFLICTS.items()) + " ELSE one END END "
    "AS primary_category, CASE WHEN n IS NULL THEN 'LOW' WHEN n = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, "
    "array_to_string(coalesce(all_kws, []), ',') AS keywords FROM documents d LEFT JOIN top t ON d.doc_id = t.doc_id)")


def _hits(s, d):
    return U.keyword_hits(_table(s, d, "documents").select("doc_id", "text"), "text")


register(
    "x1_keyword_hits", lambda s,
    d: U.hit_rows(_hits(s, d)).select("doc_id", "category", "n"),
    HITS + " SELECT doc_id, category, len(kws) AS n FROM hits"
)
register(
    "x2_categorize", lambda s,
    d: U.categorize(_hits(s, d)).select("doc_id", "primary_category", "confidence", F.concat_ws(",", "matched_keywords").alias("keywords")),
    HITS + " SELECT doc_id, primary_category, confidence, keywords FROM cat"
)
_TAGSQL = "[" + ", ".join(
    f"CASE WHEN regexp_matches({_LOW}, '{p}') THEN '{t}' END" for p, t in U.TAGS.items()
) + ", CASE WHEN lgbtq AND primary_category <> 'LGBTQ' THEN 'LGBTQ-Affirming' END]"
register(
    "x3_modifier_tags", lambda s,
    d: U.classify(_table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.concat_ws(",", "sub_tags").alias("tags")),
    HITS + f" SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_TAGSQL}, lambda x: x IS NOT NULL))), ',') AS tags FROM "
    f"cat"
)
register(
    "x5_search", lambda s, d: U.search(view(s, d, "facilities"), view(s, d, "requests")),
    ctes("facilities", "requests") + " SELECT request_id, rank, FacilityID, FacilityName, WalkInAvailable FROM (SELECT *, row_number() OVER (PARTITION BY "
    "request_id ORDER BY WalkInAvailable DESC, FacilityName, FacilityID)::INT AS rank FROM requests r JOIN facilities f ON "
    "r.category = f.PrimaryCategory AND r.zip = f.ZipCode WHERE len(list_filter(string_split(needs, '|'), lambda x: x <> '' AND "
    "NOT list_contains(string_split(SubCategories, '|'), x))) = 0) WHERE rank <= 3"
)
register(
    "x6_stale", lambda s, d: U.stale(view(s, d, "facilities"), "2024-01-31").select("FacilityID", "is_stale"),
    ctes("facilities") + " SELECT FacilityID, date_diff('day', LastVerifiedDate, DATE '2024-01-31') > 90 AS is_stale FROM facilities"
)
DISC = (ctes(
    "facilities", "observations"
) + ", known AS (SELECT FacilityID, 'Phone' AS field, Phone AS known_value FROM facilities "
    "UNION ALL SELECT FacilityID, 'Hours', Hours FROM facilities), "
    "o AS (SELECT *, CASE source_kind WHEN 'official' THEN 1 WHEN 'directory' THEN 2 ELSE 3 END AS rank FROM observations), "
    "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY FacilityID, field ORDER BY rank, retrieved DESC, source_url) AS rn FROM o) WHERE rn = 1), "
    "cl AS (SELECT FacilityID, count(DISTINCT source_url) AS c FROM observations WHERE reports_closed GROUP BY ALL), "
    "disc AS (SELECT k.FacilityID, k.field, known_value, found_value, source_url, "
    "CASE WHEN coalesce(c, 0) >= 2 THEN 'CLOSED' WHEN found_value IS NULL THEN 'UNVERIFIABLE' "
    "WHEN trim(found_value) = trim(known_value) THEN 'VERIFIED' ELSE 'NEEDS UPDATE' END AS status, "
    "CASE rank WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence "
    "FROM known k LEFT JOIN b ON k.FacilityID = b.FacilityID AND k.field = b.field LEFT JOIN cl ON k.FacilityID = cl.FacilityID)")


def disc(s, d):
    return U.discrepancies(view(s, d, "facilities"), view(s, d, "observations"))


register("x7_discrepancies", lambda s, d: U.report_order(disc(s, d)), DISC + " SELECT * FROM disc")
register(
    "x8_verification_summary", lambda s, d: U.verification_summary(disc(s, d)),
    DISC + " SELECT status, count(*) AS fields, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM disc), 1) AS pct FROM disc GROUP "
    "BY ALL"
)
register(
    "x9_index_facilities", lambda s,
    d: U.modifier_tags(
        view(s, d, "facilities").withColumn("text", F.regexp_replace("SubCategories", "-", " ")), "text"
    ).select("FacilityID", F.concat_ws(",", "sub_tags").alias("tags")),
    ctes("facilities") + ", cat AS (SELECT FacilityID, replace(SubCategories, '-', ' ') AS text, false AS lgbtq, '' AS primary_category FROM " "facilities)" + f" SELECT FacilityID, array_to_string(list_sort(list_distinct(list_filter({_TAGSQL}, lambda x: x IS NOT NULL))), ',') AS tags " f"FROM cat"
)
register(
    "p20_contact_lookup", lambda s, d: U.contact_lookup(view(s, d, "facilities"), "000000001"),
    ctes("facilities") + " SELECT FacilityID, FacilityName, Phone, Hours, ZipCode FROM facilities WHERE contains(lower(FacilityName), '000000001')"
)
register(
    "p20_eligibility", lambda s, d: U.eligibility(view(s, d, "facilities"), "supplier#00000001"),
    ctes("facilities") + " SELECT FacilityID, FacilityName, EligibilityCriteria, WalkInAvailable FROM facilities WHERE contains(lower(FacilityName), "
    "'supplier#00000001')"
)

# --- scoring --------------------------------------------------------------------------------------------------------
_KEYS = ("nomination_id", "nomination_period")
_RUB = (
    "CASE WHEN {c} >= 0.9 THEN 'exceptional' WHEN {c} >= 0.7 THEN 'strong' WHEN {c} >= 0.4 THEN 'adequate' WHEN {c} >= 0.1 THEN "
    "'insufficient' ELSE 'not_addressed' END"
)
_DIMS = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{n}' AS dimension, {p} AS max_points, '{q}' AS ask" for i, (n, p, q) in enumerate(N.DIMENSIONS))
SCORES = ctes("raw_scores") + f""", dims AS ({_DIMS}), noms AS (SELECT DISTINCT nomination_id, nomination_period FROM raw_scores),
ds0 AS (SELECT n.nomination_id, n.nomination_period, d.*, least(1.0, greatest(0.0, coalesce(raw_score,
 0.0))) AS raw_score FROM noms n CROSS JOIN dims d LEFT JOIN raw_scores r ON n.nomination_id = r.nomination_id AND n.nomination_period = r.nomination_period AND d.dimension = r.dimension),
ds AS (SELECT *, round_even(raw_score * max_points, 1) AS weighted_score, {_RUB.format(c='raw_score')} AS rubric_level,
 raw_score < 0.4 AS flagged FROM ds0),
ex AS (SELECT *, row_number() OVER (PARTITION BY nomination_id, nomination_period ORDER BY weighted_score / max_points DESC,
 ordinal) AS rank FROM ds),
cards AS (SELECT *, {_RUB.format(c='total_score / 100')} AS overall_level FROM (SELECT nomination_id, nomination_period,
 round(sum(weighted_score::DECIMAL(10,1))::DOUBLE, 1) AS total_score, count(*) FILTER (WHERE flagged) AS flagged_dimensions,
 string_agg(dimension, ',' ORDER BY rank) FILTER (WHERE rank <= 2) AS strengths, string_agg(dimension,
 ',' ORDER BY rank) FILTER (WHERE rank > 4) AS gaps, string_agg(ask,
 '|' ORDER BY ordinal) FILTER (WHERE flagged OR rank > 4) AS council_focus FROM ex GROUP BY ALL))"""


def raw(s, d):
    return view(s, d, "raw_scores")


register(
    "n1_dimension_scores", lambda s, d: N.dimension_scores(raw(s, d), _KEYS),
    SCORES + " SELECT nomination_id, nomination_period, ordinal, dimension, max_points, raw_score, weighted_score, rubric_level, flagged "
    "FROM ds"
)
register(
    "w4_extremes", lambda s, d: N.extremes(N.dimension_scores(raw(s, d), _KEYS), _KEYS).select(*_KEYS, "dimension", "strength", "gap"),
    SCORES + " SELECT nomination_id, nomination_period, dimension, rank <= 2 AS strength, rank > 4 AS gap FROM ex"
)
register("n3_score_cards", lambda s, d: N.score_cards(raw(s, d), _KEYS), SCORES + " SELECT * FROM cards")
register(
    "w5_rank_nominees", lambda s, d: N.rank_nominees(N.score_cards(raw(s, d), _KEYS)).select("nomination_id", "total_score", "rank"),
    SCORES + " SELECT nomination_id, total_score, rank() OVER (PARTITION BY nomination_period ORDER BY total_score DESC) AS rank FROM cards"
)
register(
    "n6_nomination_summary", lambda s,
    d: N.nomination_summary(
        N.score_cards(raw(s, d), _KEYS),
        _table(s, d, "lineitem").select(F.col("l_orderkey").alias("nomination_id"), F.col("l_quantity").alias("council_score"))
    ).select("nomination_id", "total_score", "council_avg", "difference", "rank"),
    SCORES + ", cc AS (SELECT l_orderkey AS nomination_id, round(avg(l_quantity), 2) AS council_avg FROM lineitem GROUP BY ALL) SELECT "
    "c.nomination_id, total_score, council_avg, round(total_score - council_avg, 2) AS difference, rank() OVER (PARTITION BY "
    "nomination_period ORDER BY total_score DESC) AS rank FROM cards c LEFT JOIN cc ON c.nomination_id = cc.nomination_id"
)
register(
    "p19_evidence_only", lambda s, d: N.evidence_only(raw(s, d).withColumnRenamed("nominee_name", "nominee_dept")),
    ctes("raw_scores") + " SELECT * EXCLUDE (nominee_name) FROM raw_scores"
)
register(
    "n5_evidence_features", lambda s, d: N.evidence_features(_table(s, d, "benchmark"), "text").drop("text"),
    "SELECT item_id, trim(t) = '' AS is_blank, len(regexp_extract_all(t, '[.!?]+(\\s|$)')) AS sentences, len(regexp_extract_all(t, "
    "'[.!?]+(\\s|$)')) < 2 AS is_short, regexp_matches(t, '[0-9]') AS has_number, regexp_matches(lower(t), "
    "'\\b(day|week|month|year|hour)s?\\b') AS has_duration, regexp_matches(lower(t), "
    "'\\b(always|every|daily|weekly|often|consistently)\\b') AS has_frequency FROM (SELECT item_id, coalesce(text, '') AS t FROM "
    "benchmark)"
)

# --- reports --------------------------------------------------------------------------------------------------------
CARD = f""", a5 AS ({A5}), a2 AS ({A2}), ra AS (SELECT ItemName, WorkspaceName, ModelMode, round(avg(success_rate_pct),
 6) AS avg_refresh_success_rate, round(avg(avg_duration_ms), 4) AS avg_refresh_duration_ms,
 count(*) FILTER (WHERE sla_status = 'SLA_BREACH') AS sla_breach_days, count(*) AS total_refresh_days FROM a5 GROUP BY ALL),
da AS (SELECT model_name AS ItemName, WorkspaceName, round(avg(avg_duration_ms), 4) AS avg_dax_duration_ms,
 max(max_duration_ms) AS max_dax_duration_ms, sum(dax_execution_count)::BIGINT AS total_dax_executions,
 round(100.0::DOUBLE * count(*) FILTER (WHERE performance_tier IN ('Slow (2-10s)', 'Critical (>10s)')) / count(*),
 2) AS pct_slow_queries FROM a2 GROUP BY ALL),
card0 AS (SELECT ra.*, avg_dax_duration_ms, max_dax_duration_ms, total_dax_executions, pct_slow_queries,
 round(least(coalesce(avg_refresh_success_rate, 0), 100) * 0.5::DOUBLE + (100 - least(coalesce(pct_slow_queries, 0),
 100)) * 0.3::DOUBLE + (1 - least(sla_breach_days, total_refresh_days)::DOUBLE / greatest(total_refresh_days, 1)) * 20,
 1) AS health_score FROM ra LEFT JOIN da ON ra.ItemName = da.ItemName AND ra.WorkspaceName = da.WorkspaceName),
card AS (SELECT *, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 75 THEN 'B'
 WHEN health_score >= 60 THEN 'C' ELSE 'D' END AS health_grade FROM card0)"""


def _on(f, *parts):
    return lambda s, d: f(*(p(parsed(s, d)) for p in parts))


def same(df):
    return df


register("a7_health_scorecard", _on(R.health_scorecard, L.refresh_summary, L.dax_performance), PARSED + CARD + " SELECT * FROM card")
register(
    "r1_refresh_success_rate", _on(R.refresh_success_rate, L.refresh_summary),
    f"{PARSED} SELECT round(sum(success_count)::DOUBLE / sum(total_refreshes) * 100, 4) AS refresh_success_rate FROM ({A5})"
)
register(
    "r2_dax_measures", _on(R.dax_measures, L.dax_performance, L.refresh_summary),
    f"{PARSED} SELECT round(avg(avg_duration_ms / 1000), 4) AS avg_dax_seconds, round(sum(CASE WHEN avg_duration_ms > 5000 THEN "
    f"dax_execution_count ELSE 0 END)::DOUBLE / sum(dax_execution_count) * 100, 4) AS slow_query_pct, (SELECT count(*) FILTER "
    f"(WHERE sla_status = 'SLA_BREACH') FROM ({A5})) AS sla_breach_days FROM ({A2})"
)
register(
    "r3_average_grade", lambda s, d: R.average_grade(_on(R.health_scorecard, L.refresh_summary, L.dax_performance)(s, d)),
    PARSED + CARD + " SELECT avg_score, CASE WHEN avg_score >= 90 THEN 'A' WHEN avg_score >= 75 THEN 'B' WHEN avg_score >= 60 THEN 'C' ELSE 'D' "
    "END AS grade FROM (SELECT round(avg(health_score), 4) AS avg_score FROM card)"
)
register(
    "r4_rolling_users", _on(lambda a: R.rolling_users(a, 7), L.user_activity),
    f"{PARSED}, a3 AS (SELECT DISTINCT log_date, user_upn FROM ({A3})), days AS (SELECT DISTINCT log_date FROM a3) SELECT "
    f"days.log_date, count(DISTINCT user_upn) AS active_users FROM days JOIN a3 ON a3.log_date BETWEEN days.log_date - 6 AND "
    f"days.log_date GROUP BY ALL"
)
register(
    "r5_page_totals", _on(R.page_totals, same),
    PARSED + " SELECT count(*) AS operations, count(DISTINCT upn) AS users, round(100.0::DOUBLE * count(*) FILTER (WHERE Status = "
    "'SUCCESS') / count(*), 2) AS success_pct FROM parsed"
)
register(
    "r5_daily_trend", _on(R.daily_trend, same),
    PARSED + " SELECT log_date, count(*) AS operations, round(100.0::DOUBLE * count(*) FILTER (WHERE Status = 'SUCCESS') / count(*), 2) AS success_pct "
    "FROM parsed GROUP BY ALL"
)
register(
    "r5_top_models", _on(R.top_models, same),
    PARSED + " SELECT ItemName, count(*) AS operations FROM parsed GROUP BY ALL ORDER BY operations DESC, ItemName LIMIT 5"
)
register("r5_by_status", _on(R.by_status, same), PARSED + " SELECT Status, count(*) AS operations FROM parsed GROUP BY ALL")
register(
    "r6_model_day", _on(lambda p: R.matrix(p, "ItemName", "DAY"), same),
    PARSED + " SELECT ItemName, log_date AS period, count(*) AS operations FROM parsed GROUP BY ALL"
)
register(
    "r6_report_week", _on(lambda p: R.matrix(p, "report_id", "WEEK"), same),
    PARSED + " SELECT report_id, CAST(date_trunc('week', Timestamp) AS DATE) AS period, count(*) AS operations FROM parsed WHERE report_id "
    "IS NOT NULL GROUP BY ALL"
)
register(
    "r7_cpu_mix", _on(R.cpu_mix, L.dax_performance),
    f"{PARSED} SELECT model_name, execution_profile, sum(dax_execution_count)::BIGINT AS executions FROM ({A2}) GROUP BY ALL"
)
register("r7_hourly", _on(R.hourly, same), PARSED + " SELECT hour(Timestamp)::INT AS hour, count(*) AS operations FROM parsed GROUP BY ALL")
register(
    "r8_report_overview", _on(R.report_overview, L.visual_usage),
    f"{PARSED} SELECT report_id, sum(total_renders)::BIGINT AS renders, sum(failure_count)::BIGINT AS failures, round(100.0::DOUBLE "
    f"* sum(failure_count) / sum(total_renders), 2) AS failure_pct FROM ({A1}) GROUP BY ALL"
)
register(
    "r8_tier_mix", _on(R.tier_mix, L.visual_usage),
    f"{PARSED} SELECT render_performance_tier, count(*) AS groups, sum(total_renders)::BIGINT AS renders FROM ({A1}) GROUP BY ALL"
)

# --- stream twins ---------------------------------------------------------------------------------------------------
register(
    "t2_feed", lambda s, d: streams.feed(logs(s, d).withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))),
    ctes("workspace_logs") + " SELECT time_bucket(INTERVAL '15 minutes', Timestamp) AS start, time_bucket(INTERVAL '15 minutes', Timestamp) + INTERVAL '15 " "minutes' AS \"end\", OperationName, count(*) AS operations FROM workspace_logs GROUP BY ALL"
)
register(
    "v5_latest_validation", lambda s,
    d: V.latest(
        valid(s, d).select(
            "day", "validation_status", F.lit("p").alias("pipeline"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("validated_at")
        )
    ).select("day", "validation_status", "validated_at"),
    VALID + " SELECT day, validation_status, 2 AS validated_at FROM valid"
)
