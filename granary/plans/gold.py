"""Gold loads and log tables after a second load, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import snake_columns
from granary.operators import audit as A
from granary.operators import gold as G
from granary.operators import logs as L
from granary.operators import reports as R
from granary.sources.fixtures import ctes, view
from granary.sources.schemas import schema

from .audit import SILVER, SUMMARY, silver
from .logs import A5, A12, PARSED, parsed
from .quality import CARD
from .registry import register

_FIRST, _SECOND = "2024-01-10 00:00:00", "2024-02-01 00:00:00"
#: Rows that the first load has not seen yet: one table, part of whose events arrive late.
_EARLY = {"logs": "DurationMs % 7 <> 3", "audit": "Id NOT LIKE '%3'"}


def _loaded(name: str, early: DataFrame, all_: DataFrame) -> DataFrame:
    """The gold table after a load of the early rows' summary and one of all rows' summary, without hashes."""
    at = lambda x: F.lit(x).cast("timestamp")
    empty = early.sparkSession.createDataFrame([], schema(name))
    first = G.merged_gold(empty, early, name, at(_FIRST))
    return G.merged_gold(first, all_, name, at(_SECOND)).drop("_row_hash", "gold_loaded_at")


# Of each gold table the keys and the columns whose change is an update, written out: the twin doesn't read the operator's own lists.
_COLUMNS = {
    "gold_model_health_scorecard": (
        "ItemName WorkspaceName ModelMode",
        "model_name avg_refresh_success_rate avg_refresh_duration_ms sla_breach_days total_refresh_days avg_dax_duration_ms max_dax_duration_ms "
        "total_dax_executions pct_slow_queries health_score health_grade"
    ),
    "gold_semantic_model_refresh_summary": (
        "log_date ItemName WorkspaceName ModelMode",
        "total_refresh_ops success_count failure_count avg_duration_ms max_duration_ms min_duration_ms avg_cpu_ms success_rate_pct sla_status"
    ),
    "gold_semantic_model_dax_performance": (
        "log_date ItemName WorkspaceName executing_user app_name",
        "dax_execution_count avg_duration_ms max_duration_ms p95_duration_ms avg_cpu_ms failed_executions performance_tier"
    ),
    "gold_audit_user_activity_summary": (
        "log_date UserId Operation WorkSpaceName", "user_tier total_events success_events failure_events unique_items success_rate_pct"
    ),
}


def _twin(name: str, ctes: str, early: str, all_: str) -> str:
    keys, hashed = (x.split() for x in _COLUMNS[name])
    columns = [f.name for f in schema(name) if f.name not in ("_row_hash", "gold_loaded_at") and not f.name.startswith("_dw_")]
    types = {f.name: f.dataType.simpleString() for f in schema(name)}
    typed = ", ".join(f"CAST({c} AS {types[c]}) AS {c}" if types[c].startswith("decimal") or types[c] in ("int", "bigint") else c for c in columns)
    differ = " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in hashed)
    out = ", ".join(f"CASE WHEN changed THEN s_{c} ELSE t_{c} END AS {c}" for c in columns)
    pairs = ", ".join(f"t.{c} AS t_{c}, s.{c} AS s_{c}" for c in columns)
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)
    return f"""{ctes}, early AS ({early}), whole AS ({all_}),
t AS (SELECT {typed}, true AS here FROM early), s AS (SELECT {typed}, true AS here FROM whole),
j AS (SELECT {pairs}, t.here AS in_t, t.here IS NULL OR (s.here IS NOT NULL AND ({differ})) AS changed FROM t FULL OUTER JOIN s ON {on})
SELECT {out}, CASE WHEN in_t THEN TIMESTAMP '{_FIRST}' ELSE TIMESTAMP '{_SECOND}' END AS _dw_created_at,
 CASE WHEN changed THEN TIMESTAMP '{_SECOND}' ELSE TIMESTAMP '{_FIRST}' END AS _dw_updated_at FROM j"""


_REFRESH = "gold_semantic_model_refresh_summary"
_DAX = "gold_semantic_model_dax_performance"
_AUDIT = "gold_audit_user_activity_summary"
_CARD = "gold_model_health_scorecard"


def _refresh(p: DataFrame) -> DataFrame:
    return L.refresh_summary(p).withColumnRenamed("total_refreshes", "total_refresh_ops")


def _dax(p: DataFrame) -> DataFrame:
    return L.gold_dax_performance(p).withColumnsRenamed({"workspace_name": "WorkspaceName", "model_name": "ItemName"})


def _card(p: DataFrame) -> DataFrame:
    return R.health_scorecard(L.refresh_summary(p), L.dax_performance(p)).withColumn("model_name", F.col("ItemName"))


def _both(f, rows, early: str):
    """f over the early rows and over all."""
    return f(rows.where(early)), f(rows)


register(
    "c8_gold_refresh", lambda s, d: _loaded(_REFRESH, *_both(_refresh, parsed(s, d), _EARLY["logs"])),
    _twin(
        _REFRESH, PARSED,
        f"SELECT * RENAME (total_refreshes AS total_refresh_ops) FROM "
        f"({A5.replace('FROM parsed WHERE', 'FROM parsed WHERE ' + _EARLY['logs'] + ' AND')})",
        f"SELECT * RENAME (total_refreshes AS total_refresh_ops) FROM ({A5})"
    )
)
register(
    "c8_gold_dax", lambda s, d: _loaded(_DAX, *_both(_dax, parsed(s, d), _EARLY["logs"])),
    _twin(
        _DAX, PARSED,
        f"SELECT * RENAME (workspace_name AS WorkspaceName, model_name AS ItemName) FROM "
        f"({A12.replace('FROM parsed WHERE', 'FROM parsed WHERE ' + _EARLY['logs'] + ' AND')})",
        f"SELECT * RENAME (workspace_name AS WorkspaceName, model_name AS ItemName) FROM ({A12})"
    )
)
register("c8_gold_audit", lambda s, d: _loaded(_AUDIT, *_both(A.audit_user_summary, silver(s, d), _EARLY["audit"])), _twin(
    _AUDIT, SILVER, SUMMARY.replace("FROM silver", f"FROM silver WHERE {_EARLY['audit']}"), SUMMARY))
#: The scorecard's steps over the early rows, under other names.
_EARLY_CARD = re.sub(r"\b(a5|a2|ra|da|card0|card)\b", r"early_\1", CARD.replace("FROM parsed WHERE", "FROM parsed WHERE " + _EARLY["logs"] + " AND"))
register("c8_gold_scorecard", lambda s, d: _loaded(_CARD, *_both(_card, parsed(s, d), _EARLY["logs"])), _twin(
    _CARD, PARSED + CARD + _EARLY_CARD, "SELECT *, ItemName AS model_name FROM early_card", "SELECT *, ItemName AS model_name FROM card"))


def _log_tables(s, d) -> DataFrame:
    """Parsed log rows after two loads that overlap."""
    raw = view(s, d, "workspace_logs")
    return G.merged_logs(G.parsed_rows(raw.where("DurationMs % 3 <> 0")), G.parsed_rows(raw.where("DurationMs % 3 <> 1")))


_LOG = "OperationId, Timestamp, Status, DurationMs, upn, report_id"
_BATCH = PARSED[PARSED.index(", parsed0 AS") :]
_TWO = ctes("workspace_logs") + "".join(
    _BATCH.replace(
        "AS rn FROM workspace_logs)", f"AS rn FROM workspace_logs WHERE DurationMs % 3 <> {k})"
    ).replace("parsed0", f"{n}0").replace("parsed AS", f"{n} AS") for n,
    k in (("p", 0), ("q", 1))
)
register(
    "c7_log_tables", lambda s, d: _log_tables(s, d).select(*_LOG.split(", ")),
    f"{_TWO} SELECT {_LOG} FROM q UNION ALL SELECT {_LOG} FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.OperationId = "
    f"p.OperationId AND q.Timestamp = p.Timestamp)"
)
register(
    "p15_snake_columns", lambda s,
    d: snake_columns(
        s.read.parquet(f"{d}/orders.parquet").select(
            F.col("o_orderkey").alias(" Order Key "), F.col("o_totalprice").alias("Total-Price (USD)"),
            F.col("o_orderdate").alias("OrderDate")
        )
    ),
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd, o_orderdate AS orderdate FROM orders"
)
