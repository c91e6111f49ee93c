"""Audit logs: flatten, cleanse, summarise, and the audit page's datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.exprs import business, cleanse, dedupe, distinct_with_null, pct, row_hash, to_bool

#: Flat fields of an audit event and their defaults.
TEXT_FIELDS = (
    "Id", "CreationTime", "Operation", "OrganizationId", "UserKey", "Workload", "UserId", "ClientIP", "UserAgent", "Activity", "ItemName",
    "WorkSpaceName", "DatasetName", "DatasetId", "ReportName", "ReportId", "ReportType", "WorkspaceId", "ObjectId", "IsSuccess",
    "RequestId", "ActivityId", "DistributionMethod", "ConsumptionMethod"
)
INT_FIELDS = {"RecordType": 0, "UserType": -1}
#: An event's id and time never change, so that its day may be a key: a merge touches the days of its batch only.
SILVER_KEYS = ["log_date", "Id"]
EXPORTS = ("ExportReport", "ShareReport", "DownloadReport")


def flatten_audit(df: DataFrame) -> DataFrame:
    """The 26 fields with their defaults and the event as JSON text."""
    raw = F.to_json(F.struct("*"))
    have = set(df.columns)
    text = [F.coalesce(F.col(c).cast("string") if c in have else F.lit(None), F.lit("")).alias(c) for c in TEXT_FIELDS]
    ints = [F.coalesce(F.col(c).try_cast("int") if c in have else F.lit(None).cast("int"), F.lit(v)).alias(c) for c, v in INT_FIELDS.items()]
    return df.select(*text, *ints, raw.alias("raw_json"))


def silver_audit(bronze: DataFrame, since=None) -> DataFrame:
    """Cleansed audit events of batches from `since` on, one row for each id. A late re-delivery of a batch is read again; the merge is idempotent."""
    rows = bronze if since is None else bronze.where(F.col("_batch_date") >= F.lit(since))
    rows = cleanse(rows, trim=["Operation", "WorkSpaceName", "ItemName"], lower=["UserId"])
    rows = rows.withColumns(
        {
            "CreationTime": F.try_to_timestamp("CreationTime"), "RecordType": F.col("RecordType").try_cast("int"),
            "IsSuccess": to_bool(F.col("IsSuccess")), "AppId": F.get_json_object("raw_json", "$.AppId"),
            "CapacityId": F.get_json_object("raw_json", "$.CapacityId"), "ArtifactKind": F.get_json_object("raw_json", "$.ArtifactKind"),
        }
    )
    rows = rows.withColumn("log_date", F.to_date("CreationTime"))
    rows = dedupe(rows, ["Id"], [F.col("CreationTime").desc_nulls_last(), F.col("UserId"), F.col("Operation")])
    return rows.withColumn("_row_hash", row_hash(business(rows.columns, [*SILVER_KEYS, "raw_json"]), null="~"))


def max_batch(df: DataFrame) -> DataFrame:
    return df.agg(F.max("_batch_date").alias("max_batch_date"))


def user_tier(n: Column) -> Column:
    return F.when(n >= 1000, "Heavy").when(n >= 100, "Moderate").otherwise("Light")


def audit_user_summary(silver: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("IsSuccess"))
    return silver.groupBy("log_date", "UserId", "Operation", "WorkSpaceName").agg(
        F.count("*").alias("total_events"), ok.alias("success_events"), F.count_if(~F.col("IsSuccess")).alias("failure_events"),
        distinct_with_null("ItemName").alias("unique_items"), pct(ok, F.count("*")).alias("success_rate_pct"),
        user_tier(F.count("*")).alias("user_tier")
    )


def export_events(audit: DataFrame) -> DataFrame:
    return audit.where(F.trim("Operation").isin(*EXPORTS))


def visible_to(df: DataFrame, entitlements: DataFrame, user: str) -> DataFrame:
    """Rows of the workspaces that the user owns; an entitlement to `*` sees all. entitlements: user, workspace."""
    own = entitlements.where(F.col("user") == user).select("workspace").distinct()
    every = own.where("workspace = '*'").select(F.lit(1).alias("__all"))
    return df.join(own, df["WorkSpaceName"] == own["workspace"], "left_semi") if every.isEmpty() else df


def batch_counts(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("_batch_date", "Operation").agg(F.count("*").alias("events"))


def operations(silver: DataFrame) -> DataFrame:
    return silver.groupBy("Operation").agg(F.count("*").alias("events"))


def daily_volume(silver: DataFrame, n: int = 14) -> DataFrame:
    return silver.groupBy("log_date").agg(F.count("*").alias("events")).orderBy(F.desc("log_date")).limit(n)


def top_users(silver: DataFrame, n: int = 15) -> DataFrame:
    return silver.groupBy("UserId").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "UserId").limit(n)


def user_operation_matrix(silver: DataFrame, operations: list[str]) -> DataFrame:
    return silver.groupBy("UserId").pivot("Operation", operations).count()


def export_focus(silver: DataFrame) -> DataFrame:
    return export_events(silver).groupBy("UserId", "Operation").agg(F.count("*").alias("exports"), F.count_distinct("ItemName").alias("items"))
