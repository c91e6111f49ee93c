"""Daily sketches that merge over days: users by HyperLogLog, latency quantiles by KLL.

A day's sketches are made once from its logs and stored below its day; reports over any days merge them and read no logs. Errors: users within
about 1.04 / sqrt(2^LOG2K) relative standard error, quantiles within a rank error of about 1.65 % (k = 200). Null users and durations are not counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Layout, Table

LOG2K, K = 12, 200
LAYOUT = Layout(("log_date",))


def daily_sketches(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """log_date, keys, operations, total_ms, timed (rows with a duration), users (HLL of upn), latency (KLL of DurationMs)."""
    return parsed.groupBy("log_date", *keys).agg(
        F.count("*").alias("operations"), F.sum("DurationMs").alias("total_ms"), F.count("DurationMs").alias("timed"),
        F.hll_sketch_agg("upn", LOG2K).alias("users"), F.kll_sketch_agg_bigint(F.col("DurationMs").cast("long"), K).alias("latency")
    )


def store_days(table: Table, parsed: DataFrame, keys: list[str]) -> None:
    """Makes the sketches of the days in parsed anew; other days' stay as they are."""
    Table(table.spark, table.root, LAYOUT).overwrite(daily_sketches(parsed, keys))


def over_days(days: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """keys, operations, avg_ms, users, p_ms over all days given: sums, and merged sketches."""
    merged = days.groupBy(*keys).agg(
        F.sum("operations").alias("operations"), F.round(F.try_divide(F.sum("total_ms"), F.sum("timed")), 2).alias("avg_ms"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
        F.kll_merge_agg_bigint(F.when(F.col("timed") > 0, F.col("latency"))).alias("latency"), F.sum("timed").alias("timed")
    )
    p = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("latency", F.lit(quantile)))
    return merged.select(*keys, "operations", "avg_ms", "users", p.alias("p_ms"))


def top_reports_from_days(days: DataFrame, n: int = 10) -> DataFrame:
    """The reports with most renders over all days given; days: sketches by report_id."""
    return over_days(days.where("report_id IS NOT NULL"), ["report_id"]).orderBy(F.desc("operations"), "report_id").limit(n)


def active_users_from_days(days: DataFrame, trailing: int = 30) -> DataFrame:
    """log_date, users: about the distinct users of the trailing days up to each day that has rows; each day's sketch is sent to the days it counts in."""
    day = days.groupBy("log_date").agg(F.hll_union_agg("users").alias("users"))
    sent = day.select(F.explode(F.sequence("log_date", F.date_add("log_date", trailing - 1))).alias("log_date"), "users")
    return sent.join(day.select("log_date"), "log_date", "left_semi").groupBy("log_date").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))
