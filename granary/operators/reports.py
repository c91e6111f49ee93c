"""Measures and page datasets over the gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.exprs import pct


def health_scorecard(refresh: DataFrame, dax: DataFrame) -> DataFrame:
    """Half refresh success, three tenths DAX speed, two tenths refresh days within the SLA; a model without DAX rows has full speed."""
    r = refresh.groupBy("ItemName", "WorkspaceName", "ModelMode").agg(
        F.round(F.avg("success_rate_pct"), 6).alias("avg_refresh_success_rate"),
        F.round(F.avg("avg_duration_ms"), 4).alias("avg_refresh_duration_ms"),
        F.count_if(F.col("sla_status") == "SLA_BREACH").alias("sla_breach_days"), F.count("*").alias("total_refresh_days")
    )
    slow = F.count_if(F.col("performance_tier").isin("Slow (2-10s)", "Critical (>10s)"))
    d = dax.groupBy(F.col("model_name").alias("ItemName"), "WorkspaceName").agg(
        F.round(F.avg("avg_duration_ms"), 4).alias("avg_dax_duration_ms"), F.max("max_duration_ms").alias("max_dax_duration_ms"),
        F.sum("dax_execution_count").alias("total_dax_executions"), pct(slow, F.count("*")).alias("pct_slow_queries")
    )
    cap = lambda c: F.least(F.coalesce(c, F.lit(0.0)), F.lit(100.0))
    score = cap(F.col("avg_refresh_success_rate")) * 0.5 + (100 - cap(F.col("pct_slow_queries"))) * 0.3 + (
        1 - F.least("sla_breach_days", "total_refresh_days") / F.greatest("total_refresh_days", F.lit(1))
    ) * 20
    out = r.join(d, ["ItemName", "WorkspaceName"], "left").withColumn("health_score", F.round(score, 1))
    return out.withColumn("health_grade", grade(F.col("health_score")))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


def refresh_success_rate(refresh: DataFrame) -> DataFrame:
    return refresh.agg(
        F.round(
            F.coalesce(F.try_divide(F.sum("success_count"), F.sum("total_refreshes")), F.lit(0.0)) * 100, 4
        ).alias("refresh_success_rate")
    )


def dax_measures(dax: DataFrame, refresh: DataFrame) -> DataFrame:
    slow = F.sum(F.when(F.col("avg_duration_ms") > 5000, F.col("dax_execution_count")).otherwise(0))
    a = dax.agg(
        F.round(F.avg("avg_duration_ms") / 1000, 4).alias("avg_dax_seconds"),
        F.round(F.coalesce(F.try_divide(slow, F.sum("dax_execution_count")), F.lit(0.0)) * 100, 4).alias("slow_query_pct")
    )
    return a.join(refresh.agg(F.count_if(F.col("sla_status") == "SLA_BREACH").alias("sla_breach_days")))


def average_grade(scorecard: DataFrame) -> DataFrame:
    return scorecard.agg(F.round(F.avg("health_score"), 4).alias("avg_score")).withColumn("grade", grade(F.col("avg_score")))


def rolling_users(activity: DataFrame, days: int = 30) -> DataFrame:
    """Distinct users of the trailing days of each day on which some user of them was active.

    A user's days make spans in which the user counts; where one begins or ends the number of users changes, and the running
    sum of a day's changes is its result. A user gives two rows a span, whatever the number of days."""
    day = activity.select("log_date", "user_upn").where("log_date IS NOT NULL AND user_upn IS NOT NULL").distinct()
    w = Window.partitionBy("user_upn").orderBy("log_date")
    left = F.date_add(F.lag("log_date").over(w), days)
    starts = day.withColumn("__new", (left.isNull() | (left < F.col("log_date"))).cast("int")).withColumn("__span", F.sum("__new").over(w))
    spans = starts.groupBy("user_upn", "__span").agg(F.min("log_date").alias("a"), F.date_add(F.max("log_date"), days).alias("b"))
    change = spans.select(
        F.explode(
            F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("n")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("n")))
        ).alias("c")
    )
    by_day = change.groupBy("c.at").agg(F.sum("c.n").alias("n"))
    # from here on there is a row a day
    last = activity.agg(F.max("log_date").alias("last"))
    running = by_day.withColumns({"active_users": F.sum("n").over(Window.orderBy("at")), "next": F.lead("at").over(Window.orderBy("at"))})
    until = F.least(F.date_sub(F.coalesce("next", F.col("at")), 1), "last")
    rows = running.where("active_users > 0").join(F.broadcast(last)).where(F.col("at") <= F.col("last"))
    return rows.select(F.explode(F.sequence("at", until)).alias("log_date"), "active_users")


def page_totals(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count("*").alias("operations"), F.count_distinct("upn").alias("users"),
        pct(F.count_if(F.col("Status") == "SUCCESS"), F.count("*")).alias("success_pct")
    )


def by_status(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("Status").agg(F.count("*").alias("operations"))


def matrix(df: DataFrame, row: str, period: str) -> DataFrame:
    """Counts by row and period (DAY, WEEK) in long form."""
    return df.where(F.col(row).isNotNull()).groupBy(
        row, F.to_date(F.date_trunc(period, "Timestamp")).alias("period")
    ).agg(F.count("*").alias("operations"))


def cpu_mix(dax: DataFrame) -> DataFrame:
    return dax.groupBy("model_name", "execution_profile").agg(F.sum("dax_execution_count").alias("executions"))


def hourly(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.hour("Timestamp").alias("hour")).agg(F.count("*").alias("operations"))


def report_overview(usage: DataFrame) -> DataFrame:
    return usage.groupBy("report_id").agg(
        F.sum("total_renders").alias("renders"), F.sum("failure_count").alias("failures"),
        pct(F.sum("failure_count"), F.sum("total_renders")).alias("failure_pct")
    )


def tier_mix(usage: DataFrame) -> DataFrame:
    return usage.groupBy("render_performance_tier").agg(F.count("*").alias("groups"), F.sum("total_renders").alias("renders"))


def daily_trend(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_date").agg(
        F.count("*").alias("operations"), pct(F.count_if(F.col("Status") == "SUCCESS"), F.count("*")).alias("success_pct")
    )


def top_models(parsed: DataFrame, n: int = 5) -> DataFrame:
    return parsed.groupBy("ItemName").agg(F.count("*").alias("operations")).orderBy(F.desc("operations"), "ItemName").limit(n)
