"""Job runs against their history: overruns, anomalies, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.exprs import hhmmss_text, hhmmss_to_seconds, run_start

WARNING_PCT, CRITICAL_PCT, MIN_RUNS, LAST_RUNS, DAYS = 20, 50, 3, 30, 90


def history_window(runs: DataFrame, as_of: str, days: int | None = DAYS) -> DataFrame:
    """Finished step runs (failed, succeeded, cancelled) with start time and seconds."""
    rows = runs.where(F.col("run_status").isin(0, 1, 3) & (F.col("step_id") != 0)).withColumns(
        {
            "run_start_datetime": run_start(F.col("run_date"), F.col("run_time")),
            "run_duration_seconds": hhmmss_to_seconds(F.col("run_duration")).cast("long")
        }
    )
    return rows if days is None else rows.where(F.col("run_start_datetime") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def recency_rank(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id", "step_id").orderBy(F.desc("run_date"), F.desc("run_time"), F.desc("run_id"))
    return history.withColumn("run_recency_rank", F.row_number().over(w))


def last_runs(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.where(F.col("run_recency_rank") <= n)


def job_history(ranked: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    """Averages over the successes among the last n runs; whole seconds, as the integer average truncates."""
    ok = F.col("run_status") == 1
    good = F.when(ok & (F.col("run_recency_rank") <= n), F.col("run_duration_seconds"))
    last = lambda c: F.max(F.when(F.col("run_recency_rank") == 1, F.col(c)))
    return ranked.groupBy("job_id", "step_id").agg(
        F.count("*").alias("total_historical_runs"), F.count_if(ok).alias("successful_runs"),
        F.count_if(F.col("run_status") == 0).alias("failed_runs"), F.floor(F.avg(good)).alias("avg_duration_seconds"),
        F.max(F.when(ok, F.col("run_duration_seconds"))).alias("max_duration_seconds"),
        F.min(F.when(ok, F.col("run_duration_seconds"))).alias("min_duration_seconds"),
        F.stddev_samp(good).alias("stddev_duration_seconds"), F.max("run_start_datetime").alias("last_run_datetime"),
        last("run_duration_seconds").alias("last_run_duration_seconds"), last("run_status").alias("last_run_status")
    )


def _over(elapsed: Column) -> Column:
    return F.round(F.try_divide(100.0 * (elapsed - F.col("avg_duration_seconds")), F.col("avg_duration_seconds")), 1)


def running(activity: DataFrame) -> DataFrame:
    """Started, not stopped, of the newest agent session."""
    newest = activity.agg(F.max("session_id").alias("session_id"))
    return activity.join(F.broadcast(newest), "session_id").where("start_execution_date IS NOT NULL AND stop_execution_date IS NULL")


def running_jobs(activity: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """Steps that run now against their history; severest first."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    rows = running(activity).withColumn(
        "elapsed_sec", now - F.unix_timestamp(F.col("last_executed_step_date").cast("timestamp"))
    ).withColumnRenamed("last_executed_step_id", "step_id")
    rows = rows.join(history, ["job_id", "step_id"], "left")
    avg, e = F.col("avg_duration_seconds"), F.col("elapsed_sec")
    enough = F.coalesce(F.col("successful_runs") >= MIN_RUNS, F.lit(False))
    status = (
        F.when(~enough, "INSUFFICIENT_HISTORY").when(avg.isNull(), "NO_SUCCESS_HISTORY").when(e > avg * (1 + CRITICAL_PCT / 100), "CRITICAL")
        .when(e > avg * (1 + WARNING_PCT / 100), "WARNING").when(e < avg, "RUNNING_FAST").otherwise("NORMAL")
    )
    known = enough & (avg > 0)
    done = F.when(known, F.timestamp_seconds(F.unix_timestamp(F.col("start_execution_date").cast("timestamp")) + avg))
    out = rows.select(
        "job_id", "step_id", "run_id", "elapsed_sec", hhmmss_text(e).alias("elapsed_hhmmss"),
        F.when(enough, e - avg).alias("overrun_seconds"), F.when(known, _over(e)).alias("overrun_pct"), status.alias("overrun_status"),
        done.alias("est_completion_time"),
        F.when(known & (F.lit(as_of).cast("timestamp") > done), "YES").otherwise("NO").alias("past_estimated_completion")
    )
    return severity_order(out)


def severity_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.when(F.col("overrun_pct") > CRITICAL_PCT, 1).when(F.col("overrun_pct") > WARNING_PCT, 2).otherwise(3), F.desc("elapsed_sec"))


def run_anomalies(ranked: DataFrame, history: DataFrame, n: int = 10) -> DataFrame:
    """Of the last n runs of each step those that took 20 % more than usual."""
    h = history.select("job_id", "step_id", "avg_duration_seconds", "successful_runs", "failed_runs")
    d = F.col("run_duration_seconds")
    rows = last_runs(ranked, n).join(h, ["job_id", "step_id"]).where(
        (F.col("successful_runs") >= MIN_RUNS) & (F.col("avg_duration_seconds") > 0) & (
            d > F.col("avg_duration_seconds") * (1 + WARNING_PCT / 100)
        )
    )
    outcome = F.when(F.col("run_status") == 1, "Success").when(F.col("run_status") == 0, "Failed").when(
        F.col("run_status") == 3, "Cancelled"
    ).otherwise("Other")
    return rows.select(
        "job_id", "step_id", "run_id", "run_start_datetime", d.alias("actual_duration_sec"), hhmmss_text(d).alias("actual_hhmmss"),
        "avg_duration_seconds", (d - F.col("avg_duration_seconds")).alias("overrun_seconds"), _over(d).alias("overrun_pct"),
        outcome.alias("run_outcome")
    )


def job_health(history: DataFrame) -> DataFrame:
    cv = F.try_divide("stddev_duration_seconds", "avg_duration_seconds")
    last = F.when(F.col("last_run_status") == 0, "Failed").when(F.col("last_run_status") == 1, "Success").when(
        F.col("last_run_status") == 3, "Cancelled"
    ).otherwise("Unknown")
    return history.select(
        "job_id", "step_id", "total_historical_runs", "successful_runs", "failed_runs",
        F.round(F.try_divide(100.0 * F.col("failed_runs"), F.col("total_historical_runs")), 1).alias("failure_rate_pct"),
        "avg_duration_seconds", F.round("stddev_duration_seconds", 1).alias("stddev_sec"), F.round(cv, 3).alias("coeff_of_variation"),
        F.when(cv > 0.5, "HIGH_VARIANCE").otherwise("STABLE").alias("run_time_stability"), last.alias("last_run_status")
    )


def _pipeline_runs(audit: DataFrame) -> DataFrame:
    """Finished run records as job runs of one step. audit: pipeline, run_id, run_start, duration_seconds, status."""
    w = Window.partitionBy("pipeline").orderBy(F.desc("run_start"), F.desc("run_id"))
    return audit.where("duration_seconds IS NOT NULL").select(
        F.col("pipeline").alias("job_id"), F.lit(1).alias("step_id"), "run_id",
        F.when(F.col("status").startswith("SUCCESS"), 1).otherwise(0).alias("run_status"),
        F.col("duration_seconds").cast("long").alias("run_duration_seconds"), F.col("run_start").alias("run_start_datetime"),
        F.row_number().over(w).alias("run_recency_rank")
    )


def pipeline_health(audit: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    """job_health on run records."""
    return job_health(job_history(_pipeline_runs(audit), n))


def pipeline_anomalies(audit: DataFrame, n: int = 10) -> DataFrame:
    """run_anomalies on run records: of each pipeline's last n runs those that took 20 % more than usual."""
    rows = _pipeline_runs(audit)
    return run_anomalies(rows, job_history(rows), n)


def running_pipelines(audit: DataFrame, as_of: str) -> DataFrame:
    """running_jobs on run records: those that have started and not ended, against their pipeline's history."""
    open_ = audit.where("run_start IS NOT NULL AND run_end IS NULL").select(
        F.col("pipeline").alias("job_id"), F.lit(0).alias("session_id"), F.col("run_start").alias("start_execution_date"),
        F.lit(None).cast("timestamp").alias("stop_execution_date"), F.lit(1).alias("last_executed_step_id"),
        F.col("run_start").alias("last_executed_step_date"), "run_id"
    )
    return running_jobs(open_, job_history(_pipeline_runs(audit)), as_of)
