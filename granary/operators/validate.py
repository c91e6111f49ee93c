"""Source against destination: daily counts, load status, silent failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(df: DataFrame, day: str, key: str) -> DataFrame:
    return df.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def load_status(src: Column, dst: Column) -> Column:
    """On the unrounded ratio: short below 95 %, over above 105 %."""
    ratio = F.try_divide(dst, src)
    return (
        F.when((src == 0) & (dst == 0), "NO_DATA").when(src == 0, "DEST_ONLY").when(dst == 0, "CRITICAL_MISSING")
        .when(ratio < 0.95, "WARN_SHORT_LOAD").when(ratio > 1.05, "WARN_OVER_LOADED").otherwise("PASS")
    )


def validate_load(src: DataFrame, dst: DataFrame, day: str = "day", key: str = "k") -> DataFrame:
    """Counts and distinct keys of both sides by day; one aggregate a side, one full outer join."""
    s = daily_counts(src, day, key).select("day", F.col("n").alias("s_n"), F.col("keys").alias("s_k"))
    d = daily_counts(dst, day, key).select("day", F.col("n").alias("d_n"), F.col("keys").alias("d_k"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = s.join(d, "day", "full_outer").select(
        "day", zero("s_n").alias("source_row_count"), zero("d_n").alias("destination_row_count"), zero("s_k").alias("source_distinct_keys"),
        zero("d_k").alias("dest_distinct_keys")
    )
    return both.withColumns(
        {
            "row_diff": F.col("source_row_count") - F.col("destination_row_count"),
            "key_diff": F.col("source_distinct_keys") - F.col("dest_distinct_keys"),
            "pct_loaded": F.round(F.try_divide(100.0 * F.col("destination_row_count"), F.col("source_row_count")), 2),
            "validation_status": load_status(F.col("source_row_count"), F.col("destination_row_count")),
        }
    )


def validate_all(specs: list[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """specs: (pipeline, source, destination, day column, key column)."""
    out = None
    for name, src, dst, day, key in specs:
        one = validate_load(src, dst, day, key).withColumn("pipeline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def latest(validation: DataFrame) -> DataFrame:
    """The last validation of each (day, pipeline)."""
    w = Window.partitionBy("day", "pipeline").orderBy(F.desc("validated_at"))
    return validation.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def silent_failures(reported: DataFrame, validation: DataFrame) -> DataFrame:
    """Days whose operations report 95 % success or more while less than 95 % arrived. reported: day, pipeline, success_rate_pct."""
    return reported.join(validation, ["day", "pipeline"]).where(
        (F.col("success_rate_pct") >= 95) & (F.col("destination_row_count") < 0.95 * F.col("source_row_count"))
    ).select("day", "pipeline", "success_rate_pct", "pct_loaded", "validation_status")


def status_counts(validation: DataFrame) -> DataFrame:
    return validation.groupBy("validation_status").agg(F.count("*").alias("days"))


def problems(validation: DataFrame) -> DataFrame:
    return validation.where(~F.col("validation_status").isin("PASS", "NO_DATA"))
