"""Column expressions shared by the operators: cleansing, casts, tiers, durations, hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cleanse(df: DataFrame, trim: Iterable[str] = (), upper: Iterable[str] = (), lower: Iterable[str] = ()) -> DataFrame:
    """Trimmed, upper-cased and lower-cased string columns (the last two are trimmed too)."""
    rules = {c: F.trim(c) for c in trim} | {c: F.upper(F.trim(c)) for c in upper} | {c: F.lower(F.trim(c)) for c in lower}
    return df.withColumns(rules)


def cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts whose bad text becomes null, also under ANSI mode."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def to_bool(c: Column) -> Column:
    """Text to a three-valued boolean: TRUE, FALSE in any case; all else is null."""
    t = F.upper(F.trim(c))
    return F.when(t == "TRUE", F.lit(True)).when(t == "FALSE", F.lit(False))


def has_term(c: Column, term: str) -> Column:
    """Case-insensitive match of a whole term between non-alphanumeric characters."""
    return c.rlike(f"(?i)(^|[^A-Za-z0-9]){term}([^A-Za-z0-9]|$)")


def not_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def latency_tier(ms: Column) -> Column:
    return F.when(ms < 500, "Fast (<0.5s)").when(ms < 2000, "Moderate (0.5-2s)").when(ms < 10000, "Slow (2-10s)").otherwise("Critical (>10s)")


def cpu_class(ratio: Column) -> Column:
    return F.when(ratio > 0.8, "CPU_Bound").when(ratio < 0.2, "IO_Bound").otherwise("Mixed")


def hhmmss_to_seconds(c: Column) -> Column:
    """An integer that reads HHMMSS, hours unbounded."""
    return F.floor(c / 10000) * 3600 + F.floor(c % 10000 / 100) * 60 + c % 100


def run_start(date: Column, time: Column) -> Column:
    """Timestamp of integers yyyyMMdd and HHMMSS."""
    day = F.to_timestamp(date.cast("string"), "yyyyMMdd")
    return F.timestamp_seconds(F.unix_timestamp(day) + hhmmss_to_seconds(time))


def hhmmss_text(seconds: Column) -> Column:
    """HH:MM:SS of a day; null is 00:00:00 and longer times wrap."""
    s = F.coalesce(seconds, F.lit(0)).cast("long") % 86400
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def row_hash(cols: Iterable[str], null: str | None = "\x00") -> Column:
    """SHA-256 over the columns joined by `|`; null fields count as `null` (None: they are skipped)."""
    parts = [F.col(c).cast("string") if null is None else F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def business(columns: Iterable[str], keys: Iterable[str]) -> list[str]:
    """The columns that are neither keys nor an engine's own (`_...`, `gold_loaded_at`)."""
    return [c for c in columns if c not in set(keys) and not c.startswith("_") and c != "gold_loaded_at"]


def stamp(df: DataFrame, **values) -> DataFrame:
    """Literal ingest columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def distinct_with_null(c: str) -> Column:
    """Number of distinct values where null counts as one."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def distinct_counts(df: DataFrame, keys: list, columns: dict[str, str]) -> DataFrame:
    """The keys and, for each column of `columns`, its number of distinct values under the given name. Every row gives one narrow (key, column, value) row a
    column; these are made distinct and then counted, and both steps aggregate before they shuffle. Several count_distinct in one aggregate would send each row once
    a column with all that the aggregate reads."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)))
    rows = df.select(*named, F.explode(cells).alias("__cell"))
    names = rows.columns[:-1]
    pairs = rows.groupBy(*names, F.col("__cell.i").alias("__i"), F.col("__cell.v").alias("__v")).agg(F.lit(1).alias("__one"))
    return pairs.groupBy(*names).agg(*(F.count_if((F.col("__i") == i) & F.col("__v").isNotNull()).alias(n) for i, n in enumerate(columns.values())))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the keys stay once."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"__{k}"])
        on = same if on is None else on & same
    return left.join(right, on).drop(*(f"__{k}" for k in keys))


def union_typed(*dfs: DataFrame) -> DataFrame:
    """Union by name; missing columns are typed nulls."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def recent(df: DataFrame, ts: str, interval: str, as_of: str) -> DataFrame:
    """Rows of the window that ends at as_of."""
    return df.where((F.col(ts) >= F.expr(f"timestamp'{as_of}' - INTERVAL {interval}")) & (F.col(ts) < F.expr(f"timestamp'{as_of}'")))


def having(df: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > min_count)


def newer_than(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Strictly newer rows; the comparison is pushed to the scan."""
    return df.where(F.col(column) > F.lit(cutoff))


def snake_columns(df: DataFrame, runs_of: str = r"\W+") -> DataFrame:
    import re

    return df.toDF(*(re.sub(runs_of, "_", c).strip("_").lower() for c in df.columns))


def where_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Case-sensitive equality."""
    return df.where(F.col(column) == F.lit(value))


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a full order: one heap a partition, then one merge."""
    return df.orderBy(*order).limit(n)
