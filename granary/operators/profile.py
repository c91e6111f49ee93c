"""Column profiles and health flags on them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = ("int", "bigint", "smallint", "tinyint", "double", "float")
STATS = (
    "total_rows", "null_count", "blank_count", "distinct_count", "min_num", "max_num", "avg_num", "stddev_num", "p25", "p50", "p75",
    "min_len", "max_len", "avg_len"
)


def null_profile(df: DataFrame, table: str, layer: str) -> DataFrame:
    """Null-or-blank share of each column."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    wide = df.agg(*(F.struct(F.count("*").alias("total_rows"), F.count_if(blank(c)).alias("null_or_blank")).alias(c) for c in df.columns))
    return _long(wide, df.columns, ("total_rows", "null_or_blank"), table, layer).withColumn(
        "null_pct", F.round(F.try_divide(100.0 * F.col("null_or_blank"), F.col("total_rows")), 2)
    )


def _long(wide: DataFrame, columns: list[str], fields: tuple[str, ...], table: str, layer: str) -> DataFrame:
    """One wide row of structs as one row a column."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}`.{f}").alias(f) for f in fields)) for c in columns))
    return wide.select(
        F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), F.explode(cells).alias("x")
    ).select("layer", "table_name", "x.*")


def profile(df: DataFrame, table: str, layer: str, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """22 figures a column. Distinct counts and quartiles are exact at any size (approximate: by sketches).

    One aggregate over the table gives all but these, and two bounds around each quartile. A second counts the values below the lower bound
    and those between the bounds, few or few distinct ones, among which the quartile has its rank. Distinct values are counted column by
    column in their own types. accuracy: that of approximate quartiles; a state holds no more values than that."""
    types = dict(df.dtypes)
    wide = df.agg(*(_figures(c, types[c], approximate, accuracy).alias(c) for c in df.columns))
    fields = STATS if approximate else tuple(x for x in STATS if x not in ("distinct_count", "p25", "p50", "p75"))
    out = _long(wide, df.columns, fields, table, layer)
    if not approximate:
        for part in (_distinct(df, types), _quartiles(df, [c for c in df.columns if _is_number(types[c])])):
            out = out.join(F.broadcast(part), "column_name", "left")
        out = out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))).select("layer", "table_name", "column_name", *STATS)
    rate = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("total_rows")), 2)
    return out.withColumns({"null_pct": rate("null_count"), "blank_pct": rate("blank_count"), "cardinality_pct": rate("distinct_count")})


def _is_number(kind: str) -> bool:
    return kind in _NUMBERS or kind.startswith("decimal")


def _distinct(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column_name, distinct_count) of columns that hold a value."""
    out = None
    for c in df.columns:
        col = F.col(f"`{c}`")
        value = col + 0.0 if types[c] in ("double", "float") else col  # the two zeros are one value
        one = df.select(value.alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*").alias("distinct_count"))
        one = one.where("distinct_count > 0").select(F.lit(c).alias("column_name"), "distinct_count")
        out = one if out is None else out.unionByName(one)
    return out


_QUARTERS, _PARTS = (0.25, 0.5, 0.75), ("p25", "p50", "p75")
#: Accuracy of the sketches behind a quartile's bounds, and how far these stand on both sides of it, as a share of the values: twenty times a sketch's own error.
_BOUND, _SIDE = 10_000, 0.002


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, p25, p50, p75): the values at rank ceil(q n) of each number column that holds one. Bounds that are equal are the quartile."""
    spark = df.sparkSession
    number = [F.col(f"`{c}`").cast("double") + 0.0 for c in columns]
    at = [x for q in _QUARTERS for x in (q - _SIDE, q + _SIDE)]
    sketches = [F.struct(F.percentile_approx(x, at, _BOUND).alias("at"), F.count(x).alias("n")).alias(f"c{i}") for i, x in enumerate(number)]
    found = df.agg(*sketches).first() if columns else ()
    known = [(i, j, *found[i]["at"][2 * j : 2 * j + 2], found[i]["n"]) for i in range(len(found)) if found[i]["n"] for j in range(3)]
    out = spark.createDataFrame([(i, j, lo) for i, j, lo, hi, _ in known if lo == hi], "i int, j int, v double")
    open_ = [x for x in known if x[2] != x[3]]
    if open_:
        between = [(number[i] >= lo) & (number[i] <= hi) for i, _, lo, hi, _ in open_]
        below = df.agg(*(F.count_if(number[i] < lo).alias(f"b{k}") for k, (i, _, lo, _, _) in enumerate(open_))).select(
            F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("below")) for k in range(len(open_))))).alias("x")
        ).select("x.*")
        cells = F.array(*(F.when(b, F.struct(F.lit(k).alias("k"), number[open_[k][0]].alias("v"))) for k, b in enumerate(between)))
        rows = df.where(functools.reduce(Column.__or__, between)).select(F.explode(cells).alias("x")).where("x IS NOT NULL")
        values = rows.groupBy("x.k", "x.v").agg(F.count("*").alias("m"))
        ranks = spark.createDataFrame([(k, i, j, -(-n * (j + 1) // 4)) for k, (i, j, _, _, n) in enumerate(open_)], "k int, i int, j int, rank long")
        upto = F.col("below") + F.sum("m").over(Window.partitionBy("k").orderBy("v"))
        ranked = values.join(F.broadcast(below.join(F.broadcast(ranks), "k")), "k").withColumn("upto", upto)
        out = out.unionByName(ranked.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank"))).select("i", "j", "v"))
    names = F.array(*(F.lit(c) for c in columns)) if columns else F.array(F.lit(""))
    figures = [F.max(F.when(F.col("j") == j, F.col("v"))).alias(p) for j, p in enumerate(_PARTS)]
    return out.groupBy("i").agg(*figures).select(names[F.col("i")].alias("column_name"), *_PARTS)


def _figures(c: str, kind: str, approximate: bool, accuracy: int) -> Column:
    col = F.col(f"`{c}`")
    text = col.cast("string")
    number = col.cast("double") if _is_number(kind) else F.lit(None).cast("double")
    length = F.length(text) if kind == "string" else F.lit(None).cast("int")
    out = [
        F.count("*").alias("total_rows"), F.count_if(col.isNull()).alias("null_count"), F.count_if(F.trim(text) == "").alias("blank_count"),
        F.min(number).alias("min_num"), F.max(number).alias("max_num"), F.round(F.avg(number), 4).alias("avg_num"),
        F.round(F.stddev(number), 4).alias("stddev_num"),
        F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.round(F.avg(length), 2).alias("avg_len"),
    ]
    if approximate:
        quarts = F.percentile_approx(number, list(_QUARTERS), accuracy)
        out += [quarts[i].alias(p) for i, p in enumerate(_PARTS)] + [F.approx_count_distinct(col).alias("distinct_count")]
    return F.struct(*out)


def health_flags(profiled: DataFrame) -> DataFrame:
    cv = F.try_divide("stddev_num", F.abs("avg_num"))
    critical = F.col("null_pct") > 80
    notes = F.concat_ws(
        "; ", F.when(critical, "mostly null"), F.when(~critical & (F.col("null_pct") > 30), "many nulls"),
        F.when(F.col("distinct_count") == 1, "one value"), F.when(cv > 3, "high variance"),
        F.when((F.col("distinct_count") == F.col("total_rows")) & (F.col("total_rows") > 1000), "all distinct")
    )
    warn = (F.col("null_pct") > 30) | (F.col("distinct_count") == 1) | F.coalesce(cv > 3, F.lit(False))
    return profiled.withColumns({"health_flag": F.when(critical, "CRITICAL").when(warn, "WARN").otherwise("OK"), "notes": notes})


def lineage_flags(profiled: DataFrame, master: DataFrame) -> DataFrame:
    """Flags that need the model: a key with nulls is CRITICAL, a type mismatch a WARN. master: table_name, column_name, is_key, alignment."""
    j = profiled.join(master.select("table_name", "column_name", "is_key", "alignment"), ["table_name", "column_name"], "left")
    flag = F.when(F.col("is_key") & (F.col("null_count") > 0), "CRITICAL").when(
        F.col("alignment") == "TYPE_MISMATCH", F.when(F.col("health_flag") == "CRITICAL", "CRITICAL").otherwise("WARN")
    ).otherwise(F.col("health_flag"))
    return j.withColumn("health_flag", flag)


def profile_mapped(targets: DataFrame, reader: Callable[[str], DataFrame], accuracy: int = 10_000) -> DataFrame:
    """Profiles only the mapped columns, with one scan for each table. targets: table_name, column_name."""
    out = None
    for row in targets.groupBy("table_name").agg(F.sort_array(F.collect_set("column_name")).alias("cols")).orderBy("table_name").collect():
        df = reader(row["table_name"])
        one = profile(df.select(*[c for c in row["cols"] if c in df.columns]), row["table_name"], "MAPPED", accuracy=accuracy)
        out = one if out is None else out.unionByName(one)
    return out


def flagged(profiled: DataFrame, *flags: str) -> DataFrame:
    return profiled.where(F.col("health_flag").isin(*flags))


def impact(profiled: DataFrame, master: DataFrame) -> DataFrame:
    """Model objects fed by columns that are not OK. master: table_name, column_name, object_name."""
    return profiled.where("health_flag <> 'OK'").join(master, ["table_name", "column_name"]).select(
        "table_name", "column_name", "health_flag", "object_name"
    )


def release_gate(profiled: DataFrame, validation: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: whether no flag is CRITICAL, all validations pass and no run failed."""
    a = profiled.agg(F.count_if(F.col("health_flag") == "CRITICAL").alias("critical"))
    b = validation.agg(F.count_if(~F.col("validation_status").isin("PASS", "NO_DATA")).alias("not_passed"))
    c = audit.agg(F.count_if(F.col("status") == "FAILURE").alias("failures"))
    return a.join(b).join(c).withColumn("open", (F.col("critical") == 0) & (F.col("not_passed") == 0) & (F.col("failures") == 0))


def flag_list(profiled: DataFrame, flag: str) -> DataFrame:
    """Columns with a flag, worst first."""
    return flagged(profiled, flag).orderBy(F.desc("null_pct"), "table_name", "column_name")
