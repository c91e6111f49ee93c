"""Steps whose work must not outgrow their input, and figures that must be exact at any size."""

import random
from unittest import mock

from pyspark.sql import functions as F

from granary.operators import logs, profile, rules
from granary.plans import registry  # noqa: F401  it loads the plans in their order
from granary.plans import logs as plans


def rows_of_joins(df):
    """The rows that each join of an executed plan gave."""
    out = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name:
            out.append(node.metrics().get("numOutputRows").get().value())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())
        else:
            for i in range(node.children().size()):
                walk(node.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_search_meets_sets_of_needs_and_not_requests(spark):
    rng = random.Random(3)
    tags, some = ["Walk-In", "Emergency", "Free", ""], lambda xs: "|".join(rng.sample(xs, rng.randint(0, len(xs))))
    f = [(i, f"name{rng.randint(0, 99)}", rng.choice(["FOOD", "LEGAL", None]), rng.choice([some(tags), some(tags), None]), rng.choice(["1", "2", None]),
          rng.choice(["Yes", "No"])) for i in range(400)]
    r = [(rng.choice([i] * 8 + [7, None]), rng.choice(["FOOD", "LEGAL", "NONE", None]), rng.choice(["1", "2", None]), rng.choice([some(tags), "", "Free", None, "Rare"]))
         for i in range(1500)]
    facilities = spark.createDataFrame(
        f, "FacilityID long, FacilityName string, PrimaryCategory string, SubCategories string, ZipCode string, WalkInAvailable string")
    requests = spark.createDataFrame(r, "request_id long, category string, zip string, needs string")
    df = rules.search(facilities, requests)
    want, met = [], {}
    for i, cat, place, needs in r:
        need = None if needs is None else {x for x in needs.split("|") if x}
        fits = [x for x in f if need is not None and x[3] is not None and x[2] == cat is not None and x[4] == place is not None and need <= set(x[3].split("|"))]
        met.setdefault(i, []).extend(fits)
    for i, fits in met.items():
        fits.sort(key=lambda x: (-ord(x[5][0]), x[1], x[0]))
        want += [(i, k + 1, x[0], x[1], x[5]) for k, x in enumerate(fits[:3])]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and len(want) > 200
    # a request has about fifty facilities in its place; no join may give all of these pairs
    pairs = sum(1 for x in r for y in f if x[1] == y[2] is not None and x[2] == y[4] is not None)
    assert 0 < 4 * max(rows_of_joins(df)) < pairs


def test_percentiles_of_great_groups_are_exact(spark):
    """One model's day with 120,000 durations, no two of them alike, and an hour with twenty."""
    n = 120_000
    rows = spark.range(n + 20, numPartitions=8).select(
        F.to_timestamp_ntz(F.lit("2024-01-05 10:00:00")).alias("Timestamp"), F.lit("Refresh DAX").alias("OperationName"), F.lit("Success").alias("Status"),
        F.when(F.col("id") < n, (F.col("id") * 7919 % n) * 1000 + 1).otherwise(F.col("id") - n + 1).alias("DurationMs"),
        F.when(F.col("id") < n, "great").otherwise("small").alias("ItemName"), F.lit("SemanticModel").alias("ItemKind"),
        *(F.lit("x").alias(c) for c in ("ModelMode", "WorkspaceName", "upn", "app_name", "report_id", "report_name", "page_id", "page_name", "visual_id",
                                        "visual_name", "client_type")), F.lit(1).cast("long").alias("CpuTimeMs")
    ).withColumn("log_date", F.to_date("Timestamp"))
    want = {"great": (n * 95 // 100 - 1) * 1000 + 1, "small": 19}
    for df, name, p95 in (
        (logs.gold_dax_performance(rows), "model_name", "p95_duration_ms"), (logs.dax_performance(rows), "model_name", "p95_duration_ms"),
        (logs.visual_usage(rows), "model_name", "p95_render_ms"), (logs.ks2_refresh_daily(rows, "2024-01-31 00:00:00"), "ItemName", "P95DurationMs")
    ):
        assert {r[name]: r[p95] for r in df.collect()} == want and dict(df.dtypes)[p95] == "bigint"


def test_profile_is_exact_above_any_sketch(spark):
    """Quartiles of two million unlike values, of few values and of nulls; distinct counts by value (the two zeros are one)."""
    n = 2_000_000
    df = spark.range(n, numPartitions=8).select(
        ((F.col("id") * 7919) % n).alias("spread"), (F.col("id") % 3).cast("int").alias("few"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 10, -0.0).otherwise(F.when(F.col("id") < 20, 0.0)).alias("zeros"), F.when(F.col("id") % 4 == 0, F.col("id") * 0.5).alias("half"))
    got = {r.column_name: r for r in profile.profile(df, "t", "L").collect()}
    quartiles = {c: (r.p25, r.p50, r.p75, r.distinct_count) for c, r in got.items()}
    assert quartiles == {
        "spread": (n / 4 - 1, n / 2 - 1, n * 3 / 4 - 1, n), "few": (0, 1, 2, 3), "none": (None, None, None, 0), "zeros": (0, 0, 0, 1),
        "half": tuple(2.0 * (n // 4 * k // 4 - 1) for k in (1, 2, 3)) + (n // 4,)
    }


def test_sketched_percentiles_are_held_to_exact_ranks(spark):
    """Of durations 1 to n the values at 92 to 98 % are within the stated error and their neighbours are not, however great n is."""
    for n in (100, 1_000_000):
        rows = spark.range(1, n + 1, numPartitions=8).select(F.lit("r").alias("report_id"), F.lit("u").alias("upn"), F.col("id").alias("DurationMs"),
                                                             F.to_date(F.lit("2024-01-05")).alias("log_date"))
        for p, want in ((n * 92 // 100 - 1, False), (n * 92 // 100, True), (n * 98 // 100, True), (n * 98 // 100 + 1, False), (None, None)):
            merged = spark.createDataFrame([("r", n, 1, p)], "report_id string, operations long, users long, p_ms long")
            with mock.patch.object(plans.K, "over_days", return_value=merged):
                assert [tuple(r) for r in plans.within_errors(rows).collect()] == [("r", n, True, want)]
