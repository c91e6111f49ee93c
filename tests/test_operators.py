"""Operators on small frames: the stated semantics that whole-table comparisons don't isolate."""

import datetime as dt
import json
from unittest import mock

import pytest
from pyspark.sql import functions as F

from granary.functions import exprs as X
from granary.operators import audit, catalog, gold, ingest, jobs, logs, profile, reports, rules, scoring, tables, validate
from granary.sources import readers, schemas
from granary.sources.fixtures import view
from granary.streaming import streams

D = "/root/testdata/sf0.001"


def one(df):
    return df.first()[0]


def test_durations_and_rubric(spark):
    r = spark.range(1)
    assert one(r.select(X.hhmmss_to_seconds(F.lit(10523)))) == 3923
    assert one(r.select(X.hhmmss_text(F.lit(3923)))) == "01:05:23" and one(r.select(X.hhmmss_text(F.lit(None).cast("int")))) == "00:00:00"
    assert one(r.select(X.hhmmss_text(F.lit(90000)))) == "01:00:00"
    assert one(r.select(X.run_start(F.lit(20240601), F.lit(20005)))) == dt.datetime(2024, 6, 1, 2, 0, 5)
    assert [one(r.select(scoring.rubric(F.lit(x)))) for x in (0.895, 0.9, 0.395, 0.05)] == ["strong", "exceptional", "insufficient", "not_addressed"]


def test_booleans_terms_and_hashes(spark):
    df = spark.createDataFrame([("True",), (" false",), ("",), (None,), ("yes",)], "s string")
    assert [x[0] for x in df.select(X.to_bool(F.col("s"))).collect()] == [True, False, None, None, None]
    df = spark.createDataFrame([("Full Refresh",), ("Refreshed",), ("pre-refresh",)], "s string")
    assert [x[0] for x in df.select(X.has_term(F.col("s"), "refresh")).collect()] == [True, False, True]
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(X.row_hash(["x", "y", "z"])).distinct().count() == 2 and df.select(
        X.row_hash(["x", "y", "z"], null=None)
    ).distinct().count() == 1


def test_sample_nomination(spark):
    dims = dict(
        zip(
            ("impact", "consistency", "collaboration", "initiative", "values_alignment", "client_impact"),
            (0.88, 0.82, 0.95, 0.85, 0.80, 0.80)
        )
    )
    df = spark.createDataFrame([(1, d, s) for d, s in dims.items()], "nomination_id long, dimension string, raw_score double")
    got = {r.dimension: r.weighted_score for r in scoring.dimension_scores(df).collect()}
    assert got == {"impact": 22.0, "consistency": 16.4, "collaboration": 19.0, "initiative": 12.8, "values_alignment": 8.0, "client_impact": 8.0}
    card = scoring.score_cards(df).first()
    assert (card.total_score, card.overall_level, card.strengths, card.gaps) == (
        86.2, "strong", "collaboration,impact", "values_alignment,client_impact"
    )
    low = scoring.score_cards(spark.createDataFrame([(2, "impact", 7.0)], df.schema)).first()
    assert low.total_score == 25.0 and low.flagged_dimensions == 5


def test_rule_samples(spark):
    texts = [
        "food bank that's open on weekends no ID required", "transgender youth needing counseling", "nothing at all",
        "my client is a parent", None, "DV shelter, 2 kids, speaks Spanish"
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in rules.modifier_tags(rules.categorize(rules.keyword_hits(df, "text")), "text").collect()}
    assert (
        got[0].primary_category, got[0].confidence, got[0].sub_tags, got[0].matched_keywords
    ) == ("FOOD", "HIGH", ["Food-Bank", "No-ID-Required"], ["food", "food bank"])
    assert (got[1].primary_category, got[1].confidence, got[1].sub_tags) == ("MENTAL_HEALTH", "MEDIUM", ["LGBTQ-Affirming"])
    assert got[2].primary_category == got[4].primary_category == "GENERAL" and got[3].primary_category == "HOUSING"
    assert got[5].primary_category == "DOMESTIC_VIOLENCE" and "Bilingual-Spanish" in got[5].sub_tags
    strict = rules.categorize(rules.keyword_hits(df, "text", word_boundary=True)).where("i = 3").first()
    assert strict.primary_category == "GENERAL"


def test_load_status_covers_all(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (10, 0), (100, 94), (100, 106), (100, 100), (100000, 1)], "s long, t long")
    assert [x[0] for x in df.select(validate.load_status(F.col("s"), F.col("t"))).collect()] == [
        "NO_DATA", "DEST_ONLY", "CRITICAL_MISSING", "WARN_SHORT_LOAD", "WARN_OVER_LOADED", "PASS", "WARN_SHORT_LOAD"
    ]


def test_snapshot_table(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, made string").withColumn("_row_hash", X.row_hash(["v"]))
    assert not t.exists() and t.merge(frame([(1, "a", "x"), (None, "n", "x")]), ["k"], "_row_hash")["status"] == "INITIAL_LOAD"
    r = t.merge(frame([(1, "b", "y"), (None, "n", "y"), (2, "c", "y")]), ["k"], "_row_hash", ("made",))
    assert (r["inserted"], r["updated"], r["unchanged"], r["status"]) == (1, 1, 1, "SUCCESS")
    want = {(1, "b", "x"), (None, "n", "x"), (2, "c", "y")}
    rows = lambda: {(x.k, x.v, x.made) for x in t.read().collect()}
    assert rows() == want
    t.merge(frame([(1, "b", "z"), (2, "c", "z")]), ["k"], "_row_hash", ("made",))
    assert rows() == want and t.merge(frame([]), ["k"], "_row_hash")["status"] == "SKIPPED"
    t.append(spark.createDataFrame([(9, 1.5)], "k long, extra double"))
    assert t.read().count() == 4 and t.read(1).count() == 2
    assert [x.operation for x in t.history().collect()] == ["APPEND", "MERGE", "MERGE", "INITIAL_LOAD"] and t.history(1).first().n_rows == 4
    t.replace(frame([(1, "01", "q"), (2, "1", "q"), (3, "x y:%", "q")]), partition_by=("v",))
    assert sorted((x.k, x.v) for x in t.read().collect()) == [(1, "01"), (2, "1"), (3, "x y:%")]


def test_partitions_stay_and_only_touched_ones_are_rewritten(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, day string").withColumn("_row_hash", X.row_hash(["v"]))
    t.replace(frame([(1, "a", "01"), (2, "b", "02"), (3, "c", "x y:%"), (4, "n", None)]), partition_by=("day",))
    before = set(t.history(1).first().folders)
    r = t.merge(frame([(2, "B", "02"), (9, "new", "02"), (4, "N", None)]), ["k", "day"], "_row_hash")
    assert (r["inserted"], r["updated"], r["unchanged"]) == (1, 2, 0)
    head = t.history(1).first()
    assert len(before & set(head.folders)) == 2 and head.n_rows == 5 and head.partition_by == ["day"]
    assert {(x.k, x.v, x.day) for x in t.read().collect()} == {(1, "a", "01"), (2, "B", "02"), (9, "new", "02"), (3, "c", "x y:%"), (4, "N", None)}
    kept = set(t.history(1).first().folders)
    t.append(frame([(7, "z", "03")]))
    assert kept < set(t.history(1).first().folders) and t.read().where("day = '03'").count() == 1 and t.history(1).first().n_rows == 6
    with pytest.raises(ValueError, match="several rows of one key"):
        t.merge(frame([(2, "x", "02"), (2, "y", "02")]), ["k", "day"], "_row_hash")
    t.compact()
    assert t.read().count() == 6 and t.history(1).first().partition_by == ["day"]


def test_declared_tables_and_literals(spark, tmp_path):
    assert len([n for n in schemas.names() if not n.endswith(schemas.STAGING)]) == 9 and len(schemas.names()) == 13
    for n in schemas.names():
        t = tables.Table(spark, str(tmp_path / n))
        t.ensure(schemas.schema(n), schemas.partitions(n))
        t.ensure(schemas.schema(n), schemas.partitions(n))
        assert t.read().schema == schemas.schema(n) and t.history().count() == 1
    seed = schemas.control_seed(spark)
    assert seed.schema.names == schemas.schema("control_table").names and [
        r.load_type for r in seed.orderBy("control_id").collect()
    ].count("FULL") == 1
    assert schemas.lineage_map(spark).count() == 6 and schemas.schedule(spark).count() == 3


def test_gold_loads(spark, tmp_path):
    table = lambda n: tables.Table(spark, str(tmp_path / n))
    name = "gold_audit_user_activity_summary"
    rows = lambda n: spark.createDataFrame(
        [
            (dt.date(2024, 1, 1), "w", "u", "View", "Light", n, n, 0, 1, 100.0),
            (dt.date(2024, 1, 2), "w", None, "View", "Light", 5, 5, 0, 1, 100.0)
        ],
        "log_date date, WorkSpaceName string, UserId string, Operation string, user_tier string, total_events long, success_events "
        "long, failure_events long, unique_items long, success_rate_pct double"
    )
    at = lambda day: F.lit(f"2024-02-0{day} 00:00:00").cast("timestamp")
    assert {r.status for r in gold.gold_loads(spark, table).collect()} == {"SKIPPED"}
    table(name + schemas.STAGING).replace(rows(1))
    got = {r.gold_table: r for r in gold.gold_loads(spark, table, at(1)).collect()}
    assert (
        got[name].status, got[name].inserted, got[name].gold_rows
    ) == ("INITIAL_LOAD", 2, 2) and sum(r.status == "SKIPPED" for r in got.values()) == 3
    table(name + schemas.STAGING).replace(rows(7))
    r = gold.gold_load(spark, table, name, at(2))
    assert (r["status"], r["inserted"], r["updated"], r["unchanged"], r["staging_rows"], r["gold_rows"]) == ("SUCCESS", 0, 1, 1, 2, 2)
    times = {x.total_events: (x._dw_created_at.day, x._dw_updated_at.day) for x in table(name).read().collect()}
    assert times == {7: (1, 2), 5: (1, 1)} and table(name).read().schema == schemas.schema(name)


def test_log_tables_of_two_batches(spark, tmp_path):
    raw = view(spark, D, "workspace_logs")
    base, parsed = (tables.Table(spark, str(tmp_path / n)) for n in ("base", "parsed"))
    gold.load_logs(raw.where("DurationMs % 3 <> 0"), base, parsed)
    r = gold.load_logs(raw.where("DurationMs % 3 <> 1"), base, parsed)
    n = raw.where("DurationMs IS NOT NULL").select("OperationId", "Timestamp").distinct().count()
    assert base.read().count() == parsed.read().count() == n and r["base"]["inserted"] > 0 and r["base"]["unchanged"] > 0


def test_rows_that_arrive_during_a_load_are_loaded_next_time(spark, tmp_path):
    """A JDBC source gets a row between the reads of a load: what counts is what was written."""
    url = {"url": "jdbc:derby:memory:late;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    put = lambda rows: spark.createDataFrame(
        rows, "ID int, TS timestamp"
    ).write.format("jdbc").options(**url).option("dbtable", "LATE").mode("append").save()
    put([(1, dt.datetime(2024, 1, 3)), (2, dt.datetime(2024, 1, 4))])
    control = tables.Table(spark, str(tmp_path / "control"))
    control.replace(
        spark.createDataFrame(
            [
                (1, "p", "LATE", "late", "INCREMENTAL", True, dt.datetime(2024, 1, 1), None, None),
                (2, "p", "GONE", "gone", "FULL", True, None, None, None)
            ],
            "control_id int, pipeline_name string, source_table string, destination_table string, load_type string, is_active "
            "boolean, source_cutoff_date timestamp, last_run_status string, last_rows_read long"
        )
    )
    audit_log, target = tables.Table(spark, str(tmp_path / "audit")), tables.Table(spark, str(tmp_path / "late"))
    real = tables.Table.stage_append

    def slow(self, df, partition_by=(), **figures):
        out = real(self, df, partition_by, **figures)
        if self.root == target.root and not target.exists():
            put([(3, dt.datetime(2024, 1, 5))])
        return out

    run = lambda: ingest.run_controlled(
        control, audit_log, lambda r: readers.jdbc_full(spark, url, r["source_table"]), lambda n: tables.Table(spark, str(tmp_path / n)),
        "TS"
    )
    with mock.patch.object(tables.Table, "stage_append", slow):
        first = {r.control_id: r for r in run().collect()}
    assert (first[1].run_status, first[1].rows_read, first[2].run_status) == ("SUCCESS", 2, "FAILURE") and first[2].error_message
    after = {r.control_id: r for r in control.read().collect()}
    assert after[1].source_cutoff_date == dt.datetime(2024, 1, 4) and after[2].last_run_status.startswith("FAILURE") and after[2].source_cutoff_date is None
    assert run().where("control_id = 1").first().rows_read == 1 and target.read().count() == 3
    log = audit_log.read()
    assert log.count() == 4 and log.where(
        "duration_seconds >= 0 AND triggered_by = 'SYSTEM'"
    ).count() == 4 and log.select("audit_date").distinct().count() >= 1
    assert log.schema == schemas.schema("pipeline_audit_log") and len(log.columns) == 28
    row = log.where("control_id = 1").orderBy("run_start").first()
    assert (row.rows_written, row.watermark_start, row.watermark_end, row.error_step) == (2, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4), None)
    assert {r.error_step for r in log.where("control_id = 2").collect()} == {"read"}


def test_catalog_and_system_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake_gold")
    spark.createDataFrame(
        [(1, "a"), (2, "b")], "k long, v string"
    ).write.option("path", str(tmp_path / "tab")).mode("overwrite").saveAsTable("lake_gold.tab")
    rows = catalog.lakehouse_catalog(spark, {"GOLD": "lake_gold"}).where("table_name = 'tab'").orderBy("column_name").collect()
    assert [(r.column_name, r.data_type, r.table_row_count, r.layer) for r in rows] == [("k", "bigint", 2, "GOLD"), ("v", "string", 2, "GOLD")]
    spark.sql("DROP TABLE lake_gold.tab")
    info = catalog.information_schema({"t": spark.createDataFrame([], "d decimal(9,2), s string")}).collect()
    assert [(r.column_name, r.ordinal_position, r.numeric_precision, r.numeric_scale) for r in info] == [("d", 1, 9, 2), ("s", 2, None, None)]
    for n, cols in readers.SYSTEM_TABLES.items():
        body = ",".join("BASIC_DATA" if c == "column_type" else f"{c}1" for c in cols.split())
        other = ",".join("HIERARCHY" if c == "column_type" else f"{c}2" for c in cols.split())
        (tmp_path / f"{n}.csv").write_text(cols.replace(" ", ",") + f"\n{body}\n{other}\n")
    named = readers.load_system_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in named.items()} == {"tables": 2, "columns": 2, "measures": 2, "partitions": 2, "storage": 1}
    assert readers.load_system_tables(spark, str(tmp_path), "m")["tables"].first().model_name == "m"
    table = lambda n: tables.Table(spark, str(tmp_path / "saved" / n))
    for model in ("m1", "m2", "m1"):
        catalog.save_system_tables(named, table, model)
    assert sorted((r.model_name, r["count"]) for r in table("system_tables").read().groupBy("model_name").count().collect()) == [("m1", 2), ("m2", 2)]


def test_records_names_and_orders(spark, tmp_path):
    names = [x.split()[0] for x in readers.FACILITY.split(", ")]
    (tmp_path / "f.csv").write_text(",".join(names) + '\n7,"Big\nHouse",FOOD' + "," * (len(names) - 3) + "\n")
    r = readers.read_facilities(spark, str(tmp_path / "f.csv")).first()
    assert (r.FacilityID, r.FacilityName, r.PrimaryCategory, r.LastVerifiedDate) == (7, "Big\nHouse", "FOOD", None)
    (tmp_path / "n.json").write_text('{"nominee_name": "A", "submission_time": "2024-01-02T03:04:05"}\n')
    assert readers.read_nominations(spark, str(tmp_path / "n.json")).first().submission_time.day == 2
    assert X.snake_columns(spark.createDataFrame([], "`A b-C` int, ` x__y ` int")).columns == ["a_b_c", "x__y"]
    one = spark.range(1)
    assert [tables.staging_status(x) for x in (None, one.where("false"), one)] == ["MISSING", "SKIPPED", "READY"]
    order = rules.report_order(
        spark.createDataFrame(
            [(s, 1, f) for f, s in enumerate(("OTHER", "CLOSED", "NEEDS UPDATE", "VERIFIED", "VERIFIED"))],
            "status string, FacilityID int, field int"
        )
    )
    assert [r.field for r in order.collect()] == [3, 4, 2, 1, 0]


def test_rolling_users_against_brute_force(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rows = [("a", 0), ("a", 3), ("a", 3), ("b", 1), ("b", 9), ("c", 20), ("a", 21), (None, 5)]
    df = spark.createDataFrame([(u, day(n)) for u, n in rows], "user_upn string, log_date date")
    got = {r.log_date: r.active_users for r in reports.rolling_users(df, 4).collect()}
    want = {day(t): len({u for u, n in rows if u and n <= t < n + 4}) for t in range(22)}
    assert got == {d: n for d, n in want.items() if n}


def test_ingest_isolates_failures_and_moves_watermarks(spark, tmp_path):
    control = spark.createDataFrame(
        [
            (1, "full", "FULL", True), (2, "inc", "INCREMENTAL", True), (3, "bad", "FULL", True), (4, "none", "INCREMENTAL", True),
            (5, "off", "FULL", False)
        ],
        "control_id int, destination_table string, load_type string, is_active boolean"
    ).withColumns({
        "source_cutoff_date": F.lit("2024-01-02 00:00:00").cast("timestamp"), "last_run_status": F.lit(None).cast("string"),
        "last_rows_read": F.lit(None).cast("long")
    })
    data = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 6)], "id int, ts timestamp")

    def source(row):
        if row["destination_table"] == "bad":
            raise OSError("gone")
        return data.where("id < 2") if row["destination_table"] == "none" else data

    results = ingest.run_ingest(control, source, lambda n: tables.Table(spark, str(tmp_path / n)), "ts")
    assert {(r.control_id, r.status, r.rows_read) for r in results.collect()} == {
        (1, "SUCCESS", 5), (2, "SUCCESS", 3), (3, "FAILURE: OSError", 0), (4, "SUCCESS_NO_NEW_DATA", 0)
    }
    after = {r.control_id: r for r in ingest.update_control(control, results).collect()}
    assert after[2].source_cutoff_date == dt.datetime(2024, 1, 5) and after[4].source_cutoff_date == after[3].source_cutoff_date == dt.datetime(2024, 1, 2)
    assert after[3].last_rows_read is None and after[5].last_run_status is None
    with pytest.raises(ValueError):
        ingest.connection_for("X", "db", {})


def test_run_record(spark):
    r = ingest.audit_run(
        spark.createDataFrame([(dt.datetime(2024, 6, 1, 2), dt.datetime(2024, 6, 1, 2, 4, 37))], "run_start timestamp, run_end timestamp")
    ).first()
    assert (r.duration_seconds, r.audit_date, r.triggered_by) == (277, dt.date(2024, 6, 1), "SYSTEM")


def test_profile_is_one_pass_and_flags(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, ""), (1, None, "b"), (1, None, "b"), (1, "x", None)], "c int, n string, s string")
    got = {r.column_name: r for r in profile.health_flags(profile.profile(df, "t", "L")).collect()}
    assert got["n"].null_pct == 80.0 and got["n"].health_flag == "WARN" and got["c"].health_flag == "WARN" and got["s"].blank_count == 1
    assert all(r.null_count <= r.total_rows == 5 for r in got.values())
    plan = profile.profile(df, "t", "L", approximate=True)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines ""q"""\n')
    assert readers.read_system_csv(spark, str(tmp_path / "a.csv"), "id string, name string").first().name == 'two\nlines "q"'
    blobs = tmp_path / "blobs"
    blobs.mkdir()
    for i in range(3):
        (blobs / f"{i}.json").write_text(json.dumps([{"Id": f"{i}-{j}", "RecordType": 20 + j % 2} for j in range(4)]))
    rows = readers.read_audit_blobs(spark, str(blobs))
    assert rows.count() == 6 and audit.flatten_audit(rows).where("UserType = -1 AND ItemName = ''").count() == 6
    url = {"url": "jdbc:derby:memory:t;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(
        [(i, dt.date(2024, 1, i)) for i in range(1, 6)], "id int, at date"
    ).write.format("jdbc").options(**url).option("dbtable", "SRC").save()
    assert readers.jdbc_full(spark, url, "SRC", "id", (1, 6), 2).count() == 5
    assert readers.jdbc_incremental(spark, url, "SRC", '"at"', "2024-01-03").count() == 2
    assert readers.dev_sample(spark.range(100).withColumn("p", F.lit("x")), 1.0, 1, ("p",)).where("p = 'x'").count() == 0


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{D}/orders.parquet")
    plan = ingest.incremental_rows(df, "o_orderdate", "2001-01-01").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan


def test_streams_equal_batches(spark, tmp_path):
    raw = view(spark, D, "workspace_logs").withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    raw.write.parquet(str(tmp_path / "in"))
    raw = spark.read.parquet(str(tmp_path / "in"))
    streams.stream_logs(spark, str(tmp_path / "in"), raw.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = tables.Table(spark, str(tmp_path / "out")).read()
    want = raw.select("OperationId", "Timestamp").distinct()
    assert got.count() == want.count() and got.join(want, ["OperationId", "Timestamp"]).count() == want.count()
    streams.stream_logs(spark, str(tmp_path / "in"), raw.schema, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert tables.Table(spark, str(tmp_path / "out")).read().count() == want.count()
    q = streams.stream_feed(
        spark, str(tmp_path / "in"), raw.schema
    ).writeStream.format("memory").queryName("feed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("feed").collect())) == sorted(map(tuple, streams.feed(raw).collect()))
    bronze = view(spark, D, "audit_events")
    bronze.write.parquet(str(tmp_path / "ain"))
    streams.stream_audit(spark, str(tmp_path / "ain"), bronze.schema, str(tmp_path / "aout"), str(tmp_path / "acp")).awaitTermination()
    assert tables.Table(spark, str(tmp_path / "aout")).read().count() == audit.silver_audit(bronze).count()


def test_malformed_json_and_old_payloads(spark):
    df = view(spark, D, "workspace_logs")
    p = logs.parse_logs(df)
    assert p.where("EventText = '{bad' AND (dax_text IS NOT NULL OR error_message IS NOT NULL)").count() == 0
    assert p.where(
        "ApplicationContext LIKE '{\"ReportId%' AND report_id IS NULL"
    ).count() == 0 and p.where("upn IS NULL OR upn <> lower(trim(upn))").count() == 0
    assert jobs.running(view(spark, D, "activity")).where("stop_execution_date IS NOT NULL").count() == 0
