"""Loads side by side, run records, control rows, quarantine, late rows, sketches."""

import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from granary.operators import ingest, logs, sketches, tables
from granary.sources import readers, schemas
from granary.sources.fixtures import view
from granary.streaming import streams

D = "/root/testdata/sf0.001"


def control_of(spark, rows):
    named = [(i, "p", t, t, kind, True, dt.datetime(2024, 1, 1)) for i, t, kind in rows]
    frame = spark.createDataFrame(named, "control_id int, pipeline_name string, source_table string, destination_table string, load_type string, is_active boolean, source_cutoff_date timestamp")
    kind = schemas.schema("control_table")
    return tables.conform(frame, kind)


def test_loads_side_by_side(spark, tmp_path):
    """20 sources, four at a time; one fails, the others don't mind; control rows and records tell of each."""
    data = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 6)], "id int, ts timestamp")
    now, most, guard = set(), [], threading.Lock()

    def source(row):
        with guard:
            now.add(row["control_id"])
            most.append(len(now))
        time.sleep(0.2)
        if row["control_id"] == 7:
            now.discard(7)
            raise OSError("gone")
        return data

    table = lambda n: tables.Table(spark, str(tmp_path / n))

    class Watched(tables.Table):
        def commit(self, *a, **k):
            super().commit(*a, **k)
            with guard:
                now.discard(int(self.root.rsplit("t", 1)[1]))

    control, audit = table("control"), table("audit")
    control.replace(control_of(spark, [(i, f"t{i}", "FULL" if i % 2 else "INCREMENTAL") for i in range(20)]))
    records = ingest.run_controlled(control, audit, source, lambda n: Watched(spark, str(tmp_path / n)), "ts", parallel=4, triggered_by="me")
    assert 1 < max(most) <= 4 and records.count() == audit.n_rows() == 20 and records.schema == schemas.schema("pipeline_audit_log")
    assert [r.control_id for r in records.where("run_status = 'FAILURE'").collect()] == [7]
    after = {r.control_id: r for r in control.read().collect()}
    assert after[7].last_run_status == "FAILURE: OSError" and after[7].last_rows_written is None and after[7].last_run_end is not None
    assert (after[4].last_rows_read, after[4].last_rows_written, after[4].last_updated_by) == (4, 4, "me") and after[4].source_cutoff_date == dt.datetime(2024, 1, 5)
    assert after[4].last_run_start <= after[4].last_run_end <= after[4].last_updated_at and control.read().schema == schemas.schema("control_table")
    again = ingest.run_controlled(control, audit, source, table, "ts").where("control_id IN (3, 4)").orderBy("control_id").collect()
    assert [(r.rows_written, r.rows_deleted) for r in again] == [(5, 5), (0, 0)]


def test_one_load_is_cancelled(spark, tmp_path):
    @F.udf("int")
    def slow(x):
        time.sleep(60)
        return x

    data = spark.range(4).select(F.col("id").cast("int").alias("id"), F.lit("2024-01-02").cast("timestamp").alias("ts"))
    source = lambda row: data.withColumn("id", slow("id")) if row["control_id"] == 1 else data
    threading.Timer(6, lambda: spark.sparkContext.cancelJobGroup(ingest.job_group(1))).start()
    began = time.time()
    got = ingest.run_ingest(control_of(spark, [(1, "a", "FULL"), (2, "b", "FULL")]), source, lambda n: tables.Table(spark, str(tmp_path / n)), "ts")
    assert {r.control_id: r.status[:7] for r in got.collect()} == {1: "FAILURE", 2: "SUCCESS"} and time.time() - began < 50


def events(n, day=1, kind=21):
    return [{"Id": f"{day}-{i}", "RecordType": kind, "CreationTime": f"2024-01-{day:02d} 10:00:00", "Operation": "ViewReport", "UserId": "U", "IsSuccess": "True"} for i in range(n)]


def test_broken_files_go_to_quarantine(spark, tmp_path):
    blobs = tmp_path / "blobs"
    blobs.mkdir()
    (blobs / "a.json").write_text(json.dumps(events(3) + events(2, kind=20)))
    (blobs / "b.json").write_text('[{"Id": "x", "Record')
    (blobs / "c.json").write_text(json.dumps(events(4, 2)))
    silver, broken = (tables.Table(spark, str(tmp_path / n)) for n in ("silver", "broken"))
    r = ingest.land_audit(spark, str(blobs), silver, broken, batch=("audit", 0))
    assert (r["inserted"], r["rows_skipped"], r["status"]) == (7, 1, "INITIAL_LOAD")
    bad = broken.read().collect()
    assert len(bad) == 1 and bad[0].file_name.endswith("b.json") and bad[0].reason and bad[0].content.startswith('[{"Id"')
    r = ingest.land_audit(spark, str(blobs), silver, broken, batch=("audit", 0))
    assert (r["status"], r["rows_skipped"]) == ("REPLAYED", 0) and broken.n_rows() == 1


def test_a_stream_goes_on_past_a_broken_file(spark, tmp_path):
    blobs = tmp_path / "blobs"
    blobs.mkdir()
    run = lambda: streams.stream_audit_blobs(spark, str(blobs), str(tmp_path / "s"), str(tmp_path / "q"), str(tmp_path / "cp"), "audit").awaitTermination()
    (blobs / "a.json").write_text(json.dumps(events(3)))
    (blobs / "b.json").write_text("{broken")
    run()
    (blobs / "c.json").write_text(json.dumps(events(4, 2)))
    run()
    silver, broken = (tables.Table(spark, str(tmp_path / n)) for n in ("s", "q"))
    assert silver.n_rows() == silver.read().count() == 7 and broken.n_rows() == 1 and silver.head()["batches"] == {"audit": 1}


def test_late_rows_are_counted(spark, tmp_path):
    """One row comes after the watermark: it's in no window, but in the table of late rows."""
    frame = lambda at: spark.createDataFrame([(dt.datetime(2024, 1, 1, *at), "op")], "Timestamp timestamp, OperationName string").coalesce(1)
    source, kind, late = str(tmp_path / "in"), "Timestamp timestamp, OperationName string", tables.Table(spark, str(tmp_path / "late"))
    listener = streams.LateRows(late)
    spark.streams.addListener(listener)
    try:
        for at in ((10, 0), (20, 0), (10, 5)):
            frame(at).write.mode("append").parquet(source)
            q = streams.stream_feed(spark, source, spark.createDataFrame([], kind).schema).writeStream.format("noop").outputMode("append").queryName("feed").option(
                "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        for _ in range(50):
            if listener._seen:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.flush() == 1 and [(r.query, r.rows) for r in late.read().collect()] == [("feed", 1)] and listener.flush() == 0


def test_sketches_of_days_merge_within_their_errors(spark, tmp_path):
    parsed = logs.logs_parsed(view(spark, "/root/testdata/sf0.01", "workspace_logs"))
    table = tables.Table(spark, str(tmp_path / "days"))
    sketches.store_days(table, parsed, ["report_id"])
    exact = {r.report_id: r for r in parsed.groupBy("report_id").agg(
        F.count("*").alias("n"), F.count_distinct("upn").alias("users"), F.round(F.avg("DurationMs"), 2).alias("ms"), F.sort_array(F.collect_list("DurationMs")).alias("d")).collect()}
    got = sketches.over_days(table.read(), ["report_id"]).collect()
    assert len(got) == len(exact) > 5
    for r in got:
        want = exact[r.report_id]
        assert (r.operations, r.avg_ms) == (want.n, want.ms) and abs(r.users - want.users) <= 0.05 * want.users + 1
        rank = sum(x <= r.p_ms for x in want.d) / len(want.d)
        assert abs(rank - 0.95) < 0.03
    top = [r.report_id for r in sketches.top_reports_from_days(table.read()).collect()]
    assert top == [r.report_id for r in logs.top_reports(parsed).collect()]
    before = set(table.head()["folders"])
    sketches.store_days(table, parsed.where("log_date = DATE'2024-01-05'"), ["report_id"])
    assert len(before - set(table.head()["folders"])) == 1
    users = {r.log_date: r.users for r in sketches.active_users_from_days(table.read(), 7).collect()}
    day = dt.date(2024, 1, 20)
    true = parsed.where((F.col("log_date") <= F.lit(day)) & (F.col("log_date") > F.lit(day - dt.timedelta(7)))).agg(F.count_distinct("upn")).first()[0]
    assert abs(users[day] - true) <= 0.05 * true + 1


def test_several_exact_distincts_without_a_row_a_column(spark):
    parsed = logs.logs_parsed(view(spark, D, "workspace_logs"))
    for df in (logs.user_activity(parsed), logs.model_summary(parsed), logs.kw2_failures(view(spark, D, "workspace_logs"), "2024-01-31 00:00:00"), logs.visual_usage(parsed)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
