"""Merges that touch only what changed, replayed batches, buckets, new columns, loads after the ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granary.functions import exprs as X
from granary.operators import audit, catalog, gold, reports, tables
from granary.operators import logs as L
from granary.sources import schemas
from granary.sources.fixtures import view
from granary.streaming import streams

D = "/root/testdata/sf0.001"


def folders(table):
    return set(table.head()["folders"])


def days(paths):
    return {p.split("log_date=")[1].split("/")[0] for p in paths}


def test_a_batch_rewrites_only_its_days_and_counts_once(spark, tmp_path):
    raw = view(spark, D, "workspace_logs")
    base, parsed = (tables.Table(spark, str(tmp_path / n)) for n in ("base", "parsed"))
    assert gold.load_logs(raw, base, parsed, ("logs", 0))["parsed"]["status"] == "INITIAL_LOAD"
    before, n = folders(parsed), parsed.n_rows()
    assert len(before) == len(days(before)) > 20
    day = raw.where("to_date(Timestamp) = DATE'2024-01-05'").withColumn("Status", F.lit("Failed"))
    r = gold.load_logs(day, base, parsed, ("logs", 1))
    assert r["parsed"]["updated"] > 0 and r["parsed"]["updated"] + r["parsed"]["unchanged"] == parsed.read().where("Status = 'FAILURE' AND log_date = DATE'2024-01-05'").count()
    assert days(folders(parsed) - before) == {"2024-01-05"} and len(before - folders(parsed)) == 1 and parsed.n_rows() == n == parsed.read().count()
    version = parsed.head()["version"]
    assert {x["status"] for x in gold.load_logs(day, base, parsed, ("logs", 1)).values()} == {"REPLAYED"} and parsed.head()["version"] == version
    assert gold.load_logs(day, base, parsed, ("other", 0))["base"]["status"] == "SUCCESS"


def test_streams_write_each_batch_once(spark, tmp_path):
    raw = view(spark, D, "workspace_logs").withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    day = lambda n: raw.where(F.to_date("Timestamp") == F.lit(f"2024-01-{n:02d}").cast("date"))
    source, target = str(tmp_path / "in"), tables.Table(spark, str(tmp_path / "out"))
    run = lambda: streams.stream_logs(spark, source, raw.schema, target.root, str(tmp_path / "cp"), "logs").awaitTermination()
    raw.where("Timestamp < '2024-01-10'").write.parquet(source)
    run()
    before = folders(target)
    assert target.head()["batches"] == {"logs": 0} and len(before) == 9
    day(12).write.mode("append").parquet(source)
    run()
    assert before < folders(target) and days(folders(target) - before) == {"2024-01-12"}
    # the same rows, as the batch load writes them
    other = tables.Table(spark, str(tmp_path / "batch"))
    gold.load_logs(raw.where("Timestamp < '2024-01-10'").unionByName(day(12)), tables.Table(spark, str(tmp_path / "base")), other)
    key = lambda t: sorted((r.OperationId, r.Timestamp, r._row_hash) for r in t.read().collect())
    assert key(target) == key(other)


def test_the_silver_table_keeps_other_days(spark, tmp_path):
    bronze = view(spark, D, "audit_events")
    target = tables.Table(spark, str(tmp_path / "silver"), tables.Layout(("log_date",)))
    target.merge(audit.silver_audit(bronze), audit.SILVER_KEYS, "_row_hash")
    before, row = folders(target), target.read().where("IsSuccess").orderBy("Id").first()
    late = bronze.where(F.trim("Id") == row.Id).withColumn("IsSuccess", F.lit("False"))
    r = target.merge(audit.silver_audit(late), audit.SILVER_KEYS, "_row_hash")
    assert r["updated"] == 1 and r["inserted"] == 0 and days(folders(target) - before) == {str(row.log_date)}


def test_buckets_bound_a_merge(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), tables.Layout((), ("k",), 8))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string").withColumn("_row_hash", X.row_hash(["v"]))
    t.merge(frame([(i, "a") for i in range(200)] + [(None, "n")]), ["k"], "_row_hash")
    before = folders(t)
    assert len(before) == 8 and t.read().columns == ["k", "v", "_row_hash"]
    r = t.merge(frame([(7, "b"), (7000, "new")]), ["k"], "_row_hash")
    assert (r["inserted"], r["updated"]) == (1, 1) and len(before & folders(t)) >= 6
    assert r["unchanged"] == 0 and t.read().count() == t.n_rows() == 202 and {x.v for x in t.read().where("k IN (7, 7000)").collect()} == {"b", "new"}
    assert t.merge(frame([(None, "N")]), ["k"], "_row_hash")["updated"] == 1 and t.n_rows() == 202
    t.append(frame([(9000, "x")]))
    assert t.merge(frame([(9000, "y")]), ["k"], "_row_hash")["updated"] == 1 and t.read().where("k = 9000").first().v == "y"


def test_new_source_columns_are_added(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), tables.Layout(("day",)))
    one = spark.createDataFrame([(1, "a", "01", 1), (2, "b", "02", 2)], "k long, v string, day string, n int").withColumn("_row_hash", X.row_hash(["v"]))
    t.merge(one, ["k", "day"], "_row_hash")
    more = spark.createDataFrame([(1, "a", "01", 9, 1.5), (3, "c", "01", 7, 2.5)], "k long, v string, day string, n long, extra double").withColumn("_row_hash", X.row_hash(["v"]))
    r = t.merge(more, ["k", "day"], "_row_hash")
    assert (r["inserted"], r["unchanged"]) == (1, 1)
    assert sorted((x.k, x.n, x.extra) for x in t.read().collect()) == [(1, 1, 1.5), (2, 2, None), (3, 7, 2.5)]
    assert dict(t.read().dtypes)["n"] == "int"


def test_versions_are_found_without_reading_all(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    for i in range(4):
        t.append(spark.createDataFrame([(i,)], "k int"))
    t._put("_manifest/_head", "2", True)  # a writer that died before it named its version
    assert t.head()["version"] == 4 and t.read().count() == 4 and t.read(2).count() == 2 and t.history().count() == 4
    with pytest.raises(Exception, match="exist"):
        t._put(t._file(4), "{}", False)


def test_overwrite_replaces_its_partitions_only(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), tables.Layout(("m",)))
    frame = lambda rows: spark.createDataFrame(rows, "m string, v int")
    t.overwrite(frame([("a", 1), ("a", 2), ("b", 3)]))
    before = folders(t)
    t.overwrite(frame([("b", 4), ("b", 5), ("c", 6)]))
    assert len(before & folders(t)) == 1 and t.n_rows() == 5 and sorted(map(tuple, t.read().collect())) == [("a", 1), ("a", 2), ("b", 4), ("b", 5), ("c", 6)]
    named = {"tables": spark.createDataFrame([("1",)], "id string")}
    table = lambda n: tables.Table(spark, str(tmp_path / n))
    for model in ("m1", "m2"):
        catalog.save_system_tables(named, table, model)
    kept = folders(table("system_tables"))
    catalog.save_system_tables(named, table, "m2")
    assert len(kept & folders(table("system_tables"))) == 1


def test_a_merge_counts_while_it_writes(spark, tmp_path):
    """Jobs of a merge: the source's size, its places, the write. Nothing that was written is read again."""
    t = tables.Table(spark, str(tmp_path / "t"), tables.Layout(("day",)))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, day string").withColumn("_row_hash", X.row_hash(["v"]))
    t.merge(frame([(1, "a", "01")]), ["k", "day"], "_row_hash")
    read, real = [], tables.Table._rows
    tables.Table._rows = lambda self, paths, schema: read.append(set(paths)) or real(self, paths, schema)
    try:
        t.merge(frame([(1, "b", "01"), (2, "c", "02")]), ["k", "day"], "_row_hash")
    finally:
        tables.Table._rows = real
    assert len(read) == 1 and not read[0] & folders(t)


def at(day):
    return F.lit(f"2024-02-0{day} 00:00:00").cast("timestamp")


def refresh(spark, rows):
    return spark.createDataFrame(
        [(dt.date(2024, 1, 1), "w", "m", mode, 1, 1, 0, 10.0, most, 1, 5.0, 100.0, "OK") for mode, most in rows],
        "log_date date, WorkspaceName string, ItemName string, ModelMode string, total_refresh_ops long, success_count long, failure_count long, "
        "avg_duration_ms double, max_duration_ms long, min_duration_ms long, avg_cpu_ms double, success_rate_pct double, sla_status string")


def test_any_business_column_is_an_update(spark, tmp_path):
    """Only max_duration_ms changes: once taken for unchanged, as the hash left it out."""
    table = lambda n: tables.Table(spark, str(tmp_path / n))
    name = "gold_semantic_model_refresh_summary"
    for most, day, updated in ((5, 1, 0), (99, 2, 1)):
        table(name + schemas.STAGING).replace(refresh(spark, [("Import", most)]))
        assert gold.gold_load(spark, table, name, at(day))["updated"] == updated
    row = table(name).read().first()
    assert (row.max_duration_ms, row._dw_created_at.day, row._dw_updated_at.day) == (99, 1, 2)
    for n in gold.KEYS:
        assert set(gold.hashed(n)) | set(gold.KEYS[n]) | {"gold_loaded_at", "_dw_created_at", "_dw_updated_at", "_row_hash"} == set(schemas.schema(n).names)


def test_a_model_with_two_modes_loads(spark, tmp_path):
    table = lambda n: tables.Table(spark, str(tmp_path / n))
    name = "gold_semantic_model_refresh_summary"
    table(name + schemas.STAGING).replace(refresh(spark, [("Import", 5), ("DirectLake", 6), (None, 7)]))
    assert gold.gold_load(spark, table, name, at(1))["gold_rows"] == 3
    card = "gold_model_health_scorecard"
    parsed = L.logs_parsed(view(spark, D, "workspace_logs"))
    both = parsed.unionByName(parsed.withColumn("ModelMode", F.lit("Other")))
    staged = reports.health_scorecard(L.refresh_summary(both), L.dax_performance(both)).withColumn("model_name", F.col("ItemName"))
    table(card + schemas.STAGING).replace(staged)
    r = gold.gold_load(spark, table, card, at(1))
    assert r["gold_rows"] == staged.count() > staged.select("ItemName", "WorkspaceName").distinct().count()
    before = folders(table(card))
    assert len(before) > 1
    table(card + schemas.STAGING).replace(staged.where("ModelMode = 'Other'").limit(1).withColumn("health_grade", F.lit("Z")))
    assert gold.gold_load(spark, table, card, at(2))["updated"] == 1 and len(folders(table(card)) - before) == 1
