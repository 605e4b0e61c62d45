"""Counts of a change log as a stream: whole windows, late entries, entries without a time, replays."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kgspark.streaming import changes

WHOLE = "select date_trunc('hour', ts) as start, event_type as op, count(*) as entries from events group by all"


def counted(frame):
    return sorted(((r["start"], r["op"], r["entries"]) for r in frame.collect()), key=str)


def test_log_windows_have_every_event(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "add"), ("2024-01-01 05:59:59.999999", "add"), ("2024-01-01 00:59:59", "drop"), ("1969-12-31 23:30:00", "add"), (None, "add"), (None, None), ("2024-01-01 06:00:00", None)]
    made = spark.createDataFrame(rows, "t string, event_type string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", F.lit(1).cast("long").alias("user_id"))
    made.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = counted(__spark_entry__.queries()["r3_log_windows"](spark, str(tmp_path)))
    with duckdb.connect() as duck:
        duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert found == sorted(duck.execute(WHOLE).fetchall(), key=str)
    assert sum(r[2] for r in found) == len(rows)


def test_log_windows_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert counted(__spark_entry__.queries()["r3_log_windows"](spark, str(tmp_path))) == []


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_log_windows_do_not_depend_on_the_time_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    made = spark.sql("select timestamp_ntz'2024-03-10 01:30:00' as ts, 'add' as event_type union all select timestamp_ntz'2024-03-10 02:30:00', 'add' union all select timestamp_ntz'2024-03-10 03:30:00', 'add'")
    made.write.parquet(str(tmp_path / "events.parquet"))
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        found = counted(__spark_entry__.queries()["r3_log_windows"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [(datetime.datetime(2024, 3, 10, h), "add", 1) for h in (1, 2, 3)]


def test_log_counts_after_a_restart_with_late_entries_and_a_replay(spark, tmp_path):
    table = changes.LogCounts(spark, str(tmp_path / "log"), "timestamp_ntz")

    def come(i, *found):
        part = spark.createDataFrame(found, "t string, op string").select(F.col("t").cast("timestamp_ntz").alias("at"), "op")
        part.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema("at timestamp_ntz, op string").parquet(str(tmp_path / "in*"))
        stream.writeStream.foreachBatch(table.add()).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return part, [(r[0].hour, *r[1:]) for r in counted(table.read())]

    assert come(0, ("2024-01-01 00:10:00", "add"), ("2024-01-01 09:00:00", "add"))[1] == [(0, "add", 1), (9, "add", 1)]
    late, found = come(1, ("2024-01-01 00:20:00", "add"), ("2024-01-01 09:30:00", "drop"))
    assert found == [(0, "add", 2), (9, "add", 1), (9, "drop", 1)]
    table.add()(late, 1)
    assert [(r[0].hour, *r[1:]) for r in counted(table.read())] == found
