"""The weekly stream over several files and runs, and session settings."""

import datetime
import random

from larder import schemas
from larder.operators import consumption
from larder.session import sized_for
from larder.streaming import weekly_consumption, weekly_windows


def test_weekly_stream_equals_the_batch_report(spark, tmp_path):
    rng = random.Random(4)
    landing, root = str(tmp_path / "history"), str(tmp_path / "weekly")
    schema = schemas.TABLES["freezer_position_history"]
    product = spark.createDataFrame(
        [(1, "a", "t"), (2, "b", "t"), (3, "b", "t")], "id bigint, description string, product_type string"
    )
    exclude = spark.createDataFrame([(1, None)], schemas.TABLES["product_exclude"])
    everything = []

    def run():
        stream = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        )
        weekly_consumption.start_weekly_consumption(stream, root).awaitTermination()

    for step in range(3):
        start = datetime.datetime(2024, 1, 5) + datetime.timedelta(days=10 * (2 - step))
        rows = [
            (i, rng.randrange(1, 4), start + datetime.timedelta(minutes=rng.randrange(14000)))
            for i in range(60)
        ]
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        run()
        as_of = f"2024-02-{10 + 8 * step} 00:00:00"  # the window moves on
        batch = consumption.consumption_weekly(
            spark.createDataFrame(everything, schema), product, exclude, 30, as_of
        )
        streamed = weekly_consumption.read_weekly_consumption(spark, root, product, exclude, 30, as_of)
        assert sorted(streamed.collect()) == sorted(batch.collect())
        assert streamed.columns == batch.columns
    run()
    numbers = sorted(int(p.name[6:]) for p in (tmp_path / "weekly" / "counts").glob("batch=*"))
    assert numbers[:4] == [-1, 0, 1, 2]
    stored = spark.read.schema(weekly_consumption.COUNTERS).parquet(f"{root}/counts/batch=1")
    assert stored.agg({"consumed": "sum"}).first()[0] == 60  # its own changes only


def changes(rng, week, count):
    """Rows of one week that starts ``week`` weeks after the first Monday of 2024."""
    start = datetime.datetime(2024, 1, 1) + datetime.timedelta(weeks=week)
    minutes = [rng.randrange(7 * 24 * 60) for _ in range(count)]
    return [(i, rng.randrange(1, 4), start + datetime.timedelta(minutes=m)) for i, m in enumerate(minutes)]


def test_weeks_are_written_once_when_closed(spark, tmp_path):
    """On-time weeks equal the batch report; the state is the open weeks; late rows are counted."""
    rng = random.Random(9)
    landing, root = str(tmp_path / "history"), str(tmp_path / "weekly")
    schema = schemas.TABLES["freezer_position_history"]
    product = spark.createDataFrame(
        [(1, "a", "t"), (2, "b", "t"), (3, "b", "t")], "id bigint, description string, product_type string"
    )
    nobody = spark.createDataFrame([], schemas.TABLES["product_exclude"])
    on_time, late, files = [], 0, {}
    for week in range(8):
        rows = changes(rng, week, 40)
        on_time += rows
        if week == 5:
            extra = changes(rng, 0, 7)
            late += len(extra)
            rows = rows + extra + [(0, 1, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        weekly_windows.run_weekly_windows(stream, root, "1 day")
        written = {p: p.stat().st_mtime_ns for p in (tmp_path / "weekly" / "closed").rglob("*.parquet")}
        assert all(written[path] == when for path, when in files.items())  # never written again
        files = written
        open_weeks = {r.week for r in weekly_windows.read_open_weeks(spark, root).collect()}
        assert len(open_weeks) <= 2
        row = weekly_windows.late_changes(spark, root).first()
        assert (row.arrived, row.late) == (len(on_time) + late, late)
        assert row.closed + row.open == len(on_time)
    closed = weekly_windows.read_closed_weeks(spark, root, product, nobody).collect()
    batch = consumption.consumption_weekly(
        spark.createDataFrame(on_time, schema), product, nobody, 365, "2024-12-30 00:00:00"
    )
    want = sorted(r for r in batch.collect() if r.week not in open_weeks)
    assert sorted(closed) == want and len({r.week for r in closed}) >= 6
    later = weekly_windows.read_closed_weeks(spark, root, product, nobody, "2024-01-15").collect()
    assert {r.week for r in later} == {r.week for r in closed if r.week >= datetime.date(2024, 1, 15)}


def test_windows_do_not_depend_on_the_session_zone(spark, tmp_path):
    schema = schemas.TABLES["freezer_position_history"]
    edges = [datetime.datetime(2024, 3, 10, 23, 59), datetime.datetime(2024, 3, 11), datetime.datetime(2024, 3, 31, 2, 30)]
    rows = [(1, 1, at) for at in [*edges, datetime.datetime(2024, 5, 1)]]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "history"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "history"))
        weekly_windows.run_weekly_windows(stream, str(tmp_path / "weekly"))
        closed = spark.read.schema(weekly_windows.CLOSED).parquet(str(tmp_path / "weekly" / "closed"))
        got = {str(r.week): r.consumed for r in closed.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {"2024-03-04": 1, "2024-03-11": 1, "2024-03-25": 1}


def test_partitions_follow_the_input():
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert sized_for(1)[name] == "200"
    assert sized_for(10 * 1024**4)[name] == "40960"
    assert sized_for(10**15)[name] == "65536"
