"""The stream gives what the batch gives, also after restart and replay."""

import pytest
from pyspark.sql import functions as F

from idsignal.plans import analysis, catalog, fixtures as fx
from idsignal.sources import lines
from idsignal.streaming import alerts as streams

NOW = {"availableNow": True}


def write_lines(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")


def test_text_lines_restart_and_ids(spark, tmp_path):
    source = tmp_path / "in"
    store, feed, offsets = (str(tmp_path / n) for n in ("alerts", "feed", "offsets"))
    write_lines(source, "a.log", ["from 8.8.8.8", "from 8.8.8.8", "nothing"])

    def run():
        streams.start_alert_stream(lines.stream_lines(spark, str(source)), store, feed, offsets, NOW).awaitTermination()
        return streams.stored_rows(spark, store).collect()

    assert [r.risk_score for r in sorted(run(), key=lambda r: r.id)] == [15, 15, 0]
    assert len(run()) == 3
    write_lines(source, "b.log", ["from 10.0.0.1"])
    rows = run()
    assert len(rows) == 4 and len({r.id for r in rows}) == 4
    assert {r.status for r in rows} == {"OPEN"} and {r.severity for r in rows} == {"LOW"}
    pushed = spark.read.parquet(feed)
    assert pushed.drop("batch_id").columns == streams.FEED and pushed.count() == 4


def test_a_batch_written_twice_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch_id in (0, 1, 1):
        streams.write_batch(spark.range(5).withColumn("severity", F.lit("LOW")), batch_id, path)
    assert spark.read.parquet(path).count() == 10


def test_batch_and_stream_agree(spark, sf):
    batch = analysis.line_alerts(fx.derive(spark, sf, fx.RAW_LINES), F.col("event_id"), F.col("event_ts"))
    stream = catalog.QUERIES["stream_alert_store"](spark, sf)
    assert batch.exceptAll(stream.select(batch.columns)).isEmpty() and stream.count() == batch.count()


def test_running_counts_follow_new_files(spark, tmp_path):
    source, path, offsets = tmp_path / "in", str(tmp_path / "counts"), str(tmp_path / "offsets")

    def run():
        seen = lines.stream_lines(spark, str(source)).withColumn("event_id", F.lit(1))
        alerts = analysis.line_alerts(seen, F.col("event_id"), F.current_timestamp())
        streams.start_severity_counts(alerts, path, offsets, NOW).awaitTermination()
        return {r.severity: r.v for r in streams.latest_counts(spark, path).collect()}

    write_lines(source, "a.log", ["x", "y"])
    assert run() == {"LOW": 2}
    write_lines(source, "b.log", ["z"])
    assert run() == {"LOW": 3}


@pytest.mark.parametrize("trigger", [NOW])
def test_feed_is_newest_first(spark, sf, trigger):
    rows = catalog.QUERIES["live_feed"](spark, sf).limit(20).collect()
    assert [r.timestamp for r in rows] == sorted((r.timestamp for r in rows), reverse=True)


def test_line_ids_of_a_late_batch(spark):
    from idsignal.streaming.alerts import number_lines
    lines = spark.range(1000).repartition(5).selectExpr("concat('line ', id) as raw_log")
    ids = [r.event_id for r in number_lines(lines, 1 << 20).collect()]
    assert sorted(ids) == [(1 << 52) + i for i in range(1000)]
    with pytest.raises(ValueError):
        number_lines(lines, 1 << 31)
