"""Stream tables, the replay filter and the running cards, step by step."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from idsignal import schemas
from idsignal.operators import reports
from idsignal.streaming import alerts as streams, cards
from idsignal.streaming.tables import FANOUT, LISTS, Part, StreamTable

NOW = {"availableNow": True}


def numbers(spark, start, n):
    return spark.range(start, start + n, 1, 1)


def table(spark, path, **kind):
    return StreamTable(spark, str(path), spark.range(1).schema, **kind)


def held(t):
    return sorted(r.id for r in t.read().collect())


def test_many_batches_leave_few_parts(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=4)
    for i in range(70):
        assert t.append(numbers(spark, 2 * i, 2), i)
        t.compact()
    parts = t.live()[1]
    assert len(parts) <= 4 * 3 and [p.first for p in parts[1:]] == [p.last + 1 for p in parts[:-1]]
    assert held(t) == list(range(140))
    assert not t.append(numbers(spark, 1000, 5), 3) and held(t) == list(range(140))
    assert len(t.lists()) <= 21


def test_files_of_replaced_parts_go(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=2)
    for i in range(30):
        t.append(numbers(spark, i, 1), i)
        t.compact()
    assert t.expire() > 0 and held(t) == list(range(30))
    named = {p.folder for p in t.live()[1]}
    assert named <= {f"batch_id={i}" for i in range(30)} | {f"_merged/{n}" for n in os.listdir(tmp_path / "t/_merged")}


def test_replay_while_parts_are_merged(spark, tmp_path, monkeypatch):
    """A batch that comes again, and a new one, after a merge has read its parts and before it writes its list."""
    t, other = table(spark, tmp_path / "t", fanout=3), table(spark, tmp_path / "t", fanout=3)
    for i in range(3):
        t.append(numbers(spark, i, 1), i)
    commit = StreamTable.commit

    def late(self, number, parts):
        if self is t and any(p.level for p in parts) and other.live()[0] == 3:
            assert not other.append(numbers(spark, 2, 1), 2)
            assert other.append(numbers(spark, 3, 1), 3)
        return commit(self, number, parts)

    monkeypatch.setattr(StreamTable, "commit", late)
    assert t.compact() == 1
    assert held(t) == [0, 1, 2, 3] and [(p.first, p.last) for p in t.live()[1]] == [(0, 2), (3, 3)]


def test_a_list_number_is_given_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(numbers(spark, 0, 1), 0)
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append(t.commit(1, [Part(f"x{n}", 0, 0)]))) for n in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(won) == [False] * 5 + [True]
    assert not [n for n in os.listdir(tmp_path / "t" / LISTS) if "draft" in n and not n.endswith(".crc")]


def test_a_failed_batch_is_written_again(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    monkeypatch.setattr(StreamTable, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.append(numbers(spark, 0, 5), 0)
    monkeypatch.undo()
    assert held(t) == [] and t.append(numbers(spark, 0, 2), 0) and held(t) == [0, 1]


def test_keyed_table_keeps_the_newest(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, v long, batch_id long").schema
    t = StreamTable(spark, str(tmp_path / "t"), schema, ["key"], fanout=3)
    want = {}
    for i in range(11):
        rows = [(k, i * 10, i) for k in ("a", f"k{i % 4}", None)]
        want.update({k: v for k, v, _ in rows})
        t.append(spark.createDataFrame(rows, schema), i)
        t.compact()
        assert {r.key: r.v for r in t.read().collect()} == want


def test_table_without_batches(spark, tmp_path):
    assert table(spark, tmp_path / "none").read().collect() == [] and not table(spark, tmp_path / "none").has(0)


EVENT = "event_id long, event_ts timestamp_ntz, raw_log string"


def write_events(spark, folder, rows):
    spark.createDataFrame([(i, None if t is None else __import__("datetime").datetime.fromisoformat(t), r) for i, t, r in rows], EVENT) \
        .coalesce(1).write.mode("append").parquet(str(folder))


def run_alerts(spark, folder, tmp_path, memory):
    seen = streams.once_per_id(spark.readStream.schema(EVENT).parquet(str(folder)), "event_id", "event_ts", memory)
    query = streams.start_alert_stream(seen, *(str(tmp_path / n) for n in ("store", "feed", "offsets")), NOW, F.col("event_ts"))
    query.awaitTermination()
    return query, sorted((r.id is None, r.id or 0) for r in streams.stored_rows(spark, str(tmp_path / "store")).collect())


def test_replayed_events_are_stored_once(spark, tmp_path):
    folder = tmp_path / "in"
    write_events(spark, folder, [(1, "2024-01-01T00:00:00", "from 8.8.8.8"), (2, "2024-01-01T01:00:00", "x"), (2, "2024-01-01T01:00:00", "x"),
                                 (None, "2024-01-01T02:00:00", "n")])
    assert run_alerts(spark, folder, tmp_path, "2 hours")[1] == [(False, 1), (False, 2), (True, 0)]
    write_events(spark, folder, [(2, "2024-01-01T01:00:00", "x"), (3, "2024-01-01T02:30:00", "y"), (None, "2024-01-01T02:00:00", "n")])
    assert run_alerts(spark, folder, tmp_path, "2 hours")[1] == [(False, 1), (False, 2), (False, 3), (True, 0), (True, 0)]
    assert streams.stored_rows(spark, str(tmp_path / "feed")).count() == 5


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    write_events(spark, folder, [(1, "2024-01-05T00:00:00", "a")])
    run_alerts(spark, folder, tmp_path, "1 hour")
    write_events(spark, folder, [(2, "2024-01-01T00:00:00", "b"), (3, "2024-01-05T00:30:00", "c")])
    query, ids = run_alerts(spark, folder, tmp_path, "1 hour")
    assert ids == [(False, 1), (False, 3)] and streams.rows_too_late(query) == 1


FACT = "id long, event_ts timestamp_ntz, user_id long, action_id long, alert_score double, prelim_priority string"


def test_cards_follow_every_batch(spark, sf, tmp_path):
    from idsignal.plans import catalog

    facts = catalog.wh_fact(spark, sf).select(*catalog.FACT_COLUMNS)
    folder, path, listed, offsets = (str(tmp_path / n) for n in ("in", "cards", "lists", "offsets"))
    odd = spark.createDataFrame([(-1, None, None, None, None, None), (-2, None, 7, 1, float("nan"), "high")], FACT)
    parts = [facts.where("id % 3 = 0"), facts.where("id % 3 = 1").unionByName(odd), facts.where("id % 3 = 2")]
    for n in range(1, 4):
        parts[n - 1].select(facts.columns).write.mode("append").parquet(folder)
        given = spark.readStream.schema(FACT).parquet(folder)
        cards.start_cards(given, path, offsets, NOW).awaitTermination()
        cards.start_lists(given, listed, offsets + "-lists", given.schema, NOW, limit=7).awaitTermination()
        sofar = spark.read.schema(FACT).parquet(folder)
        kept = cards.totals_table(spark, path).read()
        assert cards.stats(kept).collect() == reports.warehouse_stats(sofar).select(*cards.stats(kept).columns).collect()
        assert cards.trend(kept).collect() == reports.daily_trend(sofar).collect()
        assert sorted(map(str, cards.breakdown(kept, "priority").collect())) == sorted(
            map(str, sofar.groupBy(F.col("prelim_priority").alias("name")).agg(F.count(F.lit(1)).alias("v")).collect()))
        assert sorted(map(str, cards.latest_lists(spark, listed, given.schema).collect())) == sorted(map(str, cards.best_rows(sofar, 7).collect()))


def test_cards_before_the_first_batch(spark, tmp_path):
    kept = cards.totals_table(spark, str(tmp_path / "none")).read()
    assert [tuple(r) for r in cards.stats(kept).collect()] == [(0, 0, 0, 0.0)] and cards.trend(kept).collect() == []


def test_default_fanout_and_alert_schema(spark, tmp_path):
    t = StreamTable(spark, str(tmp_path / "t"), schemas.ALERTS)
    for i in range(FANOUT + 1):
        t.append(spark.createDataFrame([], schemas.ALERTS), i)
    assert t.compact() == 1 and len(t.live()[1]) == 2 and t.read().count() == 0
