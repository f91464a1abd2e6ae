"""The alert pipeline as a stream: same columns as in batch, replay-safe tables as sinks.

Sinks are `StreamTable`s: a micro-batch that runs twice is stored once, and small parts
are merged as batches come. An event that the source gives again in a later batch is
dropped by its id while the stream remembers it. Table and checkpoint belong
together: a new checkpoint starts batch numbers again and needs new tables.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from idsignal import schemas
from idsignal.plans.analysis import line_alerts, raw_landing
from idsignal.streaming.tables import StreamTable

FEED = ["id", "src_ip", "event_type", "severity", "risk_score"]
FEED_SCHEMA = T.StructType([schemas.ALERTS[name] for name in FEED])
LANDING = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("raw_log", T.StringType()), T.StructField("normalized", T.StringType()),
    T.StructField("processed", T.BooleanType()), T.StructField("created_at", T.TimestampNTZType())])
REFRESH = {"processingTime": "30 seconds"}


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    (
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def number_lines(batch: DataFrame, batch_id: int) -> DataFrame:
    """Ids for lines that have none, unique over all batches of a checkpoint.

    An id is the batch times 2^32 plus the line's number in it: room for 2^31 batches (68 years at
    one a second) of four billion lines; beyond that it fails instead of repeating ids. Lines are
    numbered through from the counts of the partitions before theirs.
    """
    if batch_id >= 1 << 31:
        raise ValueError("batch numbers beyond 2^31 leave no room for line ids")
    place = F.monotonically_increasing_id()
    numbered = batch.withColumn("_partition", F.shiftright(place, 33)).withColumn("_row", place % F.lit(1 << 33))
    sizes = numbered.groupBy("_partition").agg(F.count(F.lit(1)).alias("_size"))
    ahead = F.sum("_size").over(Window.orderBy("_partition")) - F.col("_size")
    placed = numbered.join(F.broadcast(sizes.select("_partition", ahead.alias("_ahead"))), "_partition")
    number = F.col("_ahead") + F.col("_row")
    event_id = F.when(number < (1 << 32), F.lit(batch_id << 32) + number).otherwise(
        F.raise_error(F.lit("too many lines in one batch")).cast("bigint"))
    return placed.withColumn("event_id", event_id).select(*batch.columns, "event_id")


def once_per_id(events: DataFrame, id_column: str, ts: str, memory: str) -> DataFrame:
    """A stream without the events it has already given within `memory` of event time.

    State is one key per id and is dropped once the watermark, `memory` behind the newest event,
    has passed it. `memory` must be longer than events or replays come late: later ones are dropped,
    and counted in the query's progress (`rows_too_late`). Events without an id or a time all pass.
    """
    alone = F.when(F.col(id_column).isNull() | F.col(ts).isNull(), F.expr("uuid()"))
    # an event without a time is as new as can be; a watermark wants a timestamp, not one without zone
    seen = F.coalesce(F.col(ts).cast("timestamp"), F.current_timestamp())
    keyed = events.withColumn("_seen", seen).withColumn("_alone", alone).withWatermark("_seen", memory)
    return keyed.dropDuplicatesWithinWatermark([id_column, "_alone"]).drop("_seen", "_alone")


def rows_too_late(query: StreamingQuery) -> int:
    """Rows a query has dropped because they came after the watermark, over the progress it still keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def start_alert_stream(lines: DataFrame, store: str, feed: str, checkpoint: str, trigger: dict,
                       timestamp: Column | None = None, auth_rule: bool = False) -> StreamingQuery:
    """Normalise, score and store lines; push the five feed fields to `feed`.

    `lines` has raw_log and, where the source gives one, event_id (`once_per_id` drops replayed
    ones). `timestamp` is the column to stamp alerts with, by default the time of the micro-batch.
    """
    stamp = timestamp if timestamp is not None else F.current_timestamp().cast("timestamp_ntz")

    def process(batch: DataFrame, batch_id: int) -> None:
        alerts_table, feed_table = (StreamTable(batch.sparkSession, path, schema) for path, schema in ((store, schemas.ALERTS), (feed, FEED_SCHEMA)))
        numbered = batch if "event_id" in batch.columns else number_lines(batch, batch_id)
        alerts = line_alerts(numbered, F.col("event_id"), stamp, auth_rule)
        alerts_table.append(alerts, batch_id)
        if not feed_table.has(batch_id):
            stored = alerts_table.batch(batch_id)
            feed_table.append((alerts if stored is None else stored).select(*FEED), batch_id)
        alerts_table.compact()
        feed_table.compact()

    return _start(lines, process, checkpoint, trigger, "append")


def start_landing(lines: DataFrame, path: str, checkpoint: str, trigger: dict,
                  created_at: Column | None = None) -> StreamingQuery:
    """Land raw lines with their normalised form, not yet processed."""
    stamp = created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz")

    def process(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if "event_id" in batch.columns else number_lines(batch, batch_id)
        landing = StreamTable(batch.sparkSession, path, LANDING)
        landing.append(raw_landing(numbered, stamp, F.col("event_id")), batch_id)
        landing.compact()

    return _start(lines, process, checkpoint, trigger, "append")


def start_severity_counts(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running alert count per severity, refreshed every 30 seconds."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("v"))
    return _start(counts, lambda batch, batch_id: write_batch(batch, batch_id, path),
                  checkpoint, trigger or REFRESH, "complete")


def _start(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str,
           trigger: dict, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return StreamTable(spark, path).read()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the newest refresh."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch_id")).scalar()
    return rows.where(F.col("batch_id") == newest).drop("batch_id")
