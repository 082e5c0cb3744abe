"""Job events as streams: appending, replay, states, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "job_id string, seq bigint, type string, payload string, timestamp_ms bigint"
TERMINAL = ("JobCompleted", "JobFailed")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of rows."""
    return spark.readStream.schema(EVENTS).json(path)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.timestamp_millis("timestamp_ms"))


def is_terminal():
    return F.col("type").isin(*TERMINAL)


def job_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events, last sequence number and end of each job, kept up to date.

    Aggregates are counts, maxima and minima, so events that come twice by
    replay change nothing once they are told apart by job and number.
    """
    distinct = with_time(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["job_id", "seq"]) if events.isStreaming else with_time(events).dropDuplicates(["job_id", "seq"])
    return distinct.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("seq").alias("last_seq"),
        F.min(F.when(is_terminal(), F.col("seq"))).alias("ended_at"),
        F.max(F.when(is_terminal(), F.col("type"))).alias("outcome"),
    )


def activity_windows(events: DataFrame, length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Events by kind in tumbling windows."""
    return with_time(events).withWatermark("at", late).groupBy(F.window("at", length), "type").agg(F.count(F.lit(1)).alias("n"))


def replay(events: DataFrame, job_id: str, after: int = -1) -> DataFrame:
    """Events of one job from a place on, up to and with its first terminal one."""
    own = events.where(F.col("job_id") == job_id).dropDuplicates(["job_id", "seq"])
    end = own.where(is_terminal()).agg(F.min("seq").alias("end"))
    return own.join(F.broadcast(end)).where((F.col("seq") > after) & (F.col("end").isNull() | (F.col("seq") <= F.col("end")))).drop("end").orderBy("seq")


def timeline(events: DataFrame) -> DataFrame:
    """(job_id, kind, n): how often each kind occurs."""
    return events.groupBy("job_id", F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def append_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events to a log, once each."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def cancelled(job_id: str, seq: int, spark: SparkSession, timestamp_ms: int) -> DataFrame:
    """The terminal row of a job that was stopped."""
    return spark.createDataFrame([(job_id, seq, "JobFailed", '{"reason": "cancelled"}', timestamp_ms)], EVENTS)


# --- comments --------------------------------------------------------------------


def saved(comments: DataFrame, new: DataFrame) -> DataFrame:
    """Comments with new ones; those of another analysis are left behind."""
    keep = new.select("analysis_hash").distinct()
    return comments.join(F.broadcast(keep), "analysis_hash", "left_semi").unionByName(new)


def updated(comments: DataFrame, changes: DataFrame) -> DataFrame:
    """New texts by id."""
    met = comments.join(changes.select("id", F.col("text").alias("new_text")), "id", "left")
    return met.withColumn("text", F.coalesce("new_text", "text")).drop("new_text").select(*comments.columns)


def deleted(comments: DataFrame, ids: DataFrame) -> DataFrame:
    return comments.join(ids.select("id"), "id", "left_anti")


def exported(comments: DataFrame) -> DataFrame:
    """(group_id, text): comments as text by scope; scopes other than code, file and group are dropped."""
    line = (
        F.when(F.col("type") == "code", F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\n"), F.coalesce("selected_code", F.lit("")), F.lit("\n> "), F.col("text")))
        .when(F.col("type") == "file", F.concat(F.col("file_path"), F.lit("\n> "), F.col("text")))
        .when(F.col("type") == "group", F.concat(F.lit("> "), F.col("text")))
    )
    told = comments.withColumn("line", line).where("line IS NOT NULL")
    return told.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "line"))), lambda c: c["line"]), "\n\n").alias("text"))
