"""Conversation turns and event state: batch queries, and the same logic as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


@query("""SELECT user_id, request, min(event_id) AS event_id, count(*) AS received FROM (SELECT event_id, user_id, event_type || ':' || json_extract_string(props, '$.k') AS request FROM events) GROUP BY 1, 2""")
def turn_dedup(spark, d):
    """One turn for each (conversation, request id), however often it is sent."""
    e = table(spark, d, "events").select("event_id", "user_id", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("request"))
    return e.groupBy("user_id", "request").agg(F.min("event_id").alias("event_id"), F.count("*").alias("received"))


@query("SELECT user_id, event_type AS status, event_id AS last_sequence, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state_per_key(spark, d):
    return latest_state(table(spark, d, "events"))


def latest_state(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("event_type", "event_id", "value"), "event_id")
    return events.groupBy("user_id").agg(last.alias("s")).select("user_id", F.col("s.event_type").alias("status"), F.col("s.event_id").alias("last_sequence"), F.col("s.value").alias("value"))


@query("""WITH l AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 300 SECOND THEN 'interrupted' WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'completed' END AS status FROM l""")
def stale_pending(spark, d):
    """Pending turns untouched for 300 seconds before a given time count as interrupted."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts", "event_id"), "event_id").alias("s")).select("user_id", "s.*")
    now = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")
    return last.select("user_id", "event_id", settle_status(F.col("event_type").isin("view", "click"), F.col("ts").cast("timestamp_ntz"), now).alias("status"))


def settle_status(pending: Column, updated: Column, now: Column, seconds: int = 300) -> Column:
    return F.when(pending & (updated < now - F.expr(f"INTERVAL {seconds} SECOND")), "interrupted").when(pending, "pending").otherwise("completed")


@query("""SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_min(substring(text, 1, 40), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY 1""")
def conversation_list(spark, d):
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 40)), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), title.alias("title"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role, length(text) AS chars FROM conversations")
def conversation_messages(spark, d):
    ordinal = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", ordinal.alias("ordinal"), "role", F.length("text").cast("long").alias("chars"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Tumbling windows of a day; an extra of this engine."""
    return daily(table(spark, d, "events"))


def daily(events: DataFrame) -> DataFrame:
    """Works on batches and on streams with a watermark on ts."""
    g = events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", "total")


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start FROM events, (SELECT unnest(range(2)) AS k)) SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def sliding_events(spark, d):
    """Windows of a day that begin every twelve hours; an extra of this engine."""
    return sliding(table(spark, d, "events"))


def sliding(events: DataFrame) -> DataFrame:
    """Works on batches and on streams with a watermark on ts."""
    g = events.groupBy("event_type", F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    """Sessions that end with six hours of silence; an extra of this engine."""
    return sessions(table(spark, d, "events"))


def sessions(events: DataFrame) -> DataFrame:
    """Works on batches and on streams with a watermark on ts."""
    g = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def event_stream(spark, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Repeated requests within the watermark go."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what there is, write Parquet with exactly-once commits, and return what was written."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target)


def upsert_latest(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Last write wins by key: each micro-batch merges into a new version of the state table.

    A version is named by its batch, so a batch that runs again after a failure replaces its own version only.
    """

    spark = stream.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(before: float = float("inf")) -> str | None:
        """The last version that was written whole, of those before a batch."""
        found = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
        done = [int(x.getName().partition("=")[2]) for x in found if x.getName().startswith("version=") and files.exists(x.suffix("/_SUCCESS"))]
        return f"{target}/version={max(n for n in done if n < before)}" if any(n < before for n in done) else None

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id", "value"), "event_id").alias("s"))
        if last := newest(batch_id):
            old = batch.sparkSession.read.parquet(last)
            new = old.unionByName(new).groupBy("user_id").agg(F.max_by("s", "s.event_id").alias("s"))
        new.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(newest()).select("user_id", F.col("s.event_type").alias("status"), F.col("s.event_id").alias("last_sequence"), F.col("s.value").alias("value"))
