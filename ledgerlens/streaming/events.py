"""Structured Streaming over the JSON-lines event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, event string, query_id string, stage string, model string, input_tokens long, output_tokens long, visitor string"
#: Stages as a reader sees them.
STAGES = {"route": "Routing the question", "assess": "Judging what was found", "generate": "Writing claims", "verify": "Checking claims against their evidence"}


def tail(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """New files of the log as they come; malformed lines go."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each kind by UTC day; days close once the watermark has passed, so state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event", "n")


def stages_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each stage of a query."""
    return events.where("query_id is not null and stage is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id", "stage"])


def progress(events: DataFrame, prefix: str, late: str = "1 hour") -> DataFrame:
    """``ts, query_id, stage, label``: what a reader is told of the queries whose id begins with ``prefix``, each stage once; stages without a label are not told."""
    names = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    own = events.where(F.col("query_id").startswith(prefix) & (F.col("event") == "llm_call"))
    return stages_once(own.select("ts", "query_id", "stage", F.element_at(names, F.col("stage")).alias("label")).where("label is not null"), late)


def sessions(events: DataFrame, key: str = "visitor", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, start, last, n``: runs of events less than ``gap`` apart. One is told once the watermark has passed its end; events later than ``late`` are left out."""
    runs = events.where(F.col(key).isNotNull()).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return runs.agg(F.max("ts").alias("last"), F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "last", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs until all that is there is processed; a restart goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """As ``to_table``, a folder for each batch: a batch that is run again, after a loss or a restart in its midst, writes its folder anew instead of twice.

    Read it with ``spark.read.parquet``; the column ``batch`` is the batch's number.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
