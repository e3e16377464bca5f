"""Structured Streaming jobs: scoring of arriving reports, and hourly counts.

Cleaning is a projection, so it runs on a stream as it is. Earlier neighbours come from a
static history table, joined batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline import schema
from kerbline.models.impact import ImpactModel
from kerbline.operators import cleaning, panel, rules


def report_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw reports arriving as Parquet files."""
    reader = spark.readStream.schema(schema.RAW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_batch(raw: DataFrame, model: ImpactModel, history: DataFrame) -> DataFrame:
    """Clean, score against the history, recommend."""
    return rules.recommend(model.score(cleaning.clean(raw), history, keep=["event_cause", "corridor"]))


def score_stream(raw: DataFrame, model: ImpactModel, history: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Score every batch into its own folder of the sink; a repeated batch replaces its folder.

    Reports of earlier batches count as earlier neighbours: every batch leaves its cleaned events beside the sink, and
    later ones read those that the history does not have.
    """
    spark = raw.sparkSession
    known = history.select("id")

    def write(batch: DataFrame, number: int) -> None:
        own = f"{sink}-events/batch={number}"
        cleaning.clean(batch).write.mode("overwrite").parquet(own)
        events = spark.read.parquet(own)
        seen = history
        if number:
            before = spark.read.schema(events.schema.add("batch", "long")).parquet(f"{sink}-events").where(
                F.col("batch") < number)
            seen = history.unionByName(before.drop("batch").join(known, "id", "left_anti"), allowMissingColumns=True)
        scored = model.score(events, seen, keep=["event_cause", "corridor"])
        rules.recommend(scored).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def panel_stream(raw: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep counts per corridor and local hour: every batch writes the sums of its own reports.

    A repeated batch replaces its own sums, and a report counts however late it comes; `hourly_counts` adds them up.
    """
    def write(batch: DataFrame, number: int) -> None:
        panel.panel_counts(cleaning.clean(batch)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def hourly_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(corridor, bin, n_events, n_impact) over all batches so far."""
    sums = spark.read.parquet(sink)
    return sums.groupBy("corridor", "bin").agg(
        F.sum("n_events").alias("n_events"), F.sum("n_impact").alias("n_impact"))
