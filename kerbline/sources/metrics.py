"""The metrics log and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import schema


def rounded_text(value: Column, digits: int = 4) -> Column:
    """Numbers rounded, anything else as it is."""
    text = value.cast("string")
    number = text.try_cast("double")
    return F.coalesce(F.bround(number, digits).cast("string"), text)


def append_metrics(metrics: DataFrame, path: str, run_ts: str | None = None) -> None:
    """Append (section, metric, value) rows to the log as JSON lines, stamped with the run."""
    stamp = F.lit(run_ts) if run_ts else F.date_format(F.now(), "yyyy-MM-dd'T'HH:mm:ss")
    (metrics.select(stamp.alias("ts"), "section", "metric",
                    rounded_text(F.col("value")).alias("value"))
     .write.mode("append").json(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.METRICS).json(path)


def write_snapshot(metrics: DataFrame, path: str) -> None:
    """Replace the latest results: one JSON line per section, `{section, metrics}`."""
    (metrics.groupBy("section")
     .agg(F.map_from_entries(F.collect_list(
         F.struct("metric", rounded_text(F.col("value")).alias("value")))).alias("metrics"))
     .write.mode("overwrite").json(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    nested = spark.read.schema("section string, metrics map<string,string>").json(path)
    return nested.select("section", F.explode("metrics").alias("metric", "value"))


def flatten_metrics(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents of section -> metric -> value as rows; the `_meta` section is left out."""
    nested = F.from_json(F.col(column), "map<string,map<string,string>>")
    return (documents.select(F.explode(nested).alias("section", "entries"))
            .where(F.col("section") != "_meta")
            .select("section", F.explode("entries").alias("metric", "value")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A nested results document from a file, flattened."""
    return flatten_metrics(spark.read.option("wholetext", True).text(path))
