"""The published tables a dashboard reads, next to the models they came from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.constants import NO_CORRIDOR
from kerbline.models.forecast import HotspotModel
from kerbline.models.impact import ImpactModel
from kerbline.operators import panel, profile, weights

TABLES = ["corridor_forecast", "how_profile", "events_sample", "options", "centroids", "meta"]
OPTION_COLUMNS = ["event_cause", "event_type", "corridor", "veh_type"]


def publish(clean_events: DataFrame, impact: ImpactModel, hotspot: HotspotModel, path: str) -> None:
    """Write every table and both models below `path`; the meta table comes last."""
    forecast_path = f"{path}/forecast"
    hotspot.forecast_panel(clean_events).write.mode("overwrite").parquet(forecast_path)
    forecast = clean_events.sparkSession.read.parquet(forecast_path)
    centroids = weights.corridor_centroids(clean_events)
    tables = {
        "corridor_forecast": panel.corridor_forecast(forecast, centroids, NO_CORRIDOR),
        "how_profile": panel.how_profile(forecast, "pred_events"),
        "events_sample": profile.events_sample(clean_events),
        "options": profile.option_lists(clean_events, OPTION_COLUMNS),
        "centroids": centroids,
        "meta": profile.dataset_meta(clean_events).withColumn("built_at", F.now().cast("string")),
    }
    impact.save(f"{path}/impact")
    hotspot.save(f"{path}/hotspot")
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether the last table has been written completely."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def load(spark: SparkSession, path: str, build: Callable[[str], None] | None = None) -> dict[str, DataFrame]:
    """The published tables by name; built first where they are missing."""
    if build is not None and not is_published(spark, path):
        build(path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
