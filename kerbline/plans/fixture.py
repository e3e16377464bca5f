"""The incident view over the `events` table, and deterministic predictions on top of it.

Both texts run unchanged on Spark and on DuckDB, so that queries and their SQL checks start
from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.operators import cleaning, panel, weights
from kerbline.session import join_grown, pin_utc, settle

RAW_SQL = """
SELECT
  'E' || CAST(event_id AS STRING) AS id,
  CASE WHEN event_id % 19 = 0 THEN ' Planned' ELSE 'unplanned' END AS event_type,
  CASE WHEN (event_id * 31) % 100 < 55 THEN 'Vehicle_Breakdown'
       WHEN (event_id * 31) % 100 < 65 THEN 'accident '
       WHEN (event_id * 31) % 100 < 73 THEN 'construction'
       WHEN (event_id * 31) % 100 < 79 THEN 'water_logging'
       WHEN (event_id * 31) % 100 < 84 THEN 'tree_fall'
       WHEN (event_id * 31) % 100 < 88 THEN 'public_event'
       WHEN (event_id * 31) % 100 < 90 THEN 'vip_movement'
       WHEN (event_id * 31) % 100 < 92 THEN 'procession'
       WHEN (event_id * 31) % 100 < 93 THEN 'protest'
       WHEN (event_id * 31) % 100 < 95 THEN 'pot_holes'
       WHEN (event_id * 31) % 100 < 96 THEN 'Debris'
       WHEN (event_id * 31) % 100 < 97 THEN 'Fog / Low Visibility'
       WHEN (event_id * 31) % 100 < 98 THEN 'test_demo'
       ELSE 'others' END AS event_cause,
  CASE WHEN user_id % 22 = 0 THEN 'NULL' ELSE ' Corridor ' || CAST(user_id % 22 AS STRING) END AS corridor,
  CASE WHEN event_id % 5 = 0 THEN 'NULL' WHEN event_id % 5 < 3 THEN 'LCV' ELSE 'heavy_vehicle ' END AS veh_type,
  CASE WHEN event_id % 2 = 0 THEN 'NULL' ELSE 'Zone ' || CAST(user_id % 10 AS STRING) END AS zone,
  CASE WHEN user_id % 22 = 0 THEN 'NULL' ELSE 'High' END AS priority,
  CASE WHEN (event_id * 13) % 100 < (CASE WHEN (event_id * 31) % 100 < 55 THEN 2 WHEN (event_id * 31) % 100 < 65 THEN 6 ELSE 20 END)
       THEN 'TRUE' ELSE 'FALSE' END AS requires_road_closure,
  CAST(1297160 + ((((user_id % 22) * 5) % 22) * 2 - 21) * 2500 + ((event_id * 7919) % 2001 - 1000) * 15 AS DOUBLE) / 100000 AS latitude,
  CAST(7759460 + ((((user_id % 22) * 7) % 22) * 2 - 21) * 2500 + ((event_id * 6007) % 2001 - 1000) * 15 AS DOUBLE) / 100000 AS longitude,
  CASE WHEN event_id % 997 = 0 THEN 'not-a-date' ELSE substr(CAST(ts AS STRING), 1, 19) || '+00' END AS start_datetime,
  CASE WHEN event_id % 6 = 0 THEN substr(CAST(ts + INTERVAL '1' SECOND * CAST(floor(value * 60) AS BIGINT) AS STRING), 1, 19) || '+00' ELSE 'NULL' END AS end_datetime,
  CASE WHEN event_id % 6 = 1 THEN substr(CAST(ts + INTERVAL '1' SECOND * CAST(floor(value * 90) AS BIGINT) AS STRING), 1, 19) || '+00' ELSE 'NULL' END AS resolved_datetime,
  CASE WHEN event_id % 30 = 2 THEN substr(CAST(ts - INTERVAL '1' HOUR AS STRING), 1, 19) || '+00' ELSE 'NULL' END AS closed_datetime,
  CASE WHEN event_id % 19 = 0 THEN substr(CAST(ts - INTERVAL '1' DAY AS STRING), 1, 19) || '+00' ELSE substr(CAST(ts AS STRING), 1, 19) || '+00' END AS created_date,
  'NULL' AS modified_datetime,
  CASE WHEN event_id % 6 < 2 THEN 'closed' WHEN event_id % 6 = 3 THEN 'active' ELSE 'resolved' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'NULL' WHEN event_id % 4 = 1 THEN 'no' ELSE 'yes' END AS authenticated,
  CASE WHEN event_id % 3 = 0 THEN 'NULL' ELSE 'Junction ' || CAST((event_id * 17) % 294 AS STRING) END AS junction,
  CASE WHEN event_id % 7 = 0 THEN 'NULL' ELSE 'PS ' || CAST(user_id % 50 AS STRING) END AS police_station,
  CASE WHEN event_id % 4 = 3 THEN 'NULL' ELSE 'Main Road, Pin-' || CAST(560001 + user_id % 100 AS STRING) || ', City' END AS address,
  CASE WHEN event_id % 3 = 0 THEN 'NULL' WHEN event_id % 7 = 0 THEN 'ವಾಹನ ' || props ELSE event_type || ' reported ' || props END AS description
FROM events
"""

SCORED_SQL = """
SELECT id,
  CASE WHEN lower(trim(event_cause)) = 'fog / low visibility' THEN 'fog'
       WHEN lower(trim(event_cause)) = 'test_demo' THEN 'others'
       ELSE lower(trim(event_cause)) END AS event_cause,
  CASE WHEN upper(requires_road_closure) = 'TRUE' THEN 1 ELSE 0 END AS road_closure,
  CAST(((CAST(substr(id, 2) AS BIGINT) * 37) % 1000) * 6 + (CASE WHEN requires_road_closure = 'TRUE' THEN 3000 ELSE 0 END) AS DOUBLE) / 10000 AS p_road_closure,
  CAST(((CAST(substr(id, 2) AS BIGINT) * 53) % 1000) AS DOUBLE) / 1000 AS p_high_priority,
  CASE WHEN CAST(substr(id, 2) AS BIGINT) % 50 = 0 THEN NULL
       ELSE CAST(1 + (CAST(substr(id, 2) AS BIGINT) * 71) % 400 AS DOUBLE) END AS exp_duration_min
FROM raw_incidents
"""


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_ROWS_TO_DEAL = 100_000


class Tables:
    """The tables a query starts from, each built when first asked for.

    `clean` is the cleaning pipeline over the source. Queries that pass over it several times
    start from `clean_table`, the same rows written once per session, so that no pass parses
    the log again and scans read only the columns they need; likewise `outcome`.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = settle(build(), name)
        return _WRITTEN[key]

    def _incidents(self, events: DataFrame) -> DataFrame:
        return self.spark.sql(RAW_SQL.replace("FROM events", "FROM {events}"), events=events)

    def _spread_events(self) -> DataFrame:
        """The events, dealt to all cores where many are read by fewer tasks: parsing the log is the work. Few rows keep
        their layout, which a task parses sooner than they are dealt."""
        events = self.read("events")
        cores = self.spark.sparkContext.defaultParallelism
        few_tasks = events.rdd.getNumPartitions() < cores and events.count() > _ROWS_TO_DEAL
        return events.repartition(2 * cores) if few_tasks else events

    @cached_property
    def raw(self) -> DataFrame:
        return self._incidents(self.read("events"))

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.clean(self.raw)

    @cached_property
    def clean_table(self) -> DataFrame:
        return self.written("clean", lambda: cleaning.clean(self._incidents(self._spread_events())))

    @cached_property
    def scored(self) -> DataFrame:
        return self.spark.sql(SCORED_SQL.replace("FROM raw_incidents", "FROM {raw}"), raw=self.raw)

    @cached_property
    def scored_table(self) -> DataFrame:
        return self.written("scored", lambda: self.scored)

    @cached_property
    def outcome(self) -> DataFrame:
        """Predictions next to what was recorded (events with a start only)."""
        def build() -> DataFrame:
            recorded = self.clean_table.select("id", "start", "start_datetime", "duration_min", "status", "corridor")
            return join_grown(self.scored_table, recorded, "id")
        return self.written("outcome", build)

    @cached_property
    def counts(self) -> DataFrame:
        return panel.panel_counts(self.clean_table)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.panel_dense(self.counts)

    @cached_property
    def edges(self) -> DataFrame:
        return weights.spatial_weights(self.clean_table)

    @cached_property
    def panel_features(self) -> DataFrame:
        return panel.panel_features(self.clean_table, self.edges)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits (no negative zero), times as text: comparable across engines."""
    def one(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c.cast("double"), 6))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select([one(f) for f in df.schema])
