"""Corridor geometry: centroids, nearest-neighbour weights and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.constants import MIN_CENTROID_KM, NEIGHBOURS
from kerbline.functions import geo
from kerbline.session import settle

_FINEST_KM = 0.1
_LEVELS = 15              # cell sizes 0.1 km, 0.2 km, ... 1638.4 km
_WORLD = _LEVELS + 2      # everything in one cell


def corridor_centroids(clean_events: DataFrame) -> DataFrame:
    return clean_events.groupBy("corridor").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def _km(level):
    return F.lit(_FINEST_KM) * F.pow(F.lit(2.0), level)


def _degrees(level):
    return _km(level) / geo.KM_PER_DEGREE


def nearest_others(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, d): the k nearest other points of each, ties by name, without a cross join.

    Each point looks in a grid whose cells fit its surroundings: the finest level at which the
    cells around it hold more than k points bounds its k nearest within four cell sizes, and
    that circle is searched. Points with too few others within about 1,600 km (the Earth has
    room for few of them) search everything.
    """
    named = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("corridor").alias("name"), "latitude", "longitude")
    ladder = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS + 1))).alias("level"))
    placed = ladder.select("name", "level", geo.grid_cell(
        F.col("latitude"), F.col("longitude"), _degrees(F.col("level"))).alias("cell"))
    held = placed.groupBy("level", "cell").agg(F.count("*").alias("n"))
    around = geo.with_cover(ladder.where(F.col("level") < _LEVELS), "latitude", "longitude",
                            _km(F.col("level")), _degrees(F.col("level")))
    level = (around.join(held, ["level", "cell"])
             .groupBy("name", "level").agg(F.sum("n").alias("n"))
             .where(F.col("n") > k)
             .groupBy("name").agg((F.min("level") + 2).alias("level")))
    asking = (named.join(level, "name", "left").fillna(_WORLD, ["level"])
              .withColumn("radius", F.when(F.col("level") < _WORLD, _km(F.col("level")))))
    local = geo.with_cover(asking.where(F.col("radius").isNotNull()), "latitude", "longitude",
                           F.col("radius"), _degrees(F.col("level")))
    columns = ["name", "latitude", "longitude", "level", "cell"]
    asked = local.select(columns).unionByName(
        asking.where(F.col("radius").isNull()).withColumn("cell", F.lit(0).cast("bigint"))
        .select(columns))
    offered = (ladder.where(F.col("level") >= 2).withColumn("cell", geo.grid_cell(
                   F.col("latitude"), F.col("longitude"), _degrees(F.col("level"))))
               .unionByName(named.withColumns({"level": F.lit(_WORLD), "cell": F.lit(0).cast("bigint")}))
               .select("level", "cell", F.col("name").alias("dst"),
                       F.col("latitude").alias("o_lat"), F.col("longitude").alias("o_lon")))
    met = (asked.join(offered, ["level", "cell"]).where(F.col("name") != F.col("dst"))
           .select(F.col("name").alias("src"), "dst", geo.haversine_km(
               F.col("latitude"), F.col("longitude"), F.col("o_lat"), F.col("o_lon")).alias("d")))
    order = W.partitionBy("src").orderBy("d", "dst")
    return (met.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= k).drop("place"))


def spatial_weights(clean_events: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Row-normalised inverse-distance weights as an edge list (src, dst, w)."""
    edges = nearest_others(corridor_centroids(clean_events), k).withColumn(
        "w", 1.0 / F.greatest(F.col("d"), F.lit(MIN_CENTROID_KM)))
    return edges.select("src", "dst",
                        (F.col("w") / F.sum("w").over(W.partitionBy("src"))).alias("w"))


def morans_i(values: DataFrame, edges: DataFrame, name: str = "corridor", value: str = "value") -> DataFrame:
    """Global Moran's I of a value per name over the edges: one row, null where undefined.

    Names of the edge list without a value count as 0; values outside the edge list are left out.
    """
    # Read several times, and a few rows per name: written once, so that nothing has to be held in memory.
    edges = settle(edges, "edges")
    names = edges.select(F.col("src").alias(name)).union(edges.select(F.col("dst"))).distinct()
    held = settle(names.join(values.select(name, F.col(value).cast("double").alias("x")), name, "left")
                  .fillna(0.0, ["x"]), "held")
    size = held.agg(F.count("*").alias("n"), F.avg("x").alias("mean"),
                    (F.var_pop("x") * F.count("*")).alias("own")).first()
    centred = held.select(name, (F.col("x") - F.lit(size["mean"])).alias("x"))
    own = size["own"]
    crossed = (edges.join(centred.select(F.col(name).alias("src"), F.col("x").alias("xs")), "src")
               .join(centred.select(F.col(name).alias("dst"), F.col("x").alias("xd")), "dst")
               .agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("xs") * F.col("xd")).alias("cross")))
    if not own:
        return crossed.select(F.lit(None).cast("double").alias("morans_i"))
    return crossed.select(F.when(
        F.col("total") != 0, F.lit(size["n"]) / F.col("total") * F.col("cross") / F.lit(own)).alias("morans_i"))
