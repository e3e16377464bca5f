"""What happened nearby before: counts, kernel sums and recency around every event.

Only strictly earlier events count. The join is a grid equi-join, arranged so that its work does
not grow with the square of a hot place:

* events of one place and moment are added up on both sides, so copies cost one row;
* time is cut into blocks of about equal counts. Earlier blocks enter as one tally per place and
  block, meet place by place (distances and kernels once per pair of places) and are carried
  forward by a running sum per place; only events of the same block meet one by one. The number of
  blocks follows the busiest place, up to 1,024;
* crowded cells are split on both sides by a salt, one task per part; sums over parts add up;
* pairs are summed where they are found, never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.constants import (DENSITY_RADII_KM, KERNEL_CUTOFF_KM, NARROW_BANDWIDTH_KM,
                                RECENCY_CAP_HOURS, RECENCY_RADIUS_KM, WIDE_BANDWIDTH_KM)
from kerbline.functions import clock, geo
from kerbline.operators.ordered import bucketed, slice_limits
from kerbline.session import settle

SITE = ["latitude", "longitude"]
FEATURES = ["hist_density_1km", "hist_density_3km", "kde_intensity", "kde_gathering",
            "kde_accident", "kde_closure", "hrs_since_nearby"]
_SUMS = FEATURES[:6]
_TALLIES = ["n", "n_gathering", "n_accident", "n_closure"]

_STEP_DEGREES = KERNEL_CUTOFF_KM / geo.KM_PER_DEGREE  # a row is sent to about nine cells
_MOST_BLOCKS = 1024
_BLOCK_MOMENTS = 2         # moments of the busiest place that one block holds about
_MOST_COVER = 16           # cells one place may look into (away from the poles)
_ROWS_PER_PART = 20_000    # rows of one cell a part may hold on either side
_MOST_HOT_CELLS = 50_000   # bound of the broadcast list of crowded cells


def _moments(events: DataFrame) -> DataFrame:
    """One row per place and moment with the tallies the kernels need."""
    return (events.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                         & F.col("start").isNotNull())
            .groupBy(*SITE, clock.micros(F.col("start")).alias("t"))
            .agg(F.count("*").alias("n"),
                 F.sum(F.col("is_gathering").cast("bigint")).alias("n_gathering"),
                 F.count_if(F.col("event_cause") == "accident").alias("n_accident"),
                 F.sum(F.col("road_closure").cast("bigint")).alias("n_closure")))


def _shape(moments: DataFrame) -> tuple[int, int, list[float]]:
    """Row count, moments of the busiest place, and time quantiles."""
    per_place = moments.groupBy(*SITE).agg(F.count("*").alias("moments"))
    busiest = per_place.agg(F.sum("moments").alias("rows"), F.max("moments").alias("busiest")).first()
    # the cuts halve the busiest place's events too, if its events are spread like all others; they only balance work
    cuts = moments.agg(slice_limits("t", _MOST_BLOCKS).alias("cuts")).first()["cuts"]
    return busiest["rows"] or 0, busiest["busiest"] or 0, cuts or []


def _split(side: DataFrame, keys: list[str], rows: int, parts: str) -> DataFrame:
    """Cells with more rows than a part may hold, and the number of parts they need.

    A cell enters only above rows / _MOST_HOT_CELLS, so the list cannot exceed that bound.
    """
    floor = max(_ROWS_PER_PART, rows // _MOST_HOT_CELLS)
    return (side.groupBy(*keys).agg(F.count("*").alias("_rows"))
            .where(F.col("_rows") > floor)
            .select(*keys, F.ceil(F.col("_rows") / F.lit(floor)).cast("int").alias(parts)))


def _is_crowded(source: DataFrame, keys: list[str]) -> bool:
    """Whether a cell of either side may hold too many rows for one part (one small aggregate)."""
    fullest = source.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return fullest * _MOST_COVER > _ROWS_PER_PART


def _meet(source: DataFrame, query: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Join on the keys, with crowded keys split on both sides.

    Both sides are dealt to a fixed number of partitions: the pairs, not the bytes of the
    sides, are the work, so they must be neither broadcast nor coalesced by size.
    """
    spark = source.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
                2 * spark.sparkContext.defaultParallelism)
    if rows > _ROWS_PER_PART // _MOST_COVER and _is_crowded(source, keys):
        hot_source = F.broadcast(_split(source, keys, rows, "_s"))
        hot_query = F.broadcast(_split(query, keys, rows * _MOST_COVER, "_q"))

        def parted(side: DataFrame, own: str, other: str, mark: list[str]) -> DataFrame:
            sized = (side.join(hot_source, keys, "left").join(hot_query, keys, "left")
                     .fillna(1, ["_s", "_q"]))
            return (sized
                    .withColumn(f"{own}_part", F.pmod(F.xxhash64(*mark), F.col(own)).cast("int"))
                    .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                    .drop("_s", "_q"))

        source = parted(source, "_s", "_q", [c for c in ("s_lat", "s_lon", "s_t") if c in source.columns])
        query = parted(query, "_q", "_s", [*SITE, "t"] if "t" in query.columns else SITE)
        keys = [*keys, "_s_part", "_q_part"]
    # angles are made on either side of the shuffle's end, so that they need not be sent; the query side leads, so that a
    # query's pairs follow each other and its sums stay at hand
    return (query.repartition(tasks, *keys).select("*", *_angles("q", *SITE)).hint("merge")
            .join(source.repartition(tasks, *keys).select("*", *_angles("s", "s_lat", "s_lon")), keys))


def _nearby(pairs: DataFrame) -> DataFrame:
    """Keep pairs within the cutoff and add their distance and kernels (angles and cosines come ready)."""
    dlat = F.sin((F.col("q_rlat") - F.col("s_rlat")) / 2)
    dlon = F.sin((F.col("q_rlon") - F.col("s_rlon")) / 2)
    h = dlat * dlat + F.col("s_clat") * F.col("q_clat") * dlon * dlon
    # two thirds of the pairs are too far by their chord, a hair wide, which takes no sine; the others' arcs decide
    chord_squared = sum(((F.col(f"q_{c}") - F.col(f"s_{c}")) * (F.col(f"q_{c}") - F.col(f"s_{c}")) for c in "yz"),
                        (F.col("q_x") - F.col("s_x")) * (F.col("q_x") - F.col("s_x")))
    maybe = pairs.where(chord_squared <= 4 * geo.reach(KERNEL_CUTOFF_KM) * (1 + 1e-6))
    close = maybe.withColumn("h", h).where(F.col("h") <= geo.reach(KERNEL_CUTOFF_KM))
    inside = (F.col("d") <= KERNEL_CUTOFF_KM).cast("double")
    return close.withColumn("d", geo.arc_km(F.col("h"))).withColumns(
        {"narrow": inside * _kernel(NARROW_BANDWIDTH_KM), "wide": inside * _kernel(WIDE_BANDWIDTH_KM)})


def _kernel(bandwidth_km: float) -> Column:
    return F.exp(-(F.col("d") * F.col("d")) / F.lit(2 * bandwidth_km * bandwidth_km))


def _contributions() -> list[Column]:
    near, far = DENSITY_RADII_KM
    narrow, wide = F.col("narrow"), F.col("wide")
    return [
        F.sum(F.when(F.col("d") <= near, F.col("n")).otherwise(0)).alias("hist_density_1km"),
        F.sum(F.when(F.col("d") <= far, F.col("n")).otherwise(0)).alias("hist_density_3km"),
        F.sum(F.col("n") * narrow).alias("kde_intensity"),
        F.sum(F.col("n_gathering") * wide).alias("kde_gathering"),
        F.sum(F.col("n_accident") * narrow).alias("kde_accident"),
        F.sum(F.col("n_closure") * wide).alias("kde_closure"),
        F.max(F.when(F.col("d") <= RECENCY_RADIUS_KM, F.col("s_t"))).alias("last_t"),
    ]


def _angles(prefix: str, lat: str, lon: str) -> list[Column]:
    """What distances need of a point: its angles, and its place on the unit sphere for chords."""
    rlat, rlon = F.radians(lat), F.radians(lon)
    return [rlat.alias(f"{prefix}_rlat"), rlon.alias(f"{prefix}_rlon"), F.cos(rlat).alias(f"{prefix}_clat"),
            (F.cos(rlat) * F.cos(rlon)).alias(f"{prefix}_x"), (F.cos(rlat) * F.sin(rlon)).alias(f"{prefix}_y"),
            F.sin(rlat).alias(f"{prefix}_z")]


def _as_source(df: DataFrame, *keep: Column | str) -> DataFrame:
    return df.select(
        F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"), *keep,
        geo.grid_cell(F.col("latitude"), F.col("longitude"), F.lit(_STEP_DEGREES)).alias("cell"))


def _covered(df: DataFrame) -> DataFrame:
    return geo.with_cover(df, "latitude", "longitude", F.lit(KERNEL_CUTOFF_KM), F.lit(_STEP_DEGREES))


def _earlier_blocks(source: DataFrame, query: DataFrame, rows: int) -> DataFrame:
    """Per query place and block: totals over all earlier blocks."""
    by_block = (source.groupBy(*SITE, "block")
                .agg(F.max("t").alias("t"), *[F.sum(c).alias(c) for c in _TALLIES]))
    # a place has at most as many tallies as there are blocks
    by_place = by_block.groupBy(*SITE).agg(F.collect_list(F.struct(
        "block", F.col("t").alias("s_t"), *_TALLIES)).alias("tallies"))
    places = query.select(*SITE).distinct()
    met = _nearby(_meet(_as_source(by_place, "tallies"), _covered(places), ["cell"], rows))
    per_block = met.select(*SITE, "d", "narrow", "wide", F.inline("tallies")).groupBy(*SITE, "block").agg(*_contributions())
    asked = query.select(*SITE, "block").distinct().select(*SITE, "block", F.lit(True).alias("asked"))
    both = per_block.join(asked, [*SITE, "block"], "full")
    before = W.partitionBy(*SITE).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return (both.select(*SITE, "block", "asked",
                        *[F.sum(c).over(before).alias(f"past_{c}") for c in _SUMS],
                        F.max("last_t").over(before).alias("past_last_t"))
            .where("asked").drop("asked"))


def causal_neighbourhood(events: DataFrame, history: DataFrame | None = None,
                         blocks: int | None = None) -> DataFrame:
    """Add the density, kernel and recency columns to `events`.

    `history` is where earlier events are looked up; by default the events themselves.
    `blocks` fixes the number of time blocks (chosen from the data by default).
    """
    source = settle(_moments(events if history is None else history), "moments")
    query = source.select(*SITE, "t") if history is None else settle(
        _moments(events).select(*SITE, "t"), "asked-moments")
    rows, busiest, cuts = _shape(source)
    if blocks is None:
        blocks = min(_MOST_BLOCKS, max(1, busiest // _BLOCK_MOMENTS))

    if blocks > 1:
        every = max(1, len(cuts) // blocks)
        limits = cuts[every - 1::every]
        source, query = bucketed(source, "t", limits, "block"), bucketed(query, "t", limits, "block")
        same = ["cell", "block"]
    else:
        same = ["cell"]
    extra = same[1:]
    met = (_meet(_as_source(source, F.col("t").alias("s_t"), *_TALLIES, *extra), _covered(query), same, rows)
           .where(F.col("s_t") < F.col("t")))
    found = _nearby(met).groupBy(*SITE, "t").agg(*_contributions())
    if blocks > 1:
        past = _earlier_blocks(source, query, rows)
        found = (query.join(past, [*SITE, "block"], "left").join(found, [*SITE, "t"], "left")
                 .select(*SITE, "t",
                         *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"past_{c}", F.lit(0))).alias(c)
                           for c in _SUMS],
                         F.greatest("last_t", "past_last_t").alias("last_t")))
    hours = (F.col("t") - F.col("last_t")) / F.lit(3.6e9)
    found = found.select(*SITE, "t", *_SUMS, F.least(hours, F.lit(RECENCY_CAP_HOURS)).alias("hrs_since_nearby"))
    defaults = {c: 0 for c in _SUMS[:2]} | {c: 0.0 for c in _SUMS[2:]}
    nothing = defaults | {"hrs_since_nearby": RECENCY_CAP_HOURS}
    # rows that can have no neighbour would all meet in one task under a null key
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("start").isNotNull()
    located = (events.where(placed).withColumn("t", clock.micros(F.col("start")))
               .join(found, [*SITE, "t"], "left").drop("t").fillna(nothing))
    kinds = dict(found.dtypes)
    return located.unionByName(events.where(~placed).withColumns(
        {c: F.lit(v).cast(kinds[c]) for c, v in nothing.items()}))
