import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import neighbours, weights

EVENT = "id string, latitude double, longitude double, start timestamp_ntz, event_cause string, is_gathering int, road_closure int"


def km(a, b):
    la, lo, lb, mo = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def events(n, seed, places=None, hot=0):
    rng, rows = random.Random(seed), []
    spots = [(12.9 + rng.random() * 0.1, 77.5 + rng.random() * 0.1) for _ in range(places or n)]
    for i in range(n):
        spot = spots[0] if i < hot else rng.choice(spots) if places else spots[i]
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(0, 20000))
        rows.append((f"e{i}", *spot, start, rng.choice(["accident", "others"]), rng.randrange(2), rng.randrange(2)))
    return rows


def brute(rows, history):
    out = {}
    for r in rows:
        prior = [(km(r[1:3], s[1:3]), s) for s in history if s[3] < r[3]]
        near = [(d, s) for d, s in prior if d <= 4]
        last = max((s[3] for d, s in near if d <= 1), default=None)
        hours = 72.0 if last is None else min((r[3] - last).total_seconds() / 3600, 72.0)
        kernel = lambda bw, keep: sum(math.exp(-d * d / (2 * bw * bw)) for d, s in near if keep(s))
        out[r[0]] = (sum(d <= 1 for d, _ in near), sum(d <= 3 for d, _ in near), kernel(1, lambda s: True),
                     kernel(1.5, lambda s: s[5]), kernel(1, lambda s: s[4] == "accident"),
                     kernel(1.5, lambda s: s[6]), hours)
    return out


def check(df, expected):
    got = {r.id: tuple(r[c] for c in neighbours.FEATURES) for r in df.collect()}
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-9), key


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_against_pairs(spark, blocks):
    rows = events(160, 1)
    check(neighbours.causal_neighbourhood(spark.createDataFrame(rows, EVENT), blocks=blocks), brute(rows, rows))


@pytest.mark.parametrize("blocks", [None, 5])
def test_hot_place_and_split_cells(spark, monkeypatch, blocks):
    """A third of the rows at one place; cells above four rows are split on both sides."""
    monkeypatch.setattr(neighbours, "_ROWS_PER_PART", 4)
    rows = events(240, 2, places=30, hot=80)
    check(neighbours.causal_neighbourhood(spark.createDataFrame(rows, EVENT), blocks=blocks), brute(rows, rows))


def test_history_ties_and_missing_places(spark):
    history, rows = events(80, 3), events(20, 4)
    at = datetime.datetime(2024, 1, 5)
    rows += [("same1", 12.95, 77.55, at, "others", 0, 0), ("same2", 12.95, 77.55, at, "others", 0, 0)]
    df = spark.createDataFrame(rows, EVENT)
    check(neighbours.causal_neighbourhood(df, spark.createDataFrame(history, EVENT)), brute(rows, history))
    lost = spark.createDataFrame([("x", None, None, at, "others", 0, 0)], EVENT)
    row = neighbours.causal_neighbourhood(lost, df).first()
    assert [row[c] for c in neighbours.FEATURES] == [0, 0, 0, 0, 0, 0, 72]


def test_future_does_not_matter(spark):
    rows = events(120, 5)
    early = sorted(rows, key=lambda r: r[3])[:60]
    check(neighbours.causal_neighbourhood(spark.createDataFrame(early, EVENT)),
          {k: v for k, v in brute(rows, rows).items() if k in {r[0] for r in early}})


def test_cover_finds_everything_within(spark):
    rng = random.Random(6)
    centres = [(rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for _ in range(40)] + [
        (0.0, 179.999), (89.99, 10.0), (-89.99, -170.0), (60.0, -180.0)]
    pairs = []
    for i, (lat, lon) in enumerate(centres):
        for _ in range(30):
            p = (max(-90.0, min(90.0, lat + rng.uniform(-0.04, 0.04))),
                 (lon + rng.uniform(-0.05, 0.05) / max(0.002, math.cos(math.radians(lat))) + 180) % 360 - 180)
            pairs.append((i, lat, lon, *p))
    near = {(i, *p) for i, lat, lon, *p in pairs if km((lat, lon), p) <= 4.0}
    step = F.lit(0.018)
    query = geo.with_cover(spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "i int, lat double, lon double"),
                           "lat", "lon", F.lit(4.0), step)
    points = spark.createDataFrame([(i, *p) for i, _, _, *p in pairs], "j int, plat double, plon double").withColumn(
        "cell", geo.grid_cell(F.col("plat"), F.col("plon"), step))
    found = {(r.i, r.plat, r.plon) for r in query.join(points, "cell").where("i = j").collect()}
    assert near <= found and len(near) > 300


@pytest.mark.parametrize("spread", [0.2, 170.0])
def test_nearest_others(spark, spread):
    rng = random.Random(7)
    points = [(f"c{i:03d}", rng.uniform(-spread / 2.2, spread / 2.2), rng.uniform(-spread, spread)) for i in range(60)]
    expected = {(a[0], b[0]) for a in points for b in
                sorted((b for b in points if b is not a), key=lambda b: (km(a[1:], b[1:]), b[0]))[:5]}
    df = spark.createDataFrame(points, "corridor string, latitude double, longitude double")
    assert {(r.src, r.dst) for r in weights.nearest_others(df).collect()} == expected


def test_few_corridors_and_constant_values(spark):
    df = spark.createDataFrame([("a", 12.9, 77.5), ("b", 12.9, 77.5), ("c", 13.0, 77.6)],
                               "corridor string, latitude double, longitude double")
    edges = weights.spatial_weights(df)
    sums = edges.groupBy("src").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1) and r.n == 2 for r in sums) and edges.where("src = dst").count() == 0
    flat = df.select("corridor", F.lit(2.0).alias("value"))
    assert weights.morans_i(flat, edges).first()[0] is None


def test_lookups_do_not_shuffle_the_events(spark):
    from kerbline.operators import features

    events = spark.range(1000).selectExpr("id", "concat('c', id % 3) AS corridor", "CAST(id % 2 AS INT) AS road_closure")
    plan = features.target_encoding(events, features.closure_rates(events))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(corridor" not in plan


def test_an_event_is_sent_to_few_cells(spark):
    """What the neighbourhood join shuffles follows the cells that an event looks into."""
    spots = spark.createDataFrame([(lat / 7, 77.5 + lat / 11) for lat in range(-400, 400, 9)], "latitude double, longitude double")
    cells = neighbours._covered(spots).groupBy("latitude", "longitude").count()
    assert cells.where("count > 16").count() == 0 and cells.agg({"count": "avg"}).first()[0] < 12


def test_chords_lose_no_pair_and_a_querys_pairs_follow_each_other(spark):
    """Pairs about the cutoff apart, over poles and the antimeridian: those whose arc is within it, each query's in turn."""
    rng = random.Random(3)
    points = []
    for i in range(400):
        lat, lon = rng.choice([0.0, 13.0, 60.0, 89.99, -89.99]), rng.choice([77.6, 179.99, -179.99, 0.0])
        far = neighbours.KERNEL_CUTOFF_KM / geo.KM_PER_DEGREE * rng.choice([0.5, 1 - 1e-7, 1.0, 1 + 1e-7, 2.0])
        points.append((lat, lon, lat + far * rng.choice([-1, 0, 1]), lon + far * rng.choice([-1, 0, 1]), 1, i))
    table = spark.createDataFrame(points, "latitude double, longitude double, s_lat double, s_lon double, cell int, n int")
    query, source = table.select("latitude", "longitude", "cell"), table.select("s_lat", "s_lon", "cell", "n")
    met = neighbours._meet(source, query, ["cell"], 10)
    near = neighbours._nearby(met)
    plain = query.join(source, "cell").where(geo.half_chord_squared(
        F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon")) <= geo.reach(neighbours.KERNEL_CUTOFF_KM))
    assert near.count() == plain.count() > 400
    assert "q_x" in near.columns
    rows = [(r.latitude, r.longitude) for r in met.limit(800).collect()]
    assert len({*rows}) < 10
