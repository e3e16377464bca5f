import pytest
from pyspark.sql import functions as F

from kerbline import constants as K
from kerbline.functions import clock, text
from kerbline.operators import cleaning, rules, severity
from kerbline.sources import incidents


@pytest.mark.parametrize("time,part,peak", [
    ("06:00", "night", 0), ("06:01", "morning", 0), ("08:00", "morning", 1), ("11:00", "morning", 1),
    ("11:01", "afternoon", 0), ("16:00", "afternoon", 0), ("17:00", "evening", 1), ("20:00", "evening", 1),
    ("20:01", "evening", 0), ("21:00", "evening", 0), ("21:01", "latenight", 0)])
def test_day_parts(spark, time, part, peak):
    ts = F.lit(f"2024-01-01 {time}:59").cast("timestamp_ntz")
    hour = clock.fractional_hour(ts)
    row = spark.range(1).select(clock.daypart(hour), clock.is_peak(hour)).first()
    assert tuple(row) == (part, peak)


def test_local_time(spark):
    utc = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    local = clock.utc_to_local(utc)
    row = spark.range(1).select(local.cast("string"), clock.utc_text(clock.local_to_utc(local))).first()
    assert tuple(row) == ("2024-01-01 05:30:00", "2024-01-01 00:00:00+00")


@pytest.mark.parametrize("minutes,kept", [(0.0, None), (0.5, 0.5), (1440.0, 1440.0), (1440.5, None), (-5.0, None)])
def test_clearance_gate(spark, minutes, kept):
    assert spark.range(1).select(cleaning.plausible(F.lit(minutes))).first()[0] == kept


def test_pins_and_text(spark):
    rows = spark.createDataFrame([("Pin-560001",), ("Pin 560001",), ("Pin560001",), ("Pin-5600",), (None,)], "a string")
    found = [r[0] for r in rows.select(F.coalesce(text.pin_code(F.col("a")), F.lit("none"))).collect()]
    assert found == ["560001"] * 3 + ["none"] * 2
    words = spark.createDataFrame([("ವಾಹನ",), ("abc",), (None,), ("x" * 300,)], "a string")
    got = words.select(text.has_text(F.col("a")), text.clipped_length(F.col("a")), text.has_non_ascii(F.col("a")))
    assert [tuple(r) for r in got.collect()] == [(1, 4, 1), (1, 3, 0), (0, 0, 0), (1, 200, 0)]


@pytest.mark.parametrize("cause,p,minutes,tier,barricades", [
    ("others", 0.80, 1.0, "Critical", 8), ("others", 0.60, 1.0, "High", 4), ("others", 0.0, 60.0, "Low", 0),
    ("others", 0.0, 240.0, "High", 0), ("others", 0.36, 1.0, "Moderate", 2), ("accident", 0.10, 240.0, "Critical", 8),
    ("others", 0.10, 240.0, "High", 0), ("others", 0.0, None, "Low", 0), ("others", 0.0, 0.0, "Low", 0)])
def test_tiers(spark, cause, p, minutes, tier, barricades):
    row = rules.recommend(spark.createDataFrame(
        [(cause, p, minutes)], "event_cause string, p_road_closure double, exp_duration_min double")).first()
    assert (row.severity_tier, row.rec_barricades) == (tier, barricades)
    assert row.rec_eta_minutes == (None if minutes is None else int(minutes))
    assert row.rec_officers == K.OFFICERS[tier] + 2 * (p > 0.4) + 2 * ((minutes or 0) > 180)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    with open(path, "w") as out:
        out.write("start_datetime,id,event_cause,latitude,longitude,requires_road_closure,description,priority,extra\n")
        out.write('2024-04-10 18:30:00+00,A,"Fog / Low Visibility ",12.9,77.6,true,"said ""hi"", left",NULL,1\n')
        out.write("not a date,B,accident,12.9,77.6,FALSE,,High,2\n")
        out.write("2024-04-10 20:00:00+05:30,C,,NULL,77.6,NULL,ok,High,3\n")
    rows = {r.id: r for r in cleaning.clean(incidents.read_csv(spark, path)).collect()}
    assert set(rows) == {"A", "C"}
    a, c = rows["A"], rows["C"]
    assert (a.event_cause, a.road_closure, a.priority, a.corridor) == ("fog", 1, "Low", "Non-corridor")
    assert a.description == 'said "hi", left' and str(a.start) == "2024-04-11 00:00:00"
    assert (c.event_cause, c.latitude, c.high_priority, c.road_closure) == ("unknown", None, 1, 0)
    assert str(c.start_datetime) == "2024-04-10 14:30:00"


def test_incoming_rows(spark):
    rows = [dict(id="NEW1", event_type="planned", event_cause="public_event", corridor="Hosur Road", latitude=12.915,
                 longitude=77.622, authenticated="yes", start_datetime="2024-04-10 18:30:00+00", zone="unknown"),
            dict(id="NEW2", event_type="unplanned", event_cause="accident", corridor="ORR East 1",
                 veh_type="heavy_vehicle", latitude=12.935, longitude=77.690, start_datetime="2024-04-10 09:15:00+00")]
    clean = {r.id: r for r in cleaning.clean(incidents.incoming(spark, rows)).collect()}
    assert clean["NEW1"].is_gathering == 1 and clean["NEW1"].veh_type == "unknown"
    assert clean["NEW2"].zone == "unknown" and clean["NEW2"].duration_min is None


def test_csv_files_of_several_orders_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,description,start_datetime\nA1,"two\nlines, ""quoted""",2024-01-01 00:00:00+00\n')
    (tmp_path / "b.csv").write_text("start_datetime,id,description\n2024-01-02 00:00:00+00,B1,plain\n")
    rows = {r.id: r.description for r in incidents.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {"A1": 'two\nlines, "quoted"', "B1": "plain"}


def test_broken_csv_rows_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,description\nA1,x\nA2,x,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        incidents.read_csv(spark, str(tmp_path)).collect()


def test_more_blends_than_stated_raise(spark):
    parts = spark.createDataFrame([(1.0, 0.5, 1.0, 0.5, 0.5, 0.5)], ["real_closure", "real_duration", *severity.PARTS])
    with pytest.raises(ValueError, match="blends"):
        severity.rank_objective(parts, [(1.0, 0.0, 0.0, 0.0)] * (severity.MOST_BLENDS + 1))
