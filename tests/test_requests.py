"""Guards, orderings, labels and side tables on small rows with nulls, ties and nothing at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lathe.functions import scalars as s
from lathe.operators import clean, evaluate, quality, rates
from lathe.sources import files
from lathe.streaming import replay

INBOUND = ["turn", "dist", "el"]


@pytest.mark.parametrize(
    ("row", "broken"),
    [
        ((None, None, None, None, None), set()),
        ((1, 3, None, None, None), set()),
        ((2, 3, 40.0, 500.0, 90.0), set()),
        ((None, 3, None, None, None), {"no_position"}),
        ((1, None, None, None, None), {"no_total"}),
        ((4, 3, 40.0, 500.0, 90.0), {"total_below_position"}),
        ((1, 3, 40.0, None, 90.0), {"inbound_in_part"}),
        ((2, 3, None, None, None), {"inbound_needed"}),
        ((2, 3, 40.5, 500.0, 90.0), {"turn_whole"}),
        ((2, 3, 900.0, 500.0, 90.0), {"turn_range"}),
    ],
)
def test_block_is_whole_or_absent(spark, row, broken):
    df = spark.createDataFrame([row], "pos int, n int, turn double, dist double, el double")
    rules = quality.block_rules("pos", "n", INBOUND, {"pos": (1, 30), "turn": (0, 840)}, ["turn"])
    assert {r.violation for r in quality.labelled(df, rules).collect()} == broken


def test_observations_fail_closed(spark):
    at = dt.datetime(2024, 1, 1, 12)
    hours = lambda n: at - dt.timedelta(hours=n)
    rows = [(1, at, hours(1), True), (2, at, hours(-1), True), (3, at, hours(3), True), (4, None, hours(1), True), (5, at, None, True), (6, at, hours(1), False), (7, at, None, False), (8, at, at, True)]
    df = spark.createDataFrame(rows, "id long, dep timestamp, seen timestamp, has boolean")
    found = {(r.id, r.violation) for r in quality.observation_violations(df, ["id"], "dep", "seen", "has", 3 * 3600, 0.05).collect()}
    assert found == {(2, "observed_after_departure"), (3, "outside_lookback"), (4, "cannot_verify"), (5, "flag_without_observation"), (6, "observation_without_flag"), (None, "too_many_missing")}
    assert quality.observation_violations(df.where("id IN (1, 8)"), ["id"], "dep", "seen", "has", 3 * 3600, 0.05).count() == 0
    assert quality.observation_violations(df.limit(0), ["id"], "dep", "seen", "has", 3 * 3600, 0.05).count() == 0


def test_harmonised_keeps_what_is_no_number(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 6.0), (3.0, float("nan")), (4.0, None)], "temp double, vis double")
    got = clean.harmonised(df, ["temp"], {"vis": (6.0, 6.01)}).collect()
    assert all(r.temp is None for r in got)
    assert got[0].vis == 6.01 and got[1].vis == 6.0 and got[2].vis != got[2].vis and got[3].vis is None


def test_allowed_columns_alone(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, secret int, b int")
    assert clean.allowed(df, ["b", "absent", "a"]).columns == ["b", "a"]


def test_dates_of_numbers(spark):
    parts = [(2024, 2, 29), (2023, 2, 29), (2024, 0, 1), (2024, 13, 1), (2024, 1, 0), (0, 1, 1), (None, 1, 1), (2024, 12, 31)]
    df = spark.createDataFrame(parts, "y int, m int, d int").select(s.date_of(F.col("y"), F.col("m"), F.col("d")).alias("day"))
    assert [r.day for r in df.collect()] == [dt.date(2024, 2, 29), None, None, None, None, None, None, dt.date(2024, 12, 31)]


def test_labels_and_their_codes(spark):
    df = spark.createDataFrame([("AAA", " Main ", "Town"), ("BBB", " ", "Town"), ("CCC", None, ""), ("DDD", "Two (Old) Field", None)], "code string, name string, city string")
    got = df.select("code", s.place_label(F.col("code"), F.col("name"), F.col("city")).alias("label")).withColumn("back", s.label_code(F.col("label"))).collect()
    assert [r.label for r in got] == ["Main (AAA)", "Town (BBB)", "CCC", "Two (Old) Field (DDD)"]
    assert all(r.back == r.code for r in got)


def test_connections_end_with_the_day(spark):
    df = spark.createDataFrame([(600,), (1394,), (1395,), (1439,)], "m int").select(s.earliest_connection(F.col("m")).alias("t"))
    assert [r.t for r in df.collect()] == ["10:45", "23:59", "23:59", "23:59"]


def test_zero_is_absent(spark):
    assert [r.v for r in spark.createDataFrame([(0.0,), (1.5,), (None,)], "x double").select(s.present(F.col("x")).alias("v")).collect()] == [None, 1.5, None]


def test_top_share_takes_ties_whole(spark):
    df = spark.createDataFrame([("a", p, y) for p, y in [(0.9, True), (0.9, False), (0.9, True)] + [(0.1, False)] * 17], "g string, p double, y boolean")
    row = evaluate.top_share(df, ["g"]).first()
    assert (row.n, row.top_n, row.base, row.top_late, row.lift) == (20, 3, 0.1, 0.666666667, 6.666666667)
    assert evaluate.top_share(df.limit(0), ["g"]).count() == 0


def test_places_share_full_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1), ("a", 0.9, 2), ("b", 0.1, 1)], "g string, p double, k int")
    assert sorted((r.g, r.p, r.place) for r in evaluate.placed(df, ["g"], [F.desc("p"), F.col("k")]).collect()) == [("a", 0.5, 2), ("a", 0.5, 2), ("a", 0.9, 1), ("b", 0.1, 1)]


def test_relabelled_replaces_the_level(spark):
    df = spark.createDataFrame([("origin", "X", 0.2), ("dest", "Y", 0.9), ("carrier", "Z", 0.5)], "level string, key string, rate double")
    assert sorted(map(tuple, rates.relabelled(df, "origin", "dest").collect())) == [("carrier", "Z", 0.5), ("dest", "X", 0.2), ("origin", "X", 0.2)]


def test_contract_names_what_is_absent(spark, tmp_path):
    (tmp_path / "one").write_text("")
    assert files.absent_parts(spark, f"file://{tmp_path}", ["two", "one", "three"]) == ["two", "three"]


def test_day_legs_never_below_position(spark):
    day = dt.date(2024, 1, 1)
    legs = spark.createDataFrame([("t", day, 2), ("t", day, 5), ("u", day, 3), (None, day, 1)], "tail string, service_date date, position int")
    schedule = spark.createDataFrame([("t", day, 4)], "tail string, service_date date, legs int")
    got = {(r.tail, r.position): (r.legs_today, r.missed) for r in replay.with_day_legs(legs, schedule).collect()}
    assert got == {("t", 2): (4, False), ("t", 5): (5, False), ("u", 3): (3, True), (None, 1): (1, True)}
