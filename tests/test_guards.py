"""Guards that rebuild what they check, nested differences, the slack lookup and gridded forecasts."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lathe.functions import weather
from lathe.operators import chain, joins, quality
from lathe.plans import guard_queries
from lathe.plans.adapters import legs_events

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_a_sound_mart_has_no_violation(spark):
    mart, rates = guard_queries.rotation_mart(spark, SF)
    assert chain.link_violations(mart, chain.rebuilt(legs_events(spark, SF)), rates).count() == 0


def test_each_fault_fires_its_label(spark):
    mart, rates = guard_queries.rotation_mart(spark, LARGER)
    found = chain.link_violations(guard_queries.planted(mart, guard_queries.FAULTS), chain.rebuilt(legs_events(spark, LARGER)), rates)
    by = {}
    for r in found.collect():
        by.setdefault(r.violation, set()).add(None if r.event_id is None else r.event_id % 101)
    groups = {"hist_not_constant_within_band", "hist_not_constant_within_position", "band_hist_relabelled", "position_hist_relabelled"}
    wanted = {"turnaround_mismatch": 1, "inbound_attr_mismatch": 2, "position_or_day_mismatch": 3, "flag_mismatch": 4, "swap_shaped_not_nulled": 5, "clean_link_hist_missing": 6, "rotation_join_miss": 7, "inbound_attrs_without_inbound": 8, "tail_null_not_nulled": 13}
    assert set(by) == groups | set(wanted) and all(k in by[name] for name, k in wanted.items()) and all(by[g] == {None} for g in groups)


def test_rebuilt_finds_a_leg_of_long_ago(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(1, 7, day(0), 1, 2), (2, 7, day(100), 2, 3), (3, 7, day(100) + timedelta(hours=4), 3, 2), (4, 7, day(131), 9, 2), (5, None, day(1), 1, 2)]
    legs = spark.createDataFrame([(i, t, "c", ts.date(), ts, o, to, 60, 500) for i, t, ts, o, to in rows], "event_id long, tail long, carrier string, service_date date, dep_ts timestamp_ntz, origin long, dest long, elapsed_min long, distance long")
    got = {r.event_id: (r.kind, r.position, r.legs_today, r.gap) for r in chain.rebuilt(legs).collect()}
    assert got == {1: ("b", 1, 1, None), 2: ("b", 1, 2, 100 * 1440 - 60), 3: ("a", 2, 2, 180), 4: ("c", 1, 1, 31 * 1440 - 300), 5: (None, None, None, None)}


def plain_step(steps, value):
    if value is None or not steps:
        return None, None
    below = [t for t in steps if t <= value]
    t = max(below) if below else min(steps)
    return t, "below" if not below else "at" if t == value else "above" if t == max(steps) else "between"


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_largest_step_not_above(spark, width):
    rnd = random.Random(3)
    steps = {k: sorted(rnd.sample(range(-40, 90), n)) for k, n in (("a", 1), ("b", 9), (None, 30))}
    facts = [(n, rnd.choice(["a", "b", None, "none"]), rnd.choice([None, *range(-60, 120)])) for n in range(600)]
    table = spark.createDataFrame([(k, t, t * 2) for k, ts in steps.items() for t in ts] + [("a", None, 5)], "k string, t long, w long")
    df = spark.createDataFrame(facts, "n long, k string, v long")
    out = joins.at_or_below(df, table, ["k"], "v", "t", ["w"], width)
    got = {r.n: (r.t, r.place) for r in out.collect()}
    assert got == {n: plain_step(steps.get(k, []), v) for n, k, v in facts} and all(r.w is None or r.w == 2 * r.t for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_differences(a, b, path):
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted(a.keys() | b.keys()):
            yield from plain_differences(a.get(k), b.get(k), f"{path}.{k}")
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            yield f"{path}.length"
        else:
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                yield from plain_differences(x, y, f"{path}[{i}]")
    elif not (a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)):
        yield path


def test_nested_differences_against_plain_walk(spark):
    rnd = random.Random(8)
    pick = lambda *xs: rnd.choice(xs)
    value = lambda: {"s": pick(None, {"x": pick(1, 2, None), "l": pick(None, [], [1.0], [float("nan"), 2.0], [None, 2.0])}), "m": pick(None, {}, {"a": [1]}, {"a": [2], "b": None}), "d": pick(1.5, float("nan"), None)}
    schema = "id long, s struct<x: long, l: array<double>>, m map<string, array<long>>, d double"
    left, right = ({i: value() for i in range(60)} for _ in range(2))
    right = {i: (left[i] if i % 5 == 0 else v) for i, v in right.items()}
    del left[7], right[9]
    frame = lambda rows: spark.createDataFrame([(i, (v["s"]["x"], v["s"]["l"]) if v["s"] else None, v["m"], v["d"]) for i, v in rows.items()], schema)
    got = {(r.id, r.path) for r in quality.nested_differences(frame(left), frame(right), ["id"]).collect()}
    want = {(7, ""), (9, "")} | {(i, p) for i in left.keys() & right.keys() for c in ("s", "m", "d") for p in plain_differences(left[i][c], right[i][c], c)}
    assert got == want and len(want) > 60
    with pytest.raises(ValueError, match="differ"):
        quality.nested_differences(frame(left), frame(right).drop("d"), ["id"])


def grid_at(spark, grid, at):
    df = spark.createDataFrame([(json.dumps(grid), at)], "g string, at string").select(F.from_json("g", weather.GRID).alias("g"), F.to_timestamp("at").alias("at"))
    return df.select(*[c.alias(n) for n, c in weather.grid_features(F.col("g"), F.col("at")).items()]).first().asDict()


def layer(unit, *values):
    return {"uom": unit, "values": [{"validTime": t, "value": v} for t, v in values]}


def test_grid_at_an_instant(spark):
    grid = {
        "temperature": layer("wmoUnit:degC", ("2024-01-01T00:00:00+00:00/PT2H", None), ("2024-01-01T01:00:00+00:00/PT45M", 10.0), ("2024-01-01T01:00:00+00:00/PT6H", 20.0)),
        "windSpeed": layer("wmoUnit:m_s-1", ("2024-01-01T00:00:00+00:00/P1D", 9.0)), "windGust": layer(None, ("2023-12-31T19:00:00-05:00/P1DT2H", 18.52)),
        "visibility": layer("wmoUnit:m", ("2024-01-01T00:00:00+00:00/P1D", 40_000.0)), "quantitativePrecipitation": layer("wmoUnit:mm", ("2024-01-01T00:00:00+00:00/PT6H", 25.4)),
        "weather": {"values": [{"validTime": "2024-01-01T00:00:00+00:00/PT2H", "value": [{"weather": "freezing_fog"}, {"weather": None}, {"weather": "sleet"}]}, {"validTime": "2024-01-01T00:00:00+00:00/P1W", "value": [{"weather": "rain"}]}]},
    }
    got = grid_at(spark, grid, "2024-01-01T01:44:59Z")
    assert {k: round(v, 6) if v is not None else None for k, v in got.items()} == {
        "temp_f": 50.0, "dewpoint_f": None, "wind_kn": None, "gust_kn": 10.0, "gust_reported": 1.0, "visibility_mi": 10.0, "precip_1h_in": round(1 / 6, 6), "had_fog": 1.0, "had_rain": 0.0, "had_snow": 1.0, "had_thunder": 0.0, "has_weather": 1.0,
    }
    assert grid_at(spark, grid, "2024-01-01T01:45:00Z")["temp_f"] == 68.0
    late = grid_at(spark, grid, "2024-01-01T07:00:00Z")
    assert late.pop("has_weather") == 0.0 and set(late.values()) == {None}
    assert grid_at(spark, {"temperature": layer("wmoUnit:degF", ("2024-01-01T00:00:00+00:00/P1D", 1.0))}, "2024-01-01T01:00:00Z")["has_weather"] == 0.0
    calm = grid_at(spark, {"temperature": layer(None, ("2024-01-01T00:00:00+00:00/P1D", 0.0)), "quantitativePrecipitation": layer("wmoUnit:mm", ("2024-01-01T00:00:00+00:00/PT30M", 25.4))}, "2024-01-01T00:10:00Z")
    assert (calm["temp_f"], calm["gust_kn"], calm["gust_reported"], calm["visibility_mi"], calm["precip_1h_in"], calm["had_fog"]) == (32.0, 0.0, 0.0, 10.0, 1.0, 0.0)


def test_a_sound_whole_mart_breaks_no_rule(spark):
    from lathe.operators import features
    from lathe.plans import whole_mart_queries as whole

    mart = whole.whole_mart(spark, SF)
    assert features.mart_violations(mart, whole.CUT).count() == 0
    assert quality.not_unique(mart, ["event_id"]).count() == 0 and 0 < mart.where("has_origin_weather").count() < mart.count()


def test_holidays_reach_days_outside_of_the_table(spark):
    from lathe.operators import features

    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-05')) AS day")
    got = {str(r.day): (r.is_holiday, r.is_day_before, r.is_day_after) for r in features.holidays_padded(days, "day", F.dayofmonth("day").isin(1, 2, 4)).collect()}
    assert got == {"2023-12-31": (False, True, False), "2024-01-01": (True, True, False), "2024-01-02": (True, False, True), "2024-01-03": (False, True, True), "2024-01-04": (True, False, False), "2024-01-05": (False, False, True)}


def test_gridded_weather_reads_each_interval_once(spark):
    """What events are joined with holds numbers, not texts of intervals that every event would read again."""
    from lathe.plans.guard_queries import gridded_weather

    out = gridded_weather(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "validTime" not in plan and "gettimestamp" not in plan.lower()


def test_rebuilt_keeps_odd_rows(spark):
    """A leg that comes twice counts twice on its day, one without an instant or an id is found only by its density, and ids that tails share stay apart."""
    at = lambda n, h: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    rows = [(1, 7, at(0, 0), 1, 2), (2, 7, at(0, 4), 2, 3), (2, 7, at(0, 4), 2, 3), (3, 7, at(0, 8), 3, 2), (4, 7, at(40, 0), 2, 1), (5, 7, None, 1, 2), (6, 8, at(2, 0), 1, None), (6, 9, at(3, 0), 2, 2), (8, 9, at(3, 0.5), 2, 1), (None, 9, at(4, 0), 1, 2)]
    legs = spark.createDataFrame([(i, t, "c", ts and ts.date(), ts, o, to, 60, 500) for i, t, ts, o, to in rows], "event_id long, tail long, carrier string, service_date date, dep_ts timestamp_ntz, origin long, dest long, elapsed_min long, distance long")
    got = [tuple(r) for r in chain.rebuilt(legs).select("event_id", "density", "kind", "position", "legs_today", "gap").collect()]
    assert sorted(got, key=str) == [
        (1, 1, "b", 1, 4, None), (2, 2, "a", 3, 4, 180), (2, 2, "a", 3, 4, 180), (3, 1, "a", 4, 4, 180), (4, 1, "b", 1, 1, 57060), (6, 1, "b", 1, 1, None), (6, 1, "b", 1, 2, None), (6, 2, "b", 1, 1, None), (6, 2, "b", 1, 2, None), (8, 2, "c", 2, 2, -30), (8, 2, "c", 2, 2, -30), (None, 1, None, None, None, None),
    ]


def test_a_mart_and_its_chain_meet_once(spark):
    """Rows and groups are judged from one join of mart and chain, and legs wait for the leg before them without it."""
    mart, rates = guard_queries.rotation_mart(spark, SF)
    chained = chain.rebuilt(legs_events(spark, SF))
    assert chained._jdf.queryExecution().optimizedPlan().toString().count("timestampdiff(MINUTE") == 0, "gaps are read, not found anew on each side of a join"
    plan = chain.link_violations(mart, chained, rates)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 2, "only the two histories are still joined"
