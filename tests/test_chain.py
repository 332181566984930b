"""Each class and trigger of the rotation chain, in batch and as keyed state."""

import datetime as dt

from pyspark.sql import functions as F

from lathe.operators import chain
from lathe.streaming import replay, stateful
from lathe.streaming.stateful import advance

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, tail string, carrier string, service_date date, dep_ts timestamp_ntz, origin string, dest string, elapsed_min double, distance long"


def leg(i, tail, minute, origin, dest, elapsed=60.0, carrier="X"):
    ts = DAY + dt.timedelta(minutes=minute)
    return (i, tail, carrier, ts.date(), ts, origin, dest, elapsed, 100 + i)


def classes(spark, rows, **settings):
    out = chain.link(spark.createDataFrame(rows, SCHEMA), **settings).orderBy("event_id").collect()
    return {r.event_id: r for r in out}


def test_first_leg_turnaround_and_bands(spark):
    got = classes(spark, [leg(1, "t", 0, "A", "B"), leg(2, "t", 90, "B", "C"), leg(3, "t", 185, "C", "D"), leg(4, "t", 305, "D", "E"), leg(5, "t", 545, "E", "F")])
    assert [got[i].link_class for i in range(1, 6)] == ["b", "a", "a", "a", "a"]
    assert [got[i].turnaround_min for i in range(2, 6)] == [30, 35, 60, 180]
    assert [got[i].band for i in range(1, 6)] == ["no_inbound", "lt_35", "35_60", "60_120", "ge_120"]
    assert [got[i].is_tight for i in range(1, 6)] == [False, True, False, False, False]
    assert got[2].inbound_distance == 101 and got[2].rotation_position == 2 and got[2].legs_today == 5


def test_swapped_links_are_unknown(spark):
    rows = [
        leg(1, "gap", 0, "A", "B"), leg(2, "gap", 30, "B", "C"), leg(3, "gap", 120, "C", "D"), leg(4, "gap", 300, "D", "E"),
        leg(11, "station", 0, "A", "B"), leg(12, "station", 90, "Q", "C"),
        leg(21, "unknown", 0, "A", "B", None), leg(22, "unknown", 90, "B", "C"),
        leg(31, None, 0, "A", "B"), leg(32, None, 90, "B", "C"),
        leg(41, "night", 0, "A", "B"), leg(42, "night", 60 + 841, "B", "C"), leg(43, "night", 60 + 841 + 60 + 1000, "Q", "C"),
    ]
    got = classes(spark, rows)
    kinds = {i: r.link_class for i, r in got.items()}
    assert kinds == {1: "b", 2: "c", 3: "c", 4: "a", 11: "b", 12: "c", 21: "b", 22: "c", 31: "c", 32: "c", 41: "b", 42: "b", 43: "c"}
    assert all(got[i][c] is None for i in (2, 3, 12, 31) for c in ("band", "rotation_position", "has_inbound_leg", "is_tight", "turnaround_min"))
    assert got[31].density == 5, "density counts all legs of the hour, with and without a tail"


def test_carrier_change_resets_only_if_asked(spark):
    rows = [leg(1, "t", 0, "A", "B"), leg(2, "t", 90, "B", "C", carrier="Y")]
    assert classes(spark, rows)[2].link_class == "a"
    assert classes(spark, rows, carrier_resets=True)[2].link_class == "b"


def test_position_is_capped_and_half_minutes_truncate(spark):
    rows = [leg(i, "t", 100 * i, "A", "A", 50.0) for i in range(8)]
    got = classes(spark, rows)
    assert got[7].rotation_position == 8 and got[7].position_key == "6"
    assert advance(("B", 60.0, False), "B", 59.5)[0] == "a", "minus half a minute is zero minutes"


def test_exposure_counts_unknown_weights(spark):
    rows = spark.createDataFrame([leg(1, "t", 0, "A", "B"), leg(2, "t", 90, "B", "C"), leg(3, "t", 200, "C", "D"), leg(4, None, 0, "A", "B")], SCHEMA)
    got = {r.event_id: r for r in chain.exposure(rows, F.when(F.col("event_id") == 2, 4)).collect()}
    assert [(got[i].later_legs, got[i].later_weight, got[i].later_unknown) for i in (1, 2, 3, 4)] == [(2, 4, 1), (1, 0, 1), (0, 0, 0), (0, 0, 0)]


def test_partitions_do_not_matter(spark):
    rows = [leg(i, f"t{i % 7}", (i * 37) % 1440, "ABC"[i % 3], "ABC"[(i + 1) % 3], 30.0 + i % 50) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(str, chain.link(df.coalesce(1)).collect()))
    assert one == sorted(map(str, chain.link(df.repartition(9)).collect()))


def test_seams_of_equal_arrival_go_by_row(spark):
    """Legs of one arrival come in the order of their ids, however the rows lie."""
    rows = [(i, "t", DAY + dt.timedelta(minutes=m), 0) for i, m in ((1, 30), (2, 10), (3, 20), (4, 20))]
    for laid in (rows, rows[::-1]):
        df = spark.createDataFrame(laid, "event_id long, tail string, dep_ts timestamp_ntz, arrival long").coalesce(1)
        assert sorted(r.event_id for r in chain.seams(df, "arrival").collect()) == [2, 4]


def test_tails_that_share_a_group_keep_chains_of_their_own(spark, monkeypatch):
    """Two groups hold the last legs of many tails over several batches; links are those of the batch."""
    monkeypatch.setattr(stateful, "GROUPS", 2)
    rows = [(i, i * 7 % 23 or None, "X", (DAY + dt.timedelta(minutes=37 * i)).date(), DAY + dt.timedelta(minutes=37 * i), i % 3, i // 3 % 3, None if i % 19 == 0 else 30.0 * (i % 70), i) for i in range(300)]
    legs = spark.createDataFrame(rows, "event_id long, tail long, carrier string, service_date date, dep_ts timestamp, origin long, dest long, elapsed_min double, distance long")
    stream = replay.source(spark, replay.write_replay(legs, "dep_ts", 4), legs.schema)
    out = stateful.chain_stream(stream)
    assert "group#" in out._jdf.queryExecution().analyzed().toString()
    got = {r.event_id: (r.tail, r.link_class, r.turnaround_min) for r in replay.run_once(out, "shared").collect()}
    assert got == {r.event_id: (r.tail, r.link_class, r.turnaround_min) for r in chain.link(legs).collect()}
