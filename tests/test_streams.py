"""Keyed state in event time, sinks that may run twice, and the settlement with risks that are sent again."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lathe.operators import joins
from lathe.session import scratch_folder
from lathe.streaming import ordered, replay

START, HOUR = datetime(2024, 1, 1), 3600


def plain_settlement(moves, ttl):
    """Counters of (id, second, side, flag, late), one event after another."""
    count, state = Counter(), {}
    for i, at, side, flag, late in sorted(moves, key=lambda m: (m[1], m[2], m[3], (m[4] is not None, m[4] or False))):
        for other, (phase, since, *_) in list(state.items()):
            if phase == "open" and since + ttl < at:
                del state[other]
                count["risk_ttl"] += 1
        phase, _, mine = state.get(i, (None, 0, None))
        if phase == "settled" or phase == ("open", "pending")[side]:
            count[("duplicate_risk", "duplicate_outcome")[side]] += 1
        elif phase is None:
            state[i] = (("open", "pending")[side], at, (flag, late))
        else:
            warmup, (cancelled, label) = (mine[0], (flag, late)) if side else (flag, mine)
            count["warmup" if warmup else "cancelled" if cancelled else "unlabelled" if label is None else "scored"] += 1
            state[i] = ("settled", at, None)
    end = max((m[1] for m in moves), default=0)
    for phase, since, _ in state.values():
        if phase == "open":
            count["risk_ttl" if since + ttl < end else "risk_end_of_stream"] += 1
        elif phase == "pending":
            count["orphan_outcome"] += 1
    return {k: n for k, n in count.items() if n}


def some_moves(seed, n=400, ids=25, hours=60):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(ids)]), rnd.randrange(hours) * HOUR, int(rnd.random() < 0.25), rnd.random() < 0.3, rnd.choice([None, True, False])) for _ in range(n)]


def frames(spark, moves):
    rows = [(i, START + timedelta(seconds=at), side, flag, late if side else None) for i, at, side, flag, late in moves]
    return spark.createDataFrame(rows, "id long, ts timestamp, side int, flag boolean, late boolean")


def counts(df):
    return {r.counter: r.events for r in df.groupBy("counter").agg(F.sum("events").alias("events")).where("events <> 0").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_settlement_with_redelivery(spark, seed):
    moves = [(i, at, side, flag, late if side else None) for i, at, side, flag, late in some_moves(seed)]
    df = frames(spark, moves)
    risks, outcomes = df.where("side = 0").withColumnRenamed("flag", "warmup"), df.where("side = 1").withColumnRenamed("flag", "cancelled")
    got = joins.settle_ordered(risks, outcomes, ["id"], 5 * HOUR)
    assert counts(got) == plain_settlement(moves, 5 * HOUR)
    assert counts(joins.settle_ordered(risks, outcomes.where("false"), ["id"], HOUR)) == plain_settlement([m for m in moves if m[2] == 0], HOUR)
    assert joins.settle_ordered(risks.where("false"), outcomes.where("false"), ["id"], HOUR).count() == 0


class Kept:
    """A state variable held in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return Kept()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def run_processor(processor, rows, batches, seed):
    """Rows of one key in batches of any order, each behind the watermark of the batches before; the watermark goes to the end at last."""
    from pyspark.sql import Row

    handle, out, rnd = Handle(), [], random.Random(seed)
    processor.init(handle)
    rows = sorted(rows, key=lambda r: r[0])
    size = max(1, len(rows) // batches)
    for start in range(0, len(rows) + size, size):
        batch = rows[start : start + size]
        rnd.shuffle(batch)
        if batch:
            list(processor.handleInputRows((1,), (Row(**dict(zip(processor.names, r, strict=True))) for r in batch), Clock(0)))
        ahead = rows[start + size :]
        mark = (min(r[0] for r in ahead) - 1) // 1000 if ahead else max(r[0] for r in rows) // 1000
        for timer in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(timer)
            out += processor.handleExpiredTimer((1,), Clock(mark), None)
    return out


@pytest.mark.parametrize(("seed", "batches"), [*itertools.product(range(6), (1, 3, 40))])
def test_settlement_state_against_plain_version(seed, batches):
    moves = [(7, at, side, flag, late if side else None) for _, at, side, flag, late in some_moves(seed, 40, 1, 80)]
    rows = [(at * 1_000_000, side, flag, late) for _, at, side, flag, late in moves]
    got = Counter()
    for r in run_processor(ordered.Settlement(5 * HOUR), rows, batches, seed):
        got[r.counter] += r.events
    assert {k: n for k, n in got.items() if n} == plain_settlement(moves, 5 * HOUR)


@pytest.mark.parametrize(("seed", "batches"), [*itertools.product(range(4), (1, 5, 60))])
def test_pressure_counts_what_is_known_before(seed, batches):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(40) * 1_800_000_000, rnd.randrange(3), n) for n in range(120)]
    got = {r.event_id: (r.late_arrivals, r.cancellations) for r in run_processor(ordered.Pressure(3 * HOUR), rows, batches, seed)}
    within = 3 * HOUR * 1_000_000
    assert got == {n: tuple(sum(1 for t, s, _ in rows if s == kind and at - within <= t < at) for kind in (1, 2)) for at, side, n in rows if side == 0}


def test_pressure_bounds():
    at = 10 * HOUR * 1_000_000
    rows = [(at - 3 * HOUR * 1_000_000 - 1000, 1, None), (at - 3 * HOUR * 1_000_000, 1, None), (at - 1000, 2, None), (at, 1, None), (at, 2, None), (at, 0, 5)]
    (one,) = run_processor(ordered.Pressure(3 * HOUR), rows, 1, 0)
    assert (one.late_arrivals, one.cancellations) == (1, 1)


def test_held_rows_are_few_elements_and_what_is_left_is_cleared():
    handle, processor = Handle(), ordered.Pressure(3 * HOUR)
    processor.init(handle)
    processor.CHUNK = 40
    from pyspark.sql import Row

    list(processor.handleInputRows((1,), (Row(at=1000 * n, side=1, event_id=None) for n in range(100)), Clock(0)))
    assert [len(chunk[0]) for chunk in processor.held.get()] == [40, 40, 20]
    list(processor.handleExpiredTimer((1,), Clock(50), None))
    assert [len(chunk[0]) for chunk in processor.held.get()] == [40, 9] and len(processor.recent.get()) == 51
    list(processor.handleExpiredTimer((1,), Clock(200), None))
    (last,) = [t for t in handle.timers if t >= 3 * HOUR * 1000 + 99]
    list(processor.handleExpiredTimer((1,), Clock(last), None))
    assert not processor.held.exists() and not processor.recent.exists(), "no departure asks for it any more"


def test_pressure_of_one_place_is_spread_over_spans(spark):
    rnd = random.Random(3)
    rows = [("p", START + timedelta(minutes=30 * rnd.randrange(120)), rnd.randrange(3), n) for n in range(200)]
    df = spark.createDataFrame(rows, "place string, ts timestamp, side int, event_id long")
    stream = replay.source(spark, replay.write_replay(df, "ts", 3, closing="1 second"), df.schema)
    out = ordered.pressure_stream(stream, 3 * HOUR)
    assert "span" in out._jdf.queryExecution().analyzed().toString()
    got = {r.event_id: (r.late_arrivals, r.cancellations) for r in replay.run_once(out, "spans", provider=ordered.PROVIDER).collect()}
    within = timedelta(hours=3)
    assert got == {n: tuple(sum(1 for _, t, s, _ in rows if s == kind and at - within <= t < at) for kind in (1, 2)) for _, at, side, n in rows if side == 0}


@pytest.mark.parametrize("groups", [1, 3])
def test_identities_of_a_group_settle_apart(spark, monkeypatch, groups):
    """Many identities, a null one too, share a group's state over several batches; equal ids of different parts stay apart."""
    monkeypatch.setattr(ordered, "GROUPS", groups)
    moves = [((i, n % 2), at, side, flag, late if side else None) for n, (i, at, side, flag, late) in enumerate(some_moves(11))]
    rows = [(i, part, START + timedelta(seconds=at), side, flag, late) for (i, part), at, side, flag, late in moves]
    df = spark.createDataFrame(rows, "id long, part int, ts timestamp, side int, flag boolean, late boolean")
    stream = replay.source(spark, replay.write_replay(df, "ts", 4, closing="1 millisecond"), df.schema)
    changes = replay.run_once(ordered.settle_stream(stream, ["id", "part"], 5 * HOUR), "groups", provider=ordered.PROVIDER)
    assert counts(changes) == plain_settlement(moves, 5 * HOUR)


@pytest.mark.parametrize(
    ("last", "at", "leg", "want"),
    [
        (None, 0, ("x", 1, 5, 6, 60, 9), ("b", None, 1, None)),
        (("x", 1, 1, 5, 0, 9, 60, False), 30 * 60_000_000, ("x", 1, 5, 6, 60, 9), ("a", None, 2, 30)),
        (("x", 1, 3, 5, 0, 9, 60, False), 841 * 60_000_000, ("x", 2, 5, 6, 60, 9), ("b", None, 1, None)),
        (("x", 1, 1, 5, None, 9, None, False), 0, ("x", 1, 5, 6, 60, 9), ("c", "unknown arrival", 2, None)),
        (("x", 1, 1, 5, 60_000_001, 9, 1, False), 0, ("x", 1, 4, 6, 60, 9), ("c", "negative gap", 2, None)),
        (("x", 1, 1, 5, 59_999_999, 9, 1, False), 0, ("x", 1, 5, 6, 60, 9), ("a", None, 2, 0)),
        (("x", 1, 1, 5, 0, 9, 60, True), 0, ("x", 1, 5, 6, 60, 9), ("c", "overlap before", 2, None)),
        (("x", 1, 1, 5, 0, 9, 60, False), 0, ("x", 1, 4, 6, 60, 9), ("c", "other station", 2, None)),
        (("y", 1, 1, 5, 0, 9, 60, True), 0, ("x", 1, 4, 6, 60, 9), ("b", None, 1, None)),
    ],
)
def test_rotation_advances(last, at, leg, want):
    known, state = ordered.advance(last, at, *leg)
    assert (known["link_class"], known["reason"], known["position"], known["turnaround_min"]) == want
    assert state[0] == leg[0] and state[3] == leg[3] and state[4] == at + 60 * 60_000_000


def test_replay_goes_in_order_of_time_or_of_arrival(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 37 % 100).alias("ts"))
    path = replay.write_replay(df, "ts", 5, closing="1 hour")
    batches = {}
    stream = replay.source(spark, path, df.schema)
    folder = scratch_folder(spark, "order")
    replay.sink_by_batch(stream, f"{folder}/out", f"{folder}/checkpoint", after=batches.setdefault)
    seen = sorted((r.batch, r.low, r.high, r.n) for r in spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("id").alias("n")).collect())
    assert sum(s[3] for s in seen) == 100 and seen[-1][3] == 0 and all(a[2] < b[1] for a, b in itertools.pairwise(seen)) and len(seen) > 3
    late = replay.write_replay(df, "ts", arrival=F.col("id") % 3)
    replay.sink_by_batch(replay.source(spark, late, df.schema), f"{folder}/late", f"{folder}/checkpoint-late")
    assert {(r.batch, r.n) for r in spark.read.parquet(f"{folder}/late").groupBy("batch").agg(F.collect_set(F.col("id") % 3).alias("n")).selectExpr("batch", "n[0] AS n").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_a_batch_that_runs_again_leaves_each_row_once(spark):
    df = spark.range(90).select("id", F.timestamp_seconds("id").alias("ts"))
    path, folder = replay.write_replay(df, "ts", 3), scratch_folder(spark, "again")
    ran = []

    def fails_once(number):
        ran.append(number)
        if ran == [0, 1]:
            raise RuntimeError("lost before the commit")

    def run():
        replay.sink_by_batch(replay.source(spark, path, df.schema).where("id % 2 = 0"), f"{folder}/out", f"{folder}/checkpoint", 4, after=fails_once)

    with pytest.raises(Exception, match="lost before the commit"):
        run()
    run()
    assert ran[:3] == [0, 1, 1] and sorted(ran[2:]) == list(range(1, ran[-1] + 1))
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r.id for r in out.collect()) == list(range(0, 90, 2))
    assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 4


def test_tail_emits_what_is_wanted(spark):
    df = spark.range(20).select("id", F.timestamp_seconds("id").alias("ts"))
    lines, folder = [], scratch_folder(spark, "tail")
    replay.tail(replay.source(spark, replay.write_replay(df, "ts", 2), df.schema), F.col("id") >= 15, F.concat(F.lit("leg "), "id"), f"{folder}/checkpoint", lines.append)
    assert lines == [f"leg {i}" for i in range(15, 20)]


def test_dropped_rows_are_counted(spark):
    rows = [(1, START + timedelta(hours=h), 0, False, None, f) for h, f in [(1, 0), (20, 0), (30, 1), (2, 2), (31, 2), (32, 3), (3, 3)]]
    df = spark.createDataFrame(rows, "id long, ts timestamp, side int, flag boolean, late boolean, file int")
    stream = replay.source(spark, replay.write_replay(df, "ts", arrival=F.col("file"), closing="1 hour"), df.schema)
    changes, dropped = replay.run_counted(ordered.settle_stream(stream, ["id"], 5 * HOUR, "1 hour"), "dropped", provider=ordered.PROVIDER)
    kept = [(1, h * HOUR, 0, False, None) for h in (1, 20, 30, 31, 32)]
    assert dropped == 2 and counts(changes) == plain_settlement(kept, 5 * HOUR)


def test_timers_of_one_watermark_fold_a_key_once():
    """Whatever timers of a key are due at a watermark, its rows and states are read once; a timer that comes before what a key waits for does for it."""
    from pyspark.sql import Row

    handle, processor, folds = Handle(), ordered.Settlement(5 * HOUR), []
    processor.init(handle)
    fold = processor.fold
    processor.fold = lambda key, rows, passed: folds.append(len(rows)) or fold(key, rows, passed)
    arrive = lambda *seconds: list(processor.handleInputRows((1,), (Row(at=s * 1_000_000, side=0, flag=False, late=None) for s in seconds), Clock(0)))
    fire = lambda at: {r.counter: r.events for r in processor.handleExpiredTimer((1,), Clock(at * 1000), None)}
    arrive(10, 20)
    arrive(15, 50)
    assert [fire(30), fire(30)] == [{"risk_end_of_stream": 1, "duplicate_risk": 2}, {}] and folds == [3]
    assert handle.timers == {10_000, 15_000, 50_000}, "the row at 50 s wakes the key before its risk runs out of time"
    assert fire(60) == {"duplicate_risk": 1} and folds == [3, 1]
    assert max(handle.timers) == 5 * HOUR * 1000 + 10_001
    assert fire(5 * HOUR + 11) == {"risk_ttl": 1, "risk_end_of_stream": -1}
