"""Keyed state in event time: rows are held until the watermark has passed them and then folded in their order.

A batch brings the rows of a key in no order, and a late file brings rows that belong before others. So each processor holds rows in a list
state and wakes by a timer; what it folds is complete and in order, whatever batches it came in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from datetime import date
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lathe.operators.chain import DUTY_MIN, TIGHT_MIN

#: The state store that keyed timers and typed states need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MINUTE = 60_000_000
#: Groups that keys are dealt to: the messages to the state store go by group and batch, not by key and batch.
GROUPS = 256


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(",")]


def _millis(micros: int) -> int:
    """The first millisecond that isn't before an instant."""
    return -(-micros // 1000)


class InOrder(StatefulProcessor):
    """Rows (at in epoch microseconds, then the rest of HELD) to fold() in the order of HELD's columns, once the watermark is at or past them.

    An element of the list state is up to CHUNK rows, each column an array: an element costs a message and its own coding, a row nearly nothing.
    With an identity (a column of each row) a key of the stream is a group of identities, whose states are kept together; without one it is one identity itself.
    A key always has a timer that comes no later than the first instant it waits for. It may have more of them; what they find folded up to the watermark they leave alone.
    """

    HELD = ""
    KEPT = ""
    CHUNK = 10_000

    def __init__(self, identity: str = ""):
        self.identity = identity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = _names(self.HELD) + self._own()
        self.held = handle.getListState("held", self._arrays(self.HELD))
        self.kept = handle.getListState("kept", self._arrays(self.KEPT)) if self.KEPT else None
        self.wakes: dict[tuple, int] = {}
        self.folded: dict[tuple, int] = {}

    def _own(self) -> list[str]:
        return _names(self.identity) if self.identity else []

    def _arrays(self, schema: str) -> str:
        columns = (column.split() for column in ", ".join(filter(None, (schema, self.identity))).split(","))
        return ", ".join(f"{name} array<{kind}>" for name, kind in columns)

    def states(self) -> dict[tuple, tuple]:
        """What is kept of each identity of the group."""
        n = len(_names(self.KEPT))
        return {row[n:]: row[:n] for chunk in self.kept.get() or () for row in zip(*chunk, strict=True)}

    def keep(self, states: dict[tuple, tuple]) -> None:
        if states:
            self.kept.put(self._chunks([(*state, *identity) for identity, state in states.items()]))
        else:
            self.kept.clear()

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[i : i + self.CHUNK], strict=True))) for i in range(0, len(rows), self.CHUNK)]

    def wake(self, key: tuple, at: int, passed: int | None = None) -> None:
        """Sets a timer of the key at an instant, but not where one of this batch is still to come after what has passed and no later than that."""
        known = self.wakes.get(key)
        if passed is None or known is None or not passed < known * 1000 <= _millis(at) * 1000:
            self.wakes[key] = _millis(at)
            self.handle.registerTimer(self.wakes[key])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        places, new = None, []
        for row in rows:
            places = places or itemgetter(*map(row.__fields__.index, self.names))
            new.append(places(tuple(row)))
        self.held.appendList(self._chunks(new))
        self.wake(key, min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.folded.get(key) == passed:
            return
        self.folded[key] = passed
        due, rest = [], []
        for chunk in self.held.get() or ():
            for row in zip(*chunk, strict=True):
                (due if row[0] <= passed else rest).append(row)
        if due:
            self.held.put(self._chunks(rest)) if rest else self.held.clear()
        if rest:
            self.wake(key, min(r[0] for r in rest), passed)
        yield from self.fold(key, sorted(due, key=lambda r: tuple((x is not None, x) for x in r)), passed)

    def fold(self, key: tuple, rows: list[tuple], passed: int) -> Iterable[Row]:
        raise NotImplementedError


class Settlement(InOrder):
    """Risks and outcomes of an identity, in order, to changes of nine counters.

    A risk opens unless one is open or the identity is settled; it is evicted where anything comes more than ttl later, and may then open again. An outcome
    settles the open risk, or waits without limit for the next one. risk_end_of_stream and orphan_outcome are what is open and waits just now: they rise and fall.
    """

    HELD = "at long, side int, flag boolean, late boolean"
    KEPT = "phase string, opened long, warmup boolean, cancelled boolean, late boolean"

    def __init__(self, ttl: int, identity: str = ""):
        super().__init__(identity)
        self.ttl = ttl * 1_000_000

    def fold(self, key: tuple, rows: list[tuple], passed: int) -> Iterable[Row]:
        states, none = self.states(), (None,) * 5
        changes: dict[str, int] = {}

        def add(counter: str, n: int = 1) -> None:
            changes[counter] = changes.get(counter, 0) + n

        def settled(warmup: bool, cancelled: bool, late: bool | None) -> str:
            add("warmup" if warmup else "cancelled" if cancelled else "unlabelled" if late is None else "scored")
            return "settled"

        for at, side, flag, label, *whose in rows:
            if side is None:
                continue
            phase, opened, warmup, cancelled, late = states.get(tuple(whose), none)
            if phase == "open" and opened + self.ttl < at:
                phase = None
                add("risk_ttl")
                add("risk_end_of_stream", -1)
            if phase == "settled" or phase == ("open" if side == 0 else "pending"):
                add("duplicate_outcome" if side else "duplicate_risk")
            elif side == 0:
                opened, warmup = at, flag
                if phase == "pending":
                    add("orphan_outcome", -1)
                    phase = settled(warmup, cancelled, late)
                else:
                    phase = "open"
                    add("risk_end_of_stream")
            else:
                cancelled, late = flag, label
                if phase == "open":
                    add("risk_end_of_stream", -1)
                    phase = settled(warmup, cancelled, late)
                else:
                    phase = "pending"
                    add("orphan_outcome")
            states[tuple(whose)] = (phase, opened, warmup, cancelled, late)
        gone = [i for i, (phase, opened, *_) in states.items() if phase == "open" and opened + self.ttl < passed]
        for identity in gone:
            del states[identity]
            add("risk_ttl")
            add("risk_end_of_stream", -1)
        waiting = [opened for phase, opened, *_ in states.values() if phase == "open"]
        if waiting:
            self.wake(key, min(waiting) + self.ttl + 1, passed)
        if rows or gone:
            self.keep(states)
        return [Row(counter=c, events=n) for c, n in changes.items() if n]


class Rotation(InOrder):
    """The legs of a tail, in order, each to its link_class, why it is c, and what the chain lets it know. State is one leg: the last."""

    HELD = "at long, event_id long, carrier string, service_date date, origin long, dest long, elapsed_min long, distance long"
    KEPT = "carrier string, service_date date, position long, dest long, arrival long, distance long, elapsed_min long, overlapped boolean"
    OUT = "event_id long, tail long, service_date date, link_class string, reason string, position long, turnaround_min long, inbound_distance long, inbound_elapsed_min long"

    def fold(self, key: tuple, rows: list[tuple], passed: int) -> Iterable[Row]:
        states, n, out = self.states() if rows else {}, len(_names(self.HELD)), []
        for row in rows:
            at, event_id, *leg = row[:n]
            if event_id is not None:
                whose = row[n:]
                found, states[whose] = advance(states.get(whose), at, *leg)
                out.append(Row(event_id=event_id, tail=(whose or key)[0], service_date=leg[1], **found))
        if out:
            self.keep(states)
        return out


def advance(last: tuple | None, at: int, carrier: str, day: date, origin: int, dest: int, elapsed: int | None, distance: int | None) -> tuple[dict, tuple]:
    """What a leg that departs at (microseconds) knows of the leg before it, and the state after it. Another carrier starts anew.

    A leg's own negative gap taints its successor, also where the leg itself is c for another reason.
    """
    last = None if last is not None and last[0] != carrier else last
    position = 1 if last is None or last[1] != day else last[2] + 1
    gap = None
    if last is not None and last[4] is not None:
        gap = abs(at - last[4]) // _MINUTE * (1 if at >= last[4] else -1)
    if last is None:
        kind, reason = "b", None
    elif last[4] is None:
        kind, reason = "c", "unknown arrival"
    elif gap < 0:
        kind, reason = "c", "negative gap"
    elif last[7]:
        kind, reason = "c", "overlap before"
    elif last[3] != origin:
        kind, reason = "c", "other station"
    else:
        kind, reason = ("a" if gap <= DUTY_MIN else "b"), None
    inbound = kind == "a"
    known = {"link_class": kind, "reason": reason, "position": position, "turnaround_min": gap if inbound else None, "inbound_distance": last[5] if inbound else None, "inbound_elapsed_min": last[6] if inbound else None}
    return known, (carrier, day, position, dest, None if elapsed is None else at + elapsed * _MINUTE, distance, elapsed, gap is not None and gap < 0)


class Pressure(InOrder):
    """Departures of a place, each with how many late arrivals (side 1) and cancellations (side 2) were known there in the `within` seconds before it.

    The state keeps what is younger than that, so it is bounded by what one place sees in a window, however long the stream is; a timer clears what no departure asked for.
    """

    HELD = "at long, side int, event_id long"
    OUT = "event_id long, late_arrivals long, cancellations long"

    def __init__(self, within: int):
        super().__init__()
        self.within = within * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at long, side int")

    def fold(self, key: tuple, rows: list[tuple], passed: int) -> Iterable[Row]:
        recent = deque(map(tuple, self.recent.get() or ()))
        seen = [0, 0, 0]
        for _, side in recent:
            seen[side] += 1
        out = []
        for at, side, event_id in rows:
            while recent and recent[0][0] < at - self.within:
                seen[recent.popleft()[1]] -= 1
            if side == 0:  # sorts before what is known at the same instant
                out.append(Row(event_id=event_id, late_arrivals=seen[1], cancellations=seen[2]))
            elif side is not None:
                recent.append((at, side))
                seen[side] += 1
        kept = [r for r in recent if r[0] > passed - self.within]
        if kept:
            self.recent.put(kept)
            self.wake(key, kept[-1][0] + self.within, passed)
        elif recent or rows:
            self.recent.clear()
        return out


def _at(ts: str) -> Column:
    return F.unix_micros(F.col(ts)).alias("at")


def _group(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(GROUPS)).alias("group")


def settle_stream(risks_and_outcomes: DataFrame, identity: list[str], ttl: int, late_by: str = "0 seconds") -> DataFrame:
    """A stream of identity, ts, side (0 risk, 1 outcome; null: neither, it only moves time), flag (warm-up of a risk, cancellation of an outcome) and late to changes of counters.

    Summed by counter at any time these are the counts as if the stream ended there. Rows that come later than late_by behind the latest are dropped by the watermark;
    count them apart with replay.run_counted().
    """
    own = F.to_json(F.array(*[F.col(c).cast("string") for c in identity]), {"ignoreNullFields": "false"}).alias("identity")
    timed = risks_and_outcomes.withWatermark("ts", late_by).select(_group(*identity), own, "ts", _at("ts"), "side", "flag", "late")
    return timed.groupBy("group").transformWithState(Settlement(ttl, "identity string"), "counter string, events long", "append", "eventTime")


def rotation_stream(legs: DataFrame, schedule: DataFrame, late_by: str = "0 seconds") -> DataFrame:
    """legs (event_id, tail, carrier, service_date, dep_ts, origin, dest, elapsed_min, distance) as they come to the features of the rotation.

    schedule (tail, service_date, legs) is a written table that knows how many legs a day has. Unknown tails have no state: they are class c at once and never
    meet in one task. Rows without an event_id only move time.
    """
    timed = legs.withWatermark("dep_ts", late_by).select("tail", "dep_ts", _at("dep_ts"), *_names(Rotation.HELD)[1:])
    known = timed.where("tail IS NOT NULL OR event_id IS NULL").withColumn("group", _group("tail")).groupBy("group").transformWithState(Rotation("tail long"), Rotation.OUT, "append", "eventTime")
    unknown = timed.where("tail IS NULL AND event_id IS NOT NULL").select("event_id", "tail", "service_date", F.lit("c").alias("link_class"), F.lit("unknown tail").alias("reason"))
    placed = known.unionByName(unknown, allowMissingColumns=True).join(schedule.select("tail", "service_date", "legs"), ["tail", "service_date"], "left")
    linkable, turnaround = F.col("link_class") != "c", F.col("turnaround_min")
    return placed.select(
        "event_id", "tail", "link_class", "reason",
        F.when(linkable, F.col("position")).alias("rotation_position"), F.when(linkable, F.greatest(F.coalesce("legs", "position"), F.col("position"))).alias("legs_today"),
        F.when(linkable, F.col("link_class") == "a").alias("has_inbound_leg"), turnaround, (turnaround - TIGHT_MIN).alias("slack_min"),
        F.when(linkable, F.coalesce(turnaround < TIGHT_MIN, F.lit(False))).alias("is_tight"), "inbound_distance", "inbound_elapsed_min",
    )


def pressure_stream(moves: DataFrame, within: int, late_by: str = "0 seconds") -> DataFrame:
    """moves (place, ts, side, event_id) to a row for each departure (side 0): late arrivals (side 1) and cancellations (side 2) of its place in [ts - within, ts) seconds.

    A key is a place in a span of four times `within`, so that a few places with very many moves are spread over the spans; what is known late in a span is sent to the next one too.
    """
    timed = moves.withWatermark("ts", late_by).select("place", "ts", _at("ts"), "side", "event_id")
    span = lambda at: F.floor(at / (4 * within * 1_000_000))
    own, last = span(F.col("at")), span(F.col("at") + within * 1_000_000)
    spread = timed.withColumn("span", F.explode(F.when(F.col("side") > 0, F.array_distinct(F.array(own, last))).otherwise(F.array(own))))
    return spread.groupBy("place", "span").transformWithState(Pressure(within), Pressure.OUT, "append", "eventTime")
