"""The rotation chain as keyed state, one row in and one row out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lathe.operators.chain import DUTY_MIN

OUT = "event_id long, tail long, dep_ts timestamp, link_class string, turnaround_min long"
STATE = "tail array<long>, dest array<long>, arrival array<double>, overlapped array<boolean>"
#: Groups that tails are dealt to: a group costs a batch some milliseconds, a leg some microseconds.
GROUPS = 2048


def advance(prior: tuple | None, origin: int, departs: float) -> tuple[str, int | None, bool]:
    """Class of the link to the leg before, its turnaround, and whether the leg overlaps that one; times are epoch minutes."""
    if prior is None:
        return "b", None, False
    dest, arrival, overlapped = prior
    if pd.isna(arrival):
        return "c", None, False
    gap = int(departs - arrival)
    if gap < 0 or overlapped or dest != origin:
        return "c", None, gap < 0
    return ("a", gap, False) if gap <= DUTY_MIN else ("b", None, False)


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = {tail: leg for tail, *leg in zip(*state.get, strict=True)} if state.exists else {}
    legs = pd.concat(list(frames)).sort_values(["dep_ts", "event_id"])
    departs = legs.dep_ts.astype("datetime64[ns]").astype("int64") / 60e9
    rows = []
    for tail, origin, dest, at, elapsed in zip(legs.tail_id.tolist(), legs.origin.tolist(), legs.dest.tolist(), departs.tolist(), legs.elapsed_min.tolist(), strict=True):
        kind, gap, overlapped = advance(last.get(tail), origin, at)
        rows.append((kind, gap))
        last[tail] = (dest, float("nan") if elapsed is None or elapsed != elapsed else at + elapsed, overlapped)
    state.update((list(last), *map(list, zip(*last.values(), strict=True))))
    kinds, gaps = zip(*rows, strict=True)
    yield pd.DataFrame({"event_id": legs.event_id.values, "tail": legs.tail_id.values, "dep_ts": legs.dep_ts.values, "link_class": kinds, "turnaround_min": pd.array(gaps, dtype="Int64")})


def chain_stream(legs: DataFrame) -> DataFrame:
    """legs as they come to their link_class and turnaround_min.

    State per tail is its last leg alone, and no watermark drops late rows: every leg gets a row. Legs of a batch are taken in event time. Tails are dealt to GROUPS groups
    that keep their tails' state together, as a call for each tail and batch costs far more than its few legs.
    Unknown tails have no state: they are class c at once and never meet in one task.
    """
    dealt = legs.where("tail IS NOT NULL").withColumnRenamed("tail", "tail_id").withColumn("group", F.pmod(F.xxhash64("tail_id"), F.lit(GROUPS)))
    known = dealt.groupBy("group").applyInPandasWithState(_observe, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    unknown = legs.where("tail IS NULL").select("event_id", "tail", "dep_ts", F.lit("c").alias("link_class"), F.lit(None).cast("long").alias("turnaround_min"))
    return known.unionByName(unknown)
