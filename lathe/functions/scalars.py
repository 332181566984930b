"""Scalar expressions: cleaning of raw strings, clock and date arithmetic, units, bands and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and sentinels of the packed observations.
KNOTS_PER_MS, METRES_PER_MILE, MM_PER_INCH, KMH_PER_KNOT = 1.9438445, 1609.344, 25.4, 1.852
BAD_QUALITY = ("2", "3", "6", "7")


def cleaned(text: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(text), F.lit(""))


def code(text: Column) -> Column:
    return F.upper(cleaned(text))


def whole(text: Column) -> Column:
    """The integer of a numeric string such as '12' or '12.0', rounded half away from zero; null if it is none."""
    return F.round(cleaned(text).try_cast("double")).try_cast("bigint")


def flag(text: Column) -> Column:
    """True for one, false for other numbers, null for no number."""
    return cleaned(text).try_cast("double") == 1


def part(packed: Column, i: int) -> Column:
    """The i-th field of a comma-packed string; null if there are fewer."""
    return F.get(F.split(packed, ","), F.lit(i))


def clock_minutes(hhmm: Column) -> Column:
    """Minutes of the day of HHMM, short forms padded, 2400 as 0000; null if it is no time."""
    padded = F.lpad(cleaned(hhmm), 4, "0")
    padded = F.when(padded == "2400", "0000").otherwise(padded)
    h, m = F.substring(padded, 1, 2).try_cast("int"), F.substring(padded, 3, 2).try_cast("int")
    return F.when(F.length(padded).eqNullSafe(F.lit(4)) & h.between(0, 23) & m.between(0, 59), h * 60 + m)


def clock_label(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def layover(arrival: Column, departure: Column) -> Column:
    """Minutes from one time of the day to the next, past midnight if needed."""
    return F.pmod(departure - arrival, F.lit(1440))


def utc_from_local(day: Column, minutes: Column, zone: Column | str) -> Column:
    """The instant of a local wall clock: in a gap of the clock it moves on, in a fold the first is meant."""
    local = F.timestamp_add("MINUTE", minutes.cast("int"), day.cast("timestamp_ntz"))
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def decoded(packed: Column, field: int, quality: int, sentinel: int, scale: Column | None = None) -> Column:
    """A packed number; null for its sentinel and for bad quality, while a missing quality code keeps it."""
    value = part(packed, field).try_cast("bigint")
    bad = F.coalesce(part(packed, quality).isin(*BAD_QUALITY), F.lit(False))
    return F.when(~bad & (value != sentinel), value)


def any_in(codes: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a code lies in one of the ranges; false for none, also where codes are null."""
    hit = lambda c: F.coalesce(sum((c.between(lo, hi).cast("int") for lo, hi in ranges[1:]), c.between(*ranges[0]).cast("int")) > 0, F.lit(False))
    return F.coalesce(F.exists(codes, hit), F.lit(False))


def capped(value: Column, most: float) -> Column:
    """value, at most `most`; null stays null, which least() would not keep."""
    return F.when(value > most, most).otherwise(value)


def usable(value: Column, fallback: Column) -> Column:
    """value if it is finite and above zero, else the fallback."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (value > 0)
    return F.when(finite, value).otherwise(fallback)


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, slope: float, intercept: float) -> Column:
    return sigmoid(slope * logit(p) + intercept)


def in_ten(p: Column) -> Column:
    """k of 'k in 10', half to even; neither 0 nor 10 unless p is exactly 0 or 1."""
    k = F.bround(p * 10).cast("int")
    return F.when(p <= 0, 0).when(p >= 1, 10).otherwise(F.greatest(F.least(k, F.lit(9)), F.lit(1)))


def decile_label(p: Column) -> Column:
    low = F.least(F.floor(F.round(p * 10, 9)), F.lit(9)).cast("int")
    return F.concat((low * 10).cast("string"), F.lit("-"), (low * 10 + 10).cast("string"), F.lit("%"))


def visibility_category(miles: Column) -> Column:
    return F.when(miles > 5, "VFR").when(miles > 3, "MVFR").when(miles > 1, "IFR").when(miles.isNotNull(), "LIFR")


def channel(key: Column, partitions: int = 6, nobody: str = "NOTAIL") -> Column:
    """The partition of a key: 0 is kept for rows without one, the others share the rest by checksum."""
    return F.when(F.coalesce(key, F.lit(nobody)) == nobody, 0).otherwise(1 + F.crc32(key.cast("binary")) % (partitions - 1)).cast("int")


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null where they are none, also where Spark's own constructor would raise."""
    first = F.when(year.between(1, 9999) & month.between(1, 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, (day - 1).cast("int")))


def present(value: Column) -> Column:
    """value, or null for a zero, which some sources write where they know nothing."""
    return F.nullif(value, F.lit(0))


def place_label(code: Column, name: Column, city: Column) -> Column:
    """'Name (CODE)', 'City (CODE)' where the name is blank, else the bare code."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(F.coalesce(said(name), said(city)), F.lit(" ("), code, F.lit(")")), code)


def label_code(label: Column) -> Column:
    """The code of a place_label()."""
    return F.coalesce(F.nullif(F.regexp_extract(label, r"\(([^()]+)\)$", 1), F.lit("")), label)


def earliest_connection(arrival: Column, least: int = 45) -> Column:
    """The first time of the day at which one can go on, as a label; never past the end of the day."""
    return clock_label(F.least(arrival + least, F.lit(1439)))
