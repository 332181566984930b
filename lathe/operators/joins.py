"""Joins by role, by level, in time, by distance and by range."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.session import materialise


def role_playing(fact: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One dimension joined once for each role column of fact; the planner broadcasts it if its size allows."""
    for role, columns in roles.items():
        side = dim.select(F.col(key).alias(f"_{role}"), *[F.col(a).alias(b) for a, b in columns.items()])
        fact = fact.join(side, fact[role] == side[f"_{role}"], "left").drop(f"_{role}")
    return fact


def level_lookup(fact: DataFrame, levels: DataFrame, wanted: Mapping[str, tuple[str, Column]], values: Sequence[str]) -> DataFrame:
    """Values of one (level, key, ...) table for several (prefix: (level, key expression)), one left join each."""
    for prefix, (level, key) in wanted.items():
        side = levels.where(F.col("level") == level).select(F.col("key").alias("_key"), *[F.col(v).alias(f"{prefix}_{v}") for v in values])
        fact = fact.join(side, key == F.col("_key"), "left").drop("_key")
    return fact


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the key columns are left's."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], within: int, order: Sequence[str] = ()) -> DataFrame:
    """left with, of right's rows of its key in (ts - within, ts] seconds, the latest one's values and <ts>_matched.

    Both sides are stacked and one window carries the last match forward: a single shuffle, no pairs. As matches are at most
    `within` old, time is cut into spans of that length; right rows are copied to their own and the next span, so that a key
    with very many rows is spread over its spans. Rows with a null key or time match nothing and stay. Ties of right go to
    the largest by order, then by values.
    """
    span = F.floor(_seconds(F.col(ts)) / within)
    carried = F.struct(F.col(ts).alias("ts"), *[F.col(v).alias(v) for v in (*order, *values)])
    ours = left.withColumns({"_span": span, "_match": F.lit(None), "_side": F.lit(1)})
    theirs = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts), carried.alias("_match"), span.alias("_s"))
    theirs = theirs.select(key, ts, "_match", F.explode(F.array("_s", F.col("_s") + 1)).alias("_span")).withColumn("_side", F.lit(0))
    both = ours.drop("_match").unionByName(theirs, allowMissingColumns=True)
    seen = W.Window.partitionBy(key, "_span").orderBy(F.col(ts), "_side", F.col("_match").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_match", ignorenulls=True).over(seen)).where("_side = 1")
    fresh = F.col(key).isNotNull() & (_seconds(F.col("_last.ts")) > _seconds(F.col(ts)) - within)
    picks = {f"{ts}_matched": F.when(fresh, F.col("_last.ts"))} | {v: F.when(fresh, F.col(f"_last.{v}")) for v in values}
    return found.withColumns(picks).drop("_span", "_side", "_match", "_last")


def trailing_counts(points: DataFrame, events: DataFrame, key: str, ts: str, within: int, counts: Mapping[str, Column]) -> DataFrame:
    """points with, for each name, the number of events of its key in [ts - within, ts) seconds that meet the condition.

    As in as_of, events are copied to their own span of length `within` and the next, and counted by a range frame there.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.floor(micros / (within * 1_000_000))
    flags = {name: F.coalesce(condition, F.lit(False)).cast("int") for name, condition in counts.items()}
    theirs = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, span.alias("_s"), *[c.alias(f"_{n}") for n, c in flags.items()])
    theirs = theirs.select(key, ts, *[f"_{n}" for n in flags], F.explode(F.array("_s", F.col("_s") + 1)).alias("_span")).withColumn("_side", F.lit(0))
    ours = points.withColumns({"_span": span, "_side": F.lit(1)})
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_at", micros)
    frame = W.Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(-within * 1_000_000, -1)
    counted = both.withColumns({n: F.coalesce(F.sum(f"_{n}").over(frame), F.lit(0)) for n in flags}).where("_side = 1")
    return counted.drop("_span", "_side", "_at", *[f"_{n}" for n in flags])


def two_level_as_of(left: DataFrame, right: DataFrame, key: str, ts: str, issued: str, valid: str, values: Sequence[str], within: int) -> DataFrame:
    """For each left row: of issues at most `within` seconds old the latest that has a group valid by ts, and of it the latest group.

    Falling back to an earlier issue and picking the group are one choice, the largest (issued, valid). A group is known from the later of both on, which is within the
    same look-back, so as in trailing_counts() groups are copied to their own span of time and the next, and a running maximum by that instant finds the choice: no pair is listed.
    """
    known_at = F.greatest(_micros(F.col(issued)), _micros(F.col(valid)))
    span = lambda micros: F.floor(micros / (within * 1_000_000))
    usable = right.where(F.col(key).isNotNull() & F.col(issued).isNotNull() & F.col(valid).isNotNull())
    theirs = usable.select(F.col(key).alias("_key"), known_at.alias("_at"), F.struct(F.col(issued).alias("issued"), F.col(valid).alias("valid"), *[F.col(v).alias(v) for v in values]).alias("_group"), F.explode(F.array(span(known_at), span(known_at) + 1)).alias("_span"))
    # Rows without a key or an instant have no match, and skip the windows, so that they never meet in one task.
    whole = F.col(key).isNotNull() & F.col(ts).isNotNull()
    ours = left.where(whole).withColumns({"_key": F.col(key), "_at": _micros(F.col(ts)), "_span": span(_micros(F.col(ts))), "_ours": F.lit(True)})
    frame = W.Window.partitionBy("_key", "_span").orderBy("_at").rangeBetween(-within * 1_000_000, 0)
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_best", F.max("_group").over(frame)).where("_ours")
    best = F.when(_micros(F.col("_best.issued")) >= F.col("_at") - within * 1_000_000, F.col("_best"))
    out = both.withColumn("_best", best).unionByName(left.where(~whole), allowMissingColumns=True)
    return out.select(*left.columns, F.col("_best.issued").alias(issued), F.col("_best.valid").alias(valid), *[F.col(f"_best.{v}").alias(v) for v in values])


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def nearest(points: DataFrame, sites: DataFrame, point: str, site: str, cell: float = 10.0, widenings: int = 1, in_cell: float = 2.0) -> DataFrame:
    """point, site, distance_km: each point's nearest site (ties to the smaller site); both have lat and lon.

    Sites are looked up by cubes of space around the point, which are as wide at a pole as elsewhere. The first cubes are as narrow (as wide as `cell` degrees at most) as leaves `in_cell` places of sites to
    one of those that hold any, so what a point meets doesn't grow with the sites. A find is final if it is nearer than anything outside the cubes searched can be; points without one look in cubes
    three times as wide, up to `cell` and then `widenings` times more. Those that are left after that are far from all sites and go by
    the cubes that hold sites, of which there are some hundreds at most, however many sites: they meet the sites of the cubes that
    may hold the nearest. Coordinates that are null take no part.
    """
    placed = sites.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(site).isNotNull())
    known = materialise(placed.groupBy(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(F.min(site).alias(site)), "sites")
    edge = math.radians(cell)
    n, held = known.agg(F.count("*"), F.count_distinct(_cube(F.col("_lat"), F.col("_lon"), edge))).first()
    widths, widest = [min(edge, edge * math.sqrt(in_cell * held / n)) if n else edge], edge * 3**widenings
    while widths[-1] < widest:
        widths.append(min(widest, widths[-1] * 3))
    rest = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(point, "lat", "lon")
    best = F.min("_b").alias("b")
    found = []
    for width in widths:
        close = materialise(_in_cells(rest, known, site, width).groupBy(point, "lat", "lon", "_cube").agg(best).drop("_cube"), "nearest")
        # Outside its 3 x 3 x 3 cubes a site is a cube's width away at least, in a straight line.
        sure_km = 2 * 6371.0088 * math.asin(min(1.0, width / 2)) * (1 - 1e-9)
        sure = F.coalesce(F.col("b.km") <= sure_km, F.lit(False))
        found.append(close.where(sure))
        rest = close.where(~sure).drop("b")
        if rest.isEmpty():
            break
    else:
        found.append(_in_cubes(rest, known).withColumn("_b", _measured(F.col("_lat"), F.col("_lon"), F.col(site))).groupBy(point, "lat", "lon").agg(best))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(point, F.col("b.site").alias(site), F.round("b.km", 2).alias("distance_km"))


def _measured(lat: Column, lon: Column, site: Column) -> Column:
    return F.struct(haversine_km(F.col("lat"), F.col("lon"), lat, lon).alias("km"), site.alias("site"))


def _in_cubes(points: DataFrame, known: DataFrame, edge: float = 0.2) -> DataFrame:
    """points with the sites of every cube of space that may hold their nearest site, on a sphere of radius 1.

    A site in a cube is within half a diagonal of the cube's middle, so the least distance to a middle plus that is a bound, and cubes whose middle is farther than
    the bound plus half a diagonal hold no nearer site. A sphere touches at most 6 * (2 / edge + 2) ** 2 cubes, 864 here: that many middles are one row's array.
    """
    half = edge * math.sqrt(3) / 2
    sites = materialise(known.withColumn("_cube", _cube(F.col("_lat"), F.col("_lon"), edge)), "cubes")
    held = sites.agg(F.collect_set("_cube").alias("c")).scalar()
    at = points.withColumns(dict(zip(("_x", "_y", "_z"), _space(F.col("lat"), F.col("lon")), strict=True)))
    away = lambda c: F.sqrt(sum((F.pow((c[n] + 0.5) * edge - F.col(f"_{n}"), 2) for n in "yz"), F.pow((c["x"] + 0.5) * edge - F.col("_x"), 2)))
    measured = at.withColumn("_held", held).withColumn("_far", F.transform("_held", lambda c: F.struct(away(c).alias("d"), c.alias("c")))).withColumn("_most", F.array_min("_far")["d"] + 2 * half + 1e-9)
    asked = measured.withColumn("_cube", F.explode(F.filter("_far", lambda f: f["d"] <= F.col("_most")))).withColumn("_cube", F.col("_cube.c"))
    return asked.drop("_x", "_y", "_z", "_held", "_far", "_most").join(sites, "_cube").drop("_cube")


def _space(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cube(lat: Column, lon: Column, edge: float) -> Column:
    """The cube of space, on a sphere of radius 1, that a place lies in."""
    return F.struct(*[F.floor(c / edge).cast("int").alias(n) for c, n in zip(_space(lat, lon), "xyz", strict=True)])


def _in_cells(points: DataFrame, known: DataFrame, site: str, edge: float, chunk: int = 1024) -> DataFrame:
    """points with their cube (_cube) of `edge` and the nearest site (_b) of that and the cubes next to it, or none.

    Sites are copied to the cubes next to theirs that the sphere meets and listed there in arrays of about `chunk`, so that a point is shuffled once, by its cube, and meets an array or a few; no pair is a row.
    """
    steps = F.expr("flatten(transform(sequence(-1, 1), a -> flatten(transform(sequence(-1, 1), b -> transform(sequence(-1, 1), c -> struct(a AS a, b AS b, c AS c))))))")
    moved = lambda c, d: F.struct(*[(c[n] + d[m]).alias(n) for n, m in zip("xyz", "abc", strict=True)])
    out = lambda c: F.sqrt(sum((F.pow((c[n] + 0.5) * edge, 2) for n in "yz"), F.pow((c["x"] + 0.5) * edge, 2)))
    around = F.filter(F.transform(steps, lambda d: moved(F.col("_cube"), d)), lambda c: F.abs(out(c) - 1) <= edge * math.sqrt(3) / 2 + 1e-9)
    near = known.withColumn("_cube", _cube(F.col("_lat"), F.col("_lon"), edge)).withColumn("_cube", F.explode(around))
    crowd = F.count("*").over(W.Window.partitionBy("_cube"))
    near = near.withColumn("_chunk", F.pmod(F.xxhash64(site), F.ceil(crowd / chunk)))
    near = near.groupBy("_cube", "_chunk").agg(F.collect_list(F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col(site).alias("site"))).alias("_near")).drop("_chunk")
    nearest_of = F.array_min(F.transform("_near", lambda s: _measured(s["lat"], s["lon"], s["site"])))
    return points.withColumn("_cube", _cube(F.col("lat"), F.col("lon"), edge)).join(near, "_cube", "left").withColumn("_b", nearest_of)


def band_join(df: DataFrame, value: Column, bands: Sequence[tuple[float, float, str]], name: str = "band") -> DataFrame:
    """The label of the band lo <= value < hi (the last includes hi); a list of bands is an expression, not a join."""
    out = F.lit(None).cast("string")
    for i, (lo, hi, label) in reversed(list(enumerate(bands))):
        out = F.when((value >= lo) & ((value <= hi) if i == len(bands) - 1 else (value < hi)), label).otherwise(out)
    return df.withColumn(name, out)


def with_default(fact: DataFrame, lookup: DataFrame, key: str, values: Sequence[str], default: DataFrame) -> DataFrame:
    """Left lookup whose misses take the values of the one row of `default`."""
    side = lookup.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values])
    out = fact.join(side, fact[key] == side["_key"], "left")
    return out.withColumns({v: F.coalesce(F.col(f"_{v}"), default.select(v).scalar()) for v in values}).drop("_key", *[f"_{v}" for v in values])


def settle_outcomes(risks: DataFrame, outcomes: DataFrame, identity: Sequence[str], ttl: int) -> DataFrame:
    """Every risk and outcome with the one counter it belongs to: counter, number of events; as if replayed in time order.

    risks: identity, ts, warmup; outcomes: identity, ts, cancelled, late. The first risk and the first outcome of an identity
    count, later ones are duplicates. A pair settles if the outcome comes before the risk or within ttl seconds after it; then
    warm-up, cancelled and unlabelled pairs are set aside, in that order, and the rest are scored. A risk left over has run out
    of time or is open at the end of the stream, an outcome left over is an orphan. Holds where no risk is sent again after its time.
    """
    first = lambda df, side: df.groupBy(*identity).agg(F.min(F.struct("ts", *[c for c in df.columns if c not in (*identity, "ts")])).alias(side), F.count("*").alias(f"n_{side}"))
    r, o = first(risks, "risk"), first(outcomes, "outcome").withColumnsRenamed({k: f"_{k}" for k in identity})
    both = r.join(o, [r[k].eqNullSafe(o[f"_{k}"]) for k in identity], "full")
    end = risks.select("ts").unionByName(outcomes.select("ts")).agg(F.max("ts")).alias("e")
    last = end.select(F.col("max(ts)")).scalar()
    limit = F.col("risk.ts") + F.make_dt_interval(secs=F.lit(ttl))
    met = F.col("risk").isNotNull() & F.col("outcome").isNotNull() & (F.col("outcome.ts") <= limit)
    kind = F.when(F.col("risk.warmup"), "warmup").when(F.col("outcome.cancelled"), "cancelled").when(F.col("outcome.late").isNull(), "unlabelled").otherwise("scored")
    alone = F.when(limit < last, "risk_ttl").otherwise("risk_end_of_stream")
    fate = F.array_compact(
        F.array(
            F.when(met, kind), F.when(F.col("risk").isNotNull() & ~F.coalesce(met, F.lit(False)), alone), F.when(F.col("outcome").isNotNull() & ~F.coalesce(met, F.lit(False)), "orphan_outcome"),
        )
    )
    named = both.select(F.explode(fate).alias("counter")).groupBy("counter").agg(F.count("*").alias("events"))
    extra = both.select(F.sum(F.coalesce(F.col("n_risk") - 1, F.lit(0))).alias("duplicate_risk"), F.sum(F.coalesce(F.col("n_outcome") - 1, F.lit(0))).alias("duplicate_outcome"))
    return named.unionByName(extra.select(F.expr("stack(2, 'duplicate_risk', duplicate_risk, 'duplicate_outcome', duplicate_outcome) AS (counter, events)")).where("events > 0"))


def settle_ordered(risks: DataFrame, outcomes: DataFrame, identity: Sequence[str], ttl: int) -> DataFrame:
    """Every risk and outcome with the one counter it belongs to, as settle_outcomes(), also where a risk is sent again after its time.

    A risk that comes more than ttl seconds after the open one of its identity opens anew, and the open one has run out of time; any other is a duplicate. So the
    risks before the first outcome are a chain, each link the first that comes later than ttl after the link before: one ordered fold for each identity. The
    first outcome settles the last link if it is in time, else it waits without limit for the next risk. All that comes after it is a duplicate.

    Outcomes are reduced to the first before anything is shuffled, and so are the risks after it and those of one instant; what one task gathers of an identity is the
    instants of its risks before its first outcome. Nulls are an identity like others. Of several at one instant the first by their columns counts.
    """
    keys = list(identity)
    named = {k: f"_{k}" for k in keys}
    first = outcomes.groupBy(*keys).agg(F.min(F.struct("ts", "cancelled", "late")).alias("outcome"), F.count("*").alias("n_outcomes")).withColumnsRenamed(named)
    same = lambda left, right: [left[k].eqNullSafe(right[n]) for k, n in named.items()]
    asked = risks.select(*keys, "ts", "warmup").join(first.select(*named.values(), F.col("outcome.ts").alias("first_ts")), same(risks, first), "left")
    before = F.coalesce(F.col("ts") <= F.col("first_ts"), F.lit(True))
    instants = asked.groupBy(*keys, before.alias("before"), F.when(before, F.col("ts")).alias("at")).agg(F.min(F.struct("ts", "warmup")).alias("risk"), F.count("*").alias("n"))
    each = instants.groupBy(*keys).agg(F.sum("n").alias("n_risks"), F.array_sort(F.collect_list(F.when(F.col("before"), F.col("risk")))).alias("waiting"), F.min(F.when(~F.col("before"), F.col("risk"))).alias("later"))
    limit = F.make_dt_interval(secs=F.lit(ttl))
    none = F.struct(F.lit(None).cast(dict(risks.dtypes)["ts"]).alias("ts"), F.lit(None).cast("boolean").alias("warmup"), F.lit(0).cast("long").alias("links"))
    chain = F.aggregate(
        F.coalesce("waiting", F.array()), none,
        lambda last, risk: F.when(last["ts"].isNull() | (last["ts"] + limit < risk["ts"]), F.struct(risk["ts"].alias("ts"), risk["warmup"].alias("warmup"), (last["links"] + 1).alias("links"))).otherwise(last),
    )
    both = each.join(first, same(each, first), "full").withColumn("last", chain)
    end = risks.select("ts").unionByName(outcomes.select("ts")).agg(F.max("ts")).select(F.col("max(ts)")).scalar()
    there, open_risk = F.col("outcome").isNotNull(), F.col("last.links") > 0
    met = there & open_risk & (F.col("outcome.ts") <= F.col("last.ts") + limit)
    waited = there & ~F.coalesce(met, F.lit(False)) & F.col("later").isNotNull()
    warm = F.when(F.coalesce(met, F.lit(False)), F.col("last.warmup")).otherwise(F.col("later.warmup"))
    kind = F.when(warm, "warmup").when(F.col("outcome.cancelled"), "cancelled").when(F.col("outcome.late").isNull(), "unlabelled").otherwise("scored")
    settled = F.coalesce(met, F.lit(False)) | waited
    expired = F.when(F.coalesce(met, F.lit(False)), 1).when(there, 0).when(F.col("last.ts") + limit < end, 0).otherwise(1)
    counts = {
        "risk_ttl": F.when(open_risk, F.col("last.links") - expired),
        "risk_end_of_stream": F.when(open_risk & ~there & ~(F.col("last.ts") + limit < end), 1),
        "orphan_outcome": F.when(there & ~settled, 1),
        "duplicate_risk": F.col("n_risks") - F.col("last.links") - F.when(waited, 1).otherwise(0),
        "duplicate_outcome": F.col("n_outcomes") - 1,
    }
    rows = F.array_append(F.array(*[F.struct(F.lit(c).alias("counter"), n.cast("long").alias("n")) for c, n in counts.items()]), F.struct(F.when(settled, kind).alias("counter"), F.lit(1).cast("long").alias("n")))
    named_rows = both.select(F.explode(rows).alias("c")).where("c.counter IS NOT NULL AND c.n > 0")
    return named_rows.groupBy(F.col("c.counter").alias("counter")).agg(F.sum("c.n").alias("events"))


def at_or_below(fact: DataFrame, steps: DataFrame, keys: Sequence[str], value: str, step: str, columns: Sequence[str], width: float) -> DataFrame:
    """fact with step and columns of the largest step of its keys that isn't above value; below all steps, those of the smallest; and place.

    place: "below" the smallest step, "at" a step, "between" two, or "above" the largest; null without a step of its keys. Steps of a key differ; those that
    are null take no part, and a null value meets none. Steps become intervals that are listed for the cells of `width` that they touch, so both sides meet by equality and the interval is tested
    exactly: any size of steps is a plain join, which the planner may broadcast by the table's size. What lies above the last step is in one more cell.
    """
    lead = W.Window.partitionBy(*keys).orderBy(step)
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    side = steps.where(F.col(step).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(step).alias("_lo"), *[F.col(c).alias(f"_{c}") for c in columns], F.lead(step).over(lead).alias("_hi"), (F.row_number().over(lead) == 1).alias("_first"))
    inside = side.where("_hi IS NOT NULL").withColumn("_cell", F.explode(F.sequence(cell("_lo"), cell("_hi"))))
    outer = side.where("_hi IS NULL").withColumn("_cell", F.lit(None).cast("long"))
    low = side.where("_first").select(*[F.col(f"_{k}") for k in keys], F.col("_lo").alias("_hi"), *[f"_{c}" for c in columns]).withColumns({"_low": F.lit(True), "_cell": F.lit(None).cast("long")})
    ends = side.groupBy(*[f"_{k}" for k in keys]).agg(F.min("_lo").alias("_min"), F.max("_lo").alias("_max"))
    there = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = fact.join(ends, there, "left").drop(*[f"_{k}" for k in keys])
    side_of = F.when(F.col(value) < F.col("_min"), -1).when(F.col(value) >= F.col("_max"), 1).when(F.col(value).isNotNull(), 0)
    placed = placed.withColumns({"_side": side_of, "_at": F.when(side_of == 0, cell(value))})
    table = inside.withColumn("_of", F.lit(0)).unionByName(outer.withColumn("_of", F.lit(1))).unionByName(low.withColumn("_of", F.lit(-1)), allowMissingColumns=True)
    on = [*there, F.col("_side") == F.col("_of"), F.col("_at").eqNullSafe(F.col("_cell")), (F.col("_side") != 0) | ((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi")))]
    met = placed.join(table, on, "left")
    least = F.when(F.col("_low"), F.col("_hi")).otherwise(F.col("_lo"))
    place = F.when(F.col("_low"), "below").when(F.col(value) == F.col("_lo"), "at").when(F.col("_hi").isNull() & F.col("_lo").isNotNull(), "above").when(F.col("_lo").isNotNull(), "between")
    return met.select(*fact.columns, least.alias(step), *[F.col(f"_{c}").alias(c) for c in columns], place.alias("place"))
