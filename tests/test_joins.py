"""Edges of the joins in time, distance and range, and conservation of the outcome settlement."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lathe.operators import joins as j

T = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def test_as_of_bounds_and_nulls(spark):
    left = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(180)), (3, "k", at(181)), (4, None, at(0)), (5, "k", None)], "id long, key string, ts timestamp_ntz")
    right = spark.createDataFrame([("k", at(0), 7), ("k", at(-200), 1), (None, at(0), 9)], "key string, ts timestamp_ntz, v long")
    got = {r.id: r.v for r in j.as_of(left, right, "key", "ts", ["v"], 3 * 3600).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None, 5: None}, "the window is open at its old end and closed at T"


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.choice("xy"), at(rng.randrange(3000))) for i in range(120)]
    b = [(rng.choice("xy"), at(rng.randrange(3000)), i) for i in range(90)]
    got = {r.id: r.v for r in j.as_of(spark.createDataFrame(a, "id long, key string, ts timestamp_ntz"), spark.createDataFrame(b, "key string, ts timestamp_ntz, v long"), "key", "ts", ["v"], 7200).collect()}
    want = {i: max([(t, v) for key, t, v in b if key == k and ts - dt.timedelta(hours=2) < t <= ts], default=(None, None))[1] for i, k, ts in a}
    assert got == want


def test_trailing_window_is_closed_then_open(spark):
    points = spark.createDataFrame([(1, "k", at(0))], "id long, key string, ts timestamp_ntz")
    events = spark.createDataFrame([("k", at(-180)), ("k", at(-181)), ("k", at(-1)), ("k", at(0)), (None, at(-1))], "key string, ts timestamp_ntz")
    assert j.trailing_counts(points, events, "key", "ts", 3 * 3600, {"n": F.lit(True)}).first().n == 2


def test_nearest_against_brute_force(spark):
    import math

    rng = random.Random(5)
    sites = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(40)] + [(99, None, 1.0)]
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(999, None, None)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    got = {r.point: r.site for r in j.nearest(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(sites, "site long, lat double, lon double"), "point", "site").collect()}
    assert got == {p[0]: min((km(p, s), s[0]) for s in sites[:40])[1] for p in points[:150]}


def replayed(risks, outcomes, ttl):
    """The counters by going through all events in order of time, risks first."""
    events = sorted([(ts, 0, i, x) for i, ts, *x in risks] + [(ts, 1, i, x) for i, ts, *x in outcomes], key=lambda e: (e[0], e[1]))
    count, open_risk, waiting, seen_r, seen_o, settled = {}, {}, {}, set(), set(), set()

    def add(name):
        count[name] = count.get(name, 0) + 1

    def settle(risk, outcome):
        add("warmup" if risk[0] else "cancelled" if outcome[0] else "unlabelled" if outcome[1] is None else "scored")

    for ts, side, i, x in events:
        for k in [k for k, (t, _) in open_risk.items() if t + ttl < ts]:
            open_risk.pop(k)
            add("risk_ttl")
        if side == 0:
            if i in seen_r:
                add("duplicate_risk")
                continue
            seen_r.add(i)
            if i in waiting:
                settle(x, waiting.pop(i))
            else:
                open_risk[i] = (ts, x)
        else:
            if i in seen_o:
                add("duplicate_outcome")
                continue
            seen_o.add(i)
            if i in open_risk:
                settle(open_risk.pop(i)[1], x)
            else:
                waiting[i] = x
    for _ in open_risk:
        add("risk_end_of_stream")
    for _ in waiting:
        add("orphan_outcome")
    return count


def test_settlement_counts_every_event_once(spark):
    rng = random.Random(11)
    for _ in range(3):
        risks = [(rng.randrange(30), at(rng.randrange(0, 2000)), rng.random() < 0.2) for _ in range(30)]
        outcomes = [(rng.randrange(36), at(rng.randrange(0, 2000)), rng.random() < 0.2, rng.choice([True, False, None])) for _ in range(34)]
        risks = [r for k, r in enumerate(risks) if r[0] not in {x[0] for x in risks[:k]}]
        got = j.settle_outcomes(spark.createDataFrame(risks, "id long, ts timestamp_ntz, warmup boolean"), spark.createDataFrame(outcomes, "id long, ts timestamp_ntz, cancelled boolean, late boolean"), ["id"], 6 * 3600)
        counts = {r.counter: r.events for r in got.collect()}
        assert counts == replayed(risks, outcomes, dt.timedelta(hours=6))
        pairs = sum(counts.get(c, 0) for c in ("warmup", "cancelled", "unlabelled", "scored"))
        assert 2 * pairs + sum(v for c, v in counts.items() if c.startswith(("risk", "orphan", "dup"))) == len(risks) + len(outcomes)


def test_nearest_of_far_points_needs_no_product(spark):
    """Sites on one side of the globe, points everywhere and at the poles: all that the cells leave goes by cubes."""
    import math

    rng = random.Random(6)
    sites = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(60)] + [(70, 90.0, 0.0), (71, 3.0, 180.0), (72, 3.0, -180.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(900, 90.0, 77.0), (901, -90.0, 0.0), (902, 3.0, 179.9)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    out = j.nearest(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(sites, "site long, lat double, lon double"), "point", "site", cell=2.0, widenings=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.point: r for r in out.collect()}
    assert len(got) == len(points) and all(abs(got[p[0]].distance_km - min(km(p, s) for s in sites)) < 0.01 and abs(km(p, next(s for s in sites if s[0] == got[p[0]].site)) - got[p[0]].distance_km) < 0.01 for p in points)


def test_nearest_meets_no_more_sites_as_they_grow(spark, monkeypatch):
    """Many places of sites, also copied ones: the first cells narrow, so a point meets some sites and not a share of all; no pair is a row."""
    import math

    rng = random.Random(8)
    sites = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(3000)]
    sites += [(9000 + i, *sites[i % 5][1:]) for i in range(500)]
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(120)]
    met, plain_cells = [], j._in_cells

    def watched(asked, known, *how):
        out = plain_cells(asked, known, *how)
        met.append((asked.count(), out.count(), out.agg(F.sum(F.size(F.coalesce("_near", F.array())))).first()[0]))
        return out

    monkeypatch.setattr(j, "_in_cells", watched)

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    out = j.nearest(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(sites, "site long, lat double, lon double"), "point", "site")
    got = {r.point: r.site for r in out.collect()}
    assert got == {p[0]: min((km(p, s), s[0]) for s in sites)[1] for p in points}
    assert met[0][0] == met[0][1] == 120 and met[0][2] < 120 * 40, "some sites a point, not 9 of 432 cells of all"
    assert all(asked == rows for asked, rows, _ in met)


def test_two_level_as_of_against_brute_force(spark):
    from datetime import datetime, timedelta

    rng, start, within = random.Random(2), datetime(2024, 1, 1), 6 * 3600
    at = lambda h: None if h is None else start + timedelta(minutes=30 * h)
    left = [(n, rng.choice(["a", "b", None]), rng.choice([None, *range(60)])) for n in range(150)] + [(500, "a", 20)] * 2
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, *range(70)]), n) for n in range(120)]
    out = j.two_level_as_of(
        spark.createDataFrame([(n, k, at(t)) for n, k, t in left], "n long, k string, ts timestamp_ntz"),
        spark.createDataFrame([(k, at(i), at(v), n) for k, i, v, n in right], "k string, issued timestamp_ntz, valid timestamp_ntz, value long"), "k", "ts", "issued", "valid", ["value"], within,
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = []
    for n, k, t in left:
        found = [(i, v, x) for kk, i, v, x in right if k is not None and kk == k and None not in (t, i, v) and i <= t and v <= t and t - i <= 12]
        best = max(found, default=(None, None, None))
        want.append((n, at(best[0]), at(best[1]), best[2]))
    key = lambda r: str(r)
    assert sorted(((r.n, r.issued, r.valid, r.value) for r in out.collect()), key=key) == sorted(want, key=key)
