"""Streams over the replayed events table, each run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import joins
from lathe.plans.adapters import LEGS_EVENTS, legs_events, table
from lathe.plans.base import query
from lathe.plans.chain_queries import CHAIN_SQL
from lathe.session import materialise, scratch_folder
from lathe.streaming import ordered, replay, stateful


def _stream(df, ts, files=4, **how):
    path = replay.write_replay(df, ts, files, **how)
    schema = df.withColumn(ts, F.col(ts).cast("timestamp")).schema
    return replay.source(df.sparkSession, path, schema)


@query(f"WITH {CHAIN_SQL} SELECT event_id, tail, link_class, turnaround_min FROM chain")
def stream_chain(spark, d):
    legs = legs_events(spark, d).select("event_id", "tail", "dep_ts", "origin", "dest", "elapsed_min")
    return replay.run_once(stateful.chain_stream(_stream(legs, "dep_ts")), "chain").drop("dep_ts")


@query("""WITH g AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM g WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_tumbling(spark, d):
    events = _stream(table(spark, d, "events").select("ts", "event_type", "value"), "ts")
    counted = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    out = replay.run_once(counted, "tumbling")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE event_type IN ('signup', 'purchase')")
def stream_first_seen(spark, d):
    events = _stream(table(spark, d, "events").where("event_type IN ('signup', 'purchase')").select("user_id", F.col("ts").cast("date").alias("day"), "event_type", "ts"), "ts")
    once = events.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["user_id", "day", "event_type"])
    return replay.run_once(once, "first").drop("ts")


@query("SELECT 0 AS channel, count(*) AS legs FROM events WHERE event_id % 53 = 0")
def stream_channels(spark, d):
    legs = replay.keyed(legs_events(spark, d), "tail")
    return legs.where("tail IS NULL").groupBy("channel").agg(F.count("*").alias("legs"))


@query(f"""WITH {LEGS_EVENTS}, keys AS (SELECT tail, count(*) AS legs FROM legs GROUP BY 1),
bytes AS (SELECT tail, legs, list_transform(range(1, len(CAST(tail AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(tail AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)) AS b FROM keys),
sums AS (SELECT tail, legs, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x:
  list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) AS crc FROM bytes)
SELECT CAST(CASE WHEN tail IS NULL THEN 0 ELSE 1 + crc % 5 END AS INTEGER) AS channel, CAST(sum(legs) AS BIGINT) AS legs FROM sums GROUP BY 1""")
def stream_all_channels(spark, d):
    """Legs per channel over all keys, each leg given its channel in the stream."""
    legs = _stream(legs_events(spark, d).select("event_id", "tail", "dep_ts"), "dep_ts")
    return replay.run_once(replay.keyed(legs, "tail"), "channels").groupBy("channel").agg(F.count("*").alias("legs"))


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS outcome_id, user_id, ts AS outcome_ts FROM events WHERE event_type = 'purchase')
SELECT s.event_id, p.outcome_id FROM s JOIN p ON s.user_id = p.user_id AND outcome_ts >= ts AND outcome_ts <= ts + INTERVAL 6 HOUR""")
def stream_outcome_join(spark, d):
    e = table(spark, d, "events")
    risks = _stream(e.where("event_type = 'signup'").select("event_id", "user_id", "ts"), "ts", 3).withWatermark("ts", "1 hour")
    outcomes = _stream(e.where("event_type = 'purchase'").select(F.col("event_id").alias("outcome_id"), F.col("user_id").alias("outcome_user"), F.col("ts").alias("outcome_ts")), "outcome_ts", 3).withWatermark("outcome_ts", "1 hour")
    pairs = risks.join(outcomes, F.expr("user_id = outcome_user AND outcome_ts >= ts AND outcome_ts <= ts + INTERVAL 6 HOURS"))
    return replay.run_once(pairs.select("event_id", "outcome_id"), "outcomes")


#: Views and clicks of a user in a week are its risks, purchases its outcomes; instants in whole milliseconds, as a stream's clock has no finer ones.
SETTLED_INPUT = """moves AS (
  SELECT event_id, user_id, date_trunc('week', ts) AS week, date_trunc('milliseconds', ts) AS ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS side,
         CASE WHEN event_type = 'purchase' THEN event_id % 7 = 0 ELSE event_id % 9 = 0 END AS flag, CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN value > 5 END AS late
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
SETTLED_SQL = """ends AS (SELECT max(ts) AS e FROM {moves}),
o1 AS (SELECT user_id, week, min((ts, flag, late)) AS o, count(*) AS n FROM {moves} WHERE side = 1 GROUP BY 1, 2),
r AS (SELECT m.user_id, m.week, ts, flag, row_number() OVER (PARTITION BY m.user_id, m.week ORDER BY ts, flag) AS k, o[1] AS ots FROM {moves} m LEFT JOIN o1 USING (user_id, week) WHERE side = 0),
links(user_id, week, k, ts) AS (
  SELECT user_id, week, k, ts FROM r WHERE k = 1 AND coalesce(ts <= ots, true)
  UNION ALL
  SELECT r.user_id, r.week, min(r.k), min(r.ts) FROM links l JOIN r USING (user_id, week) WHERE r.ts > l.ts + INTERVAL {ttl} SECOND AND coalesce(r.ts <= ots, true) GROUP BY r.user_id, r.week, l.k),
lasts AS (SELECT user_id, week, count(*) AS links, max(k) AS k FROM links GROUP BY 1, 2),
ids AS (SELECT user_id, week, count(*) AS n, min((ts, flag)) FILTER (ts > ots) AS later FROM r GROUP BY 1, 2),
j AS (
  SELECT o1.o, o1.n AS n_o, ids.n AS n_r, later, coalesce(links, 0) AS links, r.ts AS last_ts, r.flag AS last_warm,
         coalesce(o[1] <= r.ts + INTERVAL {ttl} SECOND, false) AS met, coalesce(r.ts + INTERVAL {ttl} SECOND < e, false) AS gone
  FROM ids FULL JOIN o1 USING (user_id, week) LEFT JOIN lasts USING (user_id, week) LEFT JOIN r ON r.user_id = coalesce(ids.user_id, o1.user_id) AND r.week = coalesce(ids.week, o1.week) AND r.k = lasts.k, ends),
c AS (
  SELECT CASE WHEN CASE WHEN met THEN last_warm ELSE later[2] END THEN 'warmup' WHEN o[2] THEN 'cancelled' WHEN o[3] IS NULL THEN 'unlabelled' ELSE 'scored' END AS counter, 1 AS n FROM j WHERE o IS NOT NULL AND (met OR later IS NOT NULL)
  UNION ALL SELECT 'risk_ttl', CASE WHEN links = 0 THEN 0 WHEN met THEN links - 1 WHEN o IS NOT NULL OR gone THEN links ELSE links - 1 END FROM j
  UNION ALL SELECT 'risk_end_of_stream', 1 FROM j WHERE links > 0 AND o IS NULL AND NOT gone
  UNION ALL SELECT 'orphan_outcome', 1 FROM j WHERE o IS NOT NULL AND NOT met AND later IS NULL
  UNION ALL SELECT 'duplicate_risk', n_r - links - CASE WHEN o IS NOT NULL AND NOT met AND later IS NOT NULL THEN 1 ELSE 0 END FROM j WHERE n_r IS NOT NULL
  UNION ALL SELECT 'duplicate_outcome', n_o - 1 FROM j WHERE o IS NOT NULL),
counted AS (SELECT counter, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY 1 HAVING sum(n) > 0)"""
TTL = 6 * 3600


def _moves(spark, d):
    purchase = F.col("event_type") == "purchase"
    e = table(spark, d, "events").where("event_type IN ('view', 'click', 'purchase')")
    return e.select(
        "event_id", "user_id", F.date_trunc("week", "ts").alias("week"), F.date_trunc("millisecond", "ts").alias("ts"), F.when(purchase, 1).otherwise(0).alias("side"),
        F.when(purchase, F.col("event_id") % 7 == 0).otherwise(F.col("event_id") % 9 == 0).alias("flag"), F.when(purchase & (F.col("event_id") % 5 != 0), F.col("value") > 5).alias("late"),
    )


@query(f"WITH RECURSIVE {SETTLED_INPUT}, {SETTLED_SQL.format(moves='moves', ttl=TTL)} SELECT * FROM counted")
def settlement_redelivered(spark, d):
    """Nine counters over risks that are sent again, before and after their time."""
    moves = _moves(spark, d)
    risks = moves.where("side = 0").withColumnRenamed("flag", "warmup")
    return joins.settle_ordered(risks, moves.where("side = 1").withColumnRenamed("flag", "cancelled"), ["user_id", "week"], TTL)


@query(f"WITH RECURSIVE {SETTLED_INPUT}, {SETTLED_SQL.format(moves='moves', ttl=TTL)} SELECT * FROM counted")
def stream_settlement(spark, d):
    """The same counters from the stream, whose state machine sees one event after another."""
    moves = _moves(spark, d)
    stream = _stream(moves, "ts", closing="1 millisecond")
    changes = replay.run_once(ordered.settle_stream(stream, ["user_id", "week"], TTL), "settle", provider=ordered.PROVIDER)
    return changes.groupBy("counter").agg(F.sum("events").alias("events")).where("events > 0")


#: A tail's carrier changes now and then; a schedule knows only some days.
ROTATION_SQL = f"""{LEGS_EVENTS},
named AS (SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN 'X' ELSE 'Y' END AS carrier) FROM legs),
sched AS (SELECT tail, service_date, count(*) AS n FROM legs WHERE tail IS NOT NULL AND event_id % 3 > 0 GROUP BY ALL),
marked AS (SELECT *, coalesce(CAST(lag(carrier) OVER w <> carrier AS INT), 0) AS turn FROM named WHERE tail IS NOT NULL WINDOW w AS (PARTITION BY tail ORDER BY dep_ts, event_id)),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY tail ORDER BY dep_ts, event_id) AS run FROM marked),
linked AS (SELECT *, lag(dep_ts + elapsed_min * INTERVAL 1 MINUTE) OVER w AS arr, lag(dest) OVER w AS pdest, lag(distance) OVER w AS pdist, lag(elapsed_min) OVER w AS pel,
         row_number() OVER (PARTITION BY tail, run, service_date ORDER BY dep_ts, event_id) AS pos FROM runs WINDOW w AS (PARTITION BY tail, run ORDER BY dep_ts, event_id)),
gaps AS (SELECT *, date_sub('minute', arr, dep_ts) AS gap FROM linked),
tainted AS (SELECT *, coalesce(lag(gap < 0) OVER (PARTITION BY tail, run ORDER BY dep_ts, event_id), false) AS taint FROM gaps),
reasons AS (SELECT *, CASE WHEN pdest IS NULL THEN NULL WHEN arr IS NULL THEN 'unknown arrival' WHEN gap < 0 THEN 'negative gap' WHEN taint THEN 'overlap before' WHEN pdest <> origin THEN 'other station' END AS reason FROM tainted),
classed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'c' WHEN gap <= 840 THEN 'a' ELSE 'b' END AS link_class FROM reasons)"""


@query(f"""WITH {ROTATION_SQL}
SELECT event_id, tail, link_class, reason, CASE WHEN link_class <> 'c' THEN pos END AS rotation_position, CASE WHEN link_class <> 'c' THEN greatest(coalesce(n, pos), pos) END AS legs_today,
  CASE WHEN link_class <> 'c' THEN link_class = 'a' END AS has_inbound_leg, CASE WHEN link_class = 'a' THEN gap END AS turnaround_min, CASE WHEN link_class = 'a' THEN gap - 35 END AS slack_min,
  CASE WHEN link_class <> 'c' THEN link_class = 'a' AND gap < 35 END AS is_tight, CASE WHEN link_class = 'a' THEN pdist END AS inbound_distance, CASE WHEN link_class = 'a' THEN pel END AS inbound_elapsed_min
FROM classed LEFT JOIN sched USING (tail, service_date)
UNION ALL BY NAME SELECT event_id, tail, 'c' AS link_class, 'unknown tail' AS reason FROM named WHERE tail IS NULL""")
def stream_rotation(spark, d):
    """All that the rotation's state knows of a leg, with resets by carrier and the legs of a day from a side table that misses some days."""
    legs = legs_events(spark, d).withColumn("carrier", F.when(F.col("event_id") % 17 == 0, "X").otherwise("Y"))
    schedule = legs.where("tail IS NOT NULL AND event_id % 3 > 0").groupBy("tail", "service_date").agg(F.count("*").alias("legs"))
    stream = _stream(legs, "dep_ts", closing="1 second")
    return replay.run_once(ordered.rotation_stream(stream, materialise(schedule, "schedule")), "rotation", provider=ordered.PROVIDER)


#: Truth is known at the arrival, or where that is cancelled at its scheduled time.
PRESSURE_SQL = f"""{LEGS_EVENTS},
truth AS (SELECT *, event_id % 13 = 0 AS cancelled, CASE WHEN event_id % 8 > 0 THEN event_id % 5 < 2 END AS del15, dep_ts + (coalesce(elapsed_min, 0) + CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 90 END) * INTERVAL 1 MINUTE AS truth_ts FROM legs)"""


def _truth(spark, d):
    legs, i = legs_events(spark, d), F.col("event_id")
    late_by = F.coalesce("elapsed_min", F.lit(0)) + F.when(i % 13 == 0, 0).otherwise(i % 90)
    return legs.withColumns({"cancelled": i % 13 == 0, "del15": F.when(i % 8 > 0, i % 5 < 2), "truth_ts": F.timestamp_add("MINUTE", late_by.cast("int"), F.col("dep_ts"))})


@query(f"""WITH {PRESSURE_SQL},
late AS (SELECT l.event_id, count(*) AS n FROM legs l JOIN truth t ON t.dest = l.origin AND NOT t.cancelled AND t.del15 AND t.truth_ts >= l.dep_ts - INTERVAL 3 HOUR AND t.truth_ts < l.dep_ts GROUP BY 1),
gone AS (SELECT l.event_id, count(*) AS n FROM legs l JOIN truth t ON t.origin = l.origin AND t.cancelled AND t.truth_ts >= l.dep_ts - INTERVAL 3 HOUR AND t.truth_ts < l.dep_ts GROUP BY 1)
SELECT event_id, coalesce(late.n, 0) AS late_arrivals, coalesce(gone.n, 0) AS cancellations FROM legs LEFT JOIN late USING (event_id) LEFT JOIN gone USING (event_id)""")
def stream_pressure(spark, d):
    """Late arrivals at a departure's origin (by destination) and cancellations from it (by origin) in the three hours before, from keyed state with entries that expire."""
    truth = _truth(spark, d)
    known = truth.where("cancelled OR del15").select(F.when(F.col("cancelled"), F.col("origin")).otherwise(F.col("dest")).alias("place"), F.col("truth_ts").alias("ts"), F.when(F.col("cancelled"), 2).otherwise(1).alias("side"), F.lit(None).cast("long").alias("event_id"))
    departures = truth.select(F.col("origin").alias("place"), F.col("dep_ts").alias("ts"), F.lit(0).alias("side"), "event_id")
    stream = _stream(known.unionByName(departures), "ts", closing="1 second")
    return replay.run_once(ordered.pressure_stream(stream, 3 * 3600), "pressure", provider=ordered.PROVIDER)


#: Rows arrive hours late, every eleventh nine days late; a file holds what arrives in five days. A batch drops what isn't after the watermark up to which the batch before
#: it has folded: a day behind the latest instant of the files before that one.
LATE_SQL = f"""{SETTLED_INPUT},
arrived AS (SELECT *, CAST(floor(epoch(ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL 9 DAY ELSE event_id % 7 * INTERVAL 1 HOUR END) / 432000) AS BIGINT) AS file FROM moves),
files AS (SELECT file, max(ts) AS latest FROM arrived GROUP BY 1),
marks AS (SELECT file, max(latest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM files),
judged AS (SELECT a.*, coalesce(ts <= mark, false) AS dropped FROM arrived a JOIN marks USING (file)),
kept AS (SELECT * FROM judged WHERE NOT dropped)"""


@query(f"""WITH RECURSIVE {LATE_SQL}, {SETTLED_SQL.format(moves='kept', ttl=TTL)}
SELECT * FROM counted UNION ALL SELECT 'dropped_late', count(*) FROM judged WHERE dropped HAVING count(*) > 0""")
def stream_settlement_late(spark, d):
    """The counters of a stream that comes in the order of arrival: rows that the watermark drops are counted, those that are late but in time settle in their order."""
    moves = _moves(spark, d)
    delay = F.when(F.col("event_id") % 11 == 0, 9 * 24).otherwise(F.col("event_id") % 7)
    file = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + delay * 3600) / 432000)
    stream = _stream(moves, "ts", arrival=file, closing="1 day")
    changes, dropped = replay.run_counted(ordered.settle_stream(stream, ["user_id", "week"], TTL, "1 day"), "settle-late", provider=ordered.PROVIDER)
    counted = changes.groupBy("counter").agg(F.sum("events").alias("events"))
    late = moves.limit(1).select(F.lit("dropped_late").alias("counter"), F.lit(dropped).cast("long").alias("events"))
    return counted.unionByName(late).where("events > 0")


@query("SELECT event_id, user_id, ts, event_id * 37 % 1000 / 1000.0::DOUBLE AS p FROM events WHERE event_id * 37 % 1000 >= 650")
def stream_alerts(spark, d):
    """Alerts of a stream that is delivered twice from its start: each batch replaces what it wrote, so every alert is there once."""
    scored = table(spark, d, "events").select("event_id", "user_id", "ts", ((F.col("event_id") * 37 % 1000) / 1000.0).alias("p"))
    path, folder = replay.write_replay(scored, "ts"), scratch_folder(spark, "alerts")
    for delivery in range(2):
        stream = replay.source(spark, path, scored.withColumn("ts", F.col("ts").cast("timestamp")).schema)
        replay.sink_by_batch(stream.where("p >= 0.65"), f"{folder}/out", f"{folder}/checkpoint-{delivery}")
    return spark.read.parquet(f"{folder}/out").drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
