"""Typing, deduplication, decoding, dates and scalar functions over strings made from the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import scalars as s
from lathe.operators import clean
from lathe.plans.adapters import LEGS_LINEITEM, legs_lineitem, table
from lathe.plans.base import query


def _raw(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit(" "), F.lower("event_type"), F.lit(" ")).alias("carrier"),
        F.when(e % 11 == 0, "").when(e % 13 == 0, "x").when(e % 2 == 0, F.concat(e.cast("string"), F.lit(".0"))).otherwise(e.cast("string")).alias("number"),
        F.when(e % 17 == 0, "2400").when(e % 19 == 0, "2575").when(e % 23 == 0, "").otherwise(((e * 7) % 2400).cast("string")).alias("clock"),
        F.when(e % 5 == 0, "1.00").when(e % 5 == 1, "0").when(e % 5 == 2, " ").otherwise("1").alias("late"),
        F.when(e % 29 == 0, "2024-02-30").otherwise(F.col("ts").cast("date").cast("string")).alias("day"),
    )


_RAW = """raw AS (SELECT event_id, ' ' || lower(event_type) || ' ' AS carrier,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 2 = 0 THEN event_id || '.0' ELSE CAST(event_id AS VARCHAR) END AS number,
  CASE WHEN event_id % 17 = 0 THEN '2400' WHEN event_id % 19 = 0 THEN '2575' WHEN event_id % 23 = 0 THEN '' ELSE CAST((event_id * 7) % 2400 AS VARCHAR) END AS clock,
  CASE event_id % 5 WHEN 0 THEN '1.00' WHEN 1 THEN '0' WHEN 2 THEN ' ' ELSE '1' END AS late,
  CASE WHEN event_id % 29 = 0 THEN '2024-02-30' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events)"""


@query(f"""WITH {_RAW}, p AS (SELECT *, CASE WHEN nullif(trim(clock), '') IS NULL THEN NULL WHEN lpad(trim(clock), 4, '0') = '2400' THEN '0000' ELSE lpad(trim(clock), 4, '0') END AS c FROM raw)
SELECT event_id, upper(nullif(trim(carrier), '')) AS carrier, TRY_CAST(round(TRY_CAST(nullif(trim(number), '') AS DOUBLE)) AS BIGINT) AS number,
  CASE WHEN CAST(substr(c, 1, 2) AS INTEGER) < 24 AND CAST(substr(c, 3, 2) AS INTEGER) < 60 THEN CAST(substr(c, 1, 2) AS INTEGER) * 60 + CAST(substr(c, 3, 2) AS INTEGER) END AS clock,
  TRY_CAST(nullif(trim(late), '') AS DOUBLE) = 1 AS late, TRY_CAST(day AS DATE) AS day FROM p""")
def typed_projection(spark, d):
    kinds = {"carrier": "code", "number": "whole", "clock": "clock", "late": "flag", "day": "date"}
    raw = _raw(spark, d).withColumn("id", F.col("event_id").cast("string"))
    return clean.typed(raw, {"event_id": ("id", "whole")} | {c: (c, k) for c, k in kinds.items()})


_COLS = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT * EXCLUDE (k) FROM (SELECT {_COLS}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' NULLS FIRST' for c in _COLS.split(', ')[2:])}) AS k FROM lineitem) WHERE k = 1")
def deduplicated_lines(spark, d):
    cols = _COLS.split(", ")
    return clean.first_of(table(spark, d, "lineitem").select(*cols), cols[:2], [F.col(c).asc_nulls_first() for c in cols[2:]])


def _packed(spark, d):
    e = F.col("event_id")
    t = lambda c: c.cast("string")
    q = t(e % 10)
    return table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("station_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("obs_ts"),
        F.get(F.array(*map(F.lit, ("FM-15", "FM-16", "FM-12", "SAO"))), (e % 4).cast("int")).alias("report_type"),
        F.when(e % 31 == 0, "+9999,9").otherwise(F.concat(F.when(e % 3 == 0, "-").otherwise("+"), F.lpad(t(e % 400), 4, "0"), F.lit(","), q)).alias("TMP"),
        F.when(e % 7 != 0, F.concat(F.lit("+"), F.lpad(t(e % 200), 4, "0"), F.lit(","), q)).alias("DEW"),
        F.concat(F.lit("180,1,N,"), F.lpad(t(e % 150), 4, "0"), F.lit(","), q).alias("WND"),
        F.concat(F.lpad(t(e * 13 % 20000), 6, "0"), F.when(e % 9 == 0, "").otherwise(F.concat(F.lit(","), q))).alias("VIS"),
        F.when(e % 4 == 0, F.concat(F.lpad(t(e % 250), 4, "0"), F.lit(","), q)).alias("OC1"),
        F.when(e % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.when(e % 2 == 0, "01").otherwise("06"), F.lit(","), F.lpad(t(e % 90), 4, "0"), F.lit(",9,"), q))).alias("precip"),
        F.array(F.concat(t(e % 100), F.lit(","), q)).alias("manned"), F.array(F.concat(t(e * 3 % 100), F.lit(","), q)).alias("automatic"),
    ).distinct()


_Q = "CAST(event_id % 10 AS VARCHAR)"
_BAD = "('2', '3', '6', '7')"
_PACKED = f"""packed AS (SELECT DISTINCT user_id % 50 AS station_id, date_trunc('hour', ts) AS obs_ts, ['FM-15', 'FM-16', 'FM-12', 'SAO'][event_id % 4 + 1] AS report_type,
  CASE WHEN event_id % 31 = 0 THEN '+9999,9' ELSE (CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END) || lpad(CAST(event_id % 400 AS VARCHAR), 4, '0') || ',' || {_Q} END AS TMP,
  CASE WHEN event_id % 7 <> 0 THEN '+' || lpad(CAST(event_id % 200 AS VARCHAR), 4, '0') || ',' || {_Q} END AS DEW,
  '180,1,N,' || lpad(CAST(event_id % 150 AS VARCHAR), 4, '0') || ',' || {_Q} AS WND,
  lpad(CAST(event_id * 13 % 20000 AS VARCHAR), 6, '0') || CASE WHEN event_id % 9 = 0 THEN '' ELSE ',' || {_Q} END AS VIS,
  CASE WHEN event_id % 4 = 0 THEN lpad(CAST(event_id % 250 AS VARCHAR), 4, '0') || ',' || {_Q} END AS OC1,
  CASE WHEN event_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE [(CASE WHEN event_id % 2 = 0 THEN '01' ELSE '06' END) || ',' || lpad(CAST(event_id % 90 AS VARCHAR), 4, '0') || ',9,' || {_Q}] END AS precip,
  (event_id % 100) || ',' || {_Q} AS manned, (event_id * 3 % 100) || ',' || {_Q} AS automatic FROM events),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, obs_ts ORDER BY coalesce(list_position(['FM-15', 'FM-16', 'FM-12'], report_type), 4), report_type NULLS FIRST, TMP NULLS FIRST, DEW NULLS FIRST, WND NULLS FIRST, VIS NULLS FIRST, OC1 NULLS FIRST) AS k FROM packed) WHERE k = 1)"""


def _num(column: str, field: int, quality: int, sentinel: int) -> str:
    q = f"split_part({column}, ',', {quality + 1})"
    return f"CASE WHEN NOT coalesce({q} IN {_BAD}, false) AND CAST(split_part({column}, ',', {field + 1}) AS BIGINT) <> {sentinel} THEN CAST(split_part({column}, ',', {field + 1}) AS BIGINT) END"


def _code(column: str, ranges) -> str:
    c = f"CAST(split_part({column}, ',', 1) AS BIGINT)"
    return f"(split_part({column}, ',', 2) NOT IN {_BAD} AND (" + " OR ".join(f"{c} BETWEEN {lo} AND {hi}" for lo, hi in ranges) + "))"


@query(f"""WITH {_PACKED} SELECT station_id, obs_ts, report_type, round({_num('TMP', 0, 1, 9999)} / 10 * 9 / 5 + 32, 4) AS temp_f, round({_num('DEW', 0, 1, 9999)} / 10 * 9 / 5 + 32, 4) AS dewpoint_f,
  round({_num('WND', 3, 4, 9999)} / 10 * 1.9438445::DOUBLE, 4) AS wind_speed_kn, round({_num('VIS', 0, 1, 999999)} / 1609.344::DOUBLE, 4) AS visibility_mi, round({_num('OC1', 0, 1, 9999)} / 10 * 1.9438445::DOUBLE, 4) AS gust_kn,
  round(CASE WHEN len(precip) = 0 THEN 0.0::DOUBLE WHEN split_part(precip[1], ',', 1) = '01' AND split_part(precip[1], ',', 4) NOT IN {_BAD} THEN CAST(split_part(precip[1], ',', 2) AS BIGINT) / 10 / 25.4::DOUBLE END, 4) AS precip_1h_in,
  {_num('OC1', 0, 1, 9999)} IS NOT NULL AS gust_reported, {", ".join(f"({_code('manned', a)} OR {_code('automatic', b)}) AS {n}" for n, (a, b) in clean.WEATHER.items())} FROM once""")
def decoded_observations(spark, d):
    return clean.observations(_packed(spark, d))


@query("""SELECT CAST(day AS DATE) AS date_day, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month, CAST(isodow(day) AS INTEGER) AS iso_weekday, dayname(day) AS weekday_name,
  monthname(day) AS month_name, CAST(date_trunc('month', day) AS DATE) AS month_start, isodow(day) >= 6 AS is_weekend, month(day) = 12 AND day(day) = 25 AS is_holiday, month(day) = 12 AND day(day) IN (24, 26) AS near_holiday
FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS day)""")
def date_dimension(spark, d):
    ends = table(spark, d, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"), F.max(F.col("o_orderdate").cast("date")).alias("hi"))
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("date_day"))
    day = F.col("date_day")
    holidays = days.where((F.month(day) == 12) & (F.dayofmonth(day) == 25)).select(F.col("date_day").alias("holiday"))
    near = holidays.select(F.explode(F.array(F.date_add("holiday", -1), F.date_add("holiday", 1))).alias("next_to")).distinct()
    out = days.join(holidays, day == F.col("holiday"), "left").join(near, day == F.col("next_to"), "left")
    return out.select("date_day", F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), (F.weekday(day) + 1).alias("iso_weekday"), F.date_format(day, "EEEE").alias("weekday_name"), F.date_format(day, "MMMM").alias("month_name"), F.trunc(day, "MM").alias("month_start"), (F.weekday(day) >= 5).alias("is_weekend"), F.col("holiday").isNotNull().alias("is_holiday"), F.col("next_to").isNotNull().alias("near_holiday"))


@query("""WITH b AS (SELECT event_id, ts, (event_id * 7) % 1440 AS a, (event_id * 13) % 1440 AS b, round((event_id * 37 % 1001) / 1000.0::DOUBLE, 3) AS p FROM events)
SELECT event_id, ((b - a) % 1440 + 1440) % 1440 AS layover, lpad(CAST(a // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a % 60 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 10 ELSE greatest(least(CAST(round_even(p * 10, 0) AS INTEGER), 9), 1) END AS in_ten,
  CAST(least(floor(round(p * 10, 9)), 9) * 10 AS INTEGER) || '-' || CAST(least(floor(round(p * 10, 9)), 9) * 10 + 10 AS INTEGER) || '%' AS decile,
  round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) AS logit,
  round(1 / (1 + exp(-(0.8::DOUBLE * ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) - 0.1::DOUBLE))), 9) AS platt,
  CASE WHEN p * 8 > 5 THEN 'VFR' WHEN p * 8 > 3 THEN 'MVFR' WHEN p * 8 > 1 THEN 'IFR' ELSE 'LIFR' END AS category,
  CAST(date_sub('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS BIGINT) AS minutes_since, epoch_us(ts) // 1000 AS epoch_ms, CAST(hour(ts) AS INTEGER) AS hour FROM b""")
def scalar_functions(spark, d):
    e = F.col("event_id")
    p = F.round((e * 37 % 1001) / 1000.0, 3)
    a, b = (e * 7) % 1440, (e * 13) % 1440
    start = F.lit("2024-01-01 00:00:30").cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "event_id", s.layover(a, b).alias("layover"), s.clock_label(a).alias("clock"), s.in_ten(p).alias("in_ten"), s.decile_label(p).alias("decile"), F.round(s.logit(p), 6).alias("logit"), F.round(s.platt(p, 0.8, -0.1), 9).alias("platt"), s.visibility_category(p * 8).alias("category"),
        F.timestamp_diff("MINUTE", start, F.col("ts")).alias("minutes_since"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"), F.hour(F.col("ts").cast("timestamp")).alias("hour"),
    )


@query("""SELECT o_orderkey, md5('s|' || o_orderkey) AS fingerprint, o_orderpriority || '-' || o_orderstatus AS route_key, ltrim(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '0') AS trimmed, starts_with(ltrim(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '0'), '1') AS in_prefix
FROM orders ORDER BY md5('s|' || o_orderkey), o_orderkey LIMIT 200""")
def hash_ordered_sample(spark, d):
    o = table(spark, d, "orders").withColumn("fingerprint", F.md5(F.concat_ws("|", F.lit("s"), F.col("o_orderkey"))))
    top = o.orderBy("fingerprint", "o_orderkey").limit(200)
    bare = F.ltrim(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("0"))
    return top.select("o_orderkey", "fingerprint", F.concat("o_orderpriority", F.lit("-"), "o_orderstatus").alias("route_key"), bare.alias("trimmed"), bare.startswith("1").alias("in_prefix"))


@query(f"""WITH {LEGS_LINEITEM}, b AS (SELECT flight_number, line, carrier, CAST(least(floor(round(p * 10, 9)), 9) AS INTEGER) AS band, md5(flight_number || '|' || line || '|' || carrier || '|' || service_date) AS h FROM (SELECT DISTINCT flight_number, line, carrier, service_date, p FROM flown))
SELECT band, flight_number, line, carrier FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY h) AS k FROM b) WHERE k <= 5""")
def stratified_sample(spark, d):
    legs = legs_lineitem(spark, d).select("flight_number", "line", "carrier", "service_date", "p")
    keyed = legs.withColumns({"band": F.least(F.floor(F.round(F.col("p") * 10, 9)), F.lit(9)).cast("int"), "h": F.md5(F.concat_ws("|", "flight_number", "line", "carrier", "service_date"))})
    return clean.smallest_digests(keyed, "band", "h", 5).select("band", "flight_number", "line", "carrier")


@query(f"""WITH {LEGS_LINEITEM} SELECT carrier, service_date, count(*) AS legs FROM flown WHERE origin IN (1, 2, 3) AND (dest = 4 OR dest IS NULL OR dest NOT IN (5, 6)) AND dep_hour BETWEEN 6 AND 12 AND starts_with(CAST(flight_number AS VARCHAR), '1') GROUP BY ALL HAVING count(*) > 1""")
def composed_filters(spark, d):
    wanted = F.col("origin").isin(1, 2, 3) & (F.col("dest").isNull() | ~F.col("dest").isin(5, 6)) & F.col("dep_hour").between(6, 12) & F.col("flight_number").cast("string").startswith("1")
    return legs_lineitem(spark, d).where(wanted).groupBy("carrier", "service_date").agg(F.count("*").alias("legs")).where("legs > 1")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL""")
def string_round_trip(spark, d):
    return _through_csv(spark, table(spark, d, "orders").where(F.year(F.col("o_orderdate").cast("date")) == 1996))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def string_round_trip_all(spark, d):
    return _through_csv(spark, table(spark, d, "orders"))


def _through_csv(spark, orders):
    """Written as CSV folders by year and month, read back as strings, typed again."""
    import uuid

    from lathe.session import scratch_root
    from lathe.sources import files

    root = f"{scratch_root(spark)}/lathe-csv-{uuid.uuid4().hex}"
    day = F.col("o_orderdate").cast("date")
    orders = orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("o_totalprice"), F.year(day).alias("year"), F.month(day).alias("month"))
    orders.repartition("year", "month").write.partitionBy("year", "month").option("header", True).csv(root)
    raw = files.read_strings(spark, root, ["o_orderkey", "o_totalprice"])
    typed = raw.select("year", "month", KINDS_NUMBER(F.col("o_totalprice")).alias("price"))
    return typed.groupBy("year", "month").agg(F.count("*").alias("orders"), F.round(F.sum("price"), 2).alias("total"))


KINDS_NUMBER = clean.KINDS["number"]


@query("SELECT user_id, count(*) AS rows, count(*) FILTER (value > 5) AS large FROM events WHERE event_type = 'view' GROUP BY 1")
def json_round_trip(spark, d):
    return _through_json(spark, table(spark, d, "events").where("event_type = 'view'"))


@query("SELECT user_id, count(*) AS rows, count(*) FILTER (value > 5) AS large FROM events GROUP BY 1")
def json_round_trip_all(spark, d):
    return _through_json(spark, table(spark, d, "events"))


def _through_json(spark, events):
    """Written as gzipped JSON lines, read back as strings of which one key is missing."""
    import uuid

    from lathe.session import scratch_root
    from lathe.sources import files

    path = f"{scratch_root(spark)}/lathe-json-{uuid.uuid4().hex}"
    events.select("user_id", "value", "props").write.option("compression", "gzip").json(path)
    raw = files.read_json_strings(spark, path, ["user_id", "value", "absent"]).where("absent IS NULL")
    typed = clean.typed(raw, {"user_id": ("user_id", "whole"), "value": ("value", "number")})
    return typed.groupBy("user_id").agg(F.count("*").alias("rows"), F.count_if(F.col("value") > 5).alias("large"))


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-06-01' GROUP BY ALL")
def pruned_layout(spark, d):
    """Written in month folders sorted by flag, then read by month: other folders are never opened."""
    import uuid

    from lathe.session import scratch_root
    from lathe.sources import files

    path = f"{scratch_root(spark)}/lathe-layout-{uuid.uuid4().hex}"
    files.write_layout(table(spark, d, "lineitem").select("l_shipdate", "l_returnflag", "l_quantity"), path, "l_shipdate", ["l_returnflag"])
    picked = spark.read.parquet(path).where("month >= DATE '1997-03-01' AND month < DATE '1997-06-01'")
    return picked.groupBy(F.col("month").cast("date").alias("month"), "l_returnflag").agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT CAST(month AS DATE) AS month FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-06-01', INTERVAL 1 MONTH)) AS month)")
def month_range(spark, d):
    from lathe.sources import files

    return files.months(spark, "2023-11-01", "2024-06-01")
