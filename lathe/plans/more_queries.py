"""Reference builds, rankings, texts, forecast layers, models and guarded reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.functions import weather
from lathe.operators import chain, evaluate, learn, quality
from lathe.operators.clean import first_of
from lathe.plans.adapters import CUTOFF, LEGS_LINEITEM, legs_events, legs_lineitem, table
from lathe.plans.base import query
from lathe.plans.chain_queries import CHAIN_SQL
from lathe.plans.evaluate_queries import SCORED, scored
from lathe.plans.learn_queries import CATEGORIES, NUMBERS, _parts


@query("""WITH f AS (SELECT s_nationkey AS code, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 20)
SELECT code, s_suppkey AS id, s_name AS name, coalesce(n_name, 'unknown') AS zone, false AS supplement FROM f LEFT JOIN nation ON n_nationkey = code WHERE k = 1
UNION ALL SELECT n_nationkey, -1, n_name, n_name, true FROM nation WHERE n_nationkey NOT IN (SELECT code FROM f)""")
def reference_build(spark, d):
    """The first usable row of each code, its zone filled in, and supplements for codes without any."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("_key"), "n_name")
    kept = table(spark, d, "supplier").where("s_acctbal > 0 AND s_nationkey < 20")
    base = first_of(kept, ["s_nationkey"], [F.col("s_suppkey")]).join(nation, F.col("s_nationkey") == F.col("_key"), "left")
    base = base.select(F.col("s_nationkey").alias("code"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.coalesce("n_name", F.lit("unknown")).alias("zone"), F.lit(False).alias("supplement"))
    gaps = nation.join(base.select(F.col("code").alias("_key")), "_key", "left_anti")
    return base.unionByName(gaps.select(F.col("_key").alias("code"), F.lit(-1).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("zone"), F.lit(True).alias("supplement")))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, CAST(sum(o_custkey % 2) AS BIGINT) AS odd FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY 1")
def yearly_union(spark, d):
    """Tables of single years, as they would lie in a catalog, as one."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    years = [o.where(F.col("year") == y) for y in (1995, 1996, 1997)]
    return reduce(lambda a, b: a.unionByName(b), years).groupBy("year").agg(F.count("*").alias("orders"), F.sum(F.col("o_custkey") % 2).alias("odd"))


@query("SELECT * EXCLUDE (k) FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS ends, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_registry(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("ends"))
    return first_of(o, ["o_custkey"], [F.col("ends").desc_nulls_last(), F.col("o_orderkey")])


@query(f"""WITH {SCORED}, u AS (SELECT DISTINCT origin, dest, carrier, flight_number, line, service_date, dep_hour, p, y FROM s WHERE origin = 5)
SELECT dep_hour, CAST(carrier AS VARCHAR) || ' ' || flight_number AS flight, dest, p, y FROM u ORDER BY p DESC, dep_hour, flight_number, line, carrier, dest, service_date LIMIT 10""")
def contact_ranking(spark, d):
    one = scored(spark, d).where("origin = 5").select("origin", "dest", "carrier", "flight_number", "line", "service_date", "dep_hour", "p", "y").distinct()
    top = one.orderBy(F.desc("p"), "dep_hour", "flight_number", "line", "carrier", "dest", "service_date").limit(10)
    return top.select("dep_hour", F.concat_ws(" ", "carrier", "flight_number").alias("flight"), "dest", "p", "y")


@query(f"""WITH {SCORED}, b AS (SELECT avg(y::INT) AS base FROM s) SELECT CASE WHEN p < base * 0.5 THEN 'well below usual' WHEN p < base * 0.85 THEN 'below usual' WHEN p <= base * 1.15 THEN 'about usual' WHEN p <= base * 1.5 THEN 'above usual' ELSE 'well above usual' END AS phrase, count(*) AS legs FROM s, b GROUP BY 1""")
def base_rate_phrases(spark, d):
    s = scored(spark, d)
    base = s.agg(F.avg(F.col("y").cast("int"))).scalar()
    s = s.withColumn("base", base)
    p, b = F.col("p"), F.col("base")
    phrase = F.when(p < b * 0.5, "well below usual").when(p < b * 0.85, "below usual").when(p <= b * 1.15, "about usual").when(p <= b * 1.5, "above usual").otherwise("well above usual")
    return s.groupBy(phrase.alias("phrase")).agg(F.count("*").alias("legs"))


@query("""WITH t AS (SELECT event_id, ['-RA', '+TSRA', 'VCTS', 'BR', '-SN', 'VCFG', 'DZ'][event_id % 7 + 1] AS a, ['FG', 'VCSH', '-PL'][event_id % 3 + 1] AS b FROM events),
u AS (SELECT event_id, CASE WHEN a LIKE 'VC%' THEN '' ELSE a END AS a, CASE WHEN b LIKE 'VC%' THEN '' ELSE b END AS b FROM t)
SELECT event_id, a LIKE '%FG%' OR a LIKE '%BR%' OR b LIKE '%FG%' OR b LIKE '%BR%' AS had_fog, a LIKE '%RA%' OR a LIKE '%DZ%' AS had_rain, a LIKE '%SN%' OR b LIKE '%PL%' AS had_snow, a LIKE '%TS%' AS had_thunder FROM u""")
def report_tokens(spark, d):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    listed = F.concat(F.lit("['"), pick(("-RA", "+TSRA", "VCTS", "BR", "-SN", "VCFG", "DZ"), 7), F.lit("', '"), pick(("FG", "VCSH", "-PL"), 3), F.lit("']"))
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in weather.token_flags(listed).items()])


@query("""WITH g AS (SELECT unnest(range(0, 60)) AS i), l AS (SELECT i, TIMESTAMP '2024-01-01' + to_hours(i * 12) AS start, CASE WHEN i % 4 = 0 THEN 36 ELSE 1 + i % 11 END AS hours, i * 1.5::DOUBLE AS v, i % 3 <> 0 AS kmh FROM g)
SELECT event_id, count(*) AS layers, round(sum(CASE WHEN kmh THEN v / 1.852::DOUBLE END), 6) AS knots, round(sum(v / hours), 6) AS per_hour FROM (SELECT event_id, ts FROM events WHERE event_type = 'signup') e JOIN l ON ts >= start AND ts < start + to_hours(hours) GROUP BY 1""")
def forecast_layers(spark, d):
    """Layers of ISO intervals met by instants: joined on the days that an interval touches, then tested exactly."""
    i = F.col("i")
    start = F.date_format(F.timestamp_seconds(F.lit(1704067200) + i * 12 * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    span = F.when(i % 4 == 0, "P1DT12H").otherwise(F.concat(F.lit("PT"), (1 + i % 11).cast("string"), F.lit("H")))
    layers = spark.range(60).select(F.col("id").alias("i")).select(F.concat(start, F.lit("+00:00/"), span).alias("iso"), (i * 1.5).alias("v"), F.when(i % 3 != 0, "km_h-1").otherwise("m_s-1").alias("unit"))
    first = F.to_date(weather.interval_start(F.col("iso")))
    touched = layers.withColumn("day", F.explode(F.sequence(first, F.date_add(first, F.ceil(weather.interval_hours(F.col("iso")) / 24).cast("int")))))
    asked = table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.col("ts").cast("timestamp").alias("at")).withColumn("day", F.to_date("at"))
    met = asked.join(touched, "day").where(weather.covers(F.col("iso"), F.col("at")))
    return met.groupBy("event_id").agg(F.count("*").alias("layers"), F.round(F.sum(weather.knots(F.col("v"), F.col("unit"))), 6).alias("knots"), F.round(F.sum(F.col("v") / weather.interval_hours(F.col("iso"))), 6).alias("per_hour"))


@query(f"""WITH {SCORED} SELECT service_date, origin, count(*) AS n, round(sum(p), 6) AS expected, count(*) FILTER (y) AS actual FROM s WHERE origin = 7 AND service_date >= DATE '{CUTOFF}' GROUP BY ALL""")
def airport_day_replay(spark, d):
    """Days after the cutoff alone: the training window is refused by the same constant that fits the rates."""
    asked = scored(spark, d).where((F.col("origin") == 7) & (F.col("service_date") >= F.lit(CUTOFF).cast("date")))
    return asked.groupBy("service_date", "origin").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("expected"), F.count_if("y").alias("actual"))


@query(f"""WITH {CHAIN_SQL} SELECT CASE WHEN event_id % 10 = 0 THEN 'warmup' WHEN link_class = 'a' THEN 'consistent' WHEN link_class = 'b' THEN 'clean_first' ELSE 'swap_null' END AS basis, CASE WHEN elapsed_min IS NULL THEN 'null_path' WHEN elapsed_min < 100 THEN 'observed' ELSE 'forecast' END AS weather_basis, count(*) AS legs FROM chain GROUP BY ALL""")
def prediction_basis(spark, d):
    kind = F.col("link_class")
    basis = F.when(F.col("event_id") % 10 == 0, "warmup").when(kind == "a", "consistent").when(kind == "b", "clean_first").otherwise("swap_null")
    sky = F.when(F.col("elapsed_min").isNull(), "null_path").when(F.col("elapsed_min") < 100, "observed").otherwise("forecast")
    return chain.link(legs_events(spark, d)).groupBy(basis.alias("basis"), sky.alias("weather_basis")).agg(F.count("*").alias("legs"))


@query(f"""WITH {SCORED}, b AS (SELECT CASE WHEN dep_hour < 3 THEN '0_3' WHEN dep_hour < 6 THEN '3_6' WHEN dep_hour < 12 THEN '6_12' ELSE 'ge_12' END AS horizon, p, round(1 - p, 6) AS q, y FROM s),
x AS (SELECT horizon, 'p' AS score, p AS v, y FROM b UNION ALL SELECT horizon, 'q', q, y FROM b), t AS (SELECT horizon, score, v, count(*) AS n, count(*) FILTER (y) AS pos FROM x GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (PARTITION BY horizon, score ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT horizon, score, sum(n) AS n, sum(pos * (cp::DOUBLE / cn)) / sum(pos) AS ap FROM c GROUP BY ALL)
SELECT horizon, CAST(max(n) AS BIGINT) AS n, round(max(ap) FILTER (score = 'p'), 9) AS observed, round(max(ap) FILTER (score = 'q'), 9) AS substituted, round(max(ap) FILTER (score = 'p') - max(ap) FILTER (score = 'q'), 6) AS loss FROM a GROUP BY horizon""")
def substitution_study(spark, d):
    """Average precision by horizon of a score and of what replaces it, and the loss between them."""
    h = F.col("dep_hour")
    s = scored(spark, d).withColumn("horizon", F.when(h < 3, "0_3").when(h < 6, "3_6").when(h < 12, "6_12").otherwise("ge_12"))
    one = evaluate.ranking_metrics(s, ["horizon"]).select("horizon", "n", F.col("average_precision").alias("observed"))
    two = evaluate.ranking_metrics(s.withColumn("p", F.round(1 - F.col("p"), 6)), ["horizon"]).select("horizon", F.col("average_precision").alias("substituted"))
    return one.join(two, "horizon").withColumn("loss", F.round(F.col("observed") - F.col("substituted"), 6))


@query(f"""WITH {LEGS_LINEITEM} SELECT origin, dest, dep_hour, min(struct_pack(d := service_date, f := flight_number, l := line, c := carrier)).f AS flight_number, min(struct_pack(d := service_date, f := flight_number, l := line, c := carrier)).c AS carrier, count(*) AS legs FROM flown WHERE origin < 5 GROUP BY ALL""")
def one_schedule_row(spark, d):
    first = F.min(F.struct("service_date", "flight_number", "line", "carrier"))
    out = legs_lineitem(spark, d).where("origin < 5").groupBy("origin", "dest", "dep_hour").agg(first.alias("s"), F.count("*").alias("legs"))
    return out.select("origin", "dest", "dep_hour", "s.flight_number", "s.carrier", "legs")


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT carrier, month(service_date) AS m FROM flown WHERE origin = 1), b AS (SELECT carrier, month(service_date) AS m FROM flown WHERE dest = 2 AND cancelled)
SELECT 'both' AS side, count(*) AS pairs FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, d):
    legs = legs_lineitem(spark, d).withColumn("m", F.month("service_date"))
    a, b = legs.where("origin = 1").select("carrier", "m"), legs.where("dest = 2 AND cancelled").select("carrier", "m")
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("pairs"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first only"))


@query(f"WITH {CHAIN_SQL}, e AS (SELECT event_id, tail, dep_ts, link_class, band, lead(dep_ts) OVER (PARTITION BY tail ORDER BY dep_ts, event_id) AS next_ts FROM chain WHERE tail IS NOT NULL) SELECT tail, count(*) AS legs, count(*) FILTER (next_ts IS NULL) AS last_legs, sha256(string_agg(event_id || ':' || link_class, ',' ORDER BY dep_ts, event_id)) AS digest FROM e GROUP BY tail")
def ordered_digest(spark, d):
    """A digest of each tail's chain in order: equal for two runs only if they agree leg by leg."""
    legs = chain.link(legs_events(spark, d)).where("tail IS NOT NULL")
    ahead = F.lead("dep_ts").over(W.Window.partitionBy("tail").orderBy("dep_ts", "event_id"))
    listed = F.sort_array(F.collect_list(F.struct("dep_ts", "event_id", F.concat_ws(":", "event_id", "link_class").alias("x"))))
    out = legs.withColumn("next_ts", ahead).groupBy("tail").agg(F.count("*").alias("legs"), F.count_if(F.col("next_ts").isNull()).alias("last_legs"), listed.alias("l"))
    return out.select("tail", "legs", "last_legs", F.sha2(F.array_join(F.transform("l", lambda s: s["x"]), ","), 256).alias("digest"))


@query()
def feature_importances(spark, d):
    (fit,) = _parts(spark, d, "fit")
    model = learn.classifier("forest", NUMBERS, CATEGORIES, numTrees=6, maxDepth=4).fit(fit)
    return spark.createDataFrame(learn.importances(model, NUMBERS, CATEGORIES), "feature string, importance double")


@query()
def delay_regression(spark, d):
    """Boosted regression of the delay against the mean, on rows after the fit."""
    fit, validation = _parts(spark, d, "fit", "validation")
    model = learn.regressor(NUMBERS, CATEGORIES, "arr_delay", maxIter=4, maxDepth=3).fit(fit)
    off = F.col("prediction") - F.col("arr_delay")
    return model.transform(validation).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(off * off)), 4).alias("rmse"), F.round(F.avg(F.abs(off)), 4).alias("mae"))


@query()
def isotonic_scores(spark, d):
    """Calibration errors of the made-up score before and after isotonic regression fitted on earlier legs."""
    s = learn.time_split(scored(spark, d), "service_date", {"fit": "1997-01-01"}).withColumn("label", F.col("y").cast("double"))
    quality.check_columns(s.select("p", "y", "label"), ["p", "y", "label"])
    model = learn.fit_isotonic(s.where("part = 'fit'"))
    after = model.transform(s.where("part = 'test'")).withColumn("p", F.col("prediction"))
    raw = evaluate.calibration_errors(s.where("part = 'test'")).withColumn("calibration", F.lit("raw"))
    return raw.unionByName(evaluate.calibration_errors(after).withColumn("calibration", F.lit("isotonic")))
