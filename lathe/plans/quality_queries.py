"""Quality checks over the bundled tables and the derived relations; several are made to find something."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.operators import chain, quality
from lathe.plans.adapters import LEGS_LINEITEM, legs_events, legs_lineitem, table
from lathe.plans.base import query
from lathe.plans.chain_queries import CHAIN_SQL
from lathe.plans.feature_queries import FEATURES_SQL, features


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark, d):
    return quality.not_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {LEGS_LINEITEM}, c AS (SELECT count(*) FILTER (arr_delay IS NULL) AS a, count(*) FILTER (dep_delay IS NULL) AS b, count(*) FILTER (carrier IS NULL) AS c FROM flown)
SELECT * FROM (SELECT 'arr_delay' AS "column", a AS rows FROM c UNION ALL SELECT 'dep_delay', b FROM c UNION ALL SELECT 'carrier', c FROM c) WHERE rows > 0""")
def check_not_null(spark, d):
    return quality.missing(legs_lineitem(spark, d), ["arr_delay", "dep_delay", "carrier"])


@query("SELECT event_type AS value, count(*) AS rows FROM events WHERE event_type NOT IN ('view', 'purchase') GROUP BY 1")
def check_accepted_values(spark, d):
    return quality.not_accepted(table(spark, d, "events"), "event_type", ["view", "purchase"])


@query(f"""WITH {LEGS_LINEITEM}, c AS (SELECT count(*) FILTER (arr_delay < -30 OR arr_delay > 50) AS a, count(*) FILTER (dep_hour < 0 OR dep_hour > 23) AS b FROM flown)
SELECT * FROM (SELECT 'arr_delay' AS "column", 'warn' AS severity, a AS rows FROM c UNION ALL SELECT 'dep_hour', 'error', b FROM c) WHERE rows > 0""")
def check_ranges(spark, d):
    return quality.out_of_range(legs_lineitem(spark, d), {"arr_delay": (-30, 50, "warn"), "dep_hour": (0, 23, "error")})


@query("SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1")
def check_relationships(spark, d):
    return quality.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_orderkey % 10 <> 0"), "o_orderkey")


@query("""WITH g AS (SELECT l_orderkey, min(l_returnflag) <> max(l_returnflag) AS a, min(l_linestatus) <> max(l_linestatus) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'l_returnflag' AS "column" FROM g WHERE a UNION ALL SELECT l_orderkey, 'l_linestatus' FROM g WHERE b""")
def check_constant_within(spark, d):
    return quality.not_constant(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(f"""WITH {CHAIN_SQL}, v AS (
  SELECT 'turnaround_outside_duty' AS violation FROM chain WHERE NOT coalesce(turnaround_min IS NULL OR turnaround_min BETWEEN 0 AND 840, false)
  UNION ALL SELECT 'band_without_link' FROM chain WHERE NOT (link_class <> 'c' OR band IS NULL)
  UNION ALL SELECT 'known_tail' FROM chain WHERE tail IS NULL
  UNION ALL SELECT 'position_capped' FROM chain WHERE NOT coalesce(rotation_position <= 6, false))
SELECT violation, count(*) AS rows FROM v GROUP BY 1""")
def check_chain_rules(spark, d):
    legs = chain.link(legs_events(spark, d))
    rules = {
        "turnaround_outside_duty": F.col("turnaround_min").isNull() | F.col("turnaround_min").between(0, chain.DUTY_MIN), "band_without_link": (F.col("link_class") != "c") | F.col("band").isNull(),
        "known_tail": F.col("tail").isNotNull(), "position_capped": F.col("rotation_position") <= chain.MOST_POSITION,
    }
    return quality.counts_of(quality.labelled(legs, rules))


@query(f"WITH {FEATURES_SQL} SELECT 'c_rate' AS \"column\", count(*) AS rows, round(max(abs(c_rate - raw)), 6) AS largest FROM (SELECT c_rate, r.rate AS raw FROM features f JOIN rates r ON r.level = 'carrier' AND r.key = CAST(f.carrier AS VARCHAR)) WHERE abs(c_rate - raw) > 1e-9".replace("round(max", "round(max"))
def check_smoothing_moves(spark, d):
    from lathe.plans.feature_queries import _rates

    smooth = features(spark, d).select("flight_number", "line", "service_date", "carrier", F.col("carrier_rate").alias("c_rate"))
    raw = _rates(spark, d).where("level = 'carrier'").select(F.col("key").alias("k"), F.col("rate").alias("raw"))
    both = smooth.join(raw, F.col("carrier").cast("string") == F.col("k")).where(F.abs(F.col("c_rate") - F.col("raw")) > 1e-9)
    return both.agg(F.lit("c_rate").alias("column"), F.count("*").alias("rows"), F.round(F.max(F.abs(F.col("c_rate") - F.col("raw"))), 6).alias("largest"))


@query(f"""WITH {LEGS_LINEITEM}, a AS (SELECT carrier, count(*) AS n, count(*) FILTER (del15) AS late FROM flown GROUP BY 1), b AS (SELECT carrier, count(*) AS n, count(*) FILTER (arr_delay >= 25) AS late FROM flown GROUP BY 1)
SELECT 'late' AS "column", count(*) FILTER (a.late <> b.late) AS rows, max(abs(a.late - b.late))::DOUBLE AS largest FROM a JOIN b USING (carrier) HAVING count(*) FILTER (a.late <> b.late) > 0""")
def check_two_paths(spark, d):
    legs = legs_lineitem(spark, d)
    one = legs.groupBy("carrier").agg(F.count("*").alias("n"), F.count_if("del15").alias("late"))
    two = legs.groupBy("carrier").agg(F.count("*").alias("n"), F.count_if(F.col("arr_delay") >= 25).alias("late"))
    return quality.differing(one, two, ["carrier"], ["n", "late"])


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE month(o_orderdate) <> 7)
SELECT CAST(month AS DATE) AS month FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS month) WHERE CAST(month AS DATE) NOT IN (SELECT month FROM m)""")
def check_months_complete(spark, d):
    months = table(spark, d, "orders").where(F.month("o_orderdate") != 7).select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"))
    return quality.incomplete_months(months, "1995-01-01", "1997-12-01")


@query("SELECT count(*) AS rows, count(*) = 1 AS singleton FROM (SELECT median(o_totalprice) FROM orders)")
def check_singleton(spark, d):
    one = table(spark, d, "orders").agg(F.median("o_totalprice"))
    return one.agg(F.count("*").alias("rows"), (F.count("*") == 1).alias("singleton"))


@query("""WITH s AS (SELECT s_nationkey AS n, count(*) AS rows FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1)
SELECT n_nationkey, coalesce(rows, 0) AS rows FROM nation LEFT JOIN s ON n = n_nationkey WHERE coalesce(rows, 0) <> 1""")
def check_one_per_nation(spark, d):
    """Nations that don't have exactly one of some suppliers."""
    return quality.not_single(table(spark, d, "nation"), "n_nationkey", table(spark, d, "supplier").where("s_suppkey % 4 = 0"), "s_nationkey")


@query("""WITH l AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders WHERE o_custkey % 50 = 7 AND o_totalprice > 200000)
SELECT CAST(g AS DATE) AS month, (SELECT count(*) FROM l WHERE m = CAST(g AS DATE)) AS rows FROM (SELECT unnest(generate_series((SELECT min(m) FROM l), (SELECT max(m) FROM l), INTERVAL 1 MONTH)) AS g)""")
def months_of_large_orders(spark, d):
    """Every month between the first and the last large order of some customers, also those without one."""
    large = table(spark, d, "orders").where("o_custkey % 50 = 7 AND o_totalprice > 200000")
    return quality.months_of(large, "o_orderdate")
