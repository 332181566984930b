"""Shapes of physical plans: shuffles, columns read, joins that stay hashable."""

import re

import pytest
from pyspark.sql import functions as F

from lathe.operators import chain, evaluate, joins
from lathe.plans.adapters import legs_events, legs_lineitem, table
from lathe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


def test_chain_has_one_shuffle_by_tail_and_one_for_density(spark):
    text = plan(chain.link(legs_events(spark, SF)).where("link_class = 'a'"))
    assert len(re.findall(r"hashpartitioning\(tail", text)) == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_as_of_is_one_shuffle_without_a_join(spark):
    e = table(spark, SF, "events")
    out = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.select("user_id", "ts", F.col("value")), "user_id", "ts", ["value"], 3600)
    assert shuffles(out) == 1 and "Join" not in plan(out)


def test_rates_scan_once(spark):
    assert plan(QUERIES["historical_rates"](spark, SF)).count("FileScan") == 1


def test_marts_read_only_their_columns(spark):
    text = plan(legs_lineitem(spark, SF).groupBy("carrier").agg(F.sum("p")))
    assert re.search(r"ReadSchema: struct<([^>]*)>", text)[1].count(":") == 3


def test_null_safe_keys_are_equi_keys(spark):
    text = plan(QUERIES["null_safe_join"](spark, SF))
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join", text) and "NestedLoop" not in text


def test_display_filter_stays_above_the_chain(spark):
    legs = chain.link(legs_events(spark, SF))
    shown = {r.event_id: r.rotation_position for r in legs.where("origin = 1").collect()}
    whole = {r.event_id: r.rotation_position for r in legs.collect() if r.origin == 1}
    assert shown == whole


@pytest.mark.parametrize("name", ["chain_links", "ranking_metrics", "feature_mart", "outcome_settlement", "deduplicated_lines"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_metrics_by_hand(spark):
    rows = [(0.9, True), (0.8, False), (0.8, True), (0.3, True), (0.1, False)]
    got = evaluate.ranking_metrics(spark.createDataFrame(rows, "p double, y boolean")).first()
    precision = (1 * 1 / 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3
    wins = (2 + 1.5 + 1) / 6
    assert abs(got.average_precision - precision) < 1e-9 and abs(got.roc_auc - wins) < 1e-9 and (got.n, got.positives) == (5, 3)
