"""The ranking gate, drift, search within a budget, early stopping, and publishing of a run."""

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from lathe.functions.scalars import platt, usable
from lathe.operators import evaluate, learn
from lathe.plans import adapters, learn_queries
from lathe.sources import files


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(500).select(((F.col("id") * 37 % 500) / 500.0).alias("p"), (F.col("id") * 37 % 500 + F.col("id") % 200 > 300).alias("y")).cache()


def test_only_rising_maps_keep_the_ranking(scored):
    kept = evaluate.ranking_kept(scored, {"platt": platt(F.col("p"), 0.7, 0.1), "tied": F.floor(F.col("p") * 4) / 4, "turned": 1 - F.col("p")})
    assert {r.map: r.passed for r in kept.collect()} == {"raw": True, "platt": True, "tied": False, "turned": False}
    evaluate.refuse(kept, "platt")
    for name in ("tied", "turned", "unknown"):
        with pytest.raises(ValueError, match="doesn't keep the ranking"):
            evaluate.refuse(kept, name)


def test_drift_of_ranking_and_calibration(scored):
    both = scored.withColumn("part", F.lit("a")).unionByName(scored.withColumns({"part": F.lit("b"), "p": F.lit(0.5) * F.col("p")}))
    row = evaluate.drift(both, "part", "a", "b").first()
    assert row.margin_loss == 0.0 and row.ece_growth > 0 and row.calibration_decays_first
    alone = evaluate.drift(both, "part", "a", "c").first()
    assert alone.margin_loss is None and alone.ece_growth is None


def rows(spark, n, noise):
    x = (F.col("id") * 7919 % 1000) / 1000.0
    return spark.range(n).select(x.alias("x"), (F.col("id") % 3).cast("string").alias("c"), ((x + (F.col("id") * 31 % 100) / 100.0 * noise) > 0.5 + noise / 2).cast("double").alias("label"), F.lit(1.0).alias("weight"))


def test_search_stops_at_its_budget_and_scores_test_rows_once(spark):
    train, validation, test = rows(spark, 400, 0.2), rows(spark, 200, 0.3), rows(spark, 100, 0.3)
    candidates = {"noise": learn.classifier("forest", ["weight"], ["c"], numTrees=2, maxDepth=2), "good": learn.classifier("logistic", ["x"], ["c"]), "late": learn.classifier("logistic", ["x"], [])}
    ticks = itertools.count()
    report, out = learn.search_within(train, validation, test, candidates, 2, clock=lambda: next(ticks))
    got = {r.candidate: r for r in report.collect()}
    assert [got[n].fitted for n in candidates] == [True, True, False] and got["late"].average_precision is None
    assert [n for n, r in got.items() if r.chosen] == ["good"] and got["good"].average_precision == max(r.average_precision for r in got.values() if r.fitted)
    assert out.count() == 100 and out.where("p BETWEEN 0 AND 1").count() == 100
    first, _ = learn.search_within(train, validation, test, candidates, 0)
    assert [r.candidate for r in first.where("fitted").collect()] == ["noise"]


def test_boosting_stops_without_gain(spark):
    df = rows(spark, 600, 0.0).withColumns({"label": (F.xxhash64("x") % 2 == 0).cast("double"), "held": F.col("x") > 0.6})
    whole = learn.classifier("boosted", ["x"], [], maxIter=12, maxDepth=3)
    early = learn.stops_early(whole, "held")
    assert len(early.fit(df).stages[-1].trees) < len(whole.fit(df).stages[-1].trees) == 12


def test_usable_values(spark):
    df = spark.createDataFrame([(1.5,), (0.0,), (-2.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in df.select(usable(F.col("v"), F.lit(7.0))).collect()] == [1.5, 7.0, 7.0, 7.0, 7.0, 7.0, 7.0]


def test_a_run_is_published_once_and_whole(spark, tmp_path):
    run, target = tmp_path / "run", tmp_path / "served" / "run"
    run.mkdir()
    for name in ("model.bin", "map.json", "_SUCCESS"):
        (run / name).write_bytes(name.encode() * 50)
    with pytest.raises(ValueError, match="lacks \\['report.json'\\]"):
        files.publish(spark, f"file://{run}", f"file://{target}", ["model.bin", "report.json"])
    assert not target.exists()
    target.mkdir(parents=True)
    (target / "left.over").write_text("of an interrupted copy")
    manifest = files.publish(spark, f"file://{run}", f"file://{target}", ["model.bin"]).collect()
    want = [(n, 50 * len(n), hashlib.sha256(n.encode() * 50).hexdigest()) for n in ("map.json", "model.bin")]
    assert list(map(tuple, manifest)) == want and not (target / "left.over").exists() and not (tmp_path / "served" / "run-staged").exists()
    assert (target / "model.bin").read_bytes() == (run / "model.bin").read_bytes() and not (target / "_SUCCESS").exists()
    marker = json.loads((target / files.MARKER).read_text())
    assert [tuple(f.values()) for f in marker["files"]] == want and marker["required"] == ["model.bin"]
    with pytest.raises(ValueError, match="published"):
        files.publish(spark, f"file://{run}", f"file://{target}", ["model.bin"])


def test_parts_of_the_mart_are_written_once_with_balanced_weights(spark):
    d = "/root/testdata/sf0.001"
    legs = learn.time_split(adapters.legs_lineitem(spark, d).where("del15 IS NOT NULL"), "service_date", learn_queries.CUTS)
    want = {r.part: (r.n, r.late) for r in legs.groupBy("part").agg(F.count("*").alias("n"), F.count_if("del15").alias("late")).collect()}
    for name, part in zip(("validation", "fit", "test"), learn_queries._parts(spark, d, "validation", "fit", "test"), strict=True):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        n, late = want[name]
        weights = {r.label: (r.n, r.weight, r.most) for r in part.groupBy("label").agg(F.count("*").alias("n"), F.min("weight").alias("weight"), F.max("weight").alias("most")).collect()}
        assert {k: v[0] for k, v in weights.items()} == {1.0: late, 0.0: n - late}
        assert all(low == most == pytest.approx(n / (2 * rows) if name == "fit" else 1.0) for rows, low, most in weights.values())
    assert [c.count() for c in learn_queries._parts(spark, d, "none")] == [0]
