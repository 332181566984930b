"""Small operators that no registered query calls: lookups by level, defaults, sparse projection, exports and reports."""

import json

import pytest
from pyspark.sql import functions as F

from lathe.operators import joins, learn
from lathe.session import scratch_root
from lathe.sources import files


def test_level_lookup_and_default(spark):
    levels = spark.createDataFrame([("carrier", "1", 0.5), ("airport", "1", 0.25), ("airport", "2", None)], "level string, key string, rate double")
    fact = spark.createDataFrame([(1, 2), (3, 1), (None, None)], "carrier int, origin int")
    out = joins.level_lookup(fact, levels, {"c": ("carrier", F.col("carrier").cast("string")), "o": ("airport", F.col("origin").cast("string"))}, ["rate"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 2, 0.5, None), (3, 1, None, 0.25), (None, None, None, None)], key=str)


def test_default_for_misses(spark):
    lookup = spark.createDataFrame([("a", 0.5)], "k string, rate double")
    out = joins.with_default(spark.createDataFrame([("a",), ("z",), (None,)], "k string"), lookup, "k", ["rate"], spark.createDataFrame([(0.1,)], "rate double"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 0.5), ("z", 0.1), (None, 0.1)], key=str)


def test_sparse_frames_become_one(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2.5, True)], "id double, extra boolean")
    assert sorted(map(tuple, files.project_sparse([a, b], ["id", "name"]).collect())) == [("1", "x"), ("2.5", None)]


def test_exports_and_reports(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.when(F.col("id") > 0, 10 - F.col("id")))
    files.export_once(df, f"{tmp_path}/e")
    files.export_once(df.limit(1), f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 5
    found = files.freshness(spark, f"{tmp_path}/e").first()
    assert found.files >= 1 and found.bytes > 0 and found.newest is not None
    for _ in range(2):
        files.write_report(df, f"{tmp_path}/r", ["v"])
    rows = [json.loads(line) for part in sorted((tmp_path / "r").glob("part-*")) for line in part.read_text().splitlines()]
    assert [r["id"] for r in rows] == [0, 4, 3, 2, 1] and rows[0] == {"id": 0, "v": None}


def test_scratch_needs_a_shared_folder_off_a_local_master(spark):
    class Conf:
        def __init__(self, root):
            self.get = lambda key, default: root

    class Session:
        def __init__(self, master, root):
            self.sparkContext, self.conf = type("Context", (), {"master": master}), Conf(root)

    assert scratch_root(Session("spark://h:7077", "hdfs://n/c/")) == "hdfs://n/c"
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_root(Session(master, None))


def test_coefficients_are_named_by_their_values(spark):
    rows = [(float(i % 5), "abc"[i % 3], float(i % 3 == 1), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, kind string, label double, weight double")
    named = learn.importances(learn.classifier("logistic", ["x"], ["kind"]).fit(df), ["x"], ["kind"])
    assert {n for n, _ in named} == {"x", "kind=a", "kind=b", "kind=c", "kind=unknown"} and named[0][0] == "kind=b"
