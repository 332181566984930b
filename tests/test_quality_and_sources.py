"""Guards find what is broken; sources keep strings, layouts prune."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lathe.functions import scalars as s
from lathe.operators import quality
from lathe.sources import files


def test_column_gates():
    class Frame:
        columns = ["a", "b"]

    quality.check_columns(Frame, ["a", "b"])
    for required, forbidden in ((["a"], []), (["b", "a"], []), (["a", "b", "c"], []), (["a", "b"], ["b"])):
        with pytest.raises(ValueError):
            quality.check_columns(Frame, required, forbidden)


def test_knowable_gate():
    field = lambda name, when: StructField(name, StringType(), metadata={"knowable_at": when} if when else {})
    quality.check_knowable(StructType([field("a", "schedule")]), ["schedule"])
    for when in ("post_departure", None):
        with pytest.raises(ValueError, match="b"):
            quality.check_knowable(StructType([field("a", "schedule"), field("b", when)]), ["schedule"])


def test_rules_fail_closed(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id long, v long")
    got = quality.labelled(df, {"small": F.col("v") < 10}, ["id"]).collect()
    assert sorted((r.id, r.violation) for r in got) == [(2, "small"), (3, "small")]


def test_differing_treats_null_and_nan_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0)], "id long, v double")
    b = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.5)], "id long, v double")
    assert [(r.column, r.rows, r.largest) for r in quality.differing(a, b, ["id"], ["v"]).fillna(0).collect()][0][:2] == ("v", 1)


def test_clock_and_numbers(spark):
    rows = spark.createDataFrame([("2400",), ("5",), ("2575",), ("",), (None,), ("0059",)], "t string")
    assert [r[0] for r in rows.select(s.clock_minutes(F.col("t"))).collect()] == [0, 5, None, None, None, 59]
    rows = spark.createDataFrame([("1.0",), ("61.5",), (" ",), ("x",)], "t string")
    assert [r[0] for r in rows.select(s.whole(F.col("t"))).collect()] == [1, 62, None, None]


def test_local_clock_gap_and_fold(spark):
    rows = spark.createDataFrame([(dt.date(2024, 3, 10), 150), (dt.date(2024, 11, 3), 90)], "day date, m int")
    got = [r[0] for r in rows.select(s.utc_from_local(F.col("day"), F.col("m"), "America/New_York").cast("string")).collect()]
    assert got == ["2024-03-10 07:30:00", "2024-11-03 05:30:00"]


def test_decoding_keeps_without_quality_and_capped_keeps_null(spark):
    rows = spark.createDataFrame([("+0100,1", 5.0), ("+0100", 20.0), ("+0100,2", None), ("+9999,1", 1.0), (None, 1.0)], "p string, v double")
    got = rows.select(s.decoded(F.col("p"), 0, 1, 9999).alias("d"), s.capped(F.col("v"), 10).alias("c")).collect()
    assert [r.d for r in got] == [100, 100, None, None, None]
    assert [r.c for r in got][:3] == [5.0, 10.0, None]


def test_natural_frequency_never_promises(spark):
    rows = spark.createDataFrame([(0.0,), (0.001,), (0.25,), (0.999,), (1.0,)], "p double")
    assert [r[0] for r in rows.select(s.in_ten(F.col("p"))).collect()] == [0, 1, 2, 9, 10]


def test_strings_and_layout(spark, tmp_path):
    with pytest.raises(ValueError):
        files.string_schema(["a", "a"])
    assert files.string_schema(["Year", ""], {"Year": "Year_file"}).fieldNames() == ["Year_file", "trailing_empty"]
    root = f"{tmp_path}/csv"
    spark.createDataFrame([("01", 2024, 1)], "code string, year int, month int").write.partitionBy("year", "month").option("header", True).csv(root)
    row = files.read_strings(spark, root, ["code"]).first()
    assert (row.code, row.year, row.month) == ("01", 2024, 1)
    assert files.header(spark, f"{root}/year=2024/month=1") == ["code"]
    days = spark.createDataFrame([(dt.date(2024, m, d), d) for m in (1, 2) for d in range(1, 20)], "day date, v int")
    files.write_layout(days, f"{tmp_path}/lay", "day", ["v"])
    plan = spark.read.parquet(f"{tmp_path}/lay").where("month = DATE '2024-01-01'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    problems = files.check_landing(days.withColumn("y", F.lit("2023")), ["day"], {"y": "2024"}, 1, 10).collect()
    assert {p.problem for p in problems} == {"row count", "other y"}


def test_entry_without_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['lathe.llm'] = None\nimport __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert len(e.queries()) > 60"
    code = code.replace("sys.modules['lathe.llm'] = None", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith('lathe.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0], timeout=120)


def test_channels_and_round_trips_take_every_row(spark):
    import zlib
    from collections import Counter

    from lathe.plans.adapters import legs_events
    from lathe.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    tails = [r.tail for r in legs_events(spark, sf).select("tail").collect()]
    want = Counter(0 if t is None else 1 + zlib.crc32(str(t).encode()) % 5 for t in tails)
    assert {r.channel: r.legs for r in QUERIES["stream_all_channels"](spark, sf).collect()} == want and len(want) == 6
    for name, column, rows in (("string_round_trip_all", "orders", "orders"), ("json_round_trip_all", "rows", "events")):
        assert sum(r[column] for r in QUERIES[name](spark, sf).collect()) == spark.read.parquet(f"{sf}/{rows}.parquet").count()


def test_smallest_digests_sort_a_share_of_the_rows(spark, monkeypatch):
    """Copies, small groups and a null group against a plain version; what is sorted whole is few rows of many."""
    import hashlib

    from lathe.operators import clean

    rows = [(None if i % 7 == 0 else i % 3, i // 2 % 9000, hashlib.md5(str((i % 21, i // 2 % 9000)).encode()).hexdigest()) for i in range(40_000)] + [(99, 1, "ff01"), (99, 2, "ff02")]
    df = spark.createDataFrame(rows, "band int, item long, h string")
    heads, plain = [], clean.materialise
    monkeypatch.setattr(clean, "materialise", lambda found, name: heads.append(plain(found, name)) or heads[-1])
    got = clean.smallest_digests(df, "band", "h", 5).collect()
    want = {b: sorted({(h, x) for g, x, h in rows if g == b})[:5] for b in {r[0] for r in rows}}
    assert {b: sorted((r.h, r.item) for r in got if r.band == b) for b in want} == want and len(got) == sum(map(len, want.values()))
    most = {r._group: r._most for r in heads[0].collect()}
    assert sum(r[2][:3] <= most[r[0]] for r in rows) < 400
