"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math

import pytest

from lathe.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"logistic_scores", "calibrated_scores", "model_search", "feature_importances", "delay_regression", "isotonic_scores"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    places = [[c[0] for c in want.description].index(c) for c in columns]
    assert ordered(tuple(plain(r[c]) for c in columns) for r in df.collect()) == ordered(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_every_query_is_unique_and_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == SLOW
