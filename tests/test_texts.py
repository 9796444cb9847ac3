"""Negation, plain names, geocoded countries and neighbours of large layers."""

from pyspark.sql import functions as F

from casetide.functions import exprs as X
from casetide.functions import text as T
from casetide.operators import spatial


def test_a_denied_match_is_not_found_again_inside_itself(spark):
    rows = spark.createDataFrame([("not looking like a bright chinese lantern",), ("never seen as an ordinary international space station",), ("no lantern. A lantern, the ISS",), (None,)], "t string")
    got = rows.select(T.affirmed(F.col("t"), T.DESCRIPTIONS["lantern_word"]).alias("a"), T.affirmed(F.col("t"), T.DESCRIPTIONS["iss_word"]).alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (True, True), (False, False)]


def test_plain_names(spark):
    rows = spark.createDataFrame([("Gdańsk",), ("Łódź",), ("St. Étienne",), ("Ft Worth",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.ascii_name(F.col("t")).alias("n")).collect()] == ["gdansk", "odz", "saint etienne", "fort worth", None]


def test_noisy_or_of_a_group_with_nan(spark):
    rows = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (2.0,)], "p double")
    assert rows.where("p <= 0.5 OR p IS NULL OR isnan(p)").agg(X.noisy_or_agg("p").alias("x")).first().x == 0.5


def test_neighbours_of_a_layer_too_large_to_travel(spark, monkeypatch):
    areas = spark.range(60).selectExpr("id AS area", "(id * 37) % 120 - 60.0 AS lat", "(id * 91) % 360 - 180.0 AS lon")
    small = sorted(map(tuple, spatial.neighbours(areas, 5, "area").collect()))
    monkeypatch.setattr(spatial, "INLINE_SITES", 10)
    large = sorted(map(tuple, spatial.neighbours(areas, 5, "area").select("area", "rank", "neighbour", "km").collect()))
    assert [r[:3] for r in large] == [r[:3] for r in small]
