"""The geocoding cascade on a handful of places."""

import pytest
from pyspark.sql import functions as F

from casetide.operators import geocode


def test_cascade(spark):
    places = spark.createDataFrame([("Springfield city", "springfield", "IL", 39.8, -89.6, 150.0), ("Springfield village", "springfield", "IL", 40.0, -90.0, 5.0), ("Saint Paul city", "saint paul", "MN", 44.95, -93.1, 140.0), ("Belleville city", "belleville", "IL", 38.5, -90.0, 60.0)], "name string, name_clean string, state string, lat double, lon double, area_km2 double")
    gazetteer = spark.createDataFrame([("Lyon", "lyon", "FR", "84", 45.75, 4.85, 500000.0), ("Lyon", "lyon", "FR", "11", 40.0, 1.0, 100.0), ("Marseille", "marseille", "FR", "93", 43.3, 5.4, 800000.0)], "name string, name_clean string, country string, admin1 string, lat double, lon double, population double")
    bases = spark.createDataFrame([("Scott AFB", "scott", "IL", 38.54, -89.85)], "name string, name_clean string, state string, lat double, lon double")
    texts = ["Springfield, IL", "10 miles north of St. Paul, Minn.", "Scott Air Force Base, Illinois", "Bellevile, IL", "near Lyon, France", "Marseile, France", "California", "Nowhere at all", None, "Springfield (downtown), Ill."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, place_text string")
    got = {r.id: r for r in geocode.geocoded(rows, "id", "place_text", places, gazetteer, bases).collect()}
    assert (got[0].matched, got[0].precision) == ("Springfield city", "place_exact") and got[0].radius_km == pytest.approx(150**0.5 / 1.5)
    assert got[1].precision == "place_exact+offset" and got[1].lat == pytest.approx(44.95 + 16.09 / 111.19, abs=0.01) and got[1].radius_km == 10.0
    assert (got[2].matched, got[2].precision) == ("Scott AFB", "dod_site")
    assert (got[3].matched, got[3].precision) == ("Belleville city", "place_fuzzy")
    assert (got[4].matched, got[4].lat, got[4].precision) == ("Lyon", 45.75, "geonames_exact")
    assert (got[5].matched, got[5].precision) == ("Marseille", "geonames_fuzzy")
    assert (got[6].precision, got[6].state, got[6].lat) == ("region", "CA", None)
    assert got[7].precision == "unresolved" and got[8].precision == "unresolved"
    assert got[9].matched == "Springfield city"


def test_regions(spark):
    names = ["IL", "illinois", "Calif.", "West Germany", "upper michigan", "somewhere in france", "??"]
    rows = spark.createDataFrame([(n,) for n in names], "t string").select(geocode.region(F.col("t")).alias("r")).collect()
    assert [(r.r.country, r.r.state) for r in rows] == [("US", "IL"), ("US", "IL"), ("US", "CA"), ("DE", None), ("US", "MI"), ("FR", None), (None, None)]
