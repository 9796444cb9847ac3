"""Places from free text: region, offset phrase, then a cascade of exact and fuzzy joins, with explicit uncertainty.

A region alone is never given a point. Each stage joins only what earlier stages left, blocked by state or country;
similarity runs on those blocks. A fuzzy match widens the radius by half; "5 miles north of X" moves the point and
makes the radius at least 10 km and 0.3 of the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fuzzy
from ..functions import text as T
from ..session import cut

# ---------------------------------------------------------------- fixed values: names of regions and bearings

STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico",
    "GU": "Guam",
}

STATE_ALIASES = {
    "calif": "CA", "cal": "CA", "fla": "FL", "mass": "MA", "penn": "PA", "penna": "PA", "wash": "WA", "mich": "MI", "minn": "MN", "wis": "WI",
    "wisc": "WI", "tex": "TX", "ariz": "AZ", "colo": "CO", "conn": "CT", "ill": "IL", "ind": "IN", "kans": "KS", "kan": "KS", "nebr": "NE",
    "neb": "NE", "nev": "NV", "okla": "OK", "ore": "OR", "oreg": "OR", "tenn": "TN", "va": "VA", "wyo": "WY", "n.m": "NM", "n. mex": "NM",
    "n.c": "NC", "s.c": "SC", "n.d": "ND", "s.d": "SD", "n.j": "NJ", "n.y": "NY", "n.h": "NH", "w.va": "WV", "w. va": "WV", "d.c": "DC", "ala": "AL",
    "miss": "MS", "mont": "MT", "ark": "AR", "del": "DE", "md": "MD", "vt": "VT", "me": "ME", "ga": "GA", "ky": "KY", "la": "LA", "mo": "MO",
    "oh": "OH", "ut": "UT", "id": "ID", "ia": "IA", "ri": "RI", "alas": "AK", "hawaii": "HI",
}

COUNTRY_ALIASES = {
    "uk": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "great britain": "GB", "united kingdom": "GB", "n. ireland": "GB",
    "northern ireland": "GB", "korea": "KR", "south korea": "KR", "west germany": "DE", "germany": "DE", "japan": "JP", "canada": "CA",
    "france": "FR", "mexico": "MX", "italy": "IT", "spain": "ES", "australia": "AU", "brazil": "BR", "argentina": "AR", "chile": "CL",
    "greenland": "GL", "iceland": "IS", "philippines": "PH", "okinawa": "JP", "newfoundland": "CA", "labrador": "CA", "ontario": "CA", "quebec": "CA",
    "british columbia": "CA", "alberta": "CA", "manitoba": "CA", "saskatchewan": "CA", "nova scotia": "CA", "new brunswick": "CA", "libya": "LY",
    "morocco": "MA", "french morocco": "MA", "saudi arabia": "SA", "turkey": "TR", "iran": "IR", "netherlands": "NL", "holland": "NL",
    "belgium": "BE", "portugal": "PT", "azores": "PT", "bermuda": "BM", "puerto rico": "PR", "guam": "GU", "panama": "PA", "cuba": "CU",
    "venezuela": "VE", "colombia": "CO", "peru": "PE", "new zealand": "NZ", "south africa": "ZA", "india": "IN", "china": "CN", "russia": "RU",
    "ussr": "RU", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "poland": "PL", "austria": "AT", "switzerland": "CH",
    "ireland": "IE", "greece": "GR", "israel": "IL", "egypt": "EG", "vietnam": "VN", "thailand": "TH", "taiwan": "TW", "formosa": "TW",
    "ethiopia": "ET", "pakistan": "PK", "laos": "LA",
}

BEARINGS = {
    "n": 0, "nne": 22.5, "ne": 45, "ene": 67.5, "e": 90, "ese": 112.5, "se": 135, "sse": 157.5, "s": 180, "ssw": 202.5, "sw": 225, "wsw": 247.5,
    "w": 270, "wnw": 292.5, "nw": 315, "nnw": 337.5, "north": 0, "northeast": 45, "east": 90, "southeast": 135, "south": 180, "southwest": 225,
    "west": 270, "northwest": 315,
}


OFFSET = (
    r"^\s*(?:about\s+|approx\.?\s+)?([\d.l]+)\s*(?:-\s*[\d.]+\s*)?(mi|miles?|km|kilometers?|nm|nautical miles?)\.?\s+"
    r"([nsew]{1,3}|north(?:east|west)?|south(?:east|west)?|east|west)\s+(?:of|from)\s+(.*)$"
)
LEAD = r"^(over|near|off|above|in|at|vicinity of|outside|north of|south of|east of|west of)\s+"
BASE_WORDS = r"\b(afb|air force base|air base|nas|naval air station|army airfield|aaf|airport|municipal airport|naval station|army base|field|base|area|vicinity)\b"
IS_BASE = r"\b(afb|air force base|air base|nas|naval air station|army airfield|aaf|naval station|army base|arsenal|proving ground|test range|air station)\b"
#: Least similarity of a base's name, of a base perhaps meant, of a place in its state, and of a place in its country.
SIMILAR_BASE, SIMILAR_MAYBE, SIMILAR_PLACE, SIMILAR_ABROAD = 85, 90, 85, 92


def region(text: Column) -> Column:
    """Struct (country, state) of a region's name: exactly, else by a known name within it; nulls if unknown."""
    raw = F.lower(F.regexp_replace(F.trim(text), r"^\.+|\.+$", ""))
    state = F.coalesce(F.when(F.upper(raw).isin(*STATES), F.upper(raw)), T.lookup(raw, {v.lower(): k for k, v in STATES.items()}), T.lookup(raw, STATE_ALIASES))
    country = T.lookup(raw, COUNTRY_ALIASES)
    country_in = F.coalesce(*[F.when(raw.contains(k), v) for k, v in COUNTRY_ALIASES.items()])
    state_in = F.coalesce(*[F.when(raw.contains(v.lower()), k) for k, v in STATES.items()])
    found_state = F.when(state.isNotNull(), state).when(country.isNull() & country_in.isNull(), state_in)
    return F.struct(F.when(found_state.isNotNull(), "US").otherwise(F.coalesce(country, country_in)).alias("country"), found_state.alias("state"))


def parsed(rows: DataFrame, text: str, default_country: str | None = None) -> DataFrame:
    """``rows`` with country, state, offset_km, bearing, place, base_name, is_base, maybe_base, region_only."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\([^)]*\)", " ")), "(?i)" + LEAD, "")
    parts = F.filter(F.transform(F.split(clean, ","), lambda p: F.trim(p)), lambda p: p != "")
    out = rows.withColumn("__parts", parts).withColumn("__n", F.size("__parts"))
    out = out.withColumn("__region", region(F.try_element_at("__parts", F.lit(-1))))
    known = F.col("__region.country").isNotNull()
    place = F.when((F.col("__n") >= 2) & known, F.array_join(F.slice("__parts", 1, F.col("__n") - 1), ",")).otherwise(F.array_join("__parts", ","))
    out = out.withColumn("region_only", (F.col("__n") == 1) & known).withColumn("__place", place)
    out = out.withColumn("country", F.coalesce("__region.country", F.lit(default_country).cast("string"))).withColumn("state", F.col("__region.state"))
    part = lambda k: F.nullif(F.regexp_extract("__place", "(?i)" + OFFSET, k), F.lit(""))
    unit = F.lower(F.substring(part(2), 1, 1))
    km = F.replace(part(1), F.lit("l"), F.lit("1")).try_cast("double") * F.when(unit == "m", 1.609).when(unit == "n", 1.852).otherwise(1.0)
    out = out.withColumn("offset_km", km).withColumn("bearing", T.lookup(F.lower(part(3)), {k: float(v) for k, v in BEARINGS.items()}))
    name = F.get(F.split(F.get(F.split(F.coalesce(part(4), F.col("__place")), "/"), 0), " and "), 0)
    out = out.withColumn("place", T.ascii_name(name)).withColumn("base_name", F.trim(F.regexp_replace(F.regexp_replace("place", BASE_WORDS, ""), " +", " ")))
    american = F.coalesce(F.col("country") == "US", F.lit(False))
    out = out.withColumn("is_base", american & F.col("place").rlike(IS_BASE))
    maybe = F.when(american, F.col("is_base") | F.col("place").rlike(r"\b(fort|camp)\b")).otherwise(F.col("place").rlike(r"\b(fort|camp|afb|air force base|air base|nas|base|field)\b"))
    return out.withColumn("maybe_base", maybe).drop("__parts", "__n", "__region", "__place")


def _best(left: DataFrame, right: DataFrame, key: str, on: Column, score: Column, least: float, tie: str) -> DataFrame:
    """(key, hit): the best row of ``right`` for each of ``left`` that scores ``least`` or more."""
    met = left.join(right, on).withColumn("__score", score).where(F.col("__score") >= least)
    hit = F.struct("lat", "lon", "radius_km", "precision", "matched", "hit_country")
    return met.groupBy(key).agg(F.max_by(hit, F.struct("__score", tie, "matched")).alias("hit"))


def geocoded(rows: DataFrame, key: str, text: str, places: DataFrame, gazetteer: DataFrame, bases: DataFrame, default_country: str | None = None) -> DataFrame:
    """``rows`` with lat, lon, radius_km, precision, matched, country, state.

    places: name, name_clean, state, lat, lon, area_km2 (one country's places); gazetteer: name, name_clean, country,
    admin1, lat, lon, population; bases: name, name_clean, state, lat, lon.
    """
    asked = cut(parsed(rows.select(key, text), text, default_country))
    todo = asked.where(~F.col("region_only") & (F.length("base_name") > 0))
    site = lambda df, radius, precision, size: df.select(
        "name_clean", F.col("__block"), "lat", "lon", radius.alias("radius_km"), F.lit(precision).alias("precision"), F.col("name").alias("matched"), F.coalesce(size.cast("double"), F.lit(0.0)).alias("size"), (F.col("country") if "country" in df.columns else F.lit("US")).alias("hit_country")
    )
    by_state = lambda df: df.withColumn("__block", F.col("state"))
    area = X.place_radius_km("area_km2", F.lit(None).cast("double"))
    american = F.coalesce(F.col("country") == "US", F.lit(False))
    same_state = F.coalesce(F.col("state") == F.col("__block"), F.col("state").isNull())
    none = F.lit(0.0)
    exact = F.col("name_clean") == F.col("base_name")
    stages = [
        (american & F.col("is_base"), site(by_state(bases), F.lit(10.0), "dod_site", none), same_state, fuzzy.sorted_ratio(F.col("base_name"), F.col("name_clean")), SIMILAR_BASE),
        (american & ~F.col("is_base"), site(by_state(places), area, "place_exact", F.col("area_km2")), exact & same_state, F.lit(100.0), 100),
        (american & F.col("is_base"), site(by_state(places), F.greatest(F.lit(15.0), area), "place_exact_basename", F.col("area_km2")), exact & same_state, F.lit(100.0), 100),
        (american & F.col("maybe_base") & ~F.col("is_base"), site(by_state(bases), F.lit(10.0), "dod_site", none), same_state, fuzzy.sorted_ratio(F.col("place"), F.col("name_clean")), SIMILAR_MAYBE),
        (american & F.col("state").isNotNull() & (F.length(F.col("base_name")) >= 4) & ~F.col("maybe_base"), site(by_state(places), area * 1.5, "place_fuzzy", none), F.col("state") == F.col("__block"), fuzzy.ratio(F.col("base_name"), F.col("name_clean")), SIMILAR_PLACE),
    ]
    people = X.place_radius_km(F.lit(None).cast("double"), "population")
    in_country = gazetteer.withColumn("__block", F.when(F.col("country") == "US", F.concat(F.lit("US/"), F.col("admin1"))).otherwise(F.col("country")))
    blocked = (F.when(F.col("country") == "US", F.concat(F.lit("US/"), F.col("state"))).otherwise(F.col("country")) == F.col("__block")) | (F.col("country").isNull()) | ((F.col("country") == "US") & F.col("state").isNull() & F.col("__block").startswith("US/"))
    stages += [
        (F.length(F.col("base_name")) >= 3, site(in_country, people, "geonames_exact", F.col("population")), exact & blocked, F.lit(100.0), 100),
        (F.col("country").isNotNull() & (F.length(F.col("base_name")) >= 5) & ~F.col("maybe_base"), site(in_country, people * 1.5, "geonames_fuzzy", none), blocked, fuzzy.ratio(F.col("base_name"), F.col("name_clean")), SIMILAR_ABROAD),
    ]
    hits = None
    for who, layer, on, score, least in stages:  # each stage's hits are cut off, so plans don't pile up
        found = cut(_best(todo.where(who), layer, key, on, score, least, "size"))
        todo = todo.join(found.select(key), key, "left_anti")
        hits = found if hits is None else hits.unionByName(found)
    out = asked.join(hits, key, "left")
    moved = X.destination("hit.lat", "hit.lon", "bearing", "offset_km")
    turned, off = F.col("offset_km").isNotNull() & F.col("bearing").isNotNull(), F.col("offset_km").isNotNull()
    radius = F.when(turned, F.greatest(F.lit(10.0), 0.3 * F.col("offset_km"), F.col("hit.radius_km"))).when(off, F.greatest("hit.radius_km", "offset_km")).otherwise(F.col("hit.radius_km"))
    how = F.concat(F.col("hit.precision"), F.when(turned, "+offset").when(off, "+undirected_offset").otherwise(""))
    has = F.col("hit").isNotNull()
    made = out.select(
        key, F.when(turned, moved[0]).otherwise(F.col("hit.lat")).alias("lat"), F.when(turned, moved[1]).otherwise(F.col("hit.lon")).alias("lon"), F.when(has, radius).alias("radius_km"),
        F.when(F.col("region_only"), "region").when(has, how).otherwise("unresolved").alias("precision"), F.col("hit.matched").alias("matched"), F.coalesce("country", "hit.hit_country").alias("country"), "state",
    )
    return rows.join(made, key, "left")
