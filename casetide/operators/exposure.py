"""Exposures derived from raw covariates, cohorts and subsets: configuration tables and column predicates.

A derived exposure is null wherever a raw dependency is: missing is never zero.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite

#: Binary exposures: raw column, comparison, threshold (fixed values).
THRESHOLDS = {
    "kp_storm5_prior24h": ("kp_max_prior24h", ">=", 5),
    "kp_storm7_prior24h": ("kp_max_prior24h", ">=", 7),
    "dst_storm50_prior24h": ("dst_min_prior24h", "<=", -50),
    "dst_storm100_prior72h": ("dst_min_prior72h", "<=", -100),
    "ae_substorm500_prior6h": ("ae_max_prior6h", ">=", 500),
    "bz_south10_prior3h": ("bz_min_prior3h", "<=", -10),
    "hss600_prior24h": ("v_max_prior24h", ">=", 600),
    "f107_ge172": ("F107", ">=", 172),
    "proton_event_prior24h": ("pflux10_max_prior24h", ">=", 10),
    "flareMX_any_prior24h": ("n_flareMX_prior24h", ">", 0),
    "shower50": ("shower_zhr_total", ">=", 50),
    "fireball_30m_1000": ("n_fb_pm30m_1000km", ">", 0),
    "launch_3h_1500": ("n_launch_lpost3h_1500km", ">", 0),
    "wx_clear": ("wx_sky_oktas", "<=", 2),
    "wx_overcast": ("wx_sky_oktas", ">=", 7),
    "wx_front_pressure_fall": ("wx_dslp_24h", "<=", -8),
    "wx_clearing_6h": ("wx_dsky_6h", "<=", -4),
    "wx_precip_any": ("wx_precip_1h_mm", ">", 0),
}
#: Prefixes of count columns that have an ``any_`` form, and radii of ``within`` flags in km (fixed values).
COUNT_PREFIXES = ("n_eq_", "n_eq4_", "n_storm_", "n_gquake_", "n_gstorm_", "n_glaunch_")
WITHIN_KM = (1, 5, 10, 25, 50, 100, 250, 500)

_COMPOSITE: dict[str, tuple[tuple[str, ...], object]] = {
    "log_wiki_views": (("wiki_ufo_views",), lambda v: F.log10(F.when(v > 0, v))),
    "moon_up_illum": (("moon_alt", "moon_illum"), lambda a, i: (a > 0).cast("double") * i),
    "moon_full_up": (("moon_alt", "moon_illum"), lambda a, i: ((a > 0) & (i > 0.9)).cast("double")),
    "venus_vis": (("venus_alt", "sun_alt", "venus_elong"), lambda v, s, e: ((v > 3) & (s < -3) & (e > 15)).cast("double")),
    "starlink_10d": (("days_since_starlink_launch", "starlink_era"), lambda d, e: F.when(e > 0, (d <= 10).cast("double"))),
    "wx_cold_front_proxy": (("wx_dtemp_24h", "wx_dslp_24h"), lambda t, p: ((t <= -8) & (p > 0)).cast("double")),
    "wx_inversion_night": (("wx_inversion_proxy", "sun_alt"), lambda w, s: w * (s < -6).cast("double")),
}


def _above(raw: str, sign: str, limit: float) -> Column:
    x = finite(F.col(raw).cast("double"))
    hit = x >= limit if sign == ">=" else x <= limit if sign == "<=" else x > limit
    return F.when(x.isNotNull(), hit.cast("double"))


def exposure(variable: str) -> tuple[list[str], Column]:
    """(raw columns, expression) of an exposure by its name."""
    if variable in THRESHOLDS:
        raw, sign, limit = THRESHOLDS[variable]
        return [raw], _above(raw, sign, limit)
    if variable.startswith("any_") and f"n_{variable[4:]}".startswith(COUNT_PREFIXES):
        return [f"n_{variable[4:]}"], _above(f"n_{variable[4:]}", ">", 0)
    if variable in _COMPOSITE:
        raws, make = _COMPOSITE[variable]
        values = [finite(F.col(r).cast("double")) for r in raws]
        return list(raws), F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), make(*values))
    if m := re.fullmatch(r"log_(dist_.+_km)", variable):
        return [m[1]], F.log10(F.greatest(F.lit(0.5), finite(F.col(m[1]).cast("double")))) * F.when(finite(F.col(m[1]).cast("double")).isNotNull(), 1.0)
    if m := re.fullmatch(r"within(\d+)_(.+)", variable):
        return [f"dist_{m[2]}_km"], _above(f"dist_{m[2]}_km", "<=", float(m[1]))
    return [variable], finite(F.col(variable).cast("double"))


def derived(points: DataFrame) -> DataFrame:
    """``points`` with every exposure its raw columns allow; derived columns without their raw ones are dropped."""
    have = set(points.columns)
    names = [*THRESHOLDS, *_COMPOSITE]
    names += [f"any_{c[2:]}" for c in points.columns if c.startswith(COUNT_PREFIXES)]
    for c in points.columns:
        if c.startswith("dist_") and c.endswith("_km"):
            names += [f"log_{c}", *[f"within{r}_{c[5:-3]}" for r in WITHIN_KM]]
    made = {n: e for n, (raws, e) in ((n, exposure(n)) for n in dict.fromkeys(names)) if set(raws) <= have}
    pattern = re.compile(r"any_.+|log_dist_.+_km|within\d+_.+")
    stale = [c for c in points.columns if c not in made and (c in THRESHOLDS or c in _COMPOSITE or (pattern.fullmatch(c) and exposure(c)[0] != [c]))]
    return points.drop(*stale).withColumns(made)


def control_exposures() -> dict[str, Column]:
    """Exposures of the positive controls: null wherever a column they need is. Darkness is the Sun below -12 degrees,
    twilight between -20 and -3."""
    n = lambda c: finite(F.col(c).cast("double"))
    both = lambda flag, *needs: F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in needs]), flag.cast("double"))
    sun, pad, age, era = n("sun_alt"), n("n_launch_lpost3h_1500km"), n("days_since_starlink_launch"), n("starlink_era")
    dark, twilight = sun < -12, (sun < -3) & (sun > -20)
    zhr, venus, elong, moon, light = n("shower_zhr_total"), n("venus_alt"), n("venus_elong"), n("moon_alt"), n("moon_illum")
    mmdd, sky, burst = F.col("mmdd"), n("wx_sky_oktas"), n("meteor_outburst_pm1d")
    return {
        "x_shower50": both((zhr >= 50) & dark, zhr, sun), "x_shower_zhr": zhr,
        "x_fireball_30m_1000": both(n("n_fb_pm30m_1000km") > 0, n("n_fb_pm30m_1000km")), "x_fireball_30m_500": both(n("n_fb_pm30m_500km") > 0, n("n_fb_pm30m_500km")),
        "x_launch_3h_1500": both(pad > 0, pad), "x_launch_twilight": both((pad > 0) & twilight, pad, sun), "x_launch_dark_or_day": both((pad > 0) & ~twilight, pad, sun),
        "x_starlink_10d": F.when(era > 0, both(age <= 10, age)),
        "x_july4": n("hol_independence_day"), "x_nye": both(mmdd.isin("12-31", "01-01"), mmdd),
        "x_venus_vis": both((venus > 3) & (sun < -3) & (elong > 15), venus, sun, elong), "x_venus_alt": both(F.greatest(venus, F.lit(-5.0)), venus),
        "x_iss": n("iss_visible_win"), "x_moon_up": both(moon > 0, moon), "x_moon_bright": both((moon > 0).cast("double") * light, moon, light),
        "x_outburst": both(burst * dark.cast("double"), burst, sun), "x_large_airport_25km": both(n("dist_large_airport_km") <= 25, n("dist_large_airport_km")),
        "x_sky_oktas": sky, "x_clear": both(sky <= 2, sky),
    }


# ------------------------------------------------------------------ cohorts and subsets

NORTH_AMERICA = ("US", "USA", "CA", "CANADA")
NO_COUNTRY = ("", "UNKNOWN", "UNK", "NOT_REPORTED", "N/A", "NA")


def country_code(country: Column) -> Column:
    return F.upper(F.trim(F.coalesce(country, F.lit(""))))


def discovery_cohort(source="source", split="split", country="country", region="geo_region") -> Column:
    """North American reports of the main source in the discovery split, outside Europe."""
    europe = F.coalesce(F.col(region), F.lit("")).startswith("europe_")
    return F.coalesce((F.col(source) == "NUFORC") & (F.col(split) == "discovery") & country_code(F.col(country)).isin(*NORTH_AMERICA) & ~europe, F.lit(False))


def evaluation_cohorts() -> dict[str, Column]:
    """Eight disjoint cohorts; all need a time known to better than twelve hours."""
    timed = F.col("t").isNotNull() & (F.col("uncertainty_min") < 720)
    main, code = F.col("source") == "NUFORC", country_code(F.col("country"))
    home = code.isin(*NORTH_AMERICA)
    known = ~code.isin(*NO_COUNTRY)
    by_split = {"E1_validation": "validation", "E2_holdout_random": "holdout_random", "E3_holdout_temporal": "holdout_temporal"}
    out = {name: main & home & (F.col("split") == split) & timed for name, split in by_split.items()}
    out["E4_geo_GEIPAN"] = (F.col("source") == "GEIPAN") & timed
    out["E5_geo_NUFORC_nonUS"] = main & known & ~home & timed
    for name, source in {"E6_src_HATCH": "HATCH", "E7_src_BLUEBOOK": "BLUEBOOK_UNK", "E8_src_NICAP": "NICAP"}.items():
        out[name] = (F.col("source") == source) & timed
    return out


def labelled(rows: DataFrame, predicates: dict[str, Column], name: str) -> DataFrame:
    """A row for each predicate that holds, in one pass."""
    held = F.array_compact(F.array(*[F.when(p, n) for n, p in predicates.items()]))
    return rows.withColumn(name, F.explode(held))


def subsets() -> dict[str, Column]:
    """Overlapping subsets of events."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {"ALL": F.lit(True), "HQ": flag("high_quality"), "HQ_UNEXPLAINED": flag("high_quality") & flag("unexplained"), "MULTI_SENSOR": flag("multi_sensor"), "UNEXPLAINED": flag("unexplained"), "EXPLAINED": F.coalesce(F.col("p_explained") >= 0.6, F.lit(False))}


def subset(name: str) -> Column:
    if name not in subsets():
        raise ValueError(f"unknown subset {name}")
    return subsets()[name]


def sensitivity_variants(candidate_subset: str) -> dict[str, Column]:
    """Named variants of the pool; those named by quality skip the candidate's subset filter."""
    own, quality = subset(candidate_subset), F.col("event_quality")
    witness = F.coalesce(F.col("witness_type"), F.lit(""))
    out = {f"quality>={q}": quality >= q for q in (6, 7, 8)}
    out["without_quality_score(ALL)"] = F.lit(True)
    rest = {
        "exclude_mass_sightings(report_count>=10)": F.col("report_count") < 10,
        "exclude_military_witness": ~witness.contains("military"),
        "only_trained_witness": witness.rlike("pilot|police|military|astronomer|air_traffic"),
        "exclude_within25km_large_airport": F.coalesce(F.col("dist_large_airport_km"), F.lit(1e9)) > 25,
    }
    rest |= {f"drop_region_{r}": F.coalesce(F.col("census_region"), F.lit("X")) != r for r in ("NE", "MW", "S", "W")}
    rest |= {f"drop_decade_{d}s": F.coalesce(F.floor(F.col("year") / 10) * 10 != d, F.lit(True)) for d in (1990, 2000, 2010, 2020)}
    return out | {name: own & p for name, p in rest.items()}


# ------------------------------------------------------------------ routing by name


def exposure_kind(variable: str) -> str:
    """The feature family that can recompute an exposure, by its name; the first rule that fits."""
    rules = [
        (r"any_g(quake|storm|launch)_\w+_\d+km$", None), (r"iss_visible_win$", "iss"), (r"wx_", "weather"), (r"(any|n)_eq", "quake"), (r"(any|n)_storm", "storm"),
        (r".*(launch|starlink)", "launch"), (r".*fireball|n_fb", "fireball"), (r"media|log_wiki", "media"), (r"moon|venus|shower|jupiter|hol_|meteor_outburst", "astro"),
        (r"within|log_dist|in_icbm|n_airports|n_dod", "spatial"), (r"(kp|dst|ae|bz|hss|v|np|pdyn|efield|pflux10|proton|F107|SN|Ap|flareMX|n_flareMX)", "space_weather"),
    ]
    for pattern, kind in rules:
        if m := re.match(pattern, variable):
            return kind or f"grid_{m[1]}"
    return "unsupported"


def window_label(variable: str) -> str:
    m = re.search(r"_(pre\w+?|post\w+?|pm\w+?)_", f"{variable}_")
    return m[1] if m else ""


def radius_label(variable: str) -> str:
    m = re.search(r"(\d+)km", variable) or re.match(r"within(\d+)_", variable)
    return m[1] if m else ""


def family_key(variable: Column) -> Column:
    """A variable's name without window and radius."""
    v = F.regexp_replace(variable, r"_(pre|post|pm)\w*?_\d+km$", "")
    return F.regexp_replace(F.regexp_replace(v, r"^within\d+_", "within_"), r"_\d+km$", "")
