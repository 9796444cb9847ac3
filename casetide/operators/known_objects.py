"""Chances that a report has a known explanation: a table of weighted rules, and one evaluator.

A rule gives its part a weight where its condition holds. Conditions are written with ``&``, ``|``, ``!`` and brackets over the
names of ``FACTS`` and of description flags. What is unknown doesn't hold. Parts combine their rules, and categories
their parts, by noisy-or; the parts of ``SUMMED`` add theirs up to 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import first_largest, noisy_or

# ---------------------------------------------------------------- fixed values: facts, rules and weights

#: Facts by name, as SQL over the caller's columns.
FACTS = {
    "night": "sun_alt < -6",
    "twilight": "sun_alt < -3 AND sun_alt > -20",
    "dark_not_deep": "sun_alt < -6 AND sun_alt > -30",
    "daylight": "sun_alt > 0",
    "brief": "duration_s <= 10",
    "minutes": "duration_s BETWEEN 60 AND 420",
    "lasting": "duration_s >= 600",
    "fireballs": "n_fb_pm30m_1000km > 0",
    "strong_shower": "shower_zhr_total >= 50 AND sun_alt < -6",
    "outburst": "meteor_outburst_pm1d > 0",
    "fireball_named": "shape = 'fireball'",
    "starlink_years": "starlink_era > 0",
    "launched_10d": "days_since_starlink_launch <= 10",
    "launched_30d": "days_since_starlink_launch <= 30",
    "launch_3h": "n_launch_lpost3h_1500km > 0",
    "orbital_3h": "n_launchorb_lpost3h_2500km > 0",
    "launch_1h": "n_launch_lpost1h_1000km > 0",
    "station_pass": "iss_visible_win > 0",
    "venus": "venus_alt > 3 AND sun_alt < -3 AND venus_elong > 15",
    "jupiter": "jupiter_alt > 10 AND sun_alt < -8",
    "moon_up": "moon_alt > 0",
    "airport": "dist_large_airport_km <= 25",
    "drone_years": "year >= 2010",
    "festive": "mmdd IN ('07-04', '12-31', '01-01', '07-05', '07-14')",
    "weekend_night": "dow IN (4, 5) AND sun_alt < -6",
    "storm": "n_storm_pm1h_100km > 0",
    "reentry": "n_reentry_pm1d > 0",
    "coded_hoax": "contains(hatch_attrs, 'HOX')",
    "coded_misid": "contains(hatch_attrs, 'MID')",
}

METEOR = "(meteor_word | fireball_named | fireball_shape)"
SATELLITE = "(minutes & !blinking & !sound & !hover)"
STILL = "(hover | planet_word)"

#: (part, weight, condition). ``ctx`` parts come from time and place, ``txt`` from the description, ``src`` from the source.
RULES = [
    ("ctx_meteor", 0.85, "fireballs"),
    ("ctx_meteor", 0.25, f"strong_shower & (brief | {METEOR})"),
    ("ctx_meteor", 0.3, f"outburst & (brief | {METEOR})"),
    ("txt_meteor", 0.35, METEOR),
    ("txt_meteor", 0.30, "brief"),
    ("txt_meteor", 0.25, f"{METEOR} & brief"),
    ("txt_meteor", 0.9, "nuforc_note_meteor"),
    ("ctx_starlink", 0.45, "line_formation & starlink_years & launched_10d"),
    ("ctx_starlink", 0.15, "line_formation & starlink_years & launched_30d"),
    ("ctx_starlink", 0.15, "line_formation & starlink_years & twilight"),
    ("txt_starlink", 0.9, "starlink_word"),
    ("txt_starlink", 0.95, "nuforc_note_starlink"),
    ("txt_starlink", 0.35, "line_formation & starlink_years & !hover"),
    ("ctx_launch", 0.45, "launch_3h"),
    ("ctx_launch", 0.35, "launch_3h & twilight"),
    ("ctx_launch", 0.2, "orbital_3h & twilight"),
    ("ctx_launch", 0.15, "launch_1h"),
    ("txt_launch", 0.25, "rocket_word & launch_3h"),
    ("txt_launch", 0.9, "nuforc_note_launch"),
    ("ctx_satellite", 0.10, f"{SATELLITE} & dark_not_deep"),
    ("ctx_satellite", 0.55, f"station_pass & {SATELLITE}"),
    ("ctx_satellite", 0.25, f"station_pass & !{SATELLITE}"),
    ("txt_satellite", 0.55, "satellite_word"),
    ("txt_satellite", 0.6, "iss_word"),
    ("txt_satellite", 0.9, "nuforc_note_satellite"),
    ("txt_satellite", 0.9, "nuforc_note_iss"),
    ("ctx_planet", 0.5, f"venus & {STILL} & lasting"),
    ("ctx_planet", 0.25, f"jupiter & {STILL} & lasting"),
    ("ctx_planet", 0.15, f"venus & (lasting | {STILL})"),
    ("ctx_planet", 0.08, f"jupiter & (lasting | {STILL})"),
    ("txt_planet", 0.4, "planet_word"),
    ("txt_planet", 0.9, "nuforc_note_planet"),
    ("txt_moon", 0.3, "moon_word & moon_up"),
    ("ctx_aircraft", 0.08, "airport"),
    ("txt_aircraft", 0.55, "blinking & red_green"),
    ("txt_aircraft", 0.35, "aircraft_word"),
    ("txt_aircraft", 0.15, "sound"),
    ("txt_aircraft", 0.10, "airport & blinking"),
    ("txt_aircraft", 0.9, "nuforc_note_aircraft"),
    ("txt_drone", 0.6, "drone_word & drone_years"),
    ("txt_balloon", 0.6, "balloon_word"),
    ("ctx_lantern", 0.30, "orange & festive"),
    ("ctx_lantern", 0.10, "orange & weekend_night"),
    ("txt_lantern", 0.7, "lantern_word"),
    ("txt_lantern", 0.35, "orange & (silent | hover | lantern_word)"),
    ("txt_lantern", 0.9, "nuforc_note_lantern"),
    ("txt_fireworks", 0.6, "firework_word"),
    ("txt_fireworks", 0.2, "festive & blinking"),
    ("ctx_lightning", 0.25, "storm & (brief | blinking)"),
    ("txt_lightning", 0.3, "lightning_word"),
    ("txt_searchlight", 0.6, "searchlight_word"),
    ("txt_flare", 0.5, "flare_word"),
    ("txt_cloud", 0.2, "cloud_word & daylight"),
    ("ctx_reentry", 0.15, f"reentry & ({METEOR} | line_formation) & !brief"),
    ("src_hoax", 0.9, "nuforc_note_hoax"),
    ("src_hoax", 0.6, "coded_hoax"),
    ("src_misid", 0.6, "coded_misid"),
]

SUMMED = {"ctx_starlink"}

# ---------------------------------------------------------------- evaluation

_NAME = re.compile(r"[a-z_][a-z_0-9]*")
_WORD = re.compile(r"'[^']*'|\b[a-z_][a-z_0-9]*\b(?!\()")


def _inputs(sql: str) -> set[str]:
    return {w for w in _WORD.findall(sql) if not w.startswith("'")}


def _condition(condition: str) -> Column:
    logic = condition.replace("&", " AND ").replace("|", " OR ").replace("!", " NOT ")
    return F.expr(_NAME.sub(lambda m: f"`__is_{m[0]}`", logic))


def scored(reports: DataFrame, c: dict[str, Column]) -> DataFrame:
    """``reports`` with each part of the evidence, the chance by category (``p_``), overall and from context alone, and the
    likeliest category (``none`` below 0.05).

    ``c`` holds the columns a caller has, flags as ``d_<name>_txt``; a fact whose columns are missing doesn't hold. Each step is a
    projection of its own, so no expression is repeated in the next.
    """
    given = sorted(set().union(*map(_inputs, FACTS.values())))
    out = reports.withColumns({f"__in_{k}": c.get(k, F.lit(None)) for k in given})
    fact = lambda sql: F.expr(_WORD.sub(lambda m: m[0] if m[0].startswith("'") else f"`__in_{m[0]}`", sql))
    names = sorted({n for _, _, condition in RULES for n in _NAME.findall(condition)})
    holds = {n: fact(FACTS[n]) if n in FACTS else c.get(f"d_{n}_txt", F.lit(False)) for n in names}
    out = out.withColumns({f"__is_{n}": F.coalesce(x.cast("boolean"), F.lit(False)) for n, x in holds.items()})
    parts = list(dict.fromkeys(part for part, _, _ in RULES))
    weights = {p: [F.when(_condition(rule), float(w)).otherwise(0.0) for part, w, rule in RULES if part == p] for p in parts}
    added = lambda w: F.least(F.lit(1.0), sum(w[1:], w[0]))
    out = out.withColumns({p: added(w) if p in SUMMED else noisy_or(*w) for p, w in weights.items()})
    kinds = sorted({p.split("_", 1)[1] for p in parts})
    out = out.withColumns({f"p_{k}": noisy_or(*[F.col(p) for p in parts if p.split("_", 1)[1] == k]) for k in kinds})
    chances = [F.col(f"p_{k}") for k in kinds]
    out = out.withColumns({
        "p_explained": noisy_or(*chances),
        "p_explained_ctx_only": noisy_or(*[F.col(p) for p in parts if p.startswith("ctx_")]),
        "top_explanation": first_largest(kinds, chances, 0.05),
    })
    return out.drop(*[f"__in_{k}" for k in given], *[f"__is_{n}" for n in names])
