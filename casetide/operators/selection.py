"""Choosing, freezing and validating hypotheses."""

from __future__ import annotations

import hashlib
import json
import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exposure import family_key, subsets

VALID = ("OK", "OK_EXACT")
INFERENCE_VERSION = "v4"
#: Control strategies of each family and how many must support a finding (fixed values).
DESIGNS = {
    "A_global_temporal": (("CS1", "CS2"), 2),
    "B_local_catalog": (("CS1", "CS2", "CS4"), 2),
    "B_weather": (("CS1", "CS2", "CS4"), 2),
    "B_local_other": (("CS1", "CS2", "CS4"), 2),
    "G_quake_grid": (("CS1", "CS4"), 2),
    "G_storm_grid": (("CS1", "CS4"), 2),
    "G_launch_grid": (("CS1", "CS4"), 2),
}
#: Exposures the known-object matcher uses, and the subsets it defines (fixed values).
MATCHER_INPUTS = "launch|fireball|n_fb|iss_|venus|jupiter|shower|outburst|starlink|storm|hol_|mmdd|large_airport|reentry|moon_up|moon_full"
MATCHER_SUBSETS = ("UNEXPLAINED", "HQ_UNEXPLAINED", "EXPLAINED")
MIN_NULLS = 20
#: Odds ratios that count as no effect (fixed values).
EQUIVALENCE = (0.8, 1.25)


def valid_fit(status: str = "status", effect: str = "effect", p: str = "p_value") -> Column:
    e, q = F.col(effect), F.col(p)
    good = F.col(status).isin(*VALID) & ~F.isnan(e) & (e > 0) & (e < math.inf) & ~F.isnan(q) & q.between(0, 1)
    return F.coalesce(good, F.lit(False))


def candidates(results: DataFrame, effect: float = 1.15, q_max: float = 0.05, least_exposed: int = 30) -> DataFrame:
    """The best test of each family, variable family and subset, with the rules it fails; none failed: promoted.

    R0 exposure defines the subset; R1 q; R2 effect; R3 exposed cases; R4 too few strategies in support.
    """
    rows = results.withColumn("fam", family_key(F.col("variable_a"))).withColumn("__ok", valid_fit())
    own = ["family", "fam", "subset"]
    best = Window.partitionBy(*own).orderBy("p_value", "variable_a", "control_strategy")
    heads = rows.where("__ok").withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")
    sign = F.signum(F.log("effect"))
    backing = rows.where(F.col("__ok") & (F.col("p_value") < 0.05)).select("family", "variable_a", "subset", sign.alias("__sign"), F.col("control_strategy").alias("__s"))
    support = backing.groupBy("family", "variable_a", "subset", "__sign").agg(F.array_sort(F.collect_set("__s")).alias("support"))
    out = heads.withColumn("__sign", sign).join(support, ["family", "variable_a", "subset", "__sign"], "left")
    out = out.withColumn("support", F.coalesce("support", F.array().cast("array<string>")))
    lacking = F.lit("R4 no design for family")
    for family, (strategies, need) in DESIGNS.items():
        enough = F.size(F.array_intersect("support", F.array(*map(F.lit, strategies)))) >= need
        lacking = F.when(F.col("family") == family, F.when(~enough, f"R4 strategies < {need}")).otherwise(lacking)
    reasons = F.array_compact(F.array(
        F.when(F.col("subset").isin(*MATCHER_SUBSETS) & F.col("variable_a").rlike(MATCHER_INPUTS), "R0 exposure defines subset"),
        F.when(~F.coalesce(F.col("q_bh_all") < q_max, F.lit(False)), "R1 q"),
        F.when(~((F.col("effect") >= effect) | (F.col("effect") <= 1 / effect)), "R2 effect"),
        F.when(F.col("n_exposed_cases") < least_exposed, "R3 exposed cases"),
        lacking,
    ))
    return out.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("promoted", F.size(reasons) == 0).withColumn("support", F.array_join("support", ";")).drop("__ok", "__sign")


def verdict(direction: Column | str = "direction", p: str = "p_value") -> Column:
    direction = F.col(direction) if isinstance(direction, str) else direction
    same, strong = (F.col("effect") > 1) == (direction == "+"), F.col(p) < 0.05
    return (
        F.when(~valid_fit(p=p), "NOT_TESTABLE").when(same & strong, "REPLICATED").when(same, "SAME_DIRECTION_NS").when(strong, "OPPOSITE_SIGNIFICANT").otherwise("OPPOSITE_NS")
    )


def replicated_often(rows: DataFrame, sets: tuple[str, ...] = ("E1_validation", "E2_holdout_random", "E3_holdout_temporal"), least: int = 2) -> DataFrame:
    """Candidates replicated, by nominal p, in at least ``least`` of the sets."""
    hits = rows.where(F.col("eval_set").isin(*sets) & (F.col("verdict_nominal") == "REPLICATED"))
    return hits.groupBy("candidate_id").agg(F.countDistinct("eval_set").alias("n_sets")).where(F.col("n_sets") >= least)


def rank_p(nulls: DataFrame, observed: str, null: str, by: list[str], least: int = MIN_NULLS) -> DataFrame:
    """(|null| >= |observed|, counted, + 1) / (nulls + 1); null below ``least`` finite nulls."""
    n = F.count(null)
    beyond = F.count_if(F.abs(F.col(null)) >= F.abs(F.col(observed)))
    return nulls.groupBy(*by).agg(n.alias("n_null"), F.when(n >= least, (beyond + 1) / (n + 1)).alias("p_perm"))


def control_class(expected: str, status="status", effect="effect", p="p_value", lo="ci_low", hi="ci_high", equivalence: tuple[float, float] = EQUIVALENCE) -> Column:
    """Outcome of a positive control whose effect should be ``+``, ``-`` or ``0``. An invalid fit is never a pass, and
    limits that exclude a 10 % effect in the expected direction are a failure."""
    e, q, low, high = F.col(effect), F.col(p), F.col(lo), F.col(hi)
    usable = F.coalesce(valid_fit(status, effect, p) & low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high), F.lit(False))
    out = F.when(~usable, "NOT_TESTABLE")
    if expected == "+":
        return out.when((q < 0.05) & (low > 1), "PASSED").when(((q < 0.05) & (e < 1)) | (high < 1.10), "FAILED").otherwise("INCONCLUSIVE")
    if expected == "-":
        return out.when((q < 0.05) & (high < 1), "PASSED").when(((q < 0.05) & (e > 1)) | (low > 1 / 1.10), "FAILED").otherwise("INCONCLUSIVE")
    if expected == "0":
        return out.when((low >= equivalence[0]) & (high <= equivalence[1]), "PASSED_EQUIVALENT").when(q < 0.05, "FAILED_ASSOCIATED").otherwise("INCONCLUSIVE")
    return out.otherwise("INFORMATIONAL")


# ------------------------------------------------------------------ frozen specifications

REQUIRED_FIELDS = ("candidate_id", "family", "variable", "hypothesis", "subset", "control_strategy", "direction", "scale")


def check_spec(spec: list[dict]) -> None:
    """Raise unless every candidate is complete, unique, and has a finite positive scale and known names."""
    seen: set[str] = set()
    for c in spec:
        missing = [f for f in REQUIRED_FIELDS if c.get(f) in (None, "")]
        if missing:
            raise ValueError(f"candidate lacks {missing}")
        if c["candidate_id"] in seen:
            raise ValueError(f"candidate {c['candidate_id']} twice")
        seen.add(c["candidate_id"])
        scale = c["scale"]
        if isinstance(scale, bool) or not isinstance(scale, (int, float)) or not math.isfinite(scale) or scale <= 0:
            raise ValueError(f"bad scale {scale!r}")
        if c["subset"] not in subsets() or c["control_strategy"] not in ("CS1", "CS2", "CS4") or c["direction"] not in ("+", "-"):
            raise ValueError(f"candidate {c['candidate_id']} has an unknown subset, strategy or direction")


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def spec_json(value) -> str:
    """JSON with sorted keys; NaN and the infinities become null."""
    return json.dumps(_plain(value), sort_keys=True, indent=1, allow_nan=False)


def freeze(spec: list[dict], path: str) -> str:
    """Write the specification and its digest beside it, never over an existing one; returns the digest."""
    check_spec(spec)
    text = spec_json(spec)
    digest = hashlib.sha256(text.encode()).hexdigest()
    if os.path.exists(f"{path}.sha256"):
        raise FileExistsError(f"{path}.sha256")
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
    with open(f"{path}.sha256", "x", encoding="utf-8") as f:
        f.write(digest)
    return digest


def load_frozen(path: str) -> list[dict]:
    """The frozen specification; raises if it no longer matches its digest."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    with open(f"{path}.sha256", encoding="utf-8") as f:
        if hashlib.sha256(text.encode()).hexdigest() != f.read().strip():
            raise ValueError("the frozen specification has changed")
    spec = json.loads(text)
    check_spec(spec)
    return spec
