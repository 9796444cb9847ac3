"""Matched controls: calendar referents in local time, spatial controls, their check and repair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, local_to_utc
from .spatial import exact_km, vectors

#: Draws before a case goes through all its candidates, and the parts that the cases of a block are dealt to.
TRIES = 64
SALTS = 16

#: Weeks of the same month, and days a year or two off that keep the weekday (fixed values).
MONTH_WEEKS = (-4, -3, -2, -1, 1, 2, 3, 4)
YEAR_DAYS = (-728, -364, 364, 728)


def calendar_referents(cases: DataFrame, offsets_days: list[int], strategy: str, *, same_month: bool, event_id: str = "event_id", utc: str = "utc_ts", zone: str = "zone") -> DataFrame:
    """The case's wall-clock time moved by whole days in its zone; a time that a spring gap hides is dropped, a
    repeated one is its first instance. The session's zone must be UTC."""
    local = F.from_utc_timestamp(F.col(utc).cast("timestamp"), F.col(zone)).cast("timestamp_ntz")
    spread = cases.where(F.col(utc).isNotNull() & F.col(zone).isNotNull()).withColumn("__local", local).withColumn("offset", F.explode(F.array(*map(F.lit, offsets_days))))
    moved = spread.withColumn("__moved", F.timestamp_add("DAY", F.col("offset"), F.col("__local")))
    if same_month:
        moved = moved.where(F.month("__moved") == F.month("__local"))
    at, exists = local_to_utc(F.col("__moved").cast("timestamp"), F.col(zone))
    return moved.where(exists).withColumn(utc, at.cast("timestamp_ntz")).withColumn("strategy", F.lit(strategy)).drop("__local", "__moved")


def month_referents(cases: DataFrame, **names) -> DataFrame:
    out = calendar_referents(cases, [7 * k for k in MONTH_WEEKS], "CS1", same_month=True, **names)
    return out.withColumn("offset", (F.col("offset") / 7).cast("int"))


def year_referents(cases: DataFrame, **names) -> DataFrame:
    return calendar_referents(cases, list(YEAR_DAYS), "CS2", same_month=False, **names)


def referent_check(cases: DataFrame, referents: DataFrame, event_id: str = "event_id", utc: str = "utc_ts", zone: str = "zone") -> DataFrame:
    """One row: referents, and how many differ from their case in local clock or weekday."""
    of_case = cases.select(event_id, F.from_utc_timestamp(F.col(utc).cast("timestamp"), F.col(zone)).alias("__a"))
    both = referents.join(of_case, event_id).withColumn("__b", F.from_utc_timestamp(F.col(utc).cast("timestamp"), F.col(zone)))
    clock = lambda c: F.date_format(c, "HH:mm")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(clock("__a") != clock("__b")).alias("clock_mismatch"), F.count_if(F.weekday("__a") != F.weekday("__b")).alias("weekday_mismatch"))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed between two versions; equal rows are left out."""
    a = old.select(*keys, *[F.col(v).alias(f"__old_{v}") for v in values], F.lit(True).alias("__in_old"))
    b = new.select(*keys, *values, F.lit(True).alias("__in_new"))
    both = a.join(b, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"__old_{v}"))
    change = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(differs, "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def repaired(features: DataFrame, recomputed: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Features without the rows that changed or went, with the rows computed anew."""
    return features.join(changes, keys, "left_anti").unionByName(recomputed.join(changes.where("change <> 'removed'"), keys, "left_semi"), allowMissingColumns=True)


def spatial_controls(cases: DataFrame, places: DataFrame, *, seed: int, k: int = 4, least_km: float = 200.0, event_id: str = "event_id", block: list[str] | None = None) -> DataFrame:
    """``k`` places for each case, drawn without replacement in proportion to population.

    Candidates share the case's ``block`` columns (country, region), lie in its population decile or the next, and at
    least ``least_km`` away; a population that isn't finite and positive is none. A case with fewer than ``k`` candidates gets
    none. Draws are fixed by the seed, the case and the block's places. Cases: lat, lon, decile; places: place_id,
    place_lat, place_lon, population, place_decile.

    Places are drawn by the running sums of population, and drawn again if too near or drawn before, which gives the
    distribution of draws among the candidates. A case that ``TRIES`` draws don't serve goes through all of its candidates:
    a race of exponential times, which is distributed as the draws that are left.
    """
    block = block or ["country"]
    columns = [*block, "place_decile", *[c for c in cases.columns if c not in block], *[c for c in places.columns if c not in (*block, "place_decile")]]
    types = {f.name: f.dataType.simpleString() for f in [*places.schema, *cases.schema]}

    def drawn(own: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("place_id", kind="stable").reset_index(drop=True)
        at, to = vectors(own["lat"], own["lon"]), vectors(pool["place_lat"], pool["place_lon"])
        weight, seeds = pool["population"].to_numpy(float), own["__hash"].to_numpy(np.int64).view(np.uint64)
        sums = np.cumsum(weight)
        chosen, got = np.full((len(own), k), -1), np.zeros(len(own), int)
        left = np.arange(len(own) if len(pool) >= k else 0)
        for j in range(TRIES):
            if not len(left):
                break
            place = np.minimum(np.searchsorted(sums, _uniform(seeds[left], j) * sums[-1], "right"), len(pool) - 1)
            fits = (exact_km(at[:, left], to[:, place]) >= least_km) & (chosen[left] != place[:, None]).all(axis=1)
            hit = left[fits]
            chosen[hit, got[hit]] = place[fits]
            got[hit] += 1
            left = left[got[left] < k]
        for i in left:
            others = np.flatnonzero(exact_km(at[:, i : i + 1], to) >= least_km)
            others = others[~np.isin(others, chosen[i])]
            race = -np.log1p(-_uniform(seeds[i : i + 1], TRIES + others.astype(np.uint64))) / weight[others]
            some = others[np.argsort(race, kind="stable")[: k - got[i]]]
            chosen[i, got[i] : got[i] + len(some)] = some
            got[i] += len(some)
        full = np.flatnonzero(got == k)
        rows, picked = own.iloc[np.repeat(full, k)].reset_index(drop=True), pool.iloc[chosen[full].ravel()].reset_index(drop=True)
        out = pd.concat([rows, picked.drop(columns=[*block, "__near", "__salt"])], axis=1)
        return out.assign(offset=np.tile(np.arange(k), len(full)))[[*columns, "offset"]]

    placed = lambda df, lat, lon: df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    own = placed(cases, "lat", "lon").withColumns({"__near": F.col("decile"), "__salt": F.pmod(F.xxhash64(event_id), F.lit(SALTS)), "__hash": F.xxhash64(F.lit(seed), event_id)})
    pool = placed(places.where(finite(F.col("population").cast("double")) > 0), "place_lat", "place_lon")
    pool = pool.withColumn("__near", F.explode(F.array(*[F.col("place_decile") + d for d in (-1, 0, 1)]))).withColumn("__salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    by = [*block, "__near", "__salt"]
    known = lambda df: df.dropna(subset=[*block, "__near"])
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", offset int"
    return known(own).groupBy(*by).cogroup(known(pool).groupBy(*by)).applyInPandas(drawn, schema)


def _uniform(seeds: np.ndarray, draw: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) by mixing seeds with the number of the draw (splitmix64)."""
    with np.errstate(over="ignore"):
        x = seeds + (np.asarray(draw, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def decile_edges(places: DataFrame, value: str, block: list[str], least: int = 50) -> DataFrame:
    """(block, edges): the nine inner decile edges of log10(value) of each block with ``least`` places or more."""
    edges = F.percentile(F.log10(value), F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("edges")
    return places.groupBy(*block).agg(edges, F.count(F.log10(value)).alias("__n")).where(F.col("__n") >= least).drop("__n")


def deciles(rows: DataFrame, edges: DataFrame, value: str, block: list[str], name: str = "place_decile") -> DataFrame:
    """``rows`` of the blocks that ``edges`` has, with the decile code 0..9 of log10(value) by those edges."""
    above = F.size(F.filter("edges", lambda e: e <= F.log10(value)))
    return rows.join(edges, block).withColumn(name, above.cast("int")).drop("edges")
