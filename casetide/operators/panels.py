"""Panels and count regressions. Grids and sums are Spark's; the regressions run on the driver over design rows that
have been summed first (counts of equal covariates add), a few thousand at most."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a driver-side regression at most.
MOST_ROWS = 50_000


def unit_year_panel(units: DataFrame, counts: DataFrame, unit: str, year: str, first: int, last: int, value: str = "n") -> DataFrame:
    """Every unit in every year from ``first`` to ``last``, with 0 where ``counts`` has none."""
    grid = units.select(unit).distinct().withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(counts.select(unit, year, value), [unit, year], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def summed(rows: DataFrame, covariates: list[str], count: str, exposure: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(design, counts, exposure) of rows with equal covariates added up in Spark. A row's weight is its exposure."""
    weight = F.sum(exposure) if exposure else F.count(F.lit(1)).cast("double")
    table = rows.groupBy(*covariates).agg(F.sum(count).alias("__n"), weight.alias("__e")).limit(MOST_ROWS + 1).toPandas()
    if len(table) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} distinct design rows")
    return table[covariates].to_numpy(float), table["__n"].to_numpy(float), table["__e"].to_numpy(float)


def poisson(design: np.ndarray, counts: np.ndarray, exposure: np.ndarray | None = None, alpha: float = 0.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, model covariance, expected counts) of a log-linear model with an intercept first.

    ``alpha`` > 0: negative binomial variance m + alpha m^2.
    """
    x = np.column_stack([np.ones(len(design)), design])
    offset = np.log(exposure) if exposure is not None else np.zeros(len(x))
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(counts.sum(), 1e-9) / np.exp(offset).sum())
    for _ in range(steps):
        mean = np.exp(np.clip(x @ beta + offset, -500, 500))
        weight = mean / (1 + alpha * mean)
        info = x.T @ (weight[:, None] * x)
        step = np.linalg.lstsq(info, x.T @ ((counts - mean) / (1 + alpha * mean)), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    mean = np.exp(x @ beta + offset)
    info = x.T @ ((mean / (1 + alpha * mean))[:, None] * x)
    return beta, np.linalg.pinv(info), mean


def clustered_covariance(design: np.ndarray, counts: np.ndarray, mean: np.ndarray, cov: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Sandwich covariance with scores summed by cluster."""
    x = np.column_stack([np.ones(len(design)), design]) * (counts - mean)[:, None]
    names, code = np.unique(clusters, return_inverse=True)
    sums = np.zeros((len(names), x.shape[1]))
    np.add.at(sums, code, x)
    return cov @ (sums.T @ sums * len(names) / max(len(names) - 1, 1)) @ cov


def hac_covariance(design: np.ndarray, counts: np.ndarray, mean: np.ndarray, cov: np.ndarray, lags: int = 7) -> np.ndarray:
    """Sandwich covariance with Bartlett weights over ``lags`` steps of ordered rows."""
    u = np.column_stack([np.ones(len(design)), design]) * (counts - mean)[:, None]
    meat = u.T @ u
    for k in range(1, lags + 1):
        cross = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (cross + cross.T)
    return cov @ meat @ cov


def difference_in_differences(panel: DataFrame, unit: str, year: str, count: str, treated: str, exposure: str) -> dict:
    """Poisson model with unit and year effects; the rate ratio of the treated cells with errors clustered by unit."""
    table = panel.groupBy(unit, year).agg(F.sum(count).alias("n"), F.max(treated).alias("d"), F.sum(exposure).alias("e")).where("e > 0").limit(MOST_ROWS + 1).toPandas()
    if len(table) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} cells")
    units, u = np.unique(table[unit].to_numpy(), return_inverse=True)
    years, y = np.unique(table[year].to_numpy(), return_inverse=True)
    design = np.column_stack([table["d"].to_numpy(float), np.eye(len(units))[u][:, 1:], np.eye(len(years))[y][:, 1:]])
    beta, cov, mean = poisson(design, table["n"].to_numpy(float), table["e"].to_numpy(float))
    robust = clustered_covariance(design, table["n"].to_numpy(float), mean, cov, u)
    return {"rate_ratio": float(np.exp(beta[1])), "log_rr": float(beta[1]), "se": float(np.sqrt(max(robust[1, 1], 0.0))), "n_units": len(units), "n_cells": len(table)}


def window_shares(rows: DataFrame, day: str, flag: str, event_days: DataFrame, before: int, after: int) -> DataFrame:
    """For each event day: rows a day and the share of ``flag`` in the days before and after, and their ratio."""
    d = F.datediff(F.col(day), F.col("event_day"))
    near = event_days.withColumn(day, F.explode(F.sequence(F.date_sub("event_day", before), F.date_add("event_day", after - 1))))
    met = near.join(rows, day, "left").groupBy("event_day").agg(
        (F.count_if((d < 0) & F.col(flag).isNotNull()) / before).alias("rate_before"), (F.count_if((d >= 0) & F.col(flag).isNotNull()) / after).alias("rate_after"),
        F.avg(F.when(d < 0, F.col(flag).cast("double"))).alias("share_before"), F.avg(F.when(d >= 0, F.col(flag).cast("double"))).alias("share_after"),
    )
    return met.withColumn("rate_ratio", F.try_divide("rate_after", "rate_before"))
