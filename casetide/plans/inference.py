"""Queries of matched-set inference, multiplicity, panels, selection and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import convergence, matched, multiplicity, panels, selection, spatial_stats
from .registry import query, table


@query("""
WITH e AS (SELECT user_id AS s, (event_type = 'purchase') AS c, value > 50 AS x FROM events), t AS (SELECT s, count(*) FILTER (c AND x) AS a, count(*) FILTER (c AND NOT x) AS b, count(*) FILTER (NOT c AND x) AS k, count(*) FILTER (NOT c AND NOT x) AS d, count(*) AS n FROM e WHERE x IS NOT NULL GROUP BY 1)
SELECT round(sum(a * d / n) / sum(b * k / n), 6) AS mh_or FROM t
""")
def mantel_haenszel(spark: SparkSession, folder: str) -> DataFrame:
    """Common odds ratio over users (AGG-22)."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("event_id"), (F.col("event_type") == "purchase").cast("int").alias("is_case"), (F.col("value") > 50).cast("double").alias("x"), F.lit(1).alias("g"))
    return matched.mantel_haenszel(e, "x", ["g"]).select(F.round("mh_or", 6).alias("mh_or"))


@query("""
WITH t AS (SELECT p_partkey AS key, p_brand AS family, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 7919 % 10007) / 10007.0 * ((p_partkey % 5) + 1) / 50 END AS p FROM part),
r AS (SELECT *, row_number() OVER w AS k, count(p) OVER (PARTITION BY family) AS n FROM t WHERE p IS NOT NULL WINDOW w AS (PARTITION BY family ORDER BY p, key)),
a AS (SELECT *, min(p * n / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up, max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING) AS down, list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) AS h FROM r)
SELECT t.key, CASE WHEN up IS NOT NULL THEN round(least(1.0, up), 6) END AS q_bh, CASE WHEN up IS NOT NULL THEN round(least(1.0, up * h), 6) END AS q_by, CASE WHEN up IS NOT NULL THEN round(least(1.0, down), 6) END AS p_holm FROM t LEFT JOIN a USING (key)
""")
def bh_by_holm_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Three adjustments within families, missing p left out (STA-07, WIN-09)."""
    k = F.col("p_partkey")
    p = F.when(k % 17 != 0, (k * 7919 % 10007) / 10007.0 * ((k % 5) + 1) / 50)
    out = multiplicity.adjusted(table(spark, folder, "part").select(k.alias("key"), F.col("p_brand").alias("family"), p.alias("p")), "p", ["family"], "key")
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("q_bh", "q_by", "p_holm")])


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is a set: its first line is the case, the others are controls."""
    li = table(spark, folder, "lineitem")
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return li.select(
        F.col("l_orderkey").alias("event_id"), (F.col("l_linenumber") == first).cast("int").alias("is_case"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_quantity")).alias("x"),
        (F.col("l_discount") >= 0.05).cast("double").alias("b"), (F.col("l_suppkey") % 40).alias("place"), F.to_date("l_shipdate").alias("night"), (F.col("l_extendedprice") / 1e4).alias("eta"),
    )


_SETS = "SELECT l_orderkey AS event_id, (l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey))::INT AS is_case, CASE WHEN l_partkey % 50 <> 0 THEN l_quantity END AS x, l_discount >= 0.05 AS b, l_extendedprice / 1e4 AS eta FROM lineitem"


@query(f"""
WITH s AS ({_SETS}), k AS (SELECT *, sum(is_case) OVER w AS cases, count(*) OVER w AS size FROM s WHERE x IS NOT NULL WINDOW w AS (PARTITION BY event_id))
SELECT count(DISTINCT event_id) AS n_sets, count(*) FILTER (is_case = 1) AS n_cases, count(*) FILTER (is_case = 0) AS n_controls, count(*) FILTER (is_case = 1 AND b) AS n_exposed_cases, count(*) FILTER (is_case = 0 AND b) AS n_exposed_controls FROM k WHERE cases = 1 AND size >= 2
""")
def usable_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets with one case and a control with known exposure, and their counts (FLT-15, AGG-12)."""
    kept = matched.usable_sets(_sets(spark, folder), ["x"])
    counts = matched.exposure_counts(kept.withColumn("g", F.lit(1)), "b", ["g"]).drop("g")
    return kept.agg(F.countDistinct("event_id").alias("n_sets")).join(counts)


@query(None)
def conditional_logit(spark: SparkSession, folder: str) -> DataFrame:
    """Odds ratio with two-way clustered errors by night and place (STA-01 to STA-04, JON-23, AGG-18)."""
    fit = matched.clogit(_sets(spark, folder), ["x"], clusters=["night", "place"])
    r = matched.odds_ratio(fit, scale=10.0)
    return spark.createDataFrame([(r["status"], r["n_case"], r["n_ctrl"], r["n_clusters"], r["or"], r["lo"], r["hi"], r["p"])], "status string, n_case long, n_ctrl long, n_clusters long, odds_ratio double, lo double, hi double, p double")


@query(None)
def exact_odds_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Exact conditional inference of a sparse binary exposure (STA-05)."""
    sets = _sets(spark, folder).withColumn("b", ((F.col("event_id") % 97 == 0) & (F.col("b") == 1)).cast("double"))
    r = matched.exact_odds_ratio(sets, "b")
    return spark.createDataFrame([(r["method"], r["n_strata"], r["n_informative"], r["t"], r["or"], r["lo"], r["hi"], r["p"])], "method string, n_strata long, n_informative long, t long, odds_ratio double, lo double, hi double, p double")


@query(None)
def matched_test_rule(spark: SparkSession, folder: str) -> DataFrame:
    """The inference rule on a continuous and a binary exposure (STA-06, ORC-12)."""
    rows = _sets(spark, folder)
    out = [(x, *[r[k] for k in ("status", "n_cases", "effect", "p_value", "inference_method")]) for x in ("x", "b") for r in [matched.matched_test(rows, x)]]
    return spark.createDataFrame(out, "variable string, status string, n_cases long, effect double, p_value double, inference_method string")


@query(f"WITH s AS ({_SETS}) SELECT round(avg(CASE WHEN a.eta > b.eta THEN 1.0 WHEN a.eta = b.eta THEN 0.5 ELSE 0 END), 6) AS auc, count(*) AS n_pairs FROM s a JOIN s b ON a.event_id = b.event_id AND a.is_case = 1 AND b.is_case = 0")
def conditional_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Chance that a case scores above a control of its set (STA-12, JON-24)."""
    return matched.conditional_auc(_sets(spark, folder), "eta").select(F.round("auc", 6).alias("auc"), "n_pairs")


@query(f"WITH s AS ({_SETS}), g AS (SELECT event_id, sum(eta) FILTER (is_case = 1) - ln(sum(exp(eta))) AS ll, -ln(count(*)) AS ll0 FROM s GROUP BY 1 HAVING sum(is_case) = 1 AND count(*) >= 2) SELECT event_id % 7 AS yr, round(avg(ll - ll0), 6) AS gain, count(*) AS n FROM g GROUP BY 1")
def backtest_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Gain in log-likelihood a set over chance by period (STA-32)."""
    ll = matched.set_loglik(matched.usable_sets(_sets(spark, folder), ["eta"]), "eta")
    return ll.groupBy((F.col("event_id") % 7).alias("yr")).agg(F.round(F.avg(F.col("ll") - F.col("ll_null")), 6).alias("gain"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ panels and series


@query("""
WITH u AS (SELECT n_nationkey FROM nation), y AS (SELECT unnest(range(1992, 1999)) AS year), c AS (SELECT c_nationkey, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT u.n_nationkey, y.year::INT AS year, coalesce(c.n, 0) AS n FROM u CROSS JOIN y LEFT JOIN c ON c.c_nationkey = u.n_nationkey AND c.year = y.year
""")
def unit_year_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation in every year, zeros included (JON-22)."""
    o = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    counts = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return panels.unit_year_panel(table(spark, folder, "nation"), counts, "n_nationkey", "year", 1992, 1998)


@query(None)
def difference_in_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Rate ratio of treated nation-years with unit and year effects, clustered by unit (STA-16)."""
    panel = unit_year_panel(spark, folder).withColumns({"treated": ((F.col("n_nationkey") % 2 == 0) & (F.col("year") >= 1995)).cast("int"), "exposure": F.lit(1.0)})
    r = panels.difference_in_differences(panel, "n_nationkey", "year", "n", "treated", "exposure")
    return spark.createDataFrame([tuple(r.values())], "rate_ratio double, log_rr double, se double, n_units long, n_cells long")


@query(None)
def poisson_elasticity(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts on log views with errors robust to a week of autocorrelation (STA-14, STA-17, STA-18)."""
    import numpy as np

    daily = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("views")).orderBy("day").limit(panels.MOST_ROWS + 1).toPandas()
    if len(daily) > panels.MOST_ROWS:
        raise ValueError(f"more than {panels.MOST_ROWS} days")
    design, counts = np.log1p(daily[["views"]].to_numpy(float)), daily["n"].to_numpy(float)
    beta, cov, mean = panels.poisson(design, counts)
    hac = panels.hac_covariance(design, counts, mean, cov)
    return spark.createDataFrame([(float(beta[1]), float(np.sqrt(max(hac[1, 1], 0.0))), len(daily))], "elasticity double, se double, n_days long")


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT round(corr(a, b), 6) AS corr FROM d
""")
def series_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of two daily series (STA-22); the null by circular shifts is in ``shifted_correlation``."""
    return shifted_correlation(spark, folder).select(F.round("corr", 6).alias("corr"))


@query(None)
def shifted_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation against ten circular shifts (STA-22, WIN-14)."""
    d = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return spatial_stats.shifted_correlation(d, "a", "b", "day", list(range(5, 25, 2)))


@query("""
WITH s AS (SELECT ts::DATE AS event_day FROM events WHERE event_type = 'signup' GROUP BY 1), e AS (SELECT ts::DATE AS day, value > 50 AS f FROM events)
SELECT event_day, round(count(*) FILTER (day < event_day AND f IS NOT NULL) / 7, 6) AS rate_before, round(count(*) FILTER (day >= event_day AND f IS NOT NULL) / 7, 6) AS rate_after, round(avg(f::INT) FILTER (day < event_day), 6) AS share_before, round(avg(f::INT) FILTER (day >= event_day), 6) AS share_after,
  round((count(*) FILTER (day >= event_day AND f IS NOT NULL) / 7) / nullif(count(*) FILTER (day < event_day AND f IS NOT NULL) / 7, 0), 6) AS rate_ratio
FROM s LEFT JOIN e ON day BETWEEN event_day - 7 AND event_day + 6 GROUP BY 1
""")
def event_study_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rates and shares in the week before and after each event day (AGG-15, media waves)."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    days = e.where("event_type = 'signup'").select(F.col("day").alias("event_day")).distinct()
    out = panels.window_shares(e.select("day", (F.col("value") > 50).alias("f")), "day", "f", days, 7, 7)
    return out.select("event_day", *[F.round(c, 6).alias(c) for c in ("rate_before", "rate_after", "share_before", "share_after", "rate_ratio")])


# ------------------------------------------------------------------ selection and validation


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as test results: family, variable, strategy, effect, p."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    return table(spark, folder, "part").select(
        k.alias("test"), pick(_FAMILIES, k % 3).alias("family"), F.concat(pick(_STEMS, F.floor(k / 12) % 4), pick(("_pre1d_25km", "_pm3h_100km"), F.floor(k / 48) % 2)).alias("variable_a"), pick(("ALL", "EXPLAINED"), F.floor(k / 96) % 2).alias("subset"),
        pick(("CS1", "CS2", "CS4"), F.floor(k / 3) % 3).alias("control_strategy"), pick(("OK", "OK", "SEPARATION", "OK_EXACT"), F.floor(k / 9) % 4).alias("status"),
        F.exp((k * 7919 % 2001 - 1000) / 1500.0).alias("effect"), ((k * 104729 % 10007) / 10007.0 / 8).alias("p_value"), ((k * 31 % 997) / 9970.0).alias("q_bh_all"), (k % 80).alias("n_exposed_cases"), pick(("+", "-"), k % 2).alias("direction"),
    )


_FAMILIES, _STEMS = ("A_global_temporal", "B_weather", "Z_other"), ("any_eq", "any_launch", "n_storm", "any_glaunch")
_RESULTS = """SELECT p_partkey AS test, (['A_global_temporal', 'B_weather', 'Z_other'])[(p_partkey % 3 + 1)::INT] AS family, (['any_eq', 'any_launch', 'n_storm', 'any_glaunch'])[(p_partkey // 12 % 4 + 1)::INT] AS fam, (['_pre1d_25km', '_pm3h_100km'])[(p_partkey // 48 % 2 + 1)::INT] AS win,
  (['ALL', 'EXPLAINED'])[(p_partkey // 96 % 2 + 1)::INT] AS subset, (['CS1', 'CS2', 'CS4'])[(p_partkey // 3 % 3 + 1)::INT] AS control_strategy, (['OK', 'OK', 'SEPARATION', 'OK_EXACT'])[(p_partkey // 9 % 4 + 1)::INT] AS status, exp((p_partkey * 7919 % 2001 - 1000) / 1500.0) AS effect,
  (p_partkey * 104729 % 10007) / 10007.0 / 8 AS p_value, (p_partkey * 31 % 997) / 9970.0 AS q_bh_all, p_partkey % 80 AS n_exposed_cases, (['+', '-'])[(p_partkey % 2 + 1)::INT] AS direction FROM part"""


@query(f"""
WITH r AS (SELECT *, fam || win AS variable_a, status IN ('OK', 'OK_EXACT') AS ok FROM ({_RESULTS})), b AS (SELECT * FROM r WHERE ok QUALIFY row_number() OVER (PARTITION BY family, fam, subset ORDER BY p_value, variable_a, control_strategy) = 1),
s AS (SELECT family, variable_a, subset, sign(ln(effect)) AS sg, list_sort(list_distinct(list(control_strategy))) AS support FROM r WHERE ok AND p_value < 0.05 GROUP BY ALL)
SELECT b.family, b.fam, b.subset, b.variable_a, coalesce(array_to_string(s.support, ';'), '') AS support, array_to_string(list_filter([
  CASE WHEN b.subset = 'EXPLAINED' AND regexp_matches(b.variable_a, 'launch|storm') THEN 'R0 exposure defines subset' END, CASE WHEN NOT (b.q_bh_all < 0.05) THEN 'R1 q' END, CASE WHEN b.effect < 1.15 AND b.effect > 1 / 1.15 THEN 'R2 effect' END, CASE WHEN b.n_exposed_cases < 30 THEN 'R3 exposed cases' END,
  CASE WHEN b.family = 'Z_other' THEN 'R4 no design for family' WHEN len(list_intersect(coalesce(s.support, []), CASE b.family WHEN 'B_weather' THEN ['CS1', 'CS2', 'CS4'] ELSE ['CS1', 'CS2'] END)) < 2 THEN 'R4 strategies < 2' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM b LEFT JOIN s ON s.family = b.family AND s.variable_a = b.variable_a AND s.subset = b.subset AND s.sg = sign(ln(b.effect))
""")
def candidate_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Best test a variable family, its support and the rules it fails (STA-29, ORC-14, SRT-04)."""
    return selection.candidates(_results(spark, folder)).select("family", "fam", "subset", "variable_a", "support", "reasons")


@query(f"""
SELECT test, CASE WHEN status NOT IN ('OK', 'OK_EXACT') THEN 'NOT_TESTABLE' WHEN (effect > 1) = (direction = '+') THEN CASE WHEN p_value < 0.05 THEN 'REPLICATED' ELSE 'SAME_DIRECTION_NS' END WHEN p_value < 0.05 THEN 'OPPOSITE_SIGNIFICANT' ELSE 'OPPOSITE_NS' END AS verdict,
  CASE WHEN status NOT IN ('OK', 'OK_EXACT') THEN 'NOT_TESTABLE' WHEN p_value < 0.05 AND effect / 1.2 > 1 THEN 'PASSED' WHEN p_value < 0.05 AND effect < 1 OR effect * 1.2 < 1.10 THEN 'FAILED' ELSE 'INCONCLUSIVE' END AS control FROM ({_RESULTS})
""")
def validation_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of a validation test and class of a positive control (STA-28, STA-31)."""
    r = _results(spark, folder).withColumns({"ci_low": F.col("effect") / 1.2, "ci_high": F.col("effect") * 1.2})
    return r.select("test", selection.verdict().alias("verdict"), selection.control_class("+").alias("control"))


@query("""
WITH n AS (SELECT o_custkey, (o_orderkey * 7919 % 2001 - 1000) / 1000.0 AS null_value, (o_custkey * 31 % 200) / 100.0 - 1 AS observed FROM orders)
SELECT o_custkey, count(*) AS n_null, CASE WHEN count(*) >= 10 THEN round((count(*) FILTER (abs(null_value) >= abs(observed)) + 1) / (count(*) + 1), 6) END AS p_perm FROM n GROUP BY 1
""")
def rank_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Rank p against null values, none below a least number of them (ORC-19, STA-23 to STA-26)."""
    k = F.col("o_orderkey")
    nulls = table(spark, folder, "orders").select("o_custkey", ((k * 7919 % 2001 - 1000) / 1000.0).alias("v"), ((F.col("o_custkey") * 31 % 200) / 100.0 - 1).alias("observed"))
    return selection.rank_p(nulls, "observed", "v", ["o_custkey"], least=10).select("o_custkey", "n_null", F.round("p_perm", 6).alias("p_perm"))


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY k ORDER BY sha256(k || ':' || o_orderkey), o_orderkey) AS i, k FROM orders, range(3) t(k)) SELECT k::INT AS replicate, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM r WHERE i <= 200 GROUP BY k
""")
def seeded_subsamples(spark: SparkSession, folder: str) -> DataFrame:
    """Replicate subsamples of a set size by hash order: a power study's draws (STA-27)."""
    o = table(spark, folder, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, range(3)))).alias("replicate"))
    draw = F.sha2(F.concat_ws(":", F.col("replicate").cast("string"), F.col("o_orderkey").cast("string")), 256)
    ranked = o.withColumn("i", F.row_number().over(Window.partitionBy("replicate").orderBy(draw, "o_orderkey")))
    return ranked.where("i <= 200").groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query(None)
def interaction_and_spline(spark: SparkSession, folder: str) -> DataFrame:
    """Interaction term per spread, and a cubic spline of one exposure (STA-09, STA-10)."""
    rows = _sets(spark, folder).where("x IS NOT NULL")
    product = matched.interaction(rows, "x", "eta")
    basis = matched.spline_basis(F.col("x"), [5.0, 15.0, 30.0, 45.0])
    frame = rows.withColumns({f"s{i}": b for i, b in enumerate(basis)})
    spline = matched.clogit(frame, [f"s{i}" for i in range(len(basis))])
    out = [("interaction", product.status, product.beta[0] if product.beta else None, product.loglik), ("spline", spline.status, spline.beta[0] if spline.beta else None, spline.loglik)]
    return spark.createDataFrame(out, "model string, status string, beta double, loglik double")


@query(None)
def grouped_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees and an L1 logistic model, held-out sets kept whole, missing values filled from the training fold (STA-11)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _sets(spark, folder).select("event_id", F.col("is_case").cast("double").alias("label"), F.col("is_case"), "x", "eta", F.pmod(F.xxhash64("event_id"), F.lit(5)).alias("fold"))
    prepare = [Imputer(strategy="median", inputCols=["x", "eta"], outputCols=["xf", "ef"]), VectorAssembler(inputCols=["xf", "ef"], outputCol="features")]
    out = []
    for name, model in (("gbt", GBTClassifier(maxIter=5, maxDepth=3, seed=1)), ("l1", LogisticRegression(elasticNetParam=1.0, regParam=0.001))):
        fitted = Pipeline(stages=[*prepare, model]).fit(rows.where("fold <> 0"))
        scored = fitted.transform(rows.where("fold = 0")).withColumn("score", vector_to_array("probability")[1])
        r = matched.conditional_auc(scored, "score").first()
        out.append((name, r.auc, r.n_pairs))
    return spark.createDataFrame(out, "model string, auc double, n_pairs long")


@query("SELECT round(count(*) FILTER (event_type = 'error') / count(*), 9) AS share, count(*) AS n FROM events")
def catalog_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of errors with its base (AGG-15)."""
    return table(spark, folder, "events").agg(F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 9).alias("share"), F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS event_id, ((k % 4 + 1 >= 2 AND c % 2 = 0) OR c % 3 + 1 >= 2 OR (k % 5 >= 3 AND k % 2 = 0))::INT + (k % 6 <> 0)::INT + (k % 7 <> 0 OR c % 7 <> 0)::INT + (c % 4 = 0)::INT
  + (CASE WHEN k % 5 = 0 THEN c % 4 = 1 ELSE k % 100 / 100.0 < 0.1 AND NOT (k % 9 > 5) END)::INT + (k % 90 <= 15 AND c % 40 <= 10)::INT + CASE WHEN k % 11 = 0 THEN 0 ELSE (abs(c % 20 - 10) >= 8)::INT END AS score_without_mag FROM o
""")
def convergence_score(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators that converge on an event, the unknown ones as none (DOM-19, ARR-04)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    told = lambda x: F.when(x, "YES_TEXT").otherwise("NOT_REPORTED")
    e = table(spark, folder, "orders").select(
        k.alias("event_id"), (k % 4 + 1).alias("report_count"), (c % 2 == 0).alias("separated_witnesses"), (c % 3 + 1).alias("source_count"), (k % 5).alias("witnesses"), F.when(k % 2 == 0, "structured").otherwise("none").alias("witness_basis"),
        told(k % 6 != 0).alias("radar"), told(k % 7 != 0).alias("photo"), told(c % 7 != 0).alias("video"), F.when(c % 4 == 0, "ex pilot").alias("witness_type"), F.when(k % 5 == 0, "GEIPAN").otherwise("X").alias("source"), F.when(c % 4 == 1, "D").alias("geipan_class"),
        (k % 100 / 100.0).alias("p_explained"), F.when(k % 9 > 5, 1).alias("n_launch_lpost3h_1500km"), F.lit(None).cast("int").alias("n_fb_pm30m_1000km"), F.lit(0).alias("iss_visible_win"), F.lit(None).cast("double").alias("days_since_starlink_launch"),
        (k % 90).alias("uncertainty_min"), (c % 40).alias("radius_km"), F.lit(None).cast("boolean").alias("magnetometer_flag"), (c % 20 - 10).alias("wx_dslp_24h"), F.lit(0).alias("wx_inversion_proxy"), F.lit(-10.0).alias("sun_alt"), F.when(k % 11 != 0, 3).alias("wx_sky_oktas"),
    )
    return convergence.scored(e).select("event_id", "score_without_mag")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value AS h FROM events), d AS (SELECT user_id, t, abs(h - lag(h) OVER (PARTITION BY user_id ORDER BY t)) AS dh FROM e),
w AS (SELECT p.event_id, s::INT AS shift, max(d.dh) AS m FROM e p CROSS JOIN range(-3, 4) r(s) LEFT JOIN d ON d.user_id = p.user_id AND d.t BETWEEN p.t + s * 86400 - 21600 AND p.t + s * 86400 + 21600 GROUP BY ALL),
g AS (SELECT event_id, max(m) FILTER (shift = 0) AS peak, median(m) FILTER (shift <> 0) AS usual, max(m) FILTER (shift <> 0) AS highest, count(m) FILTER (shift <> 0) AS n_controls FROM w GROUP BY 1)
SELECT event_id, n_controls, round(peak / nullif(usual, 0), 6) AS ratio, peak > highest AS magnetometer_flag FROM g
""")
def anomaly_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The largest step around an event against the same hour of other days (DOM-20, WIN-07)."""
    e = table(spark, folder, "events").select("event_id", F.col("user_id").alias("station"), (X.epoch_us("ts") / 1e6).alias("t"), F.col("value").alias("h"))
    out = convergence.anomaly_rank(e.select(F.col("event_id").alias("point_id"), "station", "t"), e.select("station", "t", "h"), days=3, half_window_s=21600.0, least_values=1, least_controls=1)
    return out.select(F.col("point_id").alias("event_id"), "n_controls", F.round("ratio", 6).alias("ratio"), "magnetometer_flag")


@query("SELECT event_id, round(1 - (1 - least(1.0, greatest(0.0, coalesce(value / 200, 0)))) * (1 - 0.25 * (event_type = 'error')::INT), 9) AS score FROM events")
def indicator_score(spark: SparkSession, folder: str) -> DataFrame:
    """Combined indicator with missing parts as none (DOM-19, AGG-08)."""
    return table(spark, folder, "events").select("event_id", F.round(X.noisy_or(F.col("value") / 200, 0.25 * (F.col("event_type") == "error").cast("double")), 9).alias("score"))
