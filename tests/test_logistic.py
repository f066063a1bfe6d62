"""Quasi-binomial fits against an independent solver and closed forms."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from habitatq.plans import logistic


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    rows = []
    for data, shift in (("O", 0.0), ("P", 0.7), ("F", 2.0)):
        for i in range(40):
            x = i / 2
            y = 1 / (1 + math.exp(-(0.6 * (x - 9 - shift)))) + rng.normal(0, 0.03)
            rows.append((data, "X", x, float(min(max(y, 0.0), 1.0))))
    return spark.createDataFrame(rows, "data string, spp string, temp_bin double, cdf_q_norm double").cache()


def test_coefficients_match_spark_ml(spark, curve):
    fits = {r.stage: r for r in logistic.logistic_cdf_fit(logistic.with_stage(curve, ["F"])).collect()}
    for stage, surveys in (("Larvae", ["F"]), ("Eggs", ["O", "P"])):
        data = curve.filter(F.col("data").isin(surveys)).withColumn("label", F.round("cdf_q_norm", 4))
        data = VectorAssembler(inputCols=["temp_bin"], outputCol="features").transform(data)
        ml = GeneralizedLinearRegression(family="binomial", link="logit", tol=1e-10, maxIter=50).fit(data)
        mine = fits[stage]
        assert mine.converged and mine.n == data.count()
        assert mine.b0 == pytest.approx(ml.intercept, abs=1e-6)
        assert mine.b1 == pytest.approx(ml.coefficients[0], abs=1e-6)
        slope_se, intercept_se = ml.summary.coefficientStandardErrors
        assert math.sqrt(mine.v00) == pytest.approx(intercept_se, rel=1e-4)
        assert math.sqrt(mine.v11) == pytest.approx(slope_se, rel=1e-4)


def test_band_matches_closed_form(spark, curve):
    fit = logistic.logistic_cdf_fit(logistic.with_stage(curve, ["F"])).filter("stage = 'Eggs'")
    c = fit.first()
    points = {r.temp: r for r in logistic.logistic_cdf_predict(fit, low=-0.5, high=30.0).collect()}
    assert len(points) == 62
    cov = np.array([[c.v00, c.v01], [c.v01, c.v11]]) * c.dispersion
    for x in (-0.5, 4.0, 9.5, 15.0, 30.0):
        v = np.array([1.0, x])
        p = 1 / (1 + math.exp(-(c.b0 + c.b1 * x)))
        se = math.sqrt(v @ cov @ v) * p * (1 - p)
        assert points[x].prop == pytest.approx(p)
        assert points[x].se == pytest.approx(se)
        assert points[x].upper == pytest.approx(p + 1.959963984540054 * se)


def test_dispersion_is_pearson_over_df(spark, curve):
    c = logistic.logistic_cdf_fit(logistic.with_stage(curve, ["F"])).filter("stage = 'Larvae'").first()
    rows = curve.filter("data = 'F'").collect()
    x = np.array([r.temp_bin for r in rows])
    y = np.round(np.array([r.cdf_q_norm for r in rows]), 4)
    mu = 1 / (1 + np.exp(-(c.b0 + c.b1 * x)))
    assert c.dispersion == pytest.approx((((y - mu) ** 2) / (mu * (1 - mu))).sum() / (len(y) - 2), rel=1e-5)


def test_small_and_flat_groups_are_flagged_not_fatal(spark):
    rows = [("F", "few", 1.0, 0.2), ("F", "few", 2.0, 0.4), ("F", "one", 1.0, 0.2), ("F", "none", 1.0, None)]
    rows += [("F", "samex", 5.0, v) for v in (0.1, 0.2, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "data string, spp string, temp_bin double, cdf_q_norm double")
    got = {r.spp: r for r in logistic.logistic_cdf_fit(logistic.with_stage(df, ["F"])).collect()}
    assert set(got) == {"few", "one", "samex"}
    assert all(r.b0 is None and not r.converged for r in got.values())
    assert got["samex"].n == 4


def test_stages_are_stacked(spark, curve):
    got = logistic.stage_comparison(curve, ["F"])
    assert {r.stage for r in got.select("stage").distinct().collect()} == {"Larvae", "Eggs"}
    assert got.filter("stage = 'Larvae'").count() == 40
