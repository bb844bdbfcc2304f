"""The race's estimators over all series, in the sizes of the survey."""

from __future__ import annotations

import inspect

import numpy as np

from factorloom.functions import histograms, kernels
from factorloom.plans import catalogue, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"


def test_estimators_have_the_survey_sizes():
    size = lambda f, k: inspect.signature(f).parameters[k].default
    assert size(kernels.forest, "trees") == 300 and size(kernels.lstm, "hidden") == 24 and size(kernels.lstm, "steps") == 150


def test_race_covers_all_series(spark):
    from factorloom.plans import forecasting
    from factorloom.sources import catalog as c

    series = lambda df: {r.series for r in df.select("series").distinct().collect()}
    assert series(forecasting.race_features(spark, DATA)) == series(c.series_day(spark, DATA))


def test_both_crash_classifiers(spark):
    got = registry.QUERIES["M18_crash_classifier"](spark, DATA).toPandas()
    assert set(got.model) == {"Logit", "HGBc"} and got.p.between(0, 1).all()
    assert got.groupby(["series", "t"]).size().eq(2).all()


def test_boosted_classifier_learns():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no line separates these
    p = histograms.classifier()(x[:300], y[:300])(x[300:])
    assert ((p > 0.5) == y[300:]).mean() > 0.8 and (p > 0).all() and (p < 1).all()


def test_pareto_bootstrap_of_all_models_and_levels(spark, monkeypatch):
    from factorloom.plans import inference

    assert inference.TAIL_REPS == 2000
    monkeypatch.setattr(inference, "TAIL_REPS", 60)
    got = inference.k18(spark, DATA).toPandas()
    models = {r.model for r in inference.strats(spark, DATA).select("model").distinct().collect()} - {"RW126"}
    assert set(got.model) == models and set(got.level) == {"es5", "es1"}
