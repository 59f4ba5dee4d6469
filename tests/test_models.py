"""Penalties, selection and walk-forward against direct computation."""

import math
import re
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.operators import frames
from serieswise.operators.features import features_v2
from serieswise.plans import models, search, selection
from serieswise.plans import walk_forward as WF
from serieswise.session import side_by_side
from serieswise.sources.fixtures import fx_market, fx_panel
from test_semantics import plain_positions


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 10, -3]
    y = 0.8 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=400)
    rows = [(0, i, i, *map(float, x[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "series_id long, date_id long, pos long, a double, b double, c double, y double").persist()


@pytest.mark.parametrize("name,params", [
    ("linear", {}), ("ridge", {"alpha": 25.0}), ("lasso", {"alpha": 0.1}), ("elasticnet", {"alpha": 0.2, "l1_ratio": 0.3}),
])
def test_pipeline_and_direct_solution_agree(planted, name, params):
    fitted = models.fit_regressor(planted, ["a", "b", "c"], "y", name, **params)
    got = list(models.coefficients(fitted, ["a", "b", "c"]).values())
    pdf = planted.toPandas()
    x = pdf[["a", "b", "c"]]
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    y = (pdf["y"] - pdf["y"].mean()).to_numpy()
    want, settled = WF.solve_scaled(z.T @ z, z.T @ y, len(y), name, params.get("alpha", 1.0), params.get("l1_ratio", 0.5))
    assert settled
    assert np.allclose(got, want, atol=1e-5)
    if name in ("lasso", "elasticnet"):  # optimality of the penalised problem
        alpha, l1 = params["alpha"], params.get("l1_ratio", 1.0)
        slope = z.T @ (y - z @ want) / len(y) - alpha * (1 - l1) * want
        assert all(abs(s - alpha * l1 * np.sign(w)) < 1e-8 if w else abs(s) <= alpha * l1 + 1e-8 for s, w in zip(slope, want))


@pytest.mark.parametrize("name,params", [("rf", {"n_estimators": 10}), ("boosted", {"n_estimators": 10, "max_depth": 3})])
def test_trees_beat_the_mean_and_repeat(planted, name, params):
    from serieswise.operators.scoring import regression_metrics

    runs = [models.predict(models.fit_regressor(planted, ["a", "b", "c"], "y", name, **params), planted) for _ in range(2)]
    scores = [regression_metrics(r, "y", "prediction").first().r2 for r in runs]
    assert scores[0] > 0.3 and scores[0] == scores[1]


def test_unknown_model_is_named(planted):
    with pytest.raises(ValueError, match="nope"):
        models.fit_regressor(planted, ["a"], "y", "nope")


def test_greedy_pairs_and_keep():
    variance = {"a": 3.0, "b": 1.0, "c": 1.0}
    assert selection.greedy_pairs([("a", "b"), ("b", "c"), ("a", "c")], list("abc"), variance) == ["a"]
    assert selection.greedy_pairs([("b", "c")], list("abc"), variance) == ["a", "b"]  # a tie drops the second
    corr = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}
    kept, chosen = selection.greedy_keep(list("abc"), dict.fromkeys("abc", "g"), variance, corr)
    assert kept == ["a", "c"] and chosen == ["a"]
    assert selection.greedy_keep(["a"], {"a": "g"}, variance, {}) == (["a"], [])  # one survivor is dropped
    assert selection.greedy_keep(["a", "c"], dict.fromkeys("ac", "g"), variance, {})[0] == ["a"]


def test_cum_gain_keeps_at_least_one(spark):
    df = spark.createDataFrame([("a", 95.0), ("b", 5.0)], "feature string, gain double")
    assert {r.feature: r.kept for r in selection.cum_gain(df).collect()} == {"a": 1, "b": 0}


def test_candidates_repeat_and_stay_in_range():
    first, again = search.candidates("rf", 20), search.candidates("rf", 20)
    assert first == again and all(100 <= c["n_estimators"] <= 400 and c["n_estimators"] % 50 == 0 for c in first)
    assert all(0.5 <= c["k"] <= 3.0 for c in first)


def brute_force(pdf, cols, target, initial, folds, alpha):
    """Fold by fold in pandas: select, fill, scale, ridge, map, score."""
    n, start, rows = len(pdf), initial, []
    size, rest = divmod(n - initial, folds)
    for fold in range(folds):
        end = start + size + (fold < rest)
        train, val = pdf.iloc[:start], pdf.iloc[start:end]
        ic = {}
        for c in cols:
            pair = train[[c, target]].dropna()
            if len(pair) >= 10 and pair[c].nunique() > 1:
                r = pair[c].rank().corr(pair[target].rank())
                ic[c] = abs(r * math.sqrt(len(pair) - 2) / math.sqrt(max(1 - r * r, 1e-12)))
        passed = [c for c in cols if ic.get(c, 0) >= 0.5]
        var = train[passed].var(ddof=0)
        groups = {}
        for c in passed:
            m = re.match(r"[A-Z]+\d+", c)
            groups.setdefault(m.group(0) if m else c[0], []).append(c)
        kept = []
        for members in groups.values():
            inside = []
            for c in sorted(members, key=lambda m: -var[m]):
                if all(abs(train[c].corr(train[k])) < 0.85 for k in inside):
                    inside.append(c)
            kept += inside
        chosen = [c for c in kept if var[c] > var[kept].quantile(0.25)]
        mean = train[chosen].mean()
        x = train[chosen].fillna(mean)
        mu, sd = x.mean(), x.std(ddof=0)
        z, y = ((x - mu) / sd).to_numpy(), train[target].to_numpy()
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(chosen)), z.T @ (y - y.mean()))
        pred = lambda part: ((part[chosen].fillna(mean) - mu) / sd).to_numpy() @ w + y.mean()
        pos = plain_positions(np.concatenate([pred(train.iloc[-63:]), pred(val)]))[63:].to_numpy()
        f, rf = val["forward_returns"].to_numpy(), val["risk_free_rate"].to_numpy()
        ret = rf * (1 - pos) + pos * f
        m, mm = np.expm1(np.log1p(ret - rf).mean()), np.expm1(np.log1p(f - rf).mean())
        gap = max(0, (mm - m) * 25200)
        score = m / ret.std(ddof=1) * math.sqrt(252) / ((1 + max(0, ret.std(ddof=1) / f.std(ddof=1) - 1.2)) * (1 + gap**2 / 100))
        err = val[target].to_numpy() - pred(val)
        rows.append((fold, len(train), len(val), len(chosen), np.abs(err).mean(), np.abs(y - pred(train)).mean(), score))
        start = end
    return rows


@pytest.mark.parametrize("size", [None, 500])
def test_one_pass_folds_equal_fold_by_fold(spark, sf_dir, size):
    if size:
        spark.conf.set("serieswise.blockRows", str(size))
    df, made = features_v2(fx_market(spark, sf_dir))
    cols = [c for group in made.values() for c in group] + ["rate_regime"]
    df = df.persist()
    table, _ = WF.walk_forward_linear(df, cols, model="ridge", alpha=2.0, initial=1512, folds=3)
    got = table.orderBy("fold").collect()
    pdf = df.orderBy("pos").toPandas()
    spark.conf.unset("serieswise.blockRows")
    want = brute_force(pdf, cols, C.EXCESS_TARGET, 1512, 3, 2.0)
    assert len(got) == 3
    for g, w in zip(got, want):
        assert (g.fold, g.train_size, g.val_size, g.n_features) == w[:4]
        assert np.allclose([g.mae, g.train_mae, g.adjusted_sharpe], w[4:], atol=1e-7)


def test_walk_forward_for_trees(spark, sf_dir):
    df, made = features_v2(fx_market(spark, sf_dir))
    cols = [c for group in made.values() for c in group]
    table, val = WF.walk_forward_estimator(df.persist(), cols, model="boosted", initial=1512, folds=2, n_estimators=2, max_depth=2)
    assert table.count() == 2 and val.filter("position < 0 or position > 2").count() == 0


def test_halving_keeps_a_third_and_triples_trees(spark, planted):
    df = planted.withColumn("label", (F.col("y") > 0).cast("int"))
    log = search.successive_halving(df, ["a", "b"], "label", n_candidates=4, factor=2, min_trees=1, max_trees=2, folds=2).collect()
    assert sum(r.rung == 0 for r in log) == 4 and sum(r.rung == 1 for r in log) == 2
    assert {r.trees for r in log if r.rung == 1} == {2} and sum(r.kept for r in log if r.rung == 1) == 1


def test_final_fit_positions(spark, sf_dir):
    df, made = features_v2(fx_market(spark, sf_dir))
    df = frames.split_holdout(df).persist()
    train, test = (df.filter(F.col("split") == s) for s in ("train", "test"))
    cols = [c for group in made.values() for c in group]
    placed, chosen = WF.final_fit_predict(train, test, cols, model="ridge", alpha=1.0)
    assert chosen and placed.count() == test.count() and placed.filter("position is null").count() == 0


def test_descent_says_when_it_has_not_settled():
    gram, cross = np.array([[1.0, 0.999], [0.999, 1.0]]), np.array([0.7, 0.6])
    assert WF.solve_scaled(gram, cross, 1.0, "lasso", 1e-6, 1.0, sweeps=3)[1] is False
    assert WF.solve_scaled(gram, cross, 1.0, "lasso", 1e-6, 1.0, sweeps=100_000)[1] is True


def test_walk_forward_of_a_panel_equals_each_series_alone(spark):
    rng = np.random.default_rng(9)
    frames = []
    x = rng.standard_normal((300, 2))
    y = 0.5 * x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.standard_normal(300)
    for series, level in enumerate((0.0, 1e4, 1e7)):
        frames += [(series, i, i, float(a + level), float(b - level), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(frames, "series_id long, date_id long, pos long, M1 double, E1 double, y double")
    fit = lambda part: {
        (r.series_id, r.fold): [r.intercept, *r.weights] for r in WF.fit_folds(part, ["M1", "E1"], "y", "ridge", initial=200, folds=4).collect()
    }
    together = fit(df.repartition(5))
    assert len(together) == 12
    for series in range(3):
        for key, values in fit(df.filter(df.series_id == series)).items():
            assert np.allclose(values[1:], together[key][1:], rtol=1e-7, atol=1e-8)
            assert abs(values[0] - together[key][0]) <= 1e-7 * max(1.0, abs(values[0]))
    # the level does not change the weights
    assert all(np.allclose(v[1:], together[0, fold][1:], rtol=1e-6, atol=1e-7) for (_, fold), v in together.items())


@pytest.mark.parametrize("model", ["linear", "ridge", "lasso", "elasticnet"])
def test_path_equals_separate_solutions(model):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 6)) @ rng.standard_normal((6, 6))
    z = (x - x.mean(0)) / x.std(0)
    y = z @ rng.standard_normal(6) + rng.standard_normal(90)
    gram, cross = z.T @ z, z.T @ (y - y.mean())
    params = [{**p, "alpha": p.get("alpha", 1.0)} for p in search.candidates(model, 12)]
    weights, settled = WF.solve_path(gram, cross, 90.0, model, params)
    assert settled.all()
    for w, p in zip(weights, params):
        alone, _ = WF.solve_scaled(gram, cross, 90.0, model, p["alpha"], p.get("l1_ratio", 1.0))
        assert np.allclose(w, alone, rtol=1e-9, atol=1e-10)


@pytest.mark.parametrize("model,size", [("ridge", None), ("ridge", 100), ("lasso", None)])
def test_all_candidates_in_one_job_equal_separate_validation(spark, sf_dir, model, size):
    """The loop it replaces: one walk-forward run per candidate."""
    if size:
        spark.conf.set("serieswise.blockRows", str(size))
    df, made = features_v2(fx_panel(spark, sf_dir))
    df = df.filter("series_id <= 3").persist()
    cols = [c for group in made.values() for c in group]
    tuned = {r.candidate: r for r in search.tune(df, cols, model, trials=3, initial=150, folds=3).collect()}
    spark.conf.unset("serieswise.blockRows")
    assert sorted(tuned) == [0, 1, 2]
    for i, p in enumerate(search.candidates(model, 3)):
        table, _ = WF.walk_forward_linear(df, cols, model=model, initial=150, folds=3, **p)
        want = WF.fold_summary(table).first()["adjusted_sharpe"]
        assert tuned[i].error is None and abs(tuned[i].score - want) < 1e-7 * max(1.0, abs(want))
    assert [tuned[c].score for c in tuned] == sorted((t.score for t in tuned.values()), reverse=True)
    df.unpersist()


def test_refused_parameters_are_named_and_lost_jobs_are_errors(spark, planted, monkeypatch):
    rows = planted.withColumns({"forward_returns": F.col("y"), "risk_free_rate": F.lit(0.0)})
    monkeypatch.setattr(search, "candidates", lambda *a, **k: [{"n_estimators": 0}])
    monkeypatch.setattr(search, "walk_forward_estimator", partial(WF.walk_forward_estimator, target="y"))
    refused = search.tune(rows, ["a", "b", "c"], "rf", trials=1, initial=200, folds=2).first()
    assert refused.score == search.FAILED and "numTrees" in refused.error

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(search, "walk_forward_estimator", lost)
    with pytest.raises(RuntimeError, match="lost"):
        search.tune(rows, ["a"], "rf", trials=1)


def test_jobs_side_by_side_keep_their_order(spark):
    jobs = [partial(lambda n: spark.range(n).count(), n) for n in range(12)]
    assert side_by_side(spark, jobs, most=4) == list(range(12))


def test_estimator_folds_read_the_panel_once_and_for_their_fit(spark, planted):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    rows = planted.count()
    target = F.udf(seen, "double")("y")
    df = planted.select("*", target.alias("market_forward_excess_returns"), F.lit(0.01).alias("forward_returns"), F.lit(0.0).alias("risk_free_rate"))
    table, _ = WF.walk_forward_estimator(df, ["a", "b", "c"], model="rf", initial=100, folds=3, n_estimators=2, max_depth=2)
    assert table.count() == 3 and read.value <= 8 * rows  # once, and the fitted columns once a fold


def test_large_fits_do_not_run_side_by_side():
    assert models.fits_at_once(1_000) == 8 and models.fits_at_once(0, most=3) == 3
    assert models.fits_at_once(100_000_000, 100) == 1
    assert 1 <= models.fits_at_once(8_000_000) < 8


def test_halving_runs_large_fits_one_by_one(spark, planted, monkeypatch):
    seen = []

    def noted(session, jobs, most=8):
        seen.append(most)
        return side_by_side(session, jobs, most)

    monkeypatch.setattr(search, "side_by_side", noted)
    monkeypatch.setattr(models, "FIT_BYTES", 1)
    df = planted.withColumn("label", (F.col("y") > 0).cast("int"))
    search.successive_halving(df, ["a", "b"], "label", n_candidates=2, factor=2, min_trees=1, max_trees=1, folds=2).collect()
    assert seen and set(seen) == {1}


def test_a_large_forest_is_grown_in_groups_of_trees(planted, monkeypatch):
    monkeypatch.setattr(models, "FIT_BYTES", 4 * 400 * 3)
    fitted = models.fit_regressor(planted, ["a", "b", "c"], "y", "rf", n_estimators=8, max_depth=2)
    forests = [s for s in fitted.stages if hasattr(s, "getNumTrees")]
    assert [f.getNumTrees for f in forests] == [3, 3, 2]
    said = models.predict(fitted, planted)
    assert said.columns == [*planted.columns, "prediction"]
    filled = fitted.stages[1].transform(fitted.stages[0].transform(planted))
    rows = [(r.date_id, r.features) for r in filled.select("date_id", "features").limit(20).collect()]
    got = {r.date_id: r.prediction for r in said.select("date_id", "prediction").collect()}
    for day, features in rows:
        assert math.isclose(got[day], np.mean([t.predict(features) for f in forests for t in f.trees]), rel_tol=1e-9)
    whole = models.fit_regressor(planted, ["a"], "y", "rf", n_estimators=3, max_depth=2)
    assert whole.stages[-1].getNumTrees == 3 and len(whole.stages) == 3
