"""Models, search and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.catalog.frame_queries import EXPANDING, SPLIT
from serieswise.catalog.metric_queries import LOG, score_sql
from serieswise.catalog.selection_queries import COLS, engineered, ic_sql
from serieswise.functions.scalar import direction
from serieswise.operators import diagnostics as G
from serieswise.operators import frames as T
from serieswise.operators import scoring as S
from serieswise.plans import models as M
from serieswise.plans import search as H
from serieswise.plans import walk_forward as WF
from serieswise.session import settle, shared_dir
from serieswise.sources import panel_io as IO

TARGET = C.EXCESS_TARGET
FEATURES = ["M1", "M2", "E1", "V1"]
ROW = ["series_id", "date_id"]


# ---- linear family: with one standardised column each has a closed form in SQL

UNIVARIATE = """
fitted AS (SELECT avg(y) AS b, covar_pop(x, y) / stddev_pop(x) AS c, count(*) AS n
           FROM (SELECT M1 AS x, market_forward_excess_returns AS y FROM split WHERE split = 'train'))"""
WEIGHTS = {
    "fit_linear": ("linear", {}, "c"),
    "fit_ridge": ("ridge", {"alpha": 5000.0}, "c * n / (n + 5000.0)"),
    "fit_lasso": ("lasso", {"alpha": 0.00002}, "sign(c) * greatest(abs(c) - 0.00002, 0)"),
    "fit_elasticnet": ("elasticnet", {"alpha": 0.00005, "l1_ratio": 0.4},
                       "sign(c) * greatest(abs(c) - 0.00002, 0) / (1 + 0.00003)"),
}


def register_linear(name: str, model: str, params: dict, weight: str) -> None:
    @query(name, panel_sql(f"SELECT 'M1' AS feature, {rsql(weight)} AS weight, {rsql('b')} AS intercept FROM fitted", SPLIT, UNIVARIATE))
    def run(spark, sf_dir):
        train = T.split_three_way(fx_panel(spark, sf_dir)).filter("split = 'train'")
        fitted = M.fit_regressor(train, ["M1"], TARGET, model, **params)
        solved = fitted.stages[-1]
        rows = [("M1", float(solved.coefficients[0]), float(solved.intercept))]
        return out(spark.createDataFrame(rows, "feature string, weight double, intercept double"), ["feature"], ["weight", "intercept"])


for _name, (_model, _params, _weight) in WEIGHTS.items():
    register_linear(_name, _model, _params, _weight)


def split_panel(spark, sf_dir):
    return T.split_three_way(fx_panel(spark, sf_dir))


def scores_by_split(fitted, panel):
    return S.regression_metrics(M.predict(fitted, panel), TARGET, "prediction", ["split"])


@query("fit_forest")
def fit_forest(spark, sf_dir):
    panel = settle(split_panel(spark, sf_dir))
    fitted = M.fit_regressor(
        panel.filter("split = 'train'"), FEATURES, TARGET, "rf", min_samples_leaf=5, max_features=0.6
    )
    return scores_by_split(fitted, panel)


@query("fit_boosted")
def fit_boosted(spark, sf_dir):
    panel = settle(split_panel(spark, sf_dir))
    train, val = (panel.filter(F.col("split") == s) for s in ("train", "val"))
    fitted = M.fit_regressor(train, FEATURES, TARGET, "boosted", val)
    return scores_by_split(fitted, panel)


STUMP = """
leaf AS (SELECT D1, avg(market_forward_excess_returns) AS m, avg(CASE WHEN forward_returns > 0 THEN 1.0 ELSE -1.0 END) AS s
         FROM split WHERE split = 'train' GROUP BY D1)"""


@query("fit_boosted_stump", panel_sql(f"SELECT series_id, date_id, {rsql('m')} AS prediction FROM split JOIN leaf ON split.D1 = leaf.D1", SPLIT, STUMP))
def fit_boosted_stump(spark, sf_dir):
    """One tree of one split over a two-valued column: predictions are the leaves' means."""
    panel = split_panel(spark, sf_dir)
    fitted = M.fit_regressor(panel.filter("split = 'train'"), ["D1"], TARGET, "boosted", n_estimators=1, max_depth=1)
    return out(M.predict(fitted, panel), ROW, ["prediction"])


@query("fit_direction_stump", panel_sql(f"""
SELECT series_id, date_id, {rsql('1 / (1 + exp(-2 * s))')} AS probability FROM split JOIN leaf ON split.D1 = leaf.D1""", SPLIT, STUMP))
def fit_direction_stump(spark, sf_dir):
    panel = labelled(spark, sf_dir)
    path = shared_dir(spark, "stump")
    M.save_model(M.fit_direction(panel.filter("split = 'train'"), ["D1"], "label", n_estimators=1, max_depth=1), path)
    return out(M.predict_probability(M.load_model(path), panel), ROW, ["probability"])


def labelled(spark, sf_dir):
    panel = split_panel(spark, sf_dir)
    return panel.withColumn("label", direction(F.col(C.RETURN_TARGET)))


@query("fit_direction")
def fit_direction(spark, sf_dir):
    """Direction classifier with area under the curve and accuracy per split."""
    panel = settle(labelled(spark, sf_dir))
    fitted = M.fit_direction(panel.filter("split = 'train'"), FEATURES, "label", n_estimators=40)
    return S.auc_accuracy(M.predict_probability(fitted, panel), "label", "probability", ["split"])


@query("predict_proba")
def predict_proba(spark, sf_dir):
    """Probabilities of the test rows from a saved and reloaded classifier."""
    panel = settle(labelled(spark, sf_dir).select(*ROW, *FEATURES, "label", "split"))
    path = shared_dir(spark, "direction")
    M.save_model(M.fit_direction(panel.filter("split = 'train'"), FEATURES, "label", n_estimators=40), path)
    return M.predict_probability(M.load_model(path), panel.filter("split = 'test'")).select(*ROW, "probability")


@query("model_save_load", panel_sql(f"""
SELECT series_id, date_id, {rsql('b + c * (M1 - m) / s')} AS prediction
FROM split, fitted, (SELECT avg(M1) AS m, stddev_pop(M1) AS s FROM split WHERE split = 'train') z WHERE split = 'test'""", SPLIT, UNIVARIATE))
def model_save_load(spark, sf_dir):
    panel = split_panel(spark, sf_dir)
    path = shared_dir(spark, "linear")
    M.save_model(M.fit_regressor(panel.filter("split = 'train'"), ["M1"], TARGET, "linear"), path)
    return out(M.predict(M.load_model(path), panel.filter("split = 'test'")), ROW, ["prediction"])


@query("successive_halving")
def successive_halving(spark, sf_dir):
    train = labelled(spark, sf_dir).filter("split = 'train'")
    return H.successive_halving(train, FEATURES, "label")


def scored_columns(spark, sf_dir):
    """The columns of the engineered panel that selection, fits and scores read."""
    df = engineered(spark, sf_dir)
    kept = [c for c in (C.BLOCK, *ROW, C.POS) if c in df.columns]
    return df.select(*kept, TARGET, "forward_returns", "risk_free_rate", *COLS)


@query("search_candidates")
def search_candidates(spark, sf_dir):
    """Ridge candidates scored by walk-forward validation of every series."""
    return H.tune(settle(engineered(spark, sf_dir)), COLS, "ridge", initial=252)


@query("tuned_evaluation")
def tuned_evaluation(spark, sf_dir):
    """The best of all candidates validated anew on more folds, one row per series."""
    df = settle(scored_columns(spark, sf_dir))
    tuned = settle(H.tune(df, COLS, "ridge", initial=252))
    _, _, _, summary = H.evaluate_tuned(df, COLS, "ridge", tuned, initial=252, keep=[C.DAY])
    return summary


@query("walk_forward_cv")
def walk_forward_cv(spark, sf_dir):
    """Fold table of a ridge model: all series and folds in one job."""
    df = settle(engineered(spark, sf_dir))
    folds, _ = WF.walk_forward_linear(df, COLS, model="ridge", alpha=1.0, initial=252, folds=5)
    return folds


@query("walk_forward_forest")
def walk_forward_forest(spark, sf_dir):
    df = settle(engineered(spark, sf_dir))
    folds, _ = WF.walk_forward_estimator(df, COLS, model="rf", initial=252)
    return folds


FOLD_RULE = """
fold_rows AS (SELECT r.*, f.fold FROM returned r JOIN folds f ON r.series_id = f.series_id AND r.date_id >= f.a AND r.date_id < f.b),
fold_err AS (SELECT series_id, fold, avg(abs(market_forward_excess_returns - prediction)) AS mae,
                    avg(power(market_forward_excess_returns - prediction, 2)) AS mse,
                    1 - avg(power(market_forward_excess_returns - prediction, 2)) / var_pop(market_forward_excess_returns) AS r2
             FROM fold_rows GROUP BY series_id, fold)"""


@query("fold_summary", positioned_sql(f"""
SELECT e.series_id, {rsql('avg(mae)')} AS mae, {rsql('avg(mse)')} AS mse, {rsql('avg(sqrt(mse))')} AS rmse, {rsql('avg(r2)', 5)} AS r2,
       {rsql('avg(raw_sharpe / (vol_penalty * return_penalty))', 7)} AS adjusted_sharpe
FROM fold_err e JOIN parts p ON e.series_id = p.series_id AND e.fold = p.fold GROUP BY e.series_id""",
    EXPANDING, FOLD_RULE, score_sql(*LOG, "fold_rows", "series_id, fold")))
def fold_summary(spark, sf_dir):
    """Fold means of the lagged rule on the folds' validation rows."""
    panel = fx_panel(spark, sf_dir)
    folds = T.folds_expanding(panel, 252, 5).filter("role = 'val'").select(*ROW, "fold")
    rows = positioned(spark, sf_dir).join(folds, ROW)
    by = ["series_id", "fold"]
    table = S.regression_metrics(rows, TARGET, "prediction", by).drop("n").join(S.score_v2(rows, by).drop("n"), by)
    return out(WF.fold_summary(table, ["series_id"]), ["series_id"], {"mae": 9, "mse": 9, "rmse": 9, "r2": 5, "adjusted_sharpe": 7})


@query("final_fit_predict")
def final_fit_predict(spark, sf_dir):
    split = T.split_holdout(engineered(spark, sf_dir))
    kept = [c for c in (C.BLOCK, *ROW, C.POS) if c in split.columns]
    df = settle(split.select(*kept, TARGET, *COLS, "split"))  # the columns that the fit and the positions read
    train, test = (df.filter(F.col("split") == s) for s in ("train", "test"))
    placed, _ = WF.final_fit_predict(train, test, COLS, TARGET, "ridge", alpha=1.0)
    return placed.select(*ROW, "prediction", "position")


@query("compare_models")
def compare_models(spark, sf_dir):
    return H.compare_models(settle(split_panel(spark, sf_dir)), FEATURES)


# ---- a walk-forward run with a closed form: of two columns without a common group the one of lower variance
# is always cut, so every fold is a ridge over M1, where both columns pass the IC limit

RIDGE = 5.0
PAIR_COLS = ["M1", "E1"]
WALK_SQL = f"""
train AS (SELECT p.*, f.fold FROM fx_panel p JOIN folds f ON p.series_id = f.series_id AND p.date_id < f.a),
passing AS (SELECT series_id, fold FROM ({ic_sql('train', PAIR_COLS, 'series_id, fold')}) WHERE n >= 10 AND ic IS NOT NULL
              AND abs(ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12))) >= {C.IC_T_MIN}
            GROUP BY series_id, fold HAVING count(*) = 2),
line AS (SELECT t.series_id, t.fold, avg({TARGET}) AS base, avg(M1) AS m, stddev_pop(M1) AS s, count(*) AS n,
                covar_pop(M1, {TARGET}) / stddev_pop(M1) * count(*) / (count(*) + {RIDGE}) AS w
         FROM train t JOIN passing USING (series_id, fold) GROUP BY t.series_id, t.fold),
said AS (SELECT p.*, l.fold, base + w * (M1 - m) / s AS guess, CASE WHEN p.date_id < f.a THEN 'train' ELSE 'val' END AS role, p.date_id >= f.a - {C.K_WINDOW} AS lead_in
         FROM fx_panel p JOIN folds f ON p.series_id = f.series_id AND p.date_id < f.b JOIN line l ON l.series_id = f.series_id AND l.fold = f.fold),
errors AS (SELECT series_id, fold, role, count(*) AS n, avg(abs({TARGET} - guess)) AS mae, avg(power({TARGET} - guess, 2)) AS mse,
                  1 - avg(power({TARGET} - guess, 2)) / var_pop({TARGET}) AS r2 FROM said GROUP BY series_id, fold, role),
scored AS (SELECT series_id * 100 + fold AS series_id, date_id, guess AS prediction, forward_returns, risk_free_rate, role FROM said WHERE lead_in)"""
VAL_SQL = "val AS (SELECT * FROM returned WHERE role = 'val')"
FOLD_SQL = """
fold_table AS (SELECT e.series_id, e.fold, t.n AS train_size, e.n AS val_size, 1 AS n_features, e.mae, t.mae AS train_mae, e.r2, t.r2 AS train_r2, e.mse,
                      raw_sharpe / (vol_penalty * return_penalty) AS adjusted_sharpe
               FROM errors e JOIN errors t ON e.series_id = t.series_id AND e.fold = t.fold AND e.role = 'val' AND t.role = 'train'
               JOIN parts p ON p.series_id = e.series_id * 100 + e.fold),
verdicts AS (SELECT series_id, avg(mae - train_mae) AS mae_gap, avg(train_mae) AS train_mae, avg(mae) AS mae, quantile_cont(mae, 0.8) AS mae_p80,
                    CASE WHEN avg(mae - train_mae) > avg(train_mae) * 0.5 THEN 'high_variance'
                         WHEN avg(mae) > quantile_cont(mae, 0.8) THEN 'high_bias' ELSE 'balanced' END AS verdict
             FROM fold_table GROUP BY series_id)"""
WALK = [EXPANDING, WALK_SQL, POSITIONED, VAL_SQL, score_sql(*LOG, "val"), FOLD_SQL]
FOLD_DIGITS = {"mae": 9, "train_mae": 9, "r2": 6, "train_r2": 6, "adjusted_sharpe": 6}


def pair_folds(spark, sf_dir):
    folds, val = WF.walk_forward_linear(settle(fx_panel(spark, sf_dir)), PAIR_COLS, model="ridge", alpha=RIDGE, initial=252, folds=5)
    return folds.withColumn("fold", F.col("fold").cast("long")), val


@query("walk_forward_ridge", panel_sql(f"""
SELECT series_id, fold, train_size, val_size, n_features, {rsql('sqrt(mse)')} AS rmse, {cols_sql(['mae', 'train_mae'])}, {cols_sql(['r2', 'train_r2', 'adjusted_sharpe'], 6)}
FROM fold_table""", *WALK))
def walk_forward_ridge(spark, sf_dir):
    """Every series and fold in one job, against the closed form of a ridge."""
    folds, _ = pair_folds(spark, sf_dir)
    return out(folds, ["series_id", "fold", "train_size", "val_size", "n_features"], {"rmse": 9, **FOLD_DIGITS})


@query("learning_curve", panel_sql(f"""
SELECT series_id, {rsql('mae_gap')} AS mae_gap, {rsql('train_mae')} AS train_mae, {rsql('mae')} AS mae, {rsql('mae_p80')} AS mae_p80, verdict FROM verdicts""", *WALK))
def learning_curve(spark, sf_dir):
    folds, _ = pair_folds(spark, sf_dir)
    return out(G.learning_curve(folds, ["series_id"]), ["series_id", "verdict"], ["mae_gap", "train_mae", "mae", "mae_p80"])


@query("learning_curve_folds", panel_sql(f"""
SELECT f.series_id, fold, train_size, val_size, n_features, {', '.join(f'{rsql("f." + c, d)} AS {c}' for c, d in FOLD_DIGITS.items())}, {rsql('mae_gap')} AS mae_gap, verdict
FROM fold_table f JOIN verdicts v ON f.series_id = v.series_id""", *WALK))
def learning_curve_folds(spark, sf_dir):
    """Errors, score and features of every fold with the verdict of its series."""
    folds, _ = pair_folds(spark, sf_dir)
    plain = ["series_id", "fold", "train_size", "val_size", "n_features", "verdict"]
    return out(G.learning_curve_folds(folds, ["series_id"]), plain, {**FOLD_DIGITS, "mae_gap": 9})


@query("cv_summary")
def cv_summary(spark, sf_dir):
    """A tuned model and buy-and-hold on the same validation rows, mean over series, with the beat flag."""
    df = settle(scored_columns(spark, sf_dir))
    tuned = settle(H.tune(df, COLS, "ridge", initial=252))
    _, _, val, summary = H.evaluate_tuned(df, COLS, "ridge", tuned, initial=252, keep=[C.DAY])
    return IO.finite_numbers(H.cv_report({"ridge": summary}, val))


@query("best_direction")
def best_direction(spark, sf_dir):
    """The halving's winner refitted on all training rows: area under the curve and accuracy per split."""
    panel = settle(labelled(spark, sf_dir))
    train = panel.filter("split = 'train'")
    log = H.successive_halving(train, FEATURES, "label", n_candidates=4, factor=2, min_trees=4, max_trees=8, folds=2)
    fitted, params, _ = H.best_direction(train, FEATURES, "label", log)
    return S.auc_accuracy(M.predict_probability(fitted, panel), "label", "probability", ["split"]).withColumn("trees", F.lit(params["n_estimators"]))
