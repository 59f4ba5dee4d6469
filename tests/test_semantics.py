"""Hand-checked frames and pandas counterparts for the rules that are easy to get wrong."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.functions import scalar as Z
from serieswise.operators import backtest as B
from serieswise.operators import clean, frames, profile, scoring
from serieswise.operators import features as X
from serieswise.operators.blocks import (
    expanding_std, last_known, number_rows, renumber, rolling, running_max, running_product, running_sum, scan,
)
from serieswise.operators.concordance import kendall
from serieswise.operators.correlation import corr_target, pair_correlations
from serieswise.operators.diagnostics import learning_curve
from serieswise.operators.ordered import exact_quantiles, spearman
from serieswise.sources import panel_io as IO


def close(a, b, tol=1e-9):
    a = [math.nan if v is None else v for v in a]
    return np.allclose(np.array(a, float), np.array(b, float), rtol=0, atol=tol, equal_nan=True)


@pytest.fixture()
def noisy():
    rng = np.random.default_rng(7)
    x = rng.normal(size=700)
    x[rng.random(700) < 0.2] = np.nan
    return x


def listed(x):
    return [None if v != v else v for v in x]


def test_scans_equal_pandas_in_both_modes(spark, frame, noisy):
    results = []
    for size in (None, 50):
        if size:
            spark.conf.set("serieswise.blockRows", str(size))
        df = number_rows(frame(x=listed(noisy), r=[v / 100 for v in range(700)]).drop("pos"))
        assert ("_block" in df.columns) == bool(size)
        out = scan(df, {
            "prod": running_product(F.lit(1.0) + F.col("r") / 1000), "total": running_sum(F.col("r")),
            "top": running_max(F.col("x")), "held": last_known(F.col("x")),
            "filled": last_known(F.col("x"), lead_in=True), "std": expanding_std(F.col("x")),
        })
        out = rolling(out, lambda f: {"mean": X.rolling_mean(F.col("x"), f.last(20), 5), "rank": X.rank_pct(F.col("x"), f.last(20)),
                                      "next": F.lead("x").over(f.ordered)}, 20, 1)
        results.append({c: column(out, c) for c in ("prod", "total", "top", "held", "filled", "std", "mean", "rank", "next")})
        spark.conf.unset("serieswise.blockRows")
    s, r = pd.Series(noisy), pd.Series([v / 100 for v in range(700)])

    def pct(w):
        cur, known = w[-1], w[~np.isnan(w)]
        return (len(w) if np.isnan(cur) else (known <= cur).sum()) / len(w)

    # pandas hands over short first windows as they are
    rank = [np.nan if np.isfinite(noisy[max(0, i - 19):i + 1]).sum() < 5 else pct(noisy[max(0, i - 19):i + 1]) for i in range(700)]
    want = {
        "prod": (1 + r / 1000).cumprod(), "total": r.cumsum(), "top": s.expanding().max(), "held": s.ffill(),
        "filled": s.ffill().bfill(), "std": s.expanding().std(), "mean": s.rolling(20, min_periods=5).mean(),
        "rank": rank, "next": s.shift(-1),
    }
    for got in results:
        for name, values in want.items():
            assert close(got[name], values), name


def test_numbering_closes_gaps_and_ignores_input_order(spark, frame):
    df = frame(x=list(range(300))).drop("pos").orderBy(F.rand(3))
    for size in ("1000", "32"):
        spark.conf.set("serieswise.blockRows", size)
        kept = renumber(number_rows(df).filter("x % 3 = 1"))
        assert column(kept, "pos") == list(range(100))
        spark.conf.unset("serieswise.blockRows")


def test_future_rows_do_not_change_past_features(spark, frame, noisy):
    cols = dict(M1=listed(noisy), E1=listed(noisy[::-1]), risk_free_rate=[0.0001] * 700)
    full, _ = X.features_v2(frame(**cols), trim=False)
    cut, _ = X.features_v2(frame(**{c: v[:400] for c, v in cols.items()}), trim=False)
    for name in ("M1_roll5", "E1_diff21", "E1_diff63"):
        assert column(full, name)[:400] == column(cut, name)


def test_recipe_v1_covers_named_columns():
    names = C.MACRO_COLS + C.DYNAMIC_COLS + C.PRICE_COLS + C.SENTIMENT_COLS
    assert len(X.recipe_v1(names)) == 31


def test_trim_drops_series_without_any_value(frame):
    assert column(frames.trim_leading_empty(frame(a=[None, None, 1, None]), ["a"]), "pos") == [0, 1]
    assert frames.trim_leading_empty(frame(a=[None, None]), ["a"]).count() == 0


def test_split_boundary_is_one_float_product(frame):
    df = frames.split_three_way(frame(x=[0] * 100))
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 19, "test": 11}  # int((0.7 + 0.2) * 100) is 89


def test_fold_sizes_and_errors(frame):
    rows = frames.folds_expanding(frame(x=[0] * 23), initial=10, folds=5)
    got = {(r.fold, r.role): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    assert [got[(f, "train")] for f in range(5)] == [10, 13, 16, 19, 21]
    assert [got[(f, "val")] for f in range(5)] == [3, 3, 3, 2, 2]
    assert frames.fold_errors(frame(x=[0] * 10), 10, 5).first().reason == "too_small"
    assert frames.fold_errors(frame(x=[0] * 12), 10, 5).first().reason == "empty_folds"


def test_dummies_and_flags(frame):
    df = frame(a=[1, 0, -1], b=[None, None, None], c=[1, 2, 0], d_missing=[0, 1, 0])
    got = {r.feature: r.is_dummy for r in frames.dummy_columns(df, ["a", "b", "c", "d_missing"]).collect()}
    assert got == {"a": 1, "b": 1, "c": 0, "d_missing": 0}


def test_label_and_regime_of_null_are_zero(frame):
    df = frame(x=[None, 0.0, 0.1])
    assert column(df.withColumn("l", Z.direction(F.col("x"))), "l") == [0, 0, 1]
    assert column(df.withColumn("l", Z.rate_regime(F.col("x"), 0.1)), "l") == [0, 0, 1]


def test_spikes_need_calm_known_neighbours(frame):
    x = [100.0, 1, 1, 50, 1, 60, 60, 1, 70, None, 1, 0, 80, 1] + [1.0, 1.1] * 100 + [90]
    cleaned, summary = clean.clean_spikes(frame(x=x), ["x"], quantile=0.05, ratio=10)
    got = column(cleaned, "x")
    changed = [i for i, (a, b) in enumerate(zip(x, got)) if a != b]
    assert changed == [3]  # ends, adjacent pair, unknown and zero neighbours stay
    assert summary.first().dirty_count == 1 and abs(summary.first().dirty_rate - 1 / len(x)) < 1e-12


def plain_positions(pred, k=1.0):
    p = pd.Series(pred)
    std = p.rolling(63, min_periods=20).std().fillna(p.expanding(min_periods=1).std())
    std = std.where(std.abs() >= 1e-12).ffill().bfill().fillna(1.0)
    return (1 + k * p / std).clip(0, 2)


@pytest.mark.parametrize("size", [None, 100])
def test_positions_follow_the_fallback_chain(spark, frame, noisy, size):
    if size:
        spark.conf.set("serieswise.blockRows", str(size))
    pred = np.concatenate([np.zeros(30), np.nan_to_num(noisy[:200]), np.full(150, 0.25), np.nan_to_num(noisy[200:300])])
    df = number_rows(frame(prediction=pred).drop("pos"))
    got = column(scoring.map_positions(df, k=0.7), "position")
    spark.conf.unset("serieswise.blockRows")
    # within a constant stretch pandas' running sums leave noise instead of zero deviation
    assert close(got[:230], plain_positions(pred, 0.7)[:230]) and close(got[-40:], plain_positions(pred, 0.7)[-40:])


def test_constant_predictions_do_not_become_neutral(frame):
    assert close(column(scoring.map_positions(frame(prediction=[0.3] * 40)), "position"), [1.3] * 40)


def strategy(frame, position, n=60):
    rng = np.random.default_rng(1)
    fwd = rng.normal(0.001, 0.01, n)
    return frame(position=position, forward_returns=fwd, risk_free_rate=[0.0001] * n), fwd


def test_scores_agree_and_report_status(frame):
    df, fwd = strategy(frame, [0.5, 1.5] * 30)
    v1, v2, off = (f(df).first().adjusted_sharpe for f in (scoring.score_v1, scoring.score_v2, scoring.score_official))
    assert abs(v1 - v2) < 1e-9 and abs(v2 - off) < 1e-9
    pos = np.array([0.5, 1.5] * 30)
    ret = 0.0001 * (1 - pos) + pos * fwd
    mean, market = np.prod(1 + ret - 0.0001) ** (1 / 60) - 1, np.prod(1 + fwd - 0.0001) ** (1 / 60) - 1
    vol = 1 + max(0, ret.std(ddof=1) / fwd.std(ddof=1) - 1.2)
    gap = max(0, (market - mean) * 100 * 252)
    assert abs(v1 - mean / ret.std(ddof=1) * np.sqrt(252) / (vol * (1 + gap**2 / 100))) < 1e-9
    for position, status in (([2.5] + [1] * 59, "position_above_range"), ([-0.1] + [1] * 59, "position_below_range"), ([0] * 60, "zero_strategy_std")):
        bad = scoring.score_v2(strategy(frame, position)[0])
        assert bad.first().status == status and bad.first().adjusted_sharpe is None
        with pytest.raises(ValueError):
            scoring.require_ok(bad)


def test_total_loss_keeps_a_defined_mean(frame):
    df = frame(position=[1, 1, 1], forward_returns=[0.1, -1.0, 0.2], risk_free_rate=[0, 0, 0])
    assert scoring.score_v2(df).first().adjusted_sharpe < 0
    assert scoring.risk_metrics(df).first().max_drawdown == -1.0


def test_drawdown_starts_at_the_first_equity(frame):
    df = frame(strategy_returns=[-0.5, 0.1, -0.2])
    assert close(column(scoring.drawdown(scoring.equity_curve(df)), "drawdown"), [0, 0, -0.2])


@pytest.mark.parametrize("n,blocks", [(63, 0), (64, 1), (126, 1), (127, 2), (189, 2), (200, 3)])
def test_icir_block_count(frame, n, blocks):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.normal(size=n)
    row = scoring.ic_metrics(frame(p=x, t=y), "p", "t").first()
    rank = lambda a: pd.Series(a).rank()
    parts = [rank(x[i:i + 63]).corr(rank(y[i:i + 63])) for i in range(0, n - 63, 63)]
    assert len(parts) == blocks and abs(row.ic - rank(x).corr(rank(y))) < 1e-9
    if blocks < 2:
        assert row.icir is None
    else:
        assert abs(row.icir - row.ic / np.std(parts, ddof=1)) < 1e-9


def test_t_test_p_value(frame):
    row = scoring.with_p_value(scoring.t_test(frame(p=[1.0, 2, 3, 4, 5], t=[0.0] * 5), "p", "t")).first()
    assert abs(row.t_stat - 4.242640687) < 1e-8 and abs(row.p_value - 0.0132361) < 1e-6


def test_auc_with_ties(frame):
    df = frame(label=[0, 1, 1, 0, 1], score=[0.2, 0.2, 0.9, 0.4, 0.6])
    row = scoring.auc_accuracy(df, "label", "score").first()
    assert abs(row.auc - 4.5 / 6) < 1e-12 and row.accuracy == 0.8


def test_constant_columns_have_no_correlation(frame):
    df = frame(a=[1, 1, 1, 1], b=[1, 2, 3, 5], y=[2, 1, 4, 3], e=[None, None, None, 1])
    assert [r.feature for r in corr_target(df, ["a", "b", "e"], "y").collect()] == ["b"]
    assert pair_correlations(df, ["a", "b", "y"]).count() == 1
    assert spearman(df.select("series_id", F.col("a").alias("x"), "y"), ["series_id"]).first().ic is None


def test_pair_correlations_equal_pandas_at_any_level(spark, noisy):
    rng = np.random.default_rng(4)
    rows = []
    for series, level in ((0, 0.0), (1, 1e4), (2, 1e7), (None, -1e7)):
        a = noisy
        b = 0.7 * np.nan_to_num(a) + 0.5 * rng.standard_normal(len(a))
        rows += [(series, None if np.isnan(x) else float(x + level), float(y + level), 5.0 + level) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "series_id long, a double, b double, flat double").repartition(7)
    got = {r.series_id: r["corr"] for r in pair_correlations(df, ["a", "b", "flat"], ["series_id"]).collect()}
    assert set(got) == {0, 1, 2, None}
    want = df.toPandas()
    for series, value in got.items():
        mine = want[want.series_id.isna() if series is None else want.series_id == series]
        assert abs(value - mine["a"].corr(mine["b"])) < 1e-8
    assert pair_correlations(df.filter("a > 1e300"), ["a", "b"], ["series_id"]).isEmpty()


def test_quantiles_of_large_groups(spark, frame, noisy):
    values = np.concatenate([np.round(noisy, 2), np.zeros(400)])  # heavy ties
    df = frame(x=listed(values))
    spark.conf.set("serieswise.smallGroup", "10")
    for accuracy in (10_000, 100):
        table = exact_quantiles(df, ["x"], [0.005, 0.25, 0.5, 0.9, 1.0], accuracy=accuracy)
        got = {r.prob: r.quantile for r in table.collect()}
        for p, v in got.items():
            assert abs(v - np.nanquantile(values, p)) < 1e-12
    spark.conf.unset("serieswise.smallGroup")


def test_ranks_of_large_groups(spark, frame, noisy):
    x, y = np.round(noisy, 1), np.round(noisy[::-1], 1)
    df = frame(x=listed(x), y=listed(y))
    spark.conf.set("serieswise.smallGroup", "10")
    got = spearman(df, ["series_id"]).first()
    spark.conf.unset("serieswise.smallGroup")
    both = pd.DataFrame({"x": x, "y": y}).dropna().rank()
    assert got.n == len(both) and abs(got.ic - both["x"].corr(both["y"])) < 1e-12


def test_moments_are_sample_corrected(frame, noisy):
    row = profile.moments(frame(x=listed(noisy)), ["x"]).first()
    s = pd.Series(noisy)
    assert close([row["skew"], row["kurtosis"], row["median"]], [s.skew(), s.kurt(), s.median()])


def test_histogram_edges(frame):
    got = {r.bin: r["count"] for r in profile.histogram(frame(x=[0, 0.5, 1, 1]), "x", 2).collect()}
    assert got == {0: 1, 1: 3}
    assert {r.bin: r["count"] for r in profile.histogram(frame(x=[3, 3]), "x", 2).collect()} == {0: 0, 1: 2}
    assert [r["count"] for r in profile.histogram(frame(x=[0, 0, 9]), "x", 3).orderBy("bin").collect()] == [2, 0, 1]
    assert profile.histogram(frame(x=[1, 2]).filter("x > 5"), "x", 3).isEmpty()


@pytest.mark.parametrize("n", [2, 40, 3000])
def test_density_equals_its_definition(spark, n):
    """Few values reach the whole grid, many only a part; points that nothing reaches have density 0."""
    x = np.concatenate([np.random.default_rng(n).standard_normal(n), [60.0] * (n > 40)])
    rows = profile.density_curve(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x").orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert [r.point for r in rows] == list(range(200)) and close([r.x for r in rows], grid)
    assert np.abs(np.array([r.density for r in rows]) - want).max() < 1e-13
    if n == 3000:
        assert min(r.density for r in rows) == 0


def test_density_without_spread(frame):
    rows = profile.density_curve(frame(x=[2, 2, 2]), "x", 3).orderBy("point").collect()
    assert [(r.point, r.x, r.density) for r in rows] == [(0, 2, None), (1, 2, None), (2, 2, None)]
    with pytest.raises(ValueError):
        profile.density_curve(frame(x=[1, 2]), "x", 1)


def test_rules_scored_together_equal_single_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), int(i), float(r), 0.0001, float(p)) for i, (r, p) in enumerate(zip(rng.normal(0.0004, 0.01, 300), rng.uniform(0, 2, 300)))]
    df = spark.createDataFrame(rows, "series_id long, date_id long, forward_returns double, risk_free_rate double, position double")
    rules = {"own": F.col("position"), "hold": F.lit(1.0), "square": F.col("position") * F.col("position") / 2}
    got = {(r.series_id, r.model): r for r in scoring.score_rules(df, rules).collect()}
    assert len(got) == 6
    for model, position in rules.items():
        for want in scoring.score_v1(df.withColumn("position", position)).collect():
            row = got[want.series_id, model]
            assert row.n == want.n and close([row[c] for c in want.asDict()], list(want), 1e-12)
    assert scoring.score_rules(df.limit(0), rules).isEmpty()


def test_run_table_keeps_one_copy_of_a_run(spark, frame, tmp_path):
    path = str(tmp_path / "runs")
    first, again = frame(a=[1]).select("a", F.lit(2).alias("b")), frame(a=[5]).select("a")
    for run, df in (("01", first), ("2", first), ("01", first), ("2", again)):
        IO.append_run(df, run, "metric", path)
    IO.append_run(again, "2", "param/1", path)
    got = {(r.run, r.kind, r.key, r.value) for r in IO.read_runs(spark, path).collect()}
    assert got == {("01", "metric", "a", 1), ("01", "metric", "b", 2), ("2", "metric", "a", 5), ("2", "param/1", "a", 5)}
    assert IO.read_runs(spark, path).count() == 4
    with pytest.raises(ValueError):
        IO.append_run(again, "", "metric", path)


def test_profiles_of_an_empty_frame(frame):
    empty = frame(M1=[1, 2], E1=[3, 4]).filter("M1 > 5")
    cols = ["M1", "E1"]
    assert [r.na_rate for r in frames.null_rates(empty, cols).collect()] == [None, None]
    assert [r.outlier_rate for r in profile.outlier_rates(empty, cols).collect()] == [None, None]
    assert frames.high_na_columns(empty).isEmpty()
    for table in (profile.describe(empty, cols), profile.moments(empty, cols), profile.variance_profile(empty, cols)):
        assert table.count() == 2
    assert profile.density_curve(empty, "M1").isEmpty() and profile.missing_over_time(empty, cols).isEmpty()
    assert profile.nullity_corr(empty, cols).isEmpty() and profile.label_distribution(empty, F.col("M1")).isEmpty()
    parts = profile.basic_eda(empty)
    assert parts["histograms"].isEmpty() and parts["missing"].count() >= 2


def test_grid_has_45_settings_in_order_and_first_winner(spark):
    settings = B.grid()
    assert len(settings) == 45 and settings[0].name == "Linear | target=10.00%, win=30" and settings[-1].mapping == "Tanh"
    rows = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.9), (0, 2, 0.9), (1, 0, -2.0)], "series_id long, grid_idx long, adjusted_sharpe double")
    assert [(r.series_id, r.grid_idx) for r in B.best_strategy(rows).collect()] == [(0, 1)]


def test_sequences_end_before_or_on_the_target_row(frame):
    df = frame(a=[1, 2, 3, 4], y=[10, 20, 30, 40])
    on = X.sequence_windows(df, ["a"], "y", 2, True).orderBy("pos").collect()
    before = X.sequence_windows(df, ["a"], "y", 2, False).orderBy("pos").collect()
    assert [(r.sequence, r.target) for r in on][0] == ([[1.0], [2.0]], 20.0) and len(on) == 3
    assert [(r.sequence, r.target) for r in before][0] == ([[1.0], [2.0]], 30.0) and len(before) == 2


def test_learning_verdicts(spark):
    fields = "mae double, train_mae double"
    verdict = lambda rows: learning_curve(spark.createDataFrame(rows, fields)).first().verdict
    assert verdict([(2.0, 1.0), (2.2, 1.0)]) == "high_variance"
    assert verdict([(1.0, 1.0)] * 9 + [(1.2, 1.2)]) == "high_bias"
    assert verdict([(1.0, 1.0), (1.1, 1.0), (1.2, 1.1)]) == "balanced"


def test_finite_and_sources(spark, tmp_path):
    from serieswise.sources import panel_io as IO

    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "x double")
    assert [r.v for r in df.select(Z.finite(F.col("x")).alias("v")).collect()] == [1.0, None, None]
    with pytest.raises(FileNotFoundError):
        IO.read_report(spark, str(tmp_path / "none"), "x double")
    spark.createDataFrame([(2, math.nan), (1, 0.5)], "date_id long, x double").write.parquet(str(tmp_path / "t"))
    panel = IO.read_panel(spark, [str(tmp_path / "missing"), str(tmp_path / "t")]).orderBy("pos").collect()
    assert [(r.date_id, r.x, r.series_id) for r in panel] == [(1, 0.5, 0), (2, None, 0)]


def test_p_values_of_small_and_large_samples(spark):
    """Against Simpson's rule over the angle form, and the normal tail for a billion rows."""
    rows = [(t, n) for n in (2, 3, 4, 6, 31, 402, 403, 20_001) for t in (0.0, 0.01, 0.5, 1.0, 2.0, 3.5, -12.0)]
    for r in scoring.with_p_value(spark.createDataFrame(rows, "t_stat double, n long")).collect():
        v = r.n - 1
        x = np.linspace(0, math.atan2(abs(r.t_stat), math.sqrt(v)), 20_001)
        inside = np.cos(x) ** (v - 1) @ ([1] + [4, 2] * 9_999 + [4, 1]) * x[1] / 3
        assert abs(r.p_value - (1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * inside)) < 1e-9
    many = scoring.with_p_value(spark.createDataFrame([(t, 10**9) for t in (0.01, 0.5, 2.0, 5.0)], "t_stat double, n long"))
    assert all(abs(r.p_value - math.erfc(r.t_stat / math.sqrt(2))) < 1e-7 for r in many.collect())
    odd = scoring.with_p_value(spark.createDataFrame([(None, 5), (1.0, 1), (1.0, 0)], "t_stat double, n long"))
    assert [r.p_value for r in odd.collect()] == [None] * 3


def plain_tau(x, y):
    x, y = np.array(x, float), np.array(y, float)
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    scale = math.sqrt((a != 0).sum() * (b != 0).sum())
    return (a * b).sum() / scale if scale else None


@pytest.mark.parametrize("slice_rows", [15, 60, 10_000])
def test_tau_equals_all_pairs(spark, slice_rows):
    """Spread, tied, half-constant, constant and short columns, with slices that cut them all."""
    rng = np.random.default_rng(6)
    n = 400
    spread = rng.normal(size=n)
    cases = {
        "spread": (spread, spread + rng.normal(size=n)), "tied": (rng.integers(0, 6, n), rng.integers(0, 9, n)),
        "heavy": (np.where(rng.random(n) < 0.5, 3.0, rng.normal(3, 1, n)), np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))),
        "against": (np.arange(n), -np.arange(n)), "flat": (np.ones(n), spread), "two": ([1.0, 2.0], [5.0, 4.0]), "one": ([1.0], [1.0]),
    }
    rows = [(k, float(a), float(b)) for k, (x, y) in cases.items() for a, b in zip(x, y)] + [("tied", None, 1.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "kind string, x double, y double").repartition(3)
    got = {r.kind: r for r in kendall(df, ["kind"], slice_rows=slice_rows).collect()}
    assert set(got) == set(cases)
    for k, (x, y) in cases.items():
        want = plain_tau(x, y)
        assert got[k].n == len(x) and (got[k].tau is want is None or abs(got[k].tau - want) < 1e-12)
    whole = kendall(df.filter("kind = 'heavy'"), [], slice_rows=slice_rows).first()
    assert abs(whole.tau - plain_tau(*cases["heavy"])) < 1e-12
    assert kendall(df.limit(0), ["kind"]).isEmpty()


def test_unknown_correlation_methods_are_refused(frame):
    df = frame(a=[1.0, 2.0, 3.0], b=[1.0, 3.0, 2.0])
    for call in (lambda: corr_target(df, ["a"], "b", "kendal"), lambda: pair_correlations(df, ["a", "b"], method="")):
        with pytest.raises(ValueError, match="unknown method"):
            call()
    assert pair_correlations(df, ["a", "b"], method="spearman").first().corr == pytest.approx(0.5)
    assert pair_correlations(df, ["a", "b"], method="kendall").first().corr == pytest.approx(1 / 3)


def test_hot_days_and_ties_are_split_and_numbered_alike(spark, tiny_blocks):
    """A day and an instant with most rows of a long series, timestamps, a null series, repeated rows."""
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    at = lambda i: day + dt.timedelta(seconds=i) if i % 3 else day  # a third of the rows at one instant
    rows = [(7, at(i), float(i % 50)) for i in range(3000)] + [(None, day, float(i)) for i in range(400)] + [(8, day, 1.0)] * 5
    df = spark.createDataFrame(rows, "series_id long, ts timestamp, x double")
    runs = [number_rows(df.repartition(n), "ts") for n in (3, 11)]
    got = [sorted(map(tuple, r.select("series_id", "ts", "x", "pos", "_block").collect()), key=str) for r in runs]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for series, n in ((7, 3000), (None, 400), (8, 5)):
        mine = sorted((r for r in got[0] if r[0] == series), key=lambda r: r[3])
        assert [r[3] for r in mine] == list(range(n)) and [r[1] for r in mine] == sorted(r[1] for r in mine)
        assert all(r[4] == r[3] // 128 for r in mine)


def test_look_back_and_ahead_beyond_a_block(spark, tiny_blocks, frame):
    values = [float(v * 37 % 101) for v in range(900)]
    df = number_rows(frame(x=values).drop("pos"))
    assert "_block" in df.columns
    got = rolling(df, lambda f: {"m": F.sum("x").over(f.rows(-300, 270).spec)}, 300, 270)
    want = [sum(values[max(0, i - 300) : i + 271]) for i in range(900)]
    assert column(got, "m") == want
