"""Positions, strategy scores, risk and forecast metrics.

Scores are grouped aggregates over rows with ``position``, ``forward_returns``
and ``risk_free_rate``; partial aggregation happens before every shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.config import BLOCK, KEYS, POS
from serieswise.functions.scalar import clip, ratio, strategy_return
from serieswise.operators.blocks import block_rows, expanding_std, is_blocked, last_known, renumber, rolling, running_max, running_product, scan
from serieswise.operators.features import rolling_mean, rolling_std
from serieswise.operators.frames import stacked
from serieswise.operators.ordered import rank_corr, spearman, value_ranks, window_rank

YEAR = float(C.TRADING_DAYS)


def with_returns(df: DataFrame, position: str = "position") -> DataFrame:
    """Add ``strategy_returns``, ``excess`` and ``market_excess``."""
    strat = strategy_return(F.col(position), F.col("forward_returns"), F.col("risk_free_rate"))
    return df.withColumns(
        {
            "strategy_returns": strat,
            "excess": strat - F.col("risk_free_rate"),
            "market_excess": F.col("forward_returns") - F.col("risk_free_rate"),
        }
    )


def map_positions(
    df: DataFrame,
    prediction: str = "prediction",
    k: float | Column = C.K_DEFAULT,
    window: int = C.K_WINDOW,
    least: int = C.K_MIN_ROWS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``position`` = clip(1 + k * prediction / deviation, 0, 2).

    The deviation is rolling, else expanding; near zero it is taken from the last
    usable row, for leading rows from the first usable one, else it is 1.
    """
    pred = F.col(prediction)
    rows = rolling(df, lambda f: {"_std": rolling_std(pred, f.last(window), least)}, window, keys=keys)
    rows = scan(rows, {"_wide": expanding_std(pred)}, keys)
    std = F.coalesce(F.col("_std"), F.col("_wide"))
    rows = rows.withColumn("_std", F.when(F.abs(std) >= 1e-12, std))
    rows = scan(rows, {"_std": last_known(F.col("_std"), lead_in=True)}, keys)
    slope = k if isinstance(k, Column) else F.lit(float(k))
    position = clip(F.lit(1.0) + slope * pred / F.coalesce(F.col("_std"), F.lit(1.0)), 0.0, 2.0)
    return rows.withColumn("position", position).drop("_std", "_wide")


def _penalties(mean: Column, market_mean: Column, std: Column, market_std: Column) -> dict[str, Column]:
    vol, market_vol = std * F.sqrt(F.lit(YEAR)) * 100, market_std * F.sqrt(F.lit(YEAR)) * 100
    gap = F.greatest(F.lit(0.0), (market_mean - mean) * 100 * YEAR)
    return {
        "strategy_volatility_pct": vol,
        "market_volatility_pct": market_vol,
        "vol_penalty": F.lit(1.0) + F.greatest(F.lit(0.0), ratio(vol, market_vol) - 1.2),
        "return_penalty": F.lit(1.0) + gap * gap / 100,
    }


def _root(product: Column, n: Column) -> Column:
    return F.pow(product, F.lit(1.0) / n) - 1


def v1_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.product(F.lit(1.0) + F.col("excess")).alias("_prod"),
        F.product(F.lit(1.0) + F.col("market_excess")).alias("_mprod"),
        F.stddev_samp("strategy_returns").alias("_std"),
        F.stddev_samp("forward_returns").alias("_mstd"),
    ]


def v1_columns() -> list[Column]:
    mean, market = _root(F.col("_prod"), F.col("n")), _root(F.col("_mprod"), F.col("n"))
    parts = _penalties(mean, market, F.col("_std"), F.col("_mstd"))
    raw = ratio(mean, F.col("_std")) * F.sqrt(F.lit(YEAR))
    return [
        F.col("n"),
        raw.alias("raw_sharpe"),
        mean.alias("strategy_mean_excess"),
        market.alias("market_mean_excess"),
        *[c.alias(n) for n, c in parts.items()],
        (raw / (parts["vol_penalty"] * parts["return_penalty"])).alias("adjusted_sharpe"),
    ]


def score_v1(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adjusted Sharpe with its components, no range checks and no cap."""
    return with_returns(df).groupBy(*keys).agg(*v1_sums()).select(*keys, *v1_columns())


def score_rules(df: DataFrame, rules: dict[str, Column], keys: Sequence[str] = KEYS, name: str = "model") -> DataFrame:
    """keys, the rule's name and the columns of ``score_v1`` for several position rules.

    One aggregate over the rows, whatever the number of rules; the market is summed once.
    """
    free, market = F.col("risk_free_rate"), F.col("forward_returns")
    gains = [strategy_return(position, market, free).alias(f"_r{i}") for i, position in enumerate(rules.values())]
    sums = df.select(*keys, "forward_returns", "risk_free_rate", *gains).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.product(F.lit(1.0) + (market - free)).alias("_mprod"),
        F.stddev_samp("forward_returns").alias("_mstd"),
        *[F.product(F.lit(1.0) + (F.col(f"_r{i}") - free)).alias(f"_prod{i}") for i in range(len(gains))],
        *[F.stddev_samp(f"_r{i}").alias(f"_std{i}") for i in range(len(gains))],
    )
    shared = {c: F.col(c) for c in ("n", "_mprod", "_mstd")}
    rows = [{name: F.lit(m), **shared, "_prod": F.col(f"_prod{i}"), "_std": F.col(f"_std{i}")} for i, m in enumerate(rules)]
    return stacked(sums, rows, keys).select(*keys, name, *v1_columns())


def _log_mean(total: Column, low: Column, n: Column) -> Column:
    """exp(mean log1p) - 1: -1 after a total loss, undefined below it."""
    return F.when(low > -1, F.exp(total * (F.lit(1.0) / n)) - 1).when(low == -1, F.lit(-1.0))


def _status(score: Column) -> list[Column]:
    status = (
        F.when(F.col("_high") > 2.0, "position_above_range")
        .when(F.col("_low") < 0.0, "position_below_range")
        .when(F.col("_std") == 0, "zero_strategy_std")
        .when(F.col("_mstd") == 0, "zero_market_std")
        .otherwise("ok")
    )
    capped = F.when(score.isNotNull(), F.least(score, F.lit(C.SCORE_CAP)))
    return [status.alias("status"), F.when(status == "ok", capped).alias("adjusted_sharpe")]


def _ranged(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return with_returns(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("position").alias("_high"),
        F.min("position").alias("_low"),
        F.stddev_samp("strategy_returns").alias("_std"),
        F.stddev_samp("forward_returns").alias("_mstd"),
        *more,
    )


def score_v2(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adjusted Sharpe from log returns, with a status instead of an exception."""
    sums = _ranged(
        df,
        keys,
        F.sum(F.log1p("excess")).alias("_log"),
        F.sum(F.log1p("market_excess")).alias("_mlog"),
        F.min("excess").alias("_worst"),
        F.min("market_excess").alias("_mworst"),
    )
    return score_from_sums(sums, keys)


def score_from_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``score_v2`` of rows that hold its sums."""
    n = F.col("n")
    mean = _log_mean(F.col("_log"), F.col("_worst"), n)
    market = _log_mean(F.col("_mlog"), F.col("_mworst"), n)
    return _checked(sums, keys, mean, market)


def score_official(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The published form: n-th root of the compounded excess, range checks, cap."""
    sums = _ranged(
        df,
        keys,
        F.product(F.lit(1.0) + F.col("excess")).alias("_prod"),
        F.product(F.lit(1.0) + F.col("market_excess")).alias("_mprod"),
    )
    return _checked(sums, keys, _root(F.col("_prod"), F.col("n")), _root(F.col("_mprod"), F.col("n")))


def _checked(sums: DataFrame, keys: Sequence[str], mean: Column, market: Column) -> DataFrame:
    parts = _penalties(mean, market, F.col("_std"), F.col("_mstd"))
    raw = ratio(mean, F.col("_std")) * F.sqrt(F.lit(YEAR))
    score = raw / (parts["vol_penalty"] * parts["return_penalty"])
    return sums.select(*keys, "n", *_status(score))


def require_ok(scores: DataFrame) -> DataFrame:
    """Raise if any score has a status other than ok."""
    bad = scores.filter(F.col("status") != "ok").limit(1).collect()
    if bad:
        raise ValueError(f"score undefined: {bad[0].asDict()}")
    return scores


def equity_curve(df: DataFrame, returns: str = "strategy_returns", keys: Sequence[str] = KEYS, name: str = "equity") -> DataFrame:
    return scan(df, {name: running_product(F.lit(1.0) + F.col(returns))}, keys)


def drawdown(df: DataFrame, equity: str = "equity", keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``drawdown`` below the highest equity so far, starting at the first row."""
    peaks = scan(df, {"_peak": running_max(F.col(equity))}, keys)
    return peaks.withColumn("drawdown", ratio(F.col(equity), F.col("_peak")) - 1).drop("_peak")


def risk_metrics(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Raw Sharpe, Sortino, Calmar, drawdown, win rate and volatility."""
    path = drawdown(equity_curve(with_returns(df), keys=keys), keys=keys)
    loss = F.when(F.col("excess") < 0, F.col("excess"))
    s = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.log1p("excess")).alias("_log"),
        F.min("excess").alias("_worst"),
        F.stddev_samp("strategy_returns").alias("_std"),
        F.count(loss).alias("_losses"),
        F.stddev_samp(loss).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("excess") > 0).cast("double")).alias("win_rate"),
    )
    annual = F.when(
        F.col("_worst") > -1, F.exp(F.col("_log") * (F.lit(YEAR) / F.col("n"))) - 1
    ).when(F.col("_worst") == -1, F.lit(-1.0))
    root = F.sqrt(F.lit(YEAR))
    vol, down = F.col("_std") * root, F.when(F.col("_losses") > 1, F.col("_down") * root)
    return s.select(
        *keys,
        "n",
        F.when(vol > 0, annual / vol).alias("sharpe_raw"),
        F.when(down > 0, annual / down).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).alias("calmar"),
        "max_drawdown",
        "win_rate",
        (vol * 100).alias("ann_vol_pct"),
    )


def ic_metrics(df: DataFrame, prediction: str, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rank IC of a series and its ratio to the deviation of 63-row block ICs.

    Blocks start every 63 valid rows as long as more rows follow; the ratio needs
    at least two of them. Fewer than three valid rows give no result.
    """
    known = df.filter(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    kept = [*keys, POS, *([BLOCK] if is_blocked(df) else [])]
    rows = renumber(known.select(*kept, F.col(prediction).alias("x"), F.col(target).alias("y")), keys)
    overall = spearman(rows, keys, largest=None if is_blocked(df) else block_rows(df))
    part = [*keys, "_part"]
    parts = rows.withColumn("_part", F.floor(F.col(POS) / C.IC_BLOCK))
    ranked = parts.withColumn("_rx", window_rank(part, "x")).withColumn("_ry", window_rank(part, "y"))
    local = ranked.groupBy(*part).agg(rank_corr().alias("_ic"))
    # a constant block has no IC, and then neither has the deviation
    spread = (
        local.join(overall.select(*keys, "n"), list(keys))
        .filter(F.col("_part") * C.IC_BLOCK < F.col("n") - C.IC_BLOCK)
        .groupBy(*keys)
        .agg(F.when(F.count("_ic") == F.count(F.lit(1)), F.stddev_samp("_ic")).alias("_std"))
    )
    return overall.join(spread, list(keys), "left").filter(F.col("n") > 2).select(
        *keys, "n", "ic", F.when(F.col("_std") > 0, F.col("ic") / F.col("_std")).alias("icir")
    )


def t_test(df: DataFrame, prediction: str, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-sample t of prediction minus target against zero."""
    d = F.col(prediction) - F.col(target)
    s = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    return s.select(*keys, "n", ratio(F.col("_m"), F.col("_s") / F.sqrt("n")).alias("t_stat"))


def _log_gamma(z: Column) -> Column:
    """Stirling's series eight steps up, taken down by the recurrence."""
    up = z + 8
    steps = reduce(lambda a, b: a * b, [z + i for i in range(8)])
    tail = F.lit(1.0) / (12 * up) - F.lit(1.0) / (360 * F.pow(up, F.lit(3.0))) + F.lit(1.0) / (1260 * F.pow(up, F.lit(5.0)))
    return (up - 0.5) * F.ln(up) - up + math.log(2 * math.pi) / 2 + tail - F.ln(steps)


def _beta_fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    off_zero = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(held: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        c, d = off_zero(F.lit(1.0) + term / held["c"]), F.lit(1.0) / off_zero(F.lit(1.0) + term * held["d"])
        return F.struct(c.alias("c"), d.alias("d"), (held["h"] * c * d).alias("h"))

    # the first term has no quotient before it
    start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda held: held["h"])


def half_beta_share(x: Column, y: Column, a: Column) -> Column:
    """Regularised incomplete beta function of x = 1 - y with second parameter 1/2.

    The number of terms grows with the root of the first parameter; y is given because 1 - x would lose its digits.
    """
    b = F.lit(0.5)
    terms = (F.lit(100) + 16 * F.sqrt(a)).cast("int")
    # the difference of two large logarithms would lose the digits
    far = F.ln(a) / 2 - F.lit(1.0) / (8 * a) + F.lit(1.0) / (192 * F.pow(a, F.lit(3.0)))
    ratio_ = F.when(a > 200, far).otherwise(_log_gamma(a + b) - _log_gamma(a))
    front = F.exp(ratio_ - math.log(math.pi) / 2 + a * F.log1p(-y) + b * F.ln(y))
    low = front * _beta_fraction(x, a, b, terms) / a
    high = F.lit(1.0) - front * _beta_fraction(y, b, a, terms) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def with_p_value(tests: DataFrame) -> DataFrame:
    """Add the two-sided ``p_value`` of Student's t to a table of t statistics, one row per series."""
    t, dof = F.col("t_stat"), (F.col("n") - 1).cast("double")
    share = half_beta_share(dof / (dof + t * t), t * t / (dof + t * t), dof / 2)
    return tests.withColumn("p_value", F.when(t.isNotNull() & (dof >= 1), F.when(t == 0, F.lit(1.0)).otherwise(share)))


def cum_return_pct(df: DataFrame, keys: Sequence[str] = KEYS, returns: str = "strategy_returns") -> DataFrame:
    total = (F.product(F.lit(1.0) + F.col(returns)) - 1) * 100
    return df.groupBy(*keys).agg(total.alias("cum_return_pct"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAE, MSE, RMSE and R2; R2 of a constant target is 1 if exact, else 0."""
    e = F.col(actual) - F.col(predicted)
    known = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    s = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop(actual).alias("_var"),
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("mse") / F.col("_var")).otherwise(flat)
    return s.select(*keys, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def auc_accuracy(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks, and accuracy at 0.5."""
    hit = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("long")
    ranks = value_ranks(df, keys, score, {"pos": F.col(label).cast("long"), "hits": hit})
    s = ranks.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("less") + (F.col("cnt") + 1) / 2)).alias("_ranks"),
        F.sum("pos").cast("double").alias("_p"),
        F.sum("cnt").alias("n"),
        F.sum("hits").alias("_hits"),
    )
    neg = F.col("n") - F.col("_p")
    auc = (F.col("_ranks") - F.col("_p") * (F.col("_p") + 1) / 2) / F.nullif(F.col("_p") * neg, F.lit(0.0))
    return s.select(*keys, "n", auc.alias("auc"), (F.col("_hits") / F.col("n")).alias("accuracy"))


def roc_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """One point per distinct threshold: rates of rows scored at or above it."""
    ranks = value_ranks(df, keys, score, {"pos": F.col(label).cast("long")}, descending=True)
    tp = F.col("pos_less") + F.col("pos")
    fp = F.col("less") + F.col("cnt") - tp
    return ranks.select(
        *keys,
        F.col(score).alias("threshold"),
        (fp / F.nullif(F.col("total") - F.col("pos_total"), F.lit(0))).alias("fpr"),
        (tp / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"),
    )
