"""Scores, back-tests, forecast metrics and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise.catalog.base import *  # noqa: F403
from serieswise.operators import backtest as B
from serieswise.operators import diagnostics as G
from serieswise.operators import scoring as S
from serieswise.operators.frames import with_series_rows

KEY = ["series_id"]
ROW = ["series_id", "date_id"]


def score_sql(mean: str, market: str, source: str, keys: str = "series_id") -> str:
    """CTE text: score parts per key from (key, n, mean, market mean, std, market std)."""
    return f"""
sums AS (SELECT {keys}, count(*) AS n, {mean} AS m, {market} AS mm,
                stddev_samp(strategy_returns) AS sd, stddev_samp(forward_returns) AS msd
         FROM {source} GROUP BY {keys}),
parts AS (SELECT *, m / sd * sqrt(252) AS raw_sharpe, sd * sqrt(252) * 100 AS vol, msd * sqrt(252) * 100 AS mvol,
                 1 + greatest(0, (sd * sqrt(252) * 100) / (msd * sqrt(252) * 100) - 1.2) AS vol_penalty,
                 1 + power(greatest(0, (mm - m) * 100 * 252), 2) / 100 AS return_penalty
          FROM sums)"""


LOG = ("exp(sum(ln(1 + excess)) / count(*)) - 1", "exp(sum(ln(1 + market_excess)) / count(*)) - 1")
PROD = (
    "power(product(1 + excess), 1.0 / count(*)) - 1",
    "power(product(1 + market_excess), 1.0 / count(*)) - 1",
)
V2_SQL = f"SELECT series_id, n, 'ok' AS status, {rsql('raw_sharpe / (vol_penalty * return_penalty)')} AS adjusted_sharpe FROM parts"
V1_PARTS = [
    "raw_sharpe", "strategy_mean_excess", "market_mean_excess", "strategy_volatility_pct",
    "market_volatility_pct", "vol_penalty", "return_penalty", "adjusted_sharpe",
]
V1_SQL = f"""SELECT series_id, n, {rsql('raw_sharpe')} AS raw_sharpe, {rsql('m')} AS strategy_mean_excess,
  {rsql('mm')} AS market_mean_excess, {rsql('vol')} AS strategy_volatility_pct, {rsql('mvol')} AS market_volatility_pct,
  {rsql('vol_penalty')} AS vol_penalty, {rsql('return_penalty')} AS return_penalty,
  {rsql('raw_sharpe / (vol_penalty * return_penalty)')} AS adjusted_sharpe FROM parts"""


@query("score_v2", positioned_sql(V2_SQL, score_sql(*LOG, "returned")))
def score_v2(spark, sf_dir):
    return out(S.score_v2(positioned(spark, sf_dir)), ["series_id", "n", "status"], ["adjusted_sharpe"])


@query("score_official", positioned_sql(V2_SQL, score_sql(*PROD, "returned")))
def score_official(spark, sf_dir):
    return out(S.score_official(positioned(spark, sf_dir)), ["series_id", "n", "status"], ["adjusted_sharpe"])


@query("score_v1", positioned_sql(V1_SQL, score_sql(*PROD, "returned")))
def score_v1(spark, sf_dir):
    return out(S.score_v1(positioned(spark, sf_dir)), ["series_id", "n"], V1_PARTS)


# ---- paths and rolling tables

EQUITY_SQL = """
curve AS (SELECT *, product(1 + strategy_returns) OVER (PARTITION BY series_id ORDER BY date_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM returned),
path AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY date_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM curve)"""


@query("align_predictions", positioned_sql(f"""
SELECT p.series_id, p.date_id, {rsql('p.position')} AS position, r.forward_returns, r.risk_free_rate
FROM positioned p JOIN fx_panel r ON p.series_id = r.series_id AND p.date_id = r.date_id"""))
def align_predictions(spark, sf_dir):
    from serieswise.operators.frames import align

    left = positioned(spark, sf_dir).select("series_id", "date_id", "position")
    right = fx_panel(spark, sf_dir).select("series_id", "date_id", "forward_returns", "risk_free_rate")
    return out(align(left, right), [*ROW, "forward_returns", "risk_free_rate"], ["position"])


@query("strategy_return", positioned_sql(f"SELECT series_id, date_id, {cols_sql(['strategy_returns', 'excess'])} FROM returned"))
def strategy_return(spark, sf_dir):
    return out(returned(spark, sf_dir), ROW, ["strategy_returns", "excess"])


@query("map_positions", positioned_sql(f"SELECT series_id, date_id, {rsql('position')} AS position FROM positioned"))
def map_positions(spark, sf_dir):
    return out(positioned(spark, sf_dir), ROW, ["position"])


@query("equity_curve", positioned_sql(f"SELECT series_id, date_id, {rsql('equity')} AS equity FROM curve", EQUITY_SQL))
def equity_curve(spark, sf_dir):
    return out(S.equity_curve(returned(spark, sf_dir)), ROW, ["equity"])


@query("drawdown", positioned_sql(f"SELECT series_id, date_id, {rsql('drawdown')} AS drawdown FROM path", EQUITY_SQL))
def drawdown(spark, sf_dir):
    return out(S.drawdown(S.equity_curve(returned(spark, sf_dir))), ROW, ["drawdown"])


ROLLING_SQL = """
rolled AS (SELECT *, count(strategy_returns) OVER w AS known, avg(excess) OVER w AS rmu,
                  stddev_samp(strategy_returns) OVER w AS rsd, stddev_samp(forward_returns) OVER w AS rmsd
           FROM returned
           WINDOW w AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""


@query("rolling_sharpe", positioned_sql(f"""
SELECT series_id, date_id, CASE WHEN known >= 21 AND rsd > 0 THEN {rsql('rmu / rsd * sqrt(252)')} END AS rolling_sharpe
FROM rolled""", ROLLING_SQL))
def rolling_sharpe(spark, sf_dir):
    return out(G.rolling_risk(returned(spark, sf_dir)), ROW, ["rolling_sharpe"])


@query("rolling_vol", positioned_sql(f"""
SELECT series_id, date_id, CASE WHEN known >= 21 THEN {rsql('rsd * sqrt(252) * 100')} END AS rolling_vol,
       CASE WHEN known >= 21 THEN {rsql('rmsd * sqrt(252) * 100')} END AS market_rolling_vol
FROM rolled""", ROLLING_SQL))
def rolling_vol(spark, sf_dir):
    return out(G.rolling_risk(returned(spark, sf_dir)), ROW, ["rolling_vol", "market_rolling_vol"])


TARGET = "market_forward_excess_returns"
RESIDUAL_SQL = f"""
res AS (SELECT *, {TARGET} - prediction AS residual FROM scored),
rolling AS (SELECT *, CASE WHEN count(residual) OVER w >= 10 THEN avg(residual) OVER w END AS rolling_residual,
                   sum(residual) OVER e AS cumulative_residual
            FROM res
            WINDOW w AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
                   e AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("rolling_residual", scored_sql(
    f"SELECT series_id, date_id, {rsql('rolling_residual')} AS rolling_residual FROM rolling", RESIDUAL_SQL))
def rolling_residual(spark, sf_dir):
    return out(G.residual_table(scored(spark, sf_dir), TARGET, "prediction"), ROW, ["rolling_residual"])


@query("residual_table", scored_sql(f"""
SELECT series_id, date_id, {cols_sql(['residual', 'rolling_residual'])}, {rsql('cumulative_residual', 7)} AS cumulative_residual
FROM rolling""", RESIDUAL_SQL))
def residual_table(spark, sf_dir):
    table = G.residual_table(scored(spark, sf_dir), TARGET, "prediction")
    return out(table, ROW, {"residual": 9, "rolling_residual": 9, "cumulative_residual": 7})


@query("residual", scored_sql(f"SELECT series_id, date_id, {rsql(TARGET + ' - prediction')} AS residual FROM scored"))
def residual(spark, sf_dir):
    from serieswise.functions.scalar import residual as diff

    df = scored(spark, sf_dir)
    return out(df.withColumn("residual", diff(F.col(TARGET), F.col("prediction"))), ROW, ["residual"])


# ---- metrics per series

RISK = ["sharpe_raw", "sortino", "calmar", "max_drawdown", "win_rate", "ann_vol_pct"]
RISK_SQL = EQUITY_SQL + """,
agg AS (SELECT series_id, count(*) AS n, exp(sum(ln(1 + excess)) * (252.0 / count(*))) - 1 AS ann,
               stddev_samp(strategy_returns) * sqrt(252) AS vol,
               CASE WHEN count(*) FILTER (WHERE excess < 0) > 1
                    THEN stddev_samp(excess) FILTER (WHERE excess < 0) * sqrt(252) END AS down,
               min(drawdown) AS max_drawdown,
               CAST(count(*) FILTER (WHERE excess > 0) AS DOUBLE) / count(*) AS win_rate
        FROM path GROUP BY series_id),
risk AS (SELECT series_id, n, CASE WHEN vol > 0 THEN ann / vol END AS sharpe_raw,
                CASE WHEN down > 0 THEN ann / down END AS sortino,
                CASE WHEN max_drawdown < 0 THEN ann / abs(max_drawdown) END AS calmar,
                max_drawdown, win_rate, vol * 100 AS ann_vol_pct FROM agg)"""


@query("risk_metrics", positioned_sql(f"SELECT series_id, n, {cols_sql(RISK, 8)} FROM risk", RISK_SQL))
def risk_metrics(spark, sf_dir):
    return out(S.risk_metrics(positioned(spark, sf_dir)), ["series_id", "n"], {c: 8 for c in RISK})


def avg_rank_sql(part: str, value: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {part} ORDER BY {value}) + "
        f"(count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0"
    )


IC_SQL = f"""
v AS (SELECT series_id, prediction AS x, {TARGET} AS y,
             row_number() OVER (PARTITION BY series_id ORDER BY date_id) - 1 AS p,
             count(*) OVER (PARTITION BY series_id) AS n
      FROM scored WHERE prediction IS NOT NULL AND {TARGET} IS NOT NULL),
ranks AS (SELECT series_id, n, {avg_rank_sql('series_id', 'x')} AS rx, {avg_rank_sql('series_id', 'y')} AS ry FROM v),
overall AS (SELECT series_id, max(n) AS n, corr(rx, ry) AS ic FROM ranks GROUP BY series_id),
blocks AS (SELECT series_id, p // 63 AS b, {avg_rank_sql('series_id, p // 63', 'x')} AS rx,
                  {avg_rank_sql('series_id, p // 63', 'y')} AS ry
           FROM v WHERE (p // 63) * 63 < n - 63),
block_ic AS (SELECT series_id, b, corr(rx, ry) AS bic FROM blocks GROUP BY series_id, b),
spread AS (SELECT series_id, stddev_samp(bic) AS sd FROM block_ic GROUP BY series_id)"""


@query("ic_metrics", scored_sql(f"""
SELECT o.series_id, n, {rsql('ic', 8)} AS ic, CASE WHEN sd > 0 THEN {rsql('ic / sd', 8)} END AS icir
FROM overall o LEFT JOIN spread s ON o.series_id = s.series_id WHERE n > 2""", IC_SQL))
def ic_metrics(spark, sf_dir):
    return out(S.ic_metrics(scored(spark, sf_dir), "prediction", TARGET), ["series_id", "n"], {"ic": 8, "icir": 8})


# two-sided tails of Student's t: finite sums in the angle, for even and odd degrees of freedom
P_VALUE = """
tests AS (SELECT series_id, count(*) AS n, avg(prediction - market_forward_excess_returns) / (stddev_samp(prediction - market_forward_excess_returns) / sqrt(count(*))) AS t
          FROM scored GROUP BY series_id),
angles AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th, n - 1 AS v FROM tests WHERE n > 1),
tails AS (SELECT series_id, CASE WHEN v % 2 = 0
    THEN 1 - sin(th) * list_sum(list_transform(range(v // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4) + 2 * j * ln(cos(th)))))
    ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(list_transform(range((v - 1) // 2), lambda j: exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2) + 2 * j * ln(cos(th))))), 0))
    END AS p FROM angles)"""


@query("t_test", scored_sql(f"""
SELECT t.series_id, n, {rsql('t', 8)} AS t_stat, {rsql('p', 8)} AS p_value FROM tests t LEFT JOIN tails p ON t.series_id = p.series_id""", P_VALUE))
def t_test(spark, sf_dir):
    tests = S.with_p_value(S.t_test(scored(spark, sf_dir), "prediction", TARGET))
    return out(tests, ["series_id", "n"], {"t_stat": 8, "p_value": 8})


@query("cum_return_pct", positioned_sql(f"""
SELECT series_id, {rsql('(product(1 + strategy_returns) - 1) * 100')} AS cum_return_pct FROM returned GROUP BY series_id"""))
def cum_return_pct(spark, sf_dir):
    return out(S.cum_return_pct(returned(spark, sf_dir)), KEY, ["cum_return_pct"])


@query("reg_metrics", scored_sql(f"""
SELECT series_id, count(*) AS n, {rsql('avg(abs(e))')} AS mae, {rsql('avg(e * e)')} AS mse,
       {rsql('sqrt(avg(e * e))')} AS rmse, {rsql('1 - avg(e * e) / var_pop(y)', 6)} AS r2
FROM (SELECT series_id, {TARGET} AS y, {TARGET} - prediction AS e FROM scored) GROUP BY series_id"""))
def reg_metrics(spark, sf_dir):
    table = S.regression_metrics(scored(spark, sf_dir), TARGET, "prediction")
    return out(table, ["series_id", "n"], {"mae": 9, "mse": 9, "rmse": 9, "r2": 6})


RATED = """
rated AS (SELECT CAST(l.quality AS INTEGER) AS label, CAST(d.n_chars AS DOUBLE) AS score
          FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def rated(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return labels.join(texts, "doc_id").drop("doc_id")


@query("auc_acc", scored_sql(f"""
SELECT count(*) AS n,
       {rsql('(sum(label * r) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * CAST(count(*) - sum(label) AS DOUBLE))')} AS auc,
       {rsql('avg(CASE WHEN (probability >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM (SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r
      FROM (SELECT round(probability, 12) AS probability, CASE WHEN forward_returns > 0 THEN 1 ELSE 0 END AS label FROM scored))"""))
def auc_acc(spark, sf_dir):
    from serieswise.functions.scalar import direction

    # exp may differ in the last bit between engines, which would split ties
    df = scored(spark, sf_dir).select(
        F.round("probability", 12).alias("probability"), direction(F.col("forward_returns")).alias("label")
    )
    return out(S.auc_accuracy(df, "label", "probability"), ["n"], ["auc", "accuracy"])


@query("roc_points", sql(f"""
SELECT score AS threshold, {rsql('CAST(fp AS DOUBLE) / max(fp) OVER ()')} AS fpr, {rsql('CAST(tp AS DOUBLE) / max(tp) OVER ()')} AS tpr
FROM (SELECT score, sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(count(*) - sum(label)) OVER (ORDER BY score DESC) AS fp
      FROM rated GROUP BY score)""", RATED))
def roc_points(spark, sf_dir):
    return out(S.roc_points(rated(spark, sf_dir), "label", "score"), ["threshold"], ["fpr", "tpr"])


# ---- back-tests

GRID_SQL = """
grid AS (
  SELECT CAST((m.i * 5 + t.i) * 3 + w.i AS BIGINT) AS grid_idx, m.i AS m, t.v AS target, w.v AS win
  FROM (VALUES (0), (1), (2)) m(i),
       (VALUES (0, 0.10::DOUBLE), (1, 0.12::DOUBLE), (2, 0.14::DOUBLE), (3, 0.16::DOUBLE), (4, 0.18::DOUBLE)) t(i, v),
       (VALUES (0, 30), (1, 60), (2, 90)) w(i, v)),
mapped AS (
  SELECT *, least(greatest(1 + (probability - 0.5), 0), 2) AS map0,
         2 / (1 + exp(-least(greatest(5 * (probability - 0.5), -10), 10))) AS map1,
         1 + tanh(least(greatest(5 * (probability - 0.5), -10), 10)) AS map2
  FROM scored),
smooth AS (
  SELECT *, avg(map0) OVER s AS sm0, avg(map1) OVER s AS sm1, avg(map2) OVER s AS sm2,
         CASE WHEN count(forward_returns) OVER w30 >= 10 THEN stddev_samp(forward_returns) OVER w30 END AS d30,
         CASE WHEN count(forward_returns) OVER w60 >= 20 THEN stddev_samp(forward_returns) OVER w60 END AS d60,
         CASE WHEN count(forward_returns) OVER w90 >= 30 THEN stddev_samp(forward_returns) OVER w90 END AS d90
  FROM mapped
  WINDOW s AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
         w60 AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
         w90 AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)),
crossed AS (
  SELECT g.grid_idx, series_id, date_id, forward_returns, risk_free_rate,
         least(greatest((CASE m WHEN 0 THEN sm0 WHEN 1 THEN sm1 ELSE sm2 END)
           * least(greatest(coalesce(target / sqrt(252)
               / ((CASE win WHEN 30 THEN d30 WHEN 60 THEN d60 ELSE d90 END) + 1e-8), 1), 0), 3), 0), 2) AS position
  FROM smooth, grid g),
traded AS (
  SELECT *, risk_free_rate * (1 - position) + position * forward_returns AS strategy_returns,
         risk_free_rate * (1 - position) + position * forward_returns - risk_free_rate AS excess,
         forward_returns - risk_free_rate AS market_excess
  FROM crossed),
curve AS (
  SELECT *, product(1 + strategy_returns) OVER (PARTITION BY grid_idx, series_id ORDER BY date_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM traded),
path AS (
  SELECT *, equity / max(equity) OVER (PARTITION BY grid_idx, series_id ORDER BY date_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM curve),
stats AS (
  SELECT grid_idx, series_id, power(1 + avg(strategy_returns), 252) - 1 AS annual_return,
         stddev_pop(strategy_returns) * sqrt(252) AS annual_volatility, min(drawdown) AS max_drawdown,
         product(1 + strategy_returns) - 1 AS total_return
  FROM path GROUP BY grid_idx, series_id)""" + "," + score_sql(*PROD, "traded", "grid_idx, series_id")
BASIC = ["annual_return", "annual_volatility", "max_drawdown", "total_return"]
GRID_OUT = f"""SELECT p.grid_idx, p.series_id, n, {cols_sql(BASIC, 8)}, {rsql('raw_sharpe', 8)} AS raw_sharpe,
  {rsql('vol_penalty', 8)} AS vol_penalty, {rsql('return_penalty', 8)} AS return_penalty,
  {rsql('raw_sharpe / (vol_penalty * return_penalty)', 8)} AS adjusted_sharpe
FROM parts p JOIN stats s ON p.grid_idx = s.grid_idx AND p.series_id = s.series_id"""
GRID_COLS = {c: 8 for c in [*BASIC, "raw_sharpe", "vol_penalty", "return_penalty", "adjusted_sharpe"]}


@query("backtest_grid", scored_sql(GRID_OUT, GRID_SQL))
def backtest_grid(spark, sf_dir):
    return out(B.backtest_grid(scored(spark, sf_dir)), ["grid_idx", "series_id", "n"], GRID_COLS)


@query("backtest_single", scored_sql(
    GRID_OUT.replace("p.grid_idx, p.series_id", "p.series_id", 1) + " WHERE p.grid_idx = 19", GRID_SQL))
def backtest_single(spark, sf_dir):
    table = B.backtest_single(scored(spark, sf_dir), "Sigmoid", 0.12, 60)
    return out(table, ["series_id", "n"], GRID_COLS)


@query("best_strategy", scored_sql(f"""
SELECT series_id, arg_max(grid_idx, (a, -grid_idx)) AS grid_idx, {rsql('max(a)', 8)} AS adjusted_sharpe
FROM (SELECT *, round(raw_sharpe / (vol_penalty * return_penalty), 10) AS a FROM parts)
WHERE a > -1 GROUP BY series_id""", GRID_SQL))
def best_strategy(spark, sf_dir):
    results = B.backtest_grid(scored(spark, sf_dir)).withColumn("adjusted_sharpe", F.round("adjusted_sharpe", 10))
    return out(B.best_strategy(results), ["series_id", "grid_idx"], {"adjusted_sharpe": 8})


HELD = """
returned AS (SELECT *, forward_returns AS strategy_returns, forward_returns - risk_free_rate AS excess,
                    forward_returns - risk_free_rate AS market_excess FROM scored)"""


@query("baseline_hold", scored_sql(V1_SQL, HELD, score_sql(*PROD, "returned")))
def baseline_hold(spark, sf_dir):
    return out(S.score_v1(B.hold(scored(spark, sf_dir))), ["series_id", "n"], V1_PARTS)


@query("smooth_positions", positioned_sql(f"""
SELECT series_id, date_id, {rsql('avg(position) OVER (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS position
FROM positioned"""))
def smooth_positions(spark, sf_dir):
    from serieswise.operators.features import smooth_positions as smooth

    return out(smooth(positioned(spark, sf_dir), "position", 5), ROW, ["position"])


@query("vol_target", positioned_sql(f"""
SELECT series_id, date_id, {rsql('least(greatest(position * least(greatest(coalesce(0.12 / sqrt(252) / (d + 1e-8), 1), 0), 3), 0), 2)')} AS position
FROM (SELECT *, CASE WHEN count(forward_returns) OVER w >= 20 THEN stddev_samp(forward_returns) OVER w END AS d FROM positioned
      WINDOW w AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""))
def vol_target(spark, sf_dir):
    return out(B.vol_target(positioned(spark, sf_dir), 0.12, 60), ROW, ["position"])


@query("equity_compare", scored_sql(f"""
SELECT kind, series_id, date_id, {rsql('equity')} AS equity FROM (
  SELECT 'best' AS kind, c.series_id, c.date_id, c.equity FROM curve c
  JOIN (SELECT series_id, arg_max(grid_idx, (a, -grid_idx)) AS grid_idx
        FROM (SELECT *, round(raw_sharpe / (vol_penalty * return_penalty), 10) AS a FROM parts) WHERE a > -1 GROUP BY series_id) b
    ON c.series_id = b.series_id AND c.grid_idx = b.grid_idx
  UNION ALL
  SELECT 'baseline', series_id, date_id, product(1 + forward_returns) OVER (PARTITION BY series_id ORDER BY date_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM scored)""", GRID_SQL))
def equity_compare(spark, sf_dir):
    df = scored(spark, sf_dir)
    results = B.backtest_grid(df).withColumn("adjusted_sharpe", F.round("adjusted_sharpe", 10))
    chosen = B.chosen_positions(df, B.best_strategy(results), B.grid())
    best = S.equity_curve(S.with_returns(chosen))
    base = S.equity_curve(df, "forward_returns")
    rows = best.select(F.lit("best").alias("kind"), *ROW, "equity").unionByName(base.select(F.lit("baseline").alias("kind"), *ROW, "equity"))
    return out(rows, ["kind", *ROW], ["equity"])


# ---- tables behind the charts

MARKET_RET = """
returned AS (SELECT *, forward_returns AS strategy_returns FROM fx_market)"""


def market_returns(spark, sf_dir):
    return fx_market(spark, sf_dir).withColumn("strategy_returns", F.col("forward_returns"))


@query("monthly_returns", positioned_sql(f"""
SELECT series_id, y AS year, {', '.join(f"max(CASE WHEN m = {i} THEN {rsql('ret')} END) AS m{i}" for i in range(1, 13))}
FROM (SELECT series_id, CAST(year(dt) AS INTEGER) AS y, CAST(month(dt) AS INTEGER) AS m, product(1 + strategy_returns) - 1 AS ret
      FROM returned GROUP BY ALL) GROUP BY series_id, y"""))
def monthly_returns(spark, sf_dir):
    table = G.monthly_pivot(G.monthly_returns(returned(spark, sf_dir)))
    return out(table, ["series_id", "year"], [f"m{i}" for i in range(1, 13)])


@query("chunk_returns", positioned_sql(f"""
SELECT series_id, CAST(p // greatest(1, n // 20) AS BIGINT) AS chunk, {rsql('product(1 + strategy_returns) - 1')} AS ret
FROM (SELECT *, date_id - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n FROM returned)
GROUP BY series_id, p // greatest(1, n // 20)"""))
def chunk_returns(spark, sf_dir):
    return out(G.chunk_returns(returned(spark, sf_dir)), ["series_id", "chunk"], ["ret"])


@query("ic_scatter", scored_sql(f"""
SELECT {rsql(f'corr(prediction, {TARGET})')} AS ic, {rsql(f'regr_slope({TARGET}, prediction)')} AS slope,
       {rsql(f'regr_intercept({TARGET}, prediction)')} AS intercept,
       {rsql(f'greatest(quantile_cont(abs(prediction), 0.99), quantile_cont(abs({TARGET}), 0.99))')} AS axis_limit
FROM scored"""))
def ic_scatter(spark, sf_dir):
    return out(G.ic_scatter(scored(spark, sf_dir), "prediction", TARGET), [], ["ic", "slope", "intercept", "axis_limit"])


@query("ols_line", scored_sql(f"""
SELECT series_id, {rsql(f'regr_slope({TARGET}, prediction)')} AS slope,
       {rsql(f'regr_intercept({TARGET}, prediction)')} AS intercept
FROM scored GROUP BY series_id"""))
def ols_line(spark, sf_dir):
    table = scored(spark, sf_dir).groupBy("series_id").agg(
        F.regr_slope(TARGET, "prediction").alias("slope"), F.regr_intercept(TARGET, "prediction").alias("intercept")
    )
    return out(table, KEY, ["slope", "intercept"])


@query("residual_histogram", scored_sql(f"""
SELECT b.bin, count(h.bin) AS count FROM (SELECT CAST(unnest(range(50)) AS BIGINT) AS bin) b
LEFT JOIN (SELECT CAST(least(floor((r - lo) / w), 49) AS BIGINT) AS bin
      FROM (SELECT r, lo, (hi - lo) / 50 AS w
            FROM (SELECT r, min(r) OVER () AS lo, max(r) OVER () AS hi
                  FROM (SELECT round({TARGET} - prediction, 10) AS r FROM scored) WHERE r IS NOT NULL))) h
ON h.bin = b.bin GROUP BY b.bin"""))
def residual_histogram(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("residual", F.round(F.col(TARGET) - F.col("prediction"), 10))
    return G.residual_histogram(df).select("bin", "count")


@query("position_histogram", positioned_sql(f"""
SELECT b.bin, count(h.bin) AS count, {rsql('max(b.mean)')} AS mean_position
FROM (SELECT CAST(unnest(range(40)) AS BIGINT) AS bin, (SELECT avg(position) FROM positioned) AS mean) b
LEFT JOIN (SELECT CAST(least(floor((p - lo) / w), 39) AS BIGINT) AS bin
      FROM (SELECT p, lo, (hi - lo) / 40 AS w
            FROM (SELECT round(position, 10) AS p, min(round(position, 10)) OVER () AS lo, max(round(position, 10)) OVER () AS hi FROM positioned))) h
ON h.bin = b.bin GROUP BY b.bin"""))
def position_histogram(spark, sf_dir):
    from serieswise.operators.frames import one_row
    from serieswise.operators.profile import histogram

    df = positioned(spark, sf_dir)
    mean = one_row(df.agg(F.avg("position").alias("m")))["m"]
    # rounded first: positions of both engines may straddle a bin edge by one bit
    bins = histogram(df.withColumn("position", F.round("position", 10)), "position", 40)
    return bins.select("bin", "count", rnd(mean).alias("mean_position"))


# fixed values: metrics of the report table and their notes
METRIC_NOTES = {
    "adjusted_sharpe": "higher is better",
    "raw_sharpe": "higher is better",
    "vol_penalty": "1 is best",
    "return_penalty": "1 is best",
}


@query("metric_table", positioned_sql(f"""
SELECT metric, {rsql('strategy')} AS strategy, {rsql('benchmark')} AS benchmark, note FROM (
  SELECT unnest(['adjusted_sharpe', 'raw_sharpe', 'vol_penalty', 'return_penalty']) AS metric,
         unnest([sa, sr, sv, sp]) AS strategy, unnest([ba, br, bv, bp]) AS benchmark,
         unnest(['higher is better', 'higher is better', '1 is best', '1 is best']) AS note
  FROM (SELECT avg(raw_sharpe / (vol_penalty * return_penalty)) AS sa, avg(raw_sharpe) AS sr, avg(vol_penalty) AS sv, avg(return_penalty) AS sp FROM parts),
       (SELECT avg(braw) AS ba, avg(braw) AS br, 1.0 AS bv, 1.0 AS bp
        FROM (SELECT (power(product(1 + market_excess), 1.0 / count(*)) - 1) / stddev_samp(forward_returns) * sqrt(252) AS braw
              FROM returned GROUP BY series_id)))""", score_sql(*PROD, "returned")))
def metric_table(spark, sf_dir):
    df = positioned(spark, sf_dir)
    mean = lambda s: s.agg(*[F.avg(m).alias(m) for m in METRIC_NOTES])
    table = G.metric_table(mean(S.score_v1(df)), mean(S.score_v1(B.hold(df))), METRIC_NOTES)
    return out(table, ["metric", "note"], ["strategy", "benchmark"])
