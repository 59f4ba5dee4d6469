"""Rolling, lagged and cumulative features; sequences; set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.operators import clean
from serieswise.operators import features as X
from serieswise.operators.blocks import rolling

ROW = ["series_id", "date_id"]


def frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY series_id ORDER BY date_id ROWS BETWEEN {n - 1} PRECEDING AND {end})"


ORDERED = "(PARTITION BY series_id ORDER BY date_id)"


def least(agg: str, col: str, n: int, rows: int) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} >= {rows} THEN {agg} OVER {frame(n)} END"


def mean_sql(col: str, n: int, rows: int = 1) -> str:
    return least(f"avg({col})", col, n, rows)


def z_sql(col: str, n: int, rows: int) -> str:
    return f"({col} - {mean_sql(col, n, rows)}) / nullif({least(f'stddev_pop({col})', col, n, rows)}, 0)"


def dev_sql(col: str, n: int) -> str:
    return f"({col} - {mean_sql(col, n)}) / nullif({mean_sql(col, n)}, 0)"


def mom_sql(col: str, n: int) -> str:
    return f"{col} / nullif(lag({col}, {n}) OVER {ORDERED}, 0) - 1"


def rank_sql(col: str, n: int) -> str:
    seen = f"list({{'v': {col}}}) OVER {frame(n)}"
    at_most = f"CASE WHEN {col} IS NULL THEN len({seen}) ELSE len(list_filter({seen}, lambda s: s.v <= {col})) END"
    return f"CASE WHEN count({col}) OVER {frame(n)} >= 5 THEN CAST({at_most} AS DOUBLE) / len({seen}) END"


def lag_sql(col: str, n: int) -> str:
    return f"lag({col}, {n}) OVER {ORDERED}"


def register(name: str, columns: dict[str, str], recipe, back: int, digits: int = 8, base=None) -> None:
    """A query of window columns over the panel and its SQL."""
    digits_by = {c: digits for c in columns}
    text = ", ".join(f"{rsql(e, digits)} AS {c}" for c, e in columns.items())

    @query(name, panel_sql(f"SELECT series_id, date_id, {text} FROM fx_panel"))
    def run(spark, sf_dir):
        return out(rolling(fx_panel(spark, sf_dir), recipe, back), ROW, digits_by)


def col(c):
    return F.col(c)


register("macro_dev_ratio", {f"e1_w{w}": dev_sql("E1", w) for w in C.MACRO_WINDOWS},
         lambda f: {f"e1_w{w}": X.dev_ratio(col("E1"), f.last(w)) for w in C.MACRO_WINDOWS}, 120)
register("momentum", {f"m1_w{w}": mom_sql("M1", w) for w in C.MOMENTUM_LAGS} | {"v1_w5": mom_sql("V1", 5)},
         lambda f: {f"m1_w{w}": X.momentum(col("M1"), f, w) for w in C.MOMENTUM_LAGS} | {"v1_w5": X.momentum(col("V1"), f, 5)}, 10, 6)
register("rank_pct", {"m2_rank": rank_sql("M2", 20), "s1_rank": rank_sql("S1", 20)},
         lambda f: {"m2_rank": X.rank_pct(col("M2"), f.last(20)), "s1_rank": X.rank_pct(col("S1"), f.last(20))}, 20)
register("mean_reversion_z", {f"p1_w{w}": z_sql("P1", w, 5) for w in C.REVERSION_WINDOWS},
         lambda f: {f"p1_w{w}": X.zscore(col("P1"), f.last(w), 5) for w in C.REVERSION_WINDOWS}, 60)
register("sentiment_smooth", {"s1_smooth": mean_sql("S1", 20)},
         lambda f: {"s1_smooth": X.rolling_mean(col("S1"), f.last(20))}, 20, 5)
register("sentiment_spike_z", {"p1_spike": z_sql("P1", 5, 3), "e1_spike": z_sql("E1 * 0.37", 5, 3)},
         lambda f: {"p1_spike": X.zscore(col("P1"), f.last(5), 3), "e1_spike": X.zscore(col("E1") * 0.37, f.last(5), 3)}, 5, 6)
register("roll_mean_m", {"m1_roll5": mean_sql("M1", 5), "m2_roll5": mean_sql("M2", 5)},
         lambda f: {"m1_roll5": X.rolling_mean(col("M1"), f.last(5)), "m2_roll5": X.rolling_mean(col("M2"), f.last(5))}, 5, 5)
register("roll_mean_v", {"v1_roll21": mean_sql("V1", 21)}, lambda f: {"v1_roll21": X.rolling_mean(col("V1"), f.last(21))}, 21)
register("diff_e", {f"e1_diff{w}": f"E1 - {lag_sql('E1', w)}" for w in C.E_LAGS},
         lambda f: {f"e1_diff{w}": col("E1") - F.lag("E1", w).over(f.ordered) for w in C.E_LAGS}, 63)
register("diff_lag_i", {"e1_diff1_lag5": f"{lag_sql('E1', 5)} - {lag_sql('E1', 6)}"},
         lambda f: {"e1_diff1_lag5": X._lagged_diff(col("E1"), f, 5)}, 6)
register("dev_p", {"p1_dev21": f"P1 - {mean_sql('P1', 21, 5)}"},
         lambda f: {"p1_dev21": col("P1") - X.rolling_mean(col("P1"), f.last(21), 5)}, 21, 5)
register("lag_s", {"s1_lag1": lag_sql("S1", 1)}, lambda f: {"s1_lag1": F.lag("S1", 1).over(f.ordered)}, 1, 5)


FILL = ["P1", "E1", "V1", "S1", "forward_returns", "risk_free_rate"]
FILL_SQL = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
    for c in FILL
)


@query("ffill", panel_sql(f"SELECT series_id, date_id, {FILL_SQL} FROM fx_panel"))
def ffill(spark, sf_dir):
    return X.forward_fill(fx_panel(spark, sf_dir), FILL).select(*ROW, *FILL)


# ---- the full feature sets on columns named as the recipes expect

V1_NAMES = {"E1": "E18", "M1": "M3", "M2": "M4", "P1": "P5", "V1": "P6", "S1": "S2"}
V1_SQL = {
    **{f"E18_dev_ratio_w{w}": dev_sql("E1", w) for w in C.MACRO_WINDOWS},
    **{f"{n}_mom_w{w}": mom_sql(c, w) for c, n in (("M1", "M3"), ("M2", "M4")) for w in C.MOMENTUM_LAGS},
    "M3_rank_pct_w20": rank_sql("M1", 20),
    "M4_rank_pct_w20": rank_sql("M2", 20),
    **{f"{n}_mr_z_w{w}": z_sql(c, w, 5) for c, n in (("P1", "P5"), ("V1 * 0.37", "P6")) for w in C.REVERSION_WINDOWS},
    "S2_smooth_w20": mean_sql("S1", 20),
    "S2_spike_z_w5": z_sql("S1", 5, 3),
}


@query("features_v1", panel_sql(
    "SELECT series_id, date_id, " + ", ".join(f"{rsql(e, 5)} AS {n}" for n, e in V1_SQL.items()) + " FROM fx_panel"))
def features_v1(spark, sf_dir):
    # the scale keeps constant stretches of the column off exact zero deviation ties
    panel = fx_panel(spark, sf_dir).withColumn("V1", F.col("V1") * 0.37).withColumnsRenamed(V1_NAMES)
    return out(X.features_v1(panel), ROW, {n: 5 for n in V1_SQL})


V2_SQL = {
    "M1_roll5": mean_sql("M1", 5),
    "M2_roll5": mean_sql("M2", 5),
    "E1_diff21": f"E1 - {lag_sql('E1', 21)}",
    "E1_diff63": f"E1 - {lag_sql('E1', 63)}",
    "P1_dev21": f"P1 - {mean_sql('P1', 21, 5)}",
    "V1_roll21": mean_sql("V1", 21),
    "S1_lag1": lag_sql("S1", 1),
}
FEATURES = """
feat AS (SELECT *, {cols}, CASE WHEN coalesce(risk_free_rate >= 0.0001, false) THEN 1 ELSE 0 END AS rate_regime
         FROM {panel})"""
ALL_V2 = ", ".join(f"{e} AS {n}" for n, e in V2_SQL.items())


@query("features_v2", panel_sql(
    "SELECT series_id, date_id, rate_regime, " + ", ".join(f"{rsql(n, 5)} AS {n}" for n in V2_SQL) + " FROM feat",
    FEATURES.format(cols=ALL_V2, panel="fx_panel")))
def features_v2(spark, sf_dir):
    features, _ = X.features_v2(fx_panel(spark, sf_dir))
    return out(features, [*ROW, "rate_regime"], {n: 5 for n in V2_SQL})


# ---- spikes

SPIKE_COLS = ["V1", "M1", "E1", "P1"]
LIMITS = """
lim AS (SELECT series_id, {q} FROM fx_panel GROUP BY series_id)""".format(
    q=", ".join(
        f"quantile_cont({c}, 0.005::DOUBLE) AS {c}_lo, quantile_cont({c}, 0.995::DOUBLE) AS {c}_hi" for c in SPIKE_COLS
    )
)


def candidate(c: str) -> str:
    return f"({c} < {c}_lo OR {c} > {c}_hi)"


def spike_sql(c: str) -> str:
    side = lambda f: (
        f"NOT coalesce({f}({candidate(c)}) OVER o, true) AND {f}(abs({c})) OVER o > 0 "
        f"AND abs({c}) > 10 * {f}(abs({c})) OVER o"
    )
    return f"coalesce({candidate(c)} AND {side('lag')} AND {side('lead')}, false)"


MARKED = f"""
marked AS (SELECT p.*, {', '.join(f'{c}_lo, {c}_hi, {spike_sql(c)} AS {c}_spike' for c in SPIKE_COLS)}
           FROM fx_panel p JOIN lim ON p.series_id = lim.series_id
           WINDOW o AS (PARTITION BY p.series_id ORDER BY date_id))"""


@query("spike_clean", panel_sql(
    "SELECT series_id, date_id, " + ", ".join(f"CASE WHEN NOT {c}_spike THEN {c} END AS {c}" for c in SPIKE_COLS)
    + " FROM marked", LIMITS, MARKED))
def spike_clean(spark, sf_dir):
    cleaned, _ = clean.clean_spikes(fx_panel(spark, sf_dir), SPIKE_COLS)
    return cleaned.select(*ROW, *SPIKE_COLS)


@query("spike_summary", panel_sql(" UNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, count(*) FILTER (WHERE {c}_spike) AS dirty_count, "
    f"{rsql(f'CAST(count(*) FILTER (WHERE {c}_spike) AS DOUBLE) / count(*)')} AS dirty_rate, "
    f"{rsql(f'max({c}_lo)', 6)} AS lower_thr, {rsql(f'max({c}_hi)', 6)} AS upper_thr FROM marked GROUP BY series_id"
    for c in SPIKE_COLS), LIMITS, MARKED))
def spike_summary(spark, sf_dir):
    _, summary = clean.clean_spikes(fx_panel(spark, sf_dir), SPIKE_COLS)
    return out(summary, ["series_id", "feature", "dirty_count"], {"dirty_rate": 9, "lower_thr": 6, "upper_thr": 6})


# ---- sequences

def seq_sql(length: int, current: bool) -> str:
    end = "CURRENT ROW" if current else "1 PRECEDING"
    rows = length - 1 if current else length
    w = f"(PARTITION BY series_id ORDER BY date_id ROWS BETWEEN {rows} PRECEDING AND {end})"
    return f"""
SELECT series_id, date_id, market_forward_excess_returns AS target, len(s) AS length,
       list_extract(list_extract(s, 1), 1) AS first_m2, list_extract(list_extract(s, {length}), 2) AS last_v1,
       {rsql('list_sum([x[1] for x in s])', 4)} AS sum_m2
FROM (SELECT *, list([M2, V1]) OVER {w} AS s FROM fx_panel) WHERE len(s) = {length}"""


def sequences(spark, sf_dir, length, current):
    rows = X.sequence_windows(
        fx_panel(spark, sf_dir), ["M2", "V1"], "market_forward_excess_returns", length, include_current=current
    )
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0])
    return rows.select(
        *ROW, "target", F.size("sequence").cast("long").alias("length"),
        F.col("sequence")[0][0].alias("first_m2"), F.col("sequence")[length - 1][1].alias("last_v1"),
        rnd(total, 4).alias("sum_m2"),
    )


@query("sequence_windows", panel_sql(seq_sql(20, True)))
def sequence_windows(spark, sf_dir):
    return sequences(spark, sf_dir, 20, True)


@query("sequence_windows_before", panel_sql(seq_sql(20, False)))
def sequence_windows_before(spark, sf_dir):
    return sequences(spark, sf_dir, 20, False)


# ---- irregular event series

@query("sort_series", """
SELECT user_id AS series_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS pos,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS previous
FROM events""")
def sort_series(spark, sf_dir):
    from serieswise.operators.blocks import number_rows

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("series_id"), "event_id", "ts", "value"
    )
    rows = number_rows(events, "ts")
    lagged = rolling(rows, lambda f: {"previous": F.lag("value").over(f.ordered)}, 1)
    return lagged.select("series_id", "event_id", "pos", "previous")
