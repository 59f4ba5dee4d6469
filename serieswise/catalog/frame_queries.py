"""Scans, column choice, filters, splits, folds, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.functions import scalar as Z
from serieswise.operators import frames as T
from serieswise.operators import scoring as S
from serieswise.operators.features import engineered_map, features_v2
from serieswise.session import settle, shared_dir
from serieswise.sources import panel_io as IO

ROW = ["series_id", "date_id"]
TARGET = C.EXCESS_TARGET
RAW = ["M1", "M2", "P1", "E1", "V1", "S1", "D1"]


# ---- scans

@query("scan_panel", """
SELECT user_id AS series_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS pos
FROM events""")
def scan_panel(spark, sf_dir):
    """The preferred folder is missing, so the fallback is read."""
    df = IO.read_panel(
        spark, [f"{sf_dir}/raw/events.parquet", f"{sf_dir}/events.parquet"], rename={"user_id": "series_id"},
        order="ts",
    )
    return df.select("series_id", "event_id", "value", "pos")


@query("scan_single", market_sql("SELECT date_id, date_id AS pos, forward_returns, P1, E1, D1 FROM fx_market"))
def scan_single(spark, sf_dir):
    """One series through a CSV file and back, typed by an explicit schema."""
    path = shared_dir(spark, "market") + ".csv"
    cols = ["date_id", "forward_returns", "P1", "E1", "D1"]
    fx_market(spark, sf_dir).select(*cols).write.option("header", True).csv(path)
    schema = "date_id long, forward_returns double, P1 double, E1 double, D1 long"
    return IO.read_panel(spark, [path], schema).select(*cols, "pos")


# ---- column choice and filters

@query("model_columns", panel_sql(
    "SELECT series_id, date_id, D1, E1, M1, M2, P1, S1, V1, risk_free_rate FROM fx_panel"))
def model_columns(spark, sf_dir):
    panel = fx_panel(spark, sf_dir)
    chosen = [c for c in T.model_columns(panel, extra_drop=["cnt"]) if c not in ROW]
    return panel.select(*ROW, *chosen)


@query("missing_flags", panel_sql("SELECT series_id, date_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_missing" for c in ("P1", "E1", "S1")) + " FROM fx_panel"))
def missing_flags(spark, sf_dir):
    cols = ["P1", "E1", "S1"]
    return T.missing_flags(fx_panel(spark, sf_dir), cols).select(*ROW, *[f"{c}_missing" for c in cols])


def rates_sql(source: str, cols=RAW, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS na_count, "
        f"{rsql(f'CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*)')} AS na_rate FROM {source} {where}"
        for c in cols
    )


SPLIT = """
split AS (SELECT *, CASE WHEN date_id < floor(0.7::DOUBLE * n) THEN 'train'
                         WHEN date_id < floor((0.7::DOUBLE + 0.2::DOUBLE) * n) THEN 'val' ELSE 'test' END AS split
          FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM fx_panel))"""
HOLDOUT = """
held AS (SELECT *, CASE WHEN date_id < floor((1::DOUBLE - 0.1::DOUBLE) * n) THEN 'train' ELSE 'test' END AS split
         FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM fx_panel))"""


@query("high_na_columns", panel_sql(
    f"SELECT * FROM ({rates_sql('split', RAW, chr(10) + 'WHERE split = ' + chr(39) + 'train' + chr(39))}) WHERE na_rate >= 0.40", SPLIT))
def high_na_columns(spark, sf_dir):
    train = T.split_three_way(fx_panel(spark, sf_dir)).filter("split = 'train'")
    return out(T.high_na_columns(train), ["feature", "na_count"], ["na_rate"])


@query("drop_high_na", panel_sql("SELECT series_id, date_id, split, M1, M2, E1, V1, D1 FROM held", HOLDOUT))
def drop_high_na(spark, sf_dir):
    """P1 and S1 are mostly null in the training part, so they and their features go."""
    panel = T.split_holdout(fx_panel(spark, sf_dir)).withColumn("S1_lag1", F.col("S1"))
    train, test = (panel.filter(F.col("split") == s) for s in ("train", "test"))
    train, test, _ = T.drop_high_na(train, test, engineered_map(panel.columns))
    kept = [c for c in train.columns if c in RAW or c.endswith("_lag1")]
    return train.unionByName(test).select(*ROW, "split", *kept)


@query("drop_dummy", panel_sql("SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', (SELECT CASE WHEN count(*) FILTER (WHERE {c} NOT IN (-1, 0, 1)) = 0 THEN 1 ELSE 0 END FROM fx_panel))" for c in RAW)
    + ") t(feature, is_dummy)"))
def drop_dummy(spark, sf_dir):
    return T.dummy_columns(fx_panel(spark, sf_dir), RAW)


@query("drop_null_target", panel_sql("SELECT series_id, date_id, S1 FROM fx_panel WHERE S1 IS NOT NULL"))
def drop_null_target(spark, sf_dir):
    return T.drop_null_target(fx_panel(spark, sf_dir), "S1").select(*ROW, "S1")


@query("direction_label", panel_sql(
    "SELECT series_id, date_id, CASE WHEN forward_returns > 0 THEN 1 ELSE 0 END AS label FROM fx_panel"))
def direction_label(spark, sf_dir):
    return fx_panel(spark, sf_dir).select(*ROW, Z.direction(F.col("forward_returns")).alias("label"))


@query("rate_regime", panel_sql(
    "SELECT series_id, date_id, CASE WHEN coalesce(E1 / 40000.0 >= 0.0001, false) THEN 1 ELSE 0 END AS rate_regime FROM fx_panel"))
def rate_regime(spark, sf_dir):
    rate = F.col("E1") / F.lit(40000.0)
    return fx_panel(spark, sf_dir).select(*ROW, Z.rate_regime(rate, C.RATE_REGIME_THRESHOLD).alias("rate_regime"))


@query("trim_leading_empty", panel_sql("""
SELECT series_id, date_id, date_id - first AS pos FROM (
  SELECT *, min(CASE WHEN P1 IS NOT NULL THEN date_id END) OVER (PARTITION BY series_id) AS first FROM fx_panel)
WHERE date_id >= first"""))
def trim_leading_empty(spark, sf_dir):
    return T.trim_leading_empty(fx_panel(spark, sf_dir), ["P1"]).select(*ROW, "pos")


@query("mean_impute", panel_sql(f"""
SELECT series_id, date_id, {rsql('coalesce(P1, pm)', 5)} AS P1, {rsql('coalesce(E1, em)', 7)} AS E1
FROM held, (SELECT avg(P1) AS pm, avg(E1) AS em FROM held WHERE split = 'train') m WHERE split = 'test'""", HOLDOUT))
def mean_impute(spark, sf_dir):
    panel = T.split_holdout(fx_panel(spark, sf_dir))
    filled = T.mean_impute(panel.filter("split = 'test'"), panel.filter("split = 'train'"), ["P1", "E1"])
    return out(filled, ROW, {"P1": 5, "E1": 7})


@query("zscore_scale", panel_sql(f"""
SELECT series_id, date_id, {rsql('(M1 - m1m) / m1s', 8)} AS M1, {rsql('(V1 - v1m) / v1s', 8)} AS V1
FROM held, (SELECT avg(M1) AS m1m, stddev_pop(M1) AS m1s, avg(V1) AS v1m, stddev_pop(V1) AS v1s
            FROM held WHERE split = 'train') m WHERE split = 'test'""", HOLDOUT))
def zscore_scale(spark, sf_dir):
    panel = T.split_holdout(fx_panel(spark, sf_dir))
    scaled = T.zscore_scale(panel.filter("split = 'test'"), panel.filter("split = 'train'"), ["M1", "V1"])
    return out(scaled, ROW, {"M1": 8, "V1": 8})


# ---- splits and folds

@query("split_three_way", panel_sql("SELECT series_id, date_id, split FROM split", SPLIT))
def split_three_way(spark, sf_dir):
    return T.split_three_way(fx_panel(spark, sf_dir)).select(*ROW, "split")


@query("split_holdout", panel_sql("SELECT series_id, date_id, split FROM held", HOLDOUT))
def split_holdout(spark, sf_dir):
    return T.split_holdout(fx_panel(spark, sf_dir)).select(*ROW, "split")


def fold_sizes(rows):
    return rows.groupBy("series_id", F.col("fold").cast("long").alias("fold"), "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date_id").alias("first_id"), F.max("date_id").alias("last_id")
    )


FOLD_SIZES = """SELECT f.series_id, f.fold, CASE WHEN p.date_id < f.a THEN 'train' ELSE 'val' END AS role,
       count(*) AS n_rows, min(p.date_id) AS first_id, max(p.date_id) AS last_id
FROM fx_panel p JOIN folds f ON p.series_id = f.series_id AND p.date_id < f.b GROUP BY ALL"""
EXPANDING = """
folds AS (SELECT series_id, fold, 252 + fold * ((n - 252) // 5) + least(fold, (n - 252) % 5) AS a,
                 252 + (fold + 1) * ((n - 252) // 5) + least(fold + 1, (n - 252) % 5) AS b
          FROM (SELECT series_id, count(*) AS n FROM fx_panel GROUP BY series_id), (SELECT unnest(range(5)) AS fold)
          WHERE n - 252 >= 5)"""
TIMED = """
folds AS (SELECT series_id, fold, n - (5 - fold) * (n // 6) AS a, n - (4 - fold) * (n // 6) AS b
          FROM (SELECT series_id, count(*) AS n FROM fx_panel GROUP BY series_id), (SELECT unnest(range(5)) AS fold))"""


@query("folds_expanding", panel_sql(FOLD_SIZES, EXPANDING))
def folds_expanding(spark, sf_dir):
    return fold_sizes(T.folds_expanding(fx_panel(spark, sf_dir), initial=252, folds=5))


@query("folds_timeseries", panel_sql(FOLD_SIZES, TIMED))
def folds_timeseries(spark, sf_dir):
    return fold_sizes(T.folds_timeseries(fx_panel(spark, sf_dir), folds=5))


@query("context_tail", panel_sql("""
SELECT series_id, date_id FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM fx_panel) WHERE date_id >= n - 63"""))
def context_tail(spark, sf_dir):
    return T.context_tail(fx_panel(spark, sf_dir)).select(*ROW)


# ---- joins and set operations over result tables

# fixed values: order and label of the models in the report
REPORT_ORDER = [("lagged", "Lagged return"), ("hold", "Buy and hold"), ("half", "Half invested")]


def model_scores(spark, sf_dir):
    """Mean score per position rule, all from one pass over the panel."""
    rules = {"lagged": F.col("position"), "hold": F.lit(1.0), "half": F.lit(0.5)}
    rows = S.score_rules(positioned(spark, sf_dir), rules)
    return rows.groupBy("model").agg(F.avg("adjusted_sharpe").alias("score"), F.avg("raw_sharpe").alias("raw"))


MODEL_SCORES = """
rules AS (
  SELECT 'lagged' AS model, series_id, forward_returns, risk_free_rate, position FROM positioned
  UNION ALL SELECT 'hold', series_id, forward_returns, risk_free_rate, 1.0 FROM positioned
  UNION ALL SELECT 'half', series_id, forward_returns, risk_free_rate, 0.5 FROM positioned),
earned AS (SELECT *, risk_free_rate * (1 - position) + position * forward_returns AS strategy_returns,
                  risk_free_rate * (1 - position) + position * forward_returns - risk_free_rate AS excess,
                  forward_returns - risk_free_rate AS market_excess FROM rules),
{parts},
scores AS (SELECT model, avg(raw_sharpe / (vol_penalty * return_penalty)) AS score, avg(raw_sharpe) AS raw FROM parts GROUP BY model)"""


def model_scores_sql(body: str) -> str:
    from serieswise.catalog.metric_queries import PROD, score_sql

    return positioned_sql(body, MODEL_SCORES.format(parts=score_sql(*PROD, "earned", "model, series_id")))


@query("ordered_model_table", model_scores_sql(f"""
SELECT o.ord, o.label, {rsql('score')} AS score FROM scores s
JOIN (VALUES (0, 'lagged', 'Lagged return'), (1, 'hold', 'Buy and hold'), (2, 'half', 'Half invested')) o(ord, model, label)
  ON s.model = o.model"""))
def ordered_model_table(spark, sf_dir):
    order = spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(REPORT_ORDER)], "ord int, model string, label string")
    # the order table has one row per model name listed above
    return out(model_scores(spark, sf_dir).join(F.broadcast(order), "model"), ["ord", "label"], ["score"])


@query("rank_models", model_scores_sql(f"SELECT model, CAST(row_number() OVER (ORDER BY score DESC, model) AS BIGINT) AS place, {rsql('score')} AS score FROM scores"))
def rank_models(spark, sf_dir):
    from pyspark.sql import Window

    # one row per model: the window runs over the result table, not over data rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "model")).cast("long")
    return out(model_scores(spark, sf_dir).withColumn("place", place), ["model", "place"], ["score"])


@query("merge_cached_results", model_scores_sql(f"""
SELECT model, {rsql('score')} AS score, {rsql('raw')} AS raw, 'new' AS origin FROM scores WHERE model <> 'half'
UNION ALL SELECT model, {rsql('score')}, NULL, 'cached' FROM scores WHERE model = 'half'"""))
def merge_cached_results(spark, sf_dir):
    """Results of this run, plus the earlier result of a model that did not run."""
    scores = settle(model_scores(spark, sf_dir))  # a row a model, read several times
    path = shared_dir(spark, "cached")
    IO.write_report(scores, path)
    old = IO.read_report(spark, path, "model string, score double").withColumn("origin", F.lit("cached"))
    new = scores.filter("model <> 'half'").withColumn("origin", F.lit("new"))
    return out(T.merge_cached(new, old, "model"), ["model", "origin"], ["score", "raw"])


@query("summary_union", model_scores_sql(f"""
SELECT model, {rsql('score')} AS score, {rsql('raw')} AS raw, CASE WHEN model = 'hold' THEN NULL ELSE 1.0::DOUBLE END AS k,
       CASE WHEN score > (SELECT score FROM scores WHERE model = 'hold') THEN 1 ELSE 0 END AS beats_hold FROM scores"""))
def summary_union(spark, sf_dir):
    """Benchmark row and model rows in one table; the benchmark has no parameter."""
    scores = settle(model_scores(spark, sf_dir))  # a row a model, read several times
    bench = scores.filter("model = 'hold'")
    models = scores.filter("model <> 'hold'").withColumn("k", F.lit(1.0))
    level = T.one_row(bench.select("score"))["score"]
    table = bench.unionByName(models, allowMissingColumns=True)
    return out(table.withColumn("beats_hold", (F.col("score") > level).cast("int")), ["model", "k", "beats_hold"], ["score", "raw"])


@query("stitch_folds", panel_sql("""SELECT p.series_id, p.date_id, f.fold
FROM fx_panel p JOIN folds f ON p.series_id = f.series_id AND p.date_id >= f.a AND p.date_id < f.b""", EXPANDING))
def stitch_folds(spark, sf_dir):
    """Validation rows of all folds: one table from the start, keyed by fold."""
    rows = T.folds_expanding(fx_panel(spark, sf_dir), initial=252, folds=5).filter("role = 'val'")
    return rows.select(*ROW, F.col("fold").cast("long").alias("fold"))


@query("concat_splits", panel_sql("SELECT series_id, date_id, split, M1 FROM split", SPLIT))
def concat_splits(spark, sf_dir):
    panel = T.split_three_way(fx_panel(spark, sf_dir)).select(*ROW, "split", "M1")
    train, val, test = (panel.filter(F.col("split") == s) for s in ("train", "val", "test"))
    return train.unionByName(val).unionByName(test)


# ---- scalar functions

CLIPPED = "least(greatest(5 * (probability - 0.5), -10), 10)"
SCALARS = {
    "pos_linear": ("least(greatest(1 + (probability - 0.5), 0), 2)", Z.linear_position),
    "pos_sigmoid": (f"2 / (1 + exp(-{CLIPPED}))", Z.sigmoid_position),
    "pos_tanh": (f"1 + tanh({CLIPPED})", Z.tanh_position),
}


def register_position(name: str, text: str, fn) -> None:
    @query(name, scored_sql(f"SELECT series_id, date_id, {rsql(text)} AS position FROM scored"))
    def run(spark, sf_dir):
        return out(scored(spark, sf_dir).withColumn("position", fn(F.col("probability"))), ROW, ["position"])


for _name, (_text, _fn) in SCALARS.items():
    register_position(_name, _text, _fn)


@query("hard_label", scored_sql(
    "SELECT series_id, date_id, CASE WHEN round(probability, 12) >= 0.5 THEN 1 ELSE 0 END AS label FROM scored"))
def hard_label(spark, sf_dir):
    return scored(spark, sf_dir).select(*ROW, Z.hard_label(F.round("probability", 12)).alias("label"))


@query("safe_number", panel_sql(f"""
SELECT series_id, date_id, CASE WHEN forward_returns <> 0 THEN {rsql('V1 / forward_returns', 5)} END AS share FROM fx_panel"""))
def safe_number(spark, sf_dir):
    """Quotients as IEEE numbers, where a zero divisor gives NaN or infinity, made null."""
    v, r = F.col("V1"), F.col("forward_returns")
    raw = F.when(r == 0, F.when(v == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(v / F.nullif(r, F.lit(0.0)))
    return fx_panel(spark, sf_dir).select(*ROW, rnd(Z.finite(raw), 5).alias("share"))


@query("raw_source", panel_sql("""
SELECT feature, CASE WHEN regexp_extract(feature, '^([A-Z]+[0-9]+)', 1) <> '' THEN regexp_extract(feature, '^([A-Z]+[0-9]+)', 1)
                     ELSE substr(feature, 1, 1) END AS source, known
FROM (SELECT unnest(['M1_roll5', 'M2_roll5', 'E1_diff21', 'E1_diff63', 'P1_dev21', 'V1_roll21', 'S1_lag1', 'rate_regime']) AS feature,
             unnest([count(M1_roll5), count(M2_roll5), count(E1_diff21), count(E1_diff63), count(P1_dev21), count(V1_roll21),
                     count(S1_lag1), count(rate_regime)]) AS known FROM feat)""", "{features}"))
def raw_source(spark, sf_dir):
    """Raw column of every engineered feature, with its known values."""
    df, made = features_v2(fx_panel(spark, sf_dir))
    cols = [c for group in made.values() for c in group] + ["rate_regime"]
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    table = T.stacked(counts, [{"feature": F.lit(c), "known": F.col(c)} for c in cols])
    return table.withColumn("source", Z.raw_source(F.col("feature")))


@query("calendar_parts", panel_sql("""
SELECT series_id, date_id, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month,
       CAST(strftime(last_day(dt), '%Y-%m-%d') AS VARCHAR) AS month_end FROM fx_panel"""))
def calendar_parts(spark, sf_dir):
    return fx_panel(spark, sf_dir).select(
        *ROW, F.year("dt").alias("year"), F.month("dt").alias("month"),
        F.date_format(F.last_day("dt"), "yyyy-MM-dd").alias("month_end"),
    )


def _fill_feature_sql() -> None:
    from serieswise.catalog import window_queries as WQ

    text = WQ.FEATURES.format(cols=WQ.ALL_V2, panel="fx_panel")
    ORACLES["raw_source"] = ORACLES["raw_source"].replace("{features}", text)


_fill_feature_sql()
