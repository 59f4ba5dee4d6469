"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.catalog.frame_queries import EXPANDING, SPLIT
from serieswise.catalog.profile_queries import NUM, each
from serieswise.catalog.window_queries import FEATURES, V2_SQL
from serieswise.operators import frames as T
from serieswise.operators.correlation import corr_target
from serieswise.operators.features import features_v2
from serieswise.plans import selection as L
from serieswise.plans.walk_forward import raw_name
from serieswise.session import settle

TARGET = C.EXCESS_TARGET
COLS = [*V2_SQL, "rate_regime"]
ROUNDED_V2 = ", ".join(f"{rsql(e, 6)} AS {n}" for n, e in V2_SQL.items())
PANEL_FEATURES = FEATURES.format(cols=ROUNDED_V2, panel="fx_panel")


def engineered(spark, sf_dir):
    """Engineered panel; rounded, so that values tied in one engine are tied in the other."""
    df, _ = features_v2(fx_panel(spark, sf_dir))
    return df.withColumns({c: quick_rnd(c, 6) for c in V2_SQL})


@query("select_variance", panel_sql(f"""
SELECT feature, {rsql('variance', 3)} AS variance, {rsql('quantile_cont(variance, 0.25) OVER ()', 3)} AS threshold,
       CASE WHEN variance > quantile_cont(variance, 0.25) OVER () THEN 1 ELSE 0 END AS kept
FROM ({each(NUM, lambda c: f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM split WHERE split = 'train'")})""", SPLIT))
def select_variance(spark, sf_dir):
    train = T.split_three_way(fx_panel(spark, sf_dir)).filter("split = 'train'")
    return out(L.select_variance(train, NUM), ["feature", "kept"], {"variance": 3, "threshold": 3})


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
GREEDY = f"""
train AS (SELECT * FROM split WHERE split = 'train'),
va AS ({each(NUM, lambda c: f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM train")}),
pr AS ({" UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, abs(corr({a}, {b})) AS c FROM train" for a, b in PAIRS)}),
top AS (SELECT f1, f2, row_number() OVER (ORDER BY c DESC, f1, f2) AS k FROM pr WHERE c IS NOT NULL AND NOT isnan(c)),
step AS (SELECT k, f1, f2, CASE WHEN a.variance >= b.variance THEN f2 ELSE f1 END AS gone
         FROM top JOIN va a ON a.feature = f1 JOIN va b ON b.feature = f2 WHERE k <= {C.TOP_PAIRS}),
walk AS (SELECT CAST(0 AS BIGINT) AS k, {NUM} AS cols
         UNION ALL SELECT step.k, CASE WHEN list_contains(cols, f1) AND list_contains(cols, f2)
                                       THEN list_filter(cols, lambda x: x <> gone) ELSE cols END FROM walk JOIN step ON step.k = walk.k + 1)"""


@query("select_corr_greedy", panel_sql(f"""
SELECT feature, {rsql('variance', 3)} AS variance FROM va
WHERE list_contains((SELECT cols FROM walk ORDER BY k DESC LIMIT 1), feature)""", SPLIT, GREEDY).replace("WITH", "WITH RECURSIVE", 1))
def select_corr_greedy(spark, sf_dir):
    """Survivors of the greedy walk with their variance."""
    train = T.split_three_way(fx_panel(spark, sf_dir)).filter("split = 'train'")
    return out(L.variance_profile(train, L.select_corr_greedy(train, NUM)), ["feature"], {"variance": 3})


@query("cum_gain", panel_sql(f"""
SELECT feature, {rsql('gain')} AS gain, {rsql('run')} AS cum_gain,
       CASE WHEN run <= 0.9 * total OR (place = 1 AND gain > 0.9 * total) THEN 1 ELSE 0 END AS kept
FROM (SELECT *, sum(gain) OVER (ORDER BY gain DESC, feature ROWS UNBOUNDED PRECEDING) AS run, sum(gain) OVER () AS total,
             row_number() OVER (ORDER BY gain DESC, feature) AS place
      FROM ({each(NUM, lambda c: f"SELECT '{c}' AS feature, abs(corr({c}, forward_returns)) AS gain FROM fx_panel")}))"""))
def cum_gain(spark, sf_dir):
    """The cut over absolute target correlations as gains."""
    gains = corr_target(fx_panel(spark, sf_dir), NUM, C.RETURN_TARGET).select("feature", F.col("abs_corr").alias("gain"))
    return out(L.cum_gain(gains), ["feature", "kept"], ["gain", "cum_gain"])


@query("select_importance")
def select_importance(spark, sf_dir):
    panel = settle(T.split_three_way(fx_panel(spark, sf_dir)))
    train, val = (panel.filter(F.col("split") == s) for s in ("train", "val"))
    return L.select_importance(train, val, T.feature_columns(panel))


@query("selection_funnel")
def selection_funnel(spark, sf_dir):
    _, table = L.selection_funnel(settle(T.split_three_way(fx_panel(spark, sf_dir))))
    return table


def ic_sql(source: str, cols, part: str = "") -> str:
    """IC, t and variance per column, and per ``part`` columns if given."""
    keys = f"{part}, " if part else ""
    over = f"PARTITION BY {part}" if part else ""
    rank = lambda v: (
        f"rank() OVER ({over} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}{v}) - 1) / 2.0"
    )
    group = f"GROUP BY {part}" if part else ""
    return each(cols, lambda c: f"""
SELECT {keys}'{c}' AS feature, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS ic, var_pop(x) AS variance
FROM (SELECT {keys}x, {rank('x')} AS rx, {rank('y')} AS ry
      FROM (SELECT {keys}CAST({c} AS DOUBLE) AS x, {TARGET} AS y FROM {source} WHERE {c} IS NOT NULL AND {TARGET} IS NOT NULL)) {group}""")


# variances reach 1e8: three digits more would compare the order of summation
FOLD_IC_OUT = f"""{rsql('ic', 8)} AS ic, {rsql('ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12))', 6)} AS t_stat,
  {rsql('variance', 1)} AS variance"""
IC_OUT = f"""{rsql('ic', 8)} AS ic, {rsql('ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12))', 6)} AS t_stat,
  {rsql('variance', 3)} AS variance"""


@query("ic_table_raw", panel_sql(
    f"SELECT feature, n, {IC_OUT} FROM ({ic_sql('fx_panel', NUM)}) WHERE n >= 10 AND ic IS NOT NULL"))
def ic_table_raw(spark, sf_dir):
    table = L.ic_table(fx_panel(spark, sf_dir), NUM, TARGET)
    return out(table, ["feature", "n"], {"ic": 8, "t_stat": 6, "variance": 3})


@query("ic_table_engineered", panel_sql(
    f"SELECT feature, n, {IC_OUT} FROM ({ic_sql('feat', COLS)}) WHERE n >= 10 AND ic IS NOT NULL", PANEL_FEATURES))
def ic_table_engineered(spark, sf_dir):
    table = L.ic_table(engineered(spark, sf_dir), COLS, TARGET)
    return out(table, ["feature", "n"], {"ic": 8, "t_stat": 6, "variance": 3})


FOLD_ROWS = """
fold_rows AS (SELECT p.*, f.fold FROM feat p JOIN folds f ON p.series_id = f.series_id AND p.date_id < f.a)"""


@query("ic_table_per_fold", panel_sql(
    f"SELECT series_id, fold, feature, n, {FOLD_IC_OUT} FROM ({ic_sql('fold_rows', COLS, 'series_id, fold')}) WHERE n >= 10 AND ic IS NOT NULL",
    PANEL_FEATURES, EXPANDING, FOLD_ROWS))
def ic_table_per_fold(spark, sf_dir):
    table = L.ic_table_per_fold(engineered(spark, sf_dir), COLS, TARGET, 252, 5)
    return out(
        table.withColumn("fold", F.col("fold").cast("long")), ["series_id", "fold", "feature", "n"],
        {"ic": 8, "t_stat": 6, "variance": 1},
    )


KNOWN = f"known AS (SELECT * FROM fx_panel WHERE {TARGET} IS NOT NULL)"
IC_RAW = f"""
passed AS (SELECT *, ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12)) AS t, left(feature, 1) AS grp
           FROM ({ic_sql('known', NUM)}) WHERE n >= 10 AND ic IS NOT NULL),
strong AS (SELECT * FROM passed WHERE abs(t) >= {C.IC_T_MIN}),
pc AS ({" UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c FROM known" for a, b in PAIRS)}),
close AS (SELECT f1, f2 FROM pc WHERE c IS NULL OR isnan(c) OR abs(c) >= {C.CORR_MAX}),
-- exact for groups of two, which is all there are here
walked AS (SELECT *, NOT EXISTS (SELECT 1 FROM strong o, close k WHERE o.grp = s.grp AND o.variance > s.variance
             AND (k.f1, k.f2) IN ((o.feature, s.feature), (s.feature, o.feature))) AS kept FROM strong s)"""


@query("select_ic_raw", panel_sql(f"""
SELECT feature, {rsql('ic', 8)} AS ic, {rsql('t', 6)} AS t_stat, {rsql('variance', 3)} AS variance, CAST(kept AS INTEGER) AS kept,
       CAST(kept AND variance > (SELECT quantile_cont(variance, {C.VAR_QUANTILE}) FROM walked WHERE kept) AS INTEGER) AS selected
FROM walked""", KNOWN, IC_RAW))
def select_ic_raw(spark, sf_dir):
    table = L.select_ic_raw(fx_panel(spark, sf_dir), [*NUM, "D1"], TARGET)
    return out(table, ["feature", "kept", "selected"], {"ic": 8, "t_stat": 6, "variance": 3})


SOURCES = {c: raw_name(c) for c in COLS}
GROUP_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1:] if SOURCES[a] == SOURCES[b]]


def walk_sql(source: str, part: str) -> str:
    """CTEs of the greedy selection per ``part`` columns: the groups' features one by one, by falling variance."""
    on = f"{part}, grp"
    same = " AND ".join(f"w.{c.strip()} = o.{c.strip()}" for c in on.split(","))
    return f"""
passed AS (SELECT *, ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12)) AS t,
                  MAP {{{", ".join(f"'{c}': '{r}'" for c, r in SOURCES.items())}}}[feature] AS grp,
                  list_position({COLS}, feature) AS ord
           FROM ({ic_sql(source, COLS, part)}) WHERE n >= 10 AND ic IS NOT NULL),
near AS (SELECT {part}, f1, f2 FROM ({" UNION ALL ".join(f"SELECT {part}, '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS c FROM {source} GROUP BY {part}" for a, b in GROUP_PAIRS)})
         WHERE c IS NULL OR isnan(c) OR abs(c) >= {C.CORR_MAX}),
nears AS (SELECT {part}, feature, list(other) AS others
          FROM (SELECT {part}, f1 AS feature, f2 AS other FROM near UNION ALL SELECT {part}, f2, f1 FROM near) GROUP BY {part}, feature),
ordered AS (SELECT p.*, coalesce(others, []) AS others, row_number() OVER (PARTITION BY {", ".join("p." + c.strip() for c in on.split(","))} ORDER BY variance DESC, ord) AS r
            FROM (SELECT * FROM passed WHERE abs(t) >= {C.IC_T_MIN}) p
            LEFT JOIN nears s ON {" AND ".join(f"s.{c.strip()} = p.{c.strip()}" for c in part.split(","))} AND s.feature = p.feature),
walk AS (SELECT {on}, CAST(1 AS BIGINT) AS r, [feature] AS inside FROM ordered WHERE r = 1
         UNION ALL
         SELECT {", ".join("w." + c.strip() for c in on.split(","))}, o.r, CASE WHEN len(list_intersect(inside, o.others)) = 0 THEN list_append(inside, o.feature) ELSE inside END
         FROM walk w JOIN ordered o ON {same} AND o.r = w.r + 1),
inside AS (SELECT {on}, arg_max(inside, r) AS inside FROM walk GROUP BY {on}),
judged AS (SELECT w.*, list_contains(o.inside, w.feature) AS kept FROM ordered w JOIN inside o ON {same}),
cut AS (SELECT {part}, quantile_cont(variance, {C.VAR_QUANTILE}) AS limit_ FROM judged WHERE kept GROUP BY {part})"""


WALK_OUT = f"""feature, {rsql('ic', 8)} AS ic, {rsql('t', 6)} AS t_stat, {rsql('variance', 1)} AS variance,
  CAST(kept AS INTEGER) AS kept, CAST(kept AND variance > limit_ AS INTEGER) AS selected FROM judged"""
recursive = lambda text: text.replace("WITH", "WITH RECURSIVE", 1)


@query("select_ic_engineered", recursive(panel_sql(
    f"SELECT {WALK_OUT} JOIN cut ON cut.part = judged.part", PANEL_FEATURES, "whole AS (SELECT *, 0 AS part FROM feat)", walk_sql("whole", "part"))))
def select_ic_engineered(spark, sf_dir):
    table = L.select_ic(engineered(spark, sf_dir), COLS, TARGET)
    return out(table, ["feature", "kept", "selected"], {"ic": 8, "t_stat": 6, "variance": 1})


@query("select_per_fold", recursive(panel_sql(
    f"SELECT judged.series_id, judged.fold, {WALK_OUT} JOIN cut ON cut.series_id = judged.series_id AND cut.fold = judged.fold",
    PANEL_FEATURES, EXPANDING, FOLD_ROWS, walk_sql("fold_rows", "series_id, fold"))))
def select_per_fold(spark, sf_dir):
    table = L.select_per_fold(engineered(spark, sf_dir), COLS, TARGET, 252, 5)
    return out(table.withColumn("fold", F.col("fold").cast("long")), ["series_id", "fold", "feature", "kept", "selected"], {"ic": 8, "t_stat": 6, "variance": 1})
