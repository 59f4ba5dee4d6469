"""Column profiles, correlations and rankings over the stacked panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.catalog.frame_queries import HOLDOUT, RAW, rates_sql
from serieswise.operators import correlation as R
from serieswise.operators import frames as T
from serieswise.operators import profile as P
from serieswise.operators.ordered import exact_quantiles

TARGET = C.RETURN_TARGET
NUM = ["M1", "M2", "P1", "E1", "V1", "S1"]


def each(cols, make) -> str:
    return " UNION ALL ".join(make(c) for c in cols)


@query("table_shape", panel_sql(f"SELECT count(*) AS n_rows, CAST({len(RAW)} AS BIGINT) AS n_cols FROM fx_panel"))
def table_shape(spark, sf_dir):
    return P.table_shape(fx_panel(spark, sf_dir), RAW)


@query("na_rate", panel_sql(rates_sql("fx_panel")))
def na_rate(spark, sf_dir):
    return out(T.null_rates(fx_panel(spark, sf_dir), RAW), ["feature", "na_count"], ["na_rate"])


def outlier_sql(guarded: bool, cols=RAW) -> str:
    def one(c: str) -> str:
        hit = f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))" + (" AND q1 <> q3" if guarded else "")
        rate = rsql(f"CAST(count(*) FILTER (WHERE {hit}) AS DOUBLE) / count(*)")
        return (
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {hit}) AS outlier_count, {rate} AS outlier_rate FROM fx_panel, "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM fx_panel) q"
        )

    return each(cols, one)


@query("outlier_rate_iqr", panel_sql(outlier_sql(False)))
def outlier_rate_iqr(spark, sf_dir):
    return out(P.outlier_rates(fx_panel(spark, sf_dir), RAW), ["feature", "outlier_count"], ["outlier_rate"])


@query("outlier_rate_iqr_guarded", panel_sql(outlier_sql(True)))
def outlier_rate_iqr_guarded(spark, sf_dir):
    table = P.outlier_rates(fx_panel(spark, sf_dir), RAW, guarded=True)
    return out(table, ["feature", "outlier_count"], ["outlier_rate"])


@query("outlier_count", panel_sql(
    f"SELECT feature, outlier_count FROM ({outlier_sql(False, ['risk_free_rate', C.EXCESS_TARGET])})"))
def outlier_count(spark, sf_dir):
    cols = ["risk_free_rate", C.EXCESS_TARGET]
    return P.outlier_rates(fx_panel(spark, sf_dir), cols).select("feature", "outlier_count")


@query("basic_eda", panel_sql(f"""
SELECT 'missing' AS part, feature, na_count AS n FROM ({rates_sql('fx_panel', [*RAW, *C.FINANCE_COLS[:3]])})
UNION ALL SELECT 'outliers', feature, outlier_count FROM ({outlier_sql(False, [*RAW, *C.FINANCE_COLS[:3]])})
UNION ALL SELECT 'histograms', feature, n FROM (
  SELECT o.feature, u.n FROM ({outlier_sql(False, [*RAW, *C.FINANCE_COLS[:3]])}) o
  JOIN ({each([*RAW, *C.FINANCE_COLS[:3]], lambda c: f"SELECT '{c}' AS feature, count({c}) AS n FROM fx_panel")}) u ON o.feature = u.feature
  ORDER BY outlier_rate DESC, o.feature LIMIT 30)"""))
def basic_eda(spark, sf_dir):
    parts = P.basic_eda(fx_panel(spark, sf_dir))
    shown = parts["histograms"].groupBy("feature").agg(F.sum("count").alias("n"))
    rows = parts["missing"].select(F.lit("missing").alias("part"), "feature", F.col("na_count").alias("n"))
    rows = rows.unionByName(parts["outliers"].select(F.lit("outliers").alias("part"), "feature", F.col("outlier_count").alias("n")))
    return rows.unionByName(shown.select(F.lit("histograms").alias("part"), "feature", "n"))


DESC = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
        "q25": "quantile_cont({c}, 0.25)", "q50": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)"}


@query("describe", panel_sql(each(NUM, lambda c: f"SELECT '{c}' AS feature, count({c}) AS count, "
    + ", ".join(f"{rsql(e.format(c=c), 5)} AS {n}" for n, e in DESC.items()) + " FROM fx_panel")))
def describe(spark, sf_dir):
    return out(P.describe(fx_panel(spark, sf_dir), NUM), ["feature", "count"], {n: 5 for n in DESC})


@query("rows_per_day", panel_sql("SELECT date_id, count(*) AS n_rows FROM fx_panel GROUP BY date_id"))
def rows_per_day(spark, sf_dir):
    return P.rows_per_day(fx_panel(spark, sf_dir))


FIN = ["forward_returns", "risk_free_rate", C.EXCESS_TARGET, "P1"]


@query("moments", panel_sql(each(FIN, lambda c: f"""SELECT '{c}' AS feature, {rsql(f'avg({c})', 6)} AS mean,
  {rsql(f'median({c})', 6)} AS median, {rsql(f'skewness({c})', 7)} AS skew, {rsql(f'kurtosis({c})', 6)} AS kurtosis FROM fx_panel""")))
def moments(spark, sf_dir):
    return out(P.moments(fx_panel(spark, sf_dir), FIN), ["feature"], {"mean": 6, "median": 6, "skew": 7, "kurtosis": 6})


def hist_sql(c: str, bins: str) -> str:
    stats = f"SELECT lo, k, (hi - lo) / k AS w FROM (SELECT min({c}) AS lo, max({c}) AS hi, {bins} AS k FROM fx_panel)"
    return f"""SELECT b.bin, count(h.bin) AS count, {rsql('max(b.lo) + b.bin * max(b.w)', 7)} AS left_edge
FROM (SELECT CAST(unnest(range(k)) AS BIGINT) AS bin, lo, w FROM ({stats})) b
LEFT JOIN (SELECT CAST(least(floor(({c} - lo) / w), k - 1) AS BIGINT) AS bin FROM fx_panel, ({stats}) WHERE {c} IS NOT NULL) h ON h.bin = b.bin
GROUP BY b.bin"""


@query("histogram", panel_sql(hist_sql("M1", "CAST(40 AS BIGINT)")))
def histogram(spark, sf_dir):
    return out(P.histogram(fx_panel(spark, sf_dir), "M1", 40), ["bin", "count"], {"left_edge": 7})


@query("histogram_auto", panel_sql(hist_sql("P1", "CAST(least(150, floor(2 * power(count(P1), 1.0::DOUBLE / 3))) AS BIGINT)")))
def histogram_auto(spark, sf_dir):
    return out(P.histogram(fx_panel(spark, sf_dir), "P1"), ["bin", "count"], {"left_edge": 7})


@query("density_curve", panel_sql(f"""
SELECT point, {rsql('max(x)')} AS x, {rsql('sum(exp(-power((x - v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi()))', 8)} AS density
FROM (SELECT g.point, v, n, lo + g.point * (hi - lo) / 199.0 AS x, sd * power(n, -0.2) AS h
      FROM (SELECT forward_returns AS v FROM fx_panel) d,
           (SELECT min(forward_returns) AS lo, max(forward_returns) AS hi, count(*) AS n, stddev_samp(forward_returns) AS sd FROM fx_panel) s,
           (SELECT unnest(range(200)) AS point) g) GROUP BY point"""))
def density_curve(spark, sf_dir):
    return out(P.density_curve(fx_panel(spark, sf_dir), "forward_returns"), ["point"], {"x": 9, "density": 8})


def pairs_sql(cols, expr) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {expr(a, b)} AS corr FROM fx_panel" for a, b in pairs)


GAP = lambda a, b: rsql(f"corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER))")
PEARSON = lambda a, b: f"corr({a}, {b})"


@query("nullity_corr", panel_sql(pairs_sql(["P1", "E1", "S1"], GAP)))
def nullity_corr(spark, sf_dir):
    return out(P.nullity_corr(fx_panel(spark, sf_dir), RAW), ["feature_1", "feature_2"], ["corr"])


@query("missing_over_time", panel_sql(each(["P1", "E1", "S1"], lambda c: f"""
SELECT CAST(floor(date_id * 10 / m) AS BIGINT) AS bucket, '{c}' AS feature,
       {rsql(f'CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*)')} AS null_rate
FROM fx_panel, (SELECT max(date_id) + 1 AS m FROM fx_panel) GROUP BY 1""")))
def missing_over_time(spark, sf_dir):
    return out(P.missing_over_time(fx_panel(spark, sf_dir), ["P1", "E1", "S1"], 10), ["bucket", "feature"], ["null_rate"])


@query("label_distribution", panel_sql(f"""
SELECT label, count(*) AS n, {rsql('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS share
FROM (SELECT CASE WHEN forward_returns > 0 THEN 1 ELSE 0 END AS label FROM fx_panel) GROUP BY label"""))
def label_distribution(spark, sf_dir):
    from serieswise.functions.scalar import direction

    return out(P.label_distribution(fx_panel(spark, sf_dir), direction(F.col(TARGET))), ["label", "n"], ["share"])


@query("null_cell_count", panel_sql("SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in RAW)
    + " AS null_cells, CAST(" + " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS BIGINT)" for c in RAW)
    + " AS BIGINT) AS columns_with_nulls FROM held WHERE split = 'train'", HOLDOUT))
def null_cell_count(spark, sf_dir):
    train = T.split_holdout(fx_panel(spark, sf_dir)).filter("split = 'train'")
    return P.null_cell_count(train, RAW)


@query("variance_profile", panel_sql(each(NUM, lambda c: f"SELECT '{c}' AS feature, {rsql(f'var_pop({c})', 3)} AS variance FROM fx_panel")))
def variance_profile(spark, sf_dir):
    return out(P.variance_profile(fx_panel(spark, sf_dir), NUM), ["feature"], {"variance": 3})


CORR = lambda c: f"SELECT '{c}' AS feature, corr({c}, forward_returns) AS corr FROM fx_panel"


@query("corr_target", panel_sql(f"SELECT feature, {rsql('corr')} AS corr, {rsql('abs(corr)')} AS abs_corr FROM ({each(RAW, CORR)})"))
def corr_target(spark, sf_dir):
    return out(R.corr_target(fx_panel(spark, sf_dir), RAW, TARGET), ["feature"], ["corr", "abs_corr"])


def ranked_sql(c: str, y: str) -> str:
    rank = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"
    return f"""SELECT '{c}' AS feature, count(*) AS n, corr(rx, ry) AS ic
FROM (SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM (SELECT {c} AS x, {y} AS y FROM fx_panel WHERE {c} IS NOT NULL AND {y} IS NOT NULL))"""


@query("corr_target_spearman", panel_sql(
    f"SELECT feature, {rsql('ic')} AS corr, {rsql('abs(ic)')} AS abs_corr FROM ({each(NUM, lambda c: ranked_sql(c, TARGET))})"))
def corr_target_spearman(spark, sf_dir):
    return out(R.corr_target(fx_panel(spark, sf_dir), NUM, TARGET, "spearman"), ["feature"], ["corr", "abs_corr"])


def kendall_sql(a: str, b: str) -> str:
    """Tau-b of two columns by all pairs of rows."""
    return f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, sum(sign(p.x - q.x) * sign(p.y - q.y)) / nullif(sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 0) AS corr
FROM (SELECT {a} AS x, {b} AS y FROM fx_market WHERE {a} IS NOT NULL AND {b} IS NOT NULL) p,
     (SELECT {a} AS x, {b} AS y FROM fx_market WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"""


@query("corr_target_kendall", market_sql(
    f"SELECT feature_1 AS feature, {rsql('corr')} AS corr, {rsql('abs(corr)')} AS abs_corr FROM ({each(NUM, lambda c: kendall_sql(c, TARGET))}) WHERE corr IS NOT NULL"))
def corr_target_kendall(spark, sf_dir):
    return out(R.corr_target(fx_market(spark, sf_dir), NUM, TARGET, "kendall"), ["feature"], ["corr", "abs_corr"])


@query("corr_pairs_kendall", market_sql(f"""
SELECT feature_1, feature_2, {rsql('corr')} AS corr, {rsql('abs(corr)')} AS abs_corr
FROM ({" UNION ALL ".join(kendall_sql(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:])}) WHERE corr IS NOT NULL"""))
def corr_pairs_kendall(spark, sf_dir):
    pairs = R.pair_correlations(fx_market(spark, sf_dir), NUM, method="kendall")
    return out(pairs, ["feature_1", "feature_2"], ["corr", "abs_corr"])


@query("spearman_ic", panel_sql(f"""
SELECT feature, n, {rsql('ic')} AS ic, {rsql('ic * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - ic * ic, 1e-12))', 7)} AS t_stat
FROM ({each(NUM, lambda c: ranked_sql(c, C.EXCESS_TARGET))})"""))
def spearman_ic(spark, sf_dir):
    return out(R.spearman_ic(fx_panel(spark, sf_dir), NUM, C.EXCESS_TARGET), ["feature", "n"], {"ic": 9, "t_stat": 7})


@query("pair_self_join", panel_sql(f"SELECT feature_1, feature_2, {rsql('corr')} AS corr FROM ({pairs_sql(RAW, PEARSON)})"))
def pair_self_join(spark, sf_dir):
    return out(R.pair_correlations(fx_panel(spark, sf_dir), RAW), ["feature_1", "feature_2"], ["corr"])


@query("corr_pairs_topn", panel_sql(f"""
SELECT feature_1, feature_2, {rsql('corr')} AS corr, {rsql('abs(corr)')} AS abs_corr FROM ({pairs_sql(RAW, PEARSON)})
ORDER BY abs(corr) DESC, feature_1, feature_2 LIMIT 8"""))
def corr_pairs_topn(spark, sf_dir):
    return out(R.top_pairs(fx_panel(spark, sf_dir), RAW, 8), ["feature_1", "feature_2"], ["corr", "abs_corr"])


TOP3 = f"(SELECT feature FROM ({each(NUM, CORR)}) ORDER BY abs(corr) DESC, feature LIMIT 4)"


@query("corr_matrix", panel_sql(f"""
SELECT feature_1, feature_2, {rsql('corr')} AS corr FROM (
  SELECT feature_1, feature_2, corr FROM ({pairs_sql(NUM, PEARSON)}) UNION ALL SELECT feature_2, feature_1, corr FROM ({pairs_sql(NUM, PEARSON)})
  UNION ALL SELECT feature, feature, 1.0 FROM ({each(NUM, CORR)}))
WHERE feature_1 IN {TOP3} AND feature_2 IN {TOP3}"""))
def corr_matrix(spark, sf_dir):
    """Matrix of the columns most correlated with the target, given in long form."""
    panel = fx_panel(spark, sf_dir)
    best = R.corr_target(panel, NUM, TARGET).orderBy(F.desc("abs_corr"), "feature").limit(4)
    cols = sorted(T.names(best))
    cells = R.corr_matrix(panel, cols).unpivot("feature", cols, "feature_2", "corr")
    return out(cells.withColumnRenamed("feature", "feature_1"), ["feature_1", "feature_2"], ["corr"])


CLUSTERS = P.cluster_groups(NUM)
Z = ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS z_{c}" for c in NUM)
MEANS = ", ".join(
    f"({' + '.join(f'coalesce(z_{c}, 0)' for c in group)}) / nullif({' + '.join(f'CAST(z_{c} IS NOT NULL AS INTEGER)' for c in group)}, 0) AS mean_{g}"
    for g, group in CLUSTERS.items()
)
CLUSTER = f"""
zed AS (SELECT *, {Z} FROM fx_panel),
clustered AS (SELECT *, {MEANS} FROM zed)"""


@query("cluster_means", panel_sql(f"SELECT series_id, date_id, {', '.join(f'{rsql(f'mean_{g}', 8)} AS mean_{g}' for g in CLUSTERS)} FROM clustered", CLUSTER))
def cluster_means(spark, sf_dir):
    return out(P.cluster_means(fx_panel(spark, sf_dir), NUM), ["series_id", "date_id"], {f"mean_{g}": 8 for g in CLUSTERS})


@query("cluster_target_join", panel_sql(f"SELECT series_id, date_id, forward_returns, {', '.join(f'{rsql(f'mean_{g}', 8)} AS mean_{g}' for g in CLUSTERS)} FROM clustered", CLUSTER))
def cluster_target_join(spark, sf_dir):
    """The means stay on their rows, so the target is beside them without a join."""
    table = P.cluster_means(fx_panel(spark, sf_dir), NUM)
    return out(table, ["series_id", "date_id", TARGET], {f"mean_{g}": 8 for g in CLUSTERS})


@query("cluster_target_corr", panel_sql(each(CLUSTERS, lambda g: f"""
SELECT '{g}' AS cluster, {rsql(f'corr(mean_{g}, forward_returns)')} AS corr, {rsql(f'abs(corr(mean_{g}, forward_returns))')} AS abs_corr FROM clustered"""), CLUSTER))
def cluster_target_corr(spark, sf_dir):
    means = P.cluster_means(fx_panel(spark, sf_dir), NUM)
    return out(R.cluster_target_corr(means, list(CLUSTERS), TARGET), ["cluster"], ["corr", "abs_corr"])


@query("abs_percentile", panel_sql(f"""
SELECT 'excess' AS feature, p AS prob, {rsql('v')} AS quantile FROM (
  SELECT unnest([0.95::DOUBLE, 0.99::DOUBLE]) AS p, unnest([quantile_cont(abs({C.EXCESS_TARGET}), 0.95::DOUBLE), quantile_cont(abs({C.EXCESS_TARGET}), 0.99::DOUBLE)]) AS v
  FROM fx_panel)"""))
def abs_percentile(spark, sf_dir):
    sizes = fx_panel(spark, sf_dir).select(F.abs(C.EXCESS_TARGET).alias("excess"))
    return out(exact_quantiles(sizes, ["excess"], [0.95, 0.99]), ["feature", "prob"], ["quantile"])


@query("topn_profiles", panel_sql(f"""
SELECT 'missing' AS list, feature, na_rate AS value FROM (SELECT * FROM ({rates_sql('fx_panel')}) ORDER BY na_rate DESC, feature LIMIT 3)
UNION ALL SELECT 'outlier', feature, outlier_rate FROM (SELECT * FROM ({outlier_sql(False)}) ORDER BY outlier_rate DESC, feature LIMIT 3)
UNION ALL SELECT 'target', feature, {rsql('abs(corr)')} FROM (SELECT * FROM ({each(RAW, CORR)}) ORDER BY abs(corr) DESC, feature LIMIT 3)"""))
def topn_profiles(spark, sf_dir):
    panel = fx_panel(spark, sf_dir)
    top = lambda table, name, value: table.orderBy(F.desc(value), "feature").limit(3).select(
        F.lit(name).alias("list"), "feature", rnd(value).alias("value")
    )
    rows = top(T.null_rates(panel, RAW), "missing", "na_rate")
    rows = rows.unionByName(top(P.outlier_rates(panel, RAW), "outlier", "outlier_rate"))
    return rows.unionByName(top(R.corr_target(panel, RAW, TARGET), "target", "abs_corr"))
