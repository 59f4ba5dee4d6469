"""Result tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.catalog.base import *  # noqa: F403
from serieswise.catalog.frame_queries import RAW, SPLIT, rates_sql
from serieswise.catalog.profile_queries import outlier_sql
from serieswise.catalog.window_queries import LIMITS, MARKED
from serieswise.operators import frames as T
from serieswise.operators import profile as P
from serieswise.operators import scoring as S
from serieswise.operators.clean import clean_spikes
from serieswise.session import shared_dir
from serieswise.sources import panel_io as IO


HIGH_NA = rates_sql("split", RAW, "WHERE split = 'train'")


@query("sink_tables", panel_sql(f"""
SELECT 'cleaned' AS sheet, split, count(*) AS n_rows, CAST(sum(D1) AS BIGINT) AS d1 FROM split GROUP BY split
UNION ALL SELECT 'dirty_summary', 'all', count(DISTINCT series_id), CAST(count(*) FILTER (WHERE V1_spike) AS BIGINT) FROM marked
UNION ALL SELECT 'high_na', 'all', count(*), NULL FROM ({HIGH_NA}) WHERE na_rate >= 0.40""", SPLIT, LIMITS, MARKED))
def sink_tables(spark, sf_dir):
    """Cleaned panel partitioned by split, spike summary and column sheet, written twice and re-read; d1 of the summary counts spikes."""
    panel = T.split_three_way(fx_panel(spark, sf_dir)).persist()
    cleaned, summary = clean_spikes(panel, ["V1"])
    folder = shared_dir(spark, "sheets")
    tables = {"cleaned": cleaned, "dirty_summary": summary, "high_na": T.high_na_columns(panel.filter("split = 'train'"))}
    for _ in range(2):
        IO.write_tables(tables, folder, {"cleaned": "split"})
    panel.unpersist()
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    sheet = lambda name, d1: read(name).agg(F.count(F.lit(1)).alias("n_rows"), d1.cast("long").alias("d1")).select(
        F.lit(name).alias("sheet"), F.lit("all").alias("split"), "n_rows", "d1"
    )
    back = read("cleaned").groupBy(F.lit("cleaned").alias("sheet"), "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("D1").cast("long").alias("d1")
    )
    return back.unionByName(sheet("dirty_summary", F.sum("dirty_count"))).unionByName(sheet("high_na", F.max(F.lit(None))))


@query("sink_eda", panel_sql(f"""
SELECT m.feature, na_count, outlier_count FROM ({rates_sql('fx_panel')}) m JOIN ({outlier_sql(False)}) o ON m.feature = o.feature"""))
def sink_eda(spark, sf_dir):
    panel, folder = fx_panel(spark, sf_dir), shared_dir(spark, "eda")
    IO.write_tables({"missing": T.null_rates(panel, RAW), "outliers": P.outlier_rates(panel, RAW)}, folder)
    missing, outliers = (spark.read.parquet(f"{folder}/{t}") for t in ("missing", "outliers"))
    return missing.join(outliers, "feature").select("feature", "na_count", "outlier_count")


@query("sink_csv", panel_sql("SELECT series_id, split, count(*) AS n_rows FROM split GROUP BY series_id, split", SPLIT))
def sink_csv(spark, sf_dir):
    table = T.split_three_way(fx_panel(spark, sf_dir)).groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    path = shared_dir(spark, "folds") + ".csv"
    IO.write_csv(table, path)
    return spark.read.schema("series_id long, split string, n_rows long").option("header", True).csv(path)


REPORT = panel_sql(f"""
SELECT series_id, count(*) AS n, {rsql('avg(forward_returns)')} AS mean_return FROM fx_panel GROUP BY series_id""")


def report(spark, sf_dir):
    table = fx_panel(spark, sf_dir).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("forward_returns").alias("mean_return")
    )
    return table.withColumn("undefined", F.lit(float("nan")))


@query("sink_report_json", REPORT.replace("AS mean_return", "AS mean_return, CAST(NULL AS DOUBLE) AS undefined"))
def sink_report_json(spark, sf_dir):
    """Numbers without a finite value come back as null."""
    path = shared_dir(spark, "report")
    IO.write_report(report(spark, sf_dir), path)
    back = IO.read_report(spark, path, "series_id long, n long, mean_return double, undefined double")
    return out(back, ["series_id", "n", "undefined"], ["mean_return"])


@query("source_tuned", REPORT)
def source_tuned(spark, sf_dir):
    path = shared_dir(spark, "tuned")
    IO.write_report(report(spark, sf_dir).drop("undefined"), path)
    return out(IO.read_report(spark, path, "series_id long, n long, mean_return double"), ["series_id", "n"], ["mean_return"])


@query("run_log", positioned_sql(f"""
SELECT 'lagged' AS run, 'metric' AS kind, key, {rsql('value')} AS value FROM (
  SELECT unnest(['n_rows', 'mean_position', 'mean_return']) AS key,
         unnest([CAST(count(*) AS DOUBLE), avg(position), avg(strategy_returns)]) AS value FROM returned)
UNION ALL SELECT 'lagged', 'param', 'k', 1.0"""))
def run_log(spark, sf_dir):
    """Parameters and metrics of one run in a run table; the metrics are logged twice, as by a retry."""
    df, path = returned(spark, sf_dir), shared_dir(spark, "runs")
    metrics = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("position").alias("mean_position"), F.avg("strategy_returns").alias("mean_return")
    )
    for _ in range(2):
        IO.append_run(metrics, "lagged", "metric", path)
    IO.append_run(df.agg(F.max(F.lit(C.K_DEFAULT)).alias("k")), "lagged", "param", path)
    return out(IO.read_runs(spark, path), ["run", "kind", "key"], ["value"])
