"""Panels derived from the order tables, so that their size follows the data.

Sums are kept in integer cents; every ratio is one division of exact integers.
Each frame has an SQL twin in ``catalog.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieswise.config import BLOCK, DAY, POS, SERIES
from serieswise.operators.blocks import is_blocked, number_rows, renumber, rolling

DAYS_PER_BUCKET = 16384


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def calendar_days(df: DataFrame, time: str) -> int:
    """Days spanned by a time column: no daily series can hold more rows."""
    first, last = df.agg(F.min(time), F.max(time)).first()
    return 0 if first is None else (last.date() - first.date()).days + 1


def _panel(spark: SparkSession, sf_dir: str, series: Column) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    daily = (
        items.groupBy(series.alias(SERIES), F.col("l_shipdate").alias("dt"))
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.sum(_cents("l_extendedprice")).alias("rev_c"),
            F.sum(F.round("l_quantity").cast("long")).alias("qty"),
            F.sum(_cents("l_discount")).alias("disc_c"),
            F.sum(_cents("l_tax")).alias("tax_c"),
        )
    )
    day = F.floor(F.unix_date(F.to_date("dt")) / F.lit(DAYS_PER_BUCKET))
    rows = number_rows(daily, "dt", day, longest=calendar_days(items, "l_shipdate"), unique=True)
    pos, cnt = F.col(POS), F.col("cnt")
    fwd = F.col("disc_c").cast("double") / cnt / F.lit(200.0) - F.lit(0.025)
    rate = F.col("tax_c").cast("double") / cnt / F.lit(40000.0)
    m1, m2 = F.col("rev_c").cast("double") / F.lit(100.0), F.col("qty").cast("double")
    price = F.col("rev_c").cast("double") / F.col("qty") / F.lit(100.0)
    tax, disc = F.col("tax_c").cast("double") / cnt, F.col("disc_c").cast("double") / cnt
    return rows.select(
        *([BLOCK] if is_blocked(rows) else []),
        SERIES,
        pos.alias(DAY),
        pos.alias(POS),
        "dt",
        fwd.alias("forward_returns"),
        rate.alias("risk_free_rate"),
        (fwd - rate).alias("market_forward_excess_returns"),
        m1.alias("M1"),
        m2.alias("M2"),
        F.when(pos >= 200, price).alias("P1"),  # burn-in
        F.when(pos % 7 != 3, tax).alias("E1"),  # scattered nulls
        F.when(pos % 397 == 200, disc * 50).otherwise(disc).alias("V1"),  # isolated spikes
        F.when(pos % 2 != 0, m1 / m2).alias("S1"),  # half null
        (cnt % 2).cast("long").alias("D1"),  # dummy
    )


def fx_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series over all suppliers."""
    return _panel(spark, sf_dir, F.lit(0).cast("long"))


def fx_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier."""
    return _panel(spark, sf_dir, F.col("l_suppkey"))


def fx_scored(panel: DataFrame) -> DataFrame:
    """Panel with a lagged prediction and probability, from the second day on."""
    lagged = rolling(panel, lambda f: {"_prev": F.lag("forward_returns").over(f.ordered)}, back=1)
    scored = (
        lagged.filter(F.col(DAY) >= 1)
        .withColumn("prediction", F.tanh(F.lit(100.0) * F.col("_prev")))
        .withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-200.0) * F.col("_prev"))))
        .drop("_prev")
    )
    return renumber(scored)


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series: one per user, ordered by event time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias(SERIES), "ts", F.col("value")
    )
    return number_rows(events, "ts").withColumn(DAY, F.col(POS))
