"""Registry of queries and the SQL twins of the shared frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieswise.session import shipped
from serieswise.sources.fixtures import fx_market, fx_panel, fx_scored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(c: str | Column, digits: int = DIGITS) -> Column:
    """Rounded half up for comparison.

    The engines break exact ties differently, so the last step is plain floating
    arithmetic; the round before it settles the noise around a tie.
    """
    scale = F.lit(float(10**digits))
    return F.floor(F.round(c, digits + 3) * scale + F.lit(0.5)) / scale


def quick_rnd(name: str, digits: int = DIGITS) -> Column:
    """``rnd`` of a column, to the last bit: the decimal rounding is left out where no tie is near.

    It moves a value by half a thousandth of the last digit at most, so that beyond two the floor is the same.
    """
    up = F.col(name) * F.lit(float(10**digits)) + F.lit(0.5)
    rest = up - F.floor(up)
    far = (F.abs(up) < 1e11) & (rest > 0.002) & (rest < 0.998)
    return F.when(far, F.floor(up) / F.lit(float(10**digits))).otherwise(rnd(name, digits))


def out(df: DataFrame, plain: list[str], rounded: list[str] | dict[str, int]) -> DataFrame:
    digits = rounded if isinstance(rounded, dict) else {c: DIGITS for c in rounded}
    return df.select(*plain, *[rnd(c, d).alias(c) for c, d in digits.items()])


def rsql(expr: str, digits: int = DIGITS) -> str:
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(floor(round({expr}, {digits + 3}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def cols_sql(names: list[str], digits: int = DIGITS) -> str:
    return ", ".join(f"{rsql(n, digits)} AS {n}" for n in names)


def _panel_cte(name: str, series: str, group: str) -> str:
    return f"""
{name}_d AS (
  SELECT {series} AS series_id, l_shipdate AS dt, count(*) AS cnt,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS rev_c,
         sum(CAST(round(l_quantity) AS BIGINT)) AS qty,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_c,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_c
  FROM lineitem GROUP BY {group}),
{name}_f AS (
  SELECT series_id, dt, cnt,
         CAST(row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS BIGINT) AS date_id,
         CAST(disc_c AS DOUBLE) / cnt / CAST(200.0 AS DOUBLE) - CAST(0.025 AS DOUBLE) AS forward_returns,
         CAST(tax_c AS DOUBLE) / cnt / CAST(40000.0 AS DOUBLE) AS risk_free_rate,
         CAST(rev_c AS DOUBLE) / CAST(100.0 AS DOUBLE) AS M1, CAST(qty AS DOUBLE) AS M2,
         CAST(rev_c AS DOUBLE) / qty / CAST(100.0 AS DOUBLE) AS px,
         CAST(tax_c AS DOUBLE) / cnt AS tx, CAST(disc_c AS DOUBLE) / cnt AS ds
  FROM {name}_d),
{name} AS (
  SELECT series_id, date_id, dt, forward_returns, risk_free_rate,
         forward_returns - risk_free_rate AS market_forward_excess_returns,
         M1, M2,
         CASE WHEN date_id < 200 THEN NULL ELSE px END AS P1,
         CASE WHEN date_id % 7 = 3 THEN NULL ELSE tx END AS E1,
         CASE WHEN date_id % 397 = 200 THEN ds * 50 ELSE ds END AS V1,
         CASE WHEN date_id % 2 = 0 THEN NULL ELSE M1 / M2 END AS S1,
         CAST(cnt % 2 AS BIGINT) AS D1
  FROM {name}_f)"""


PANEL = _panel_cte("fx_panel", "l_suppkey", "l_suppkey, l_shipdate")
MARKET = _panel_cte("fx_market", "CAST(0 AS BIGINT)", "l_shipdate")
SCORED = """
scored AS (
  SELECT *, tanh(100 * prev) AS prediction, 1 / (1 + exp(-200 * prev)) AS probability
  FROM (SELECT *, lag(forward_returns) OVER (PARTITION BY series_id ORDER BY date_id) AS prev
        FROM fx_panel)
  WHERE date_id >= 1)"""
POSITIONED = """
pos_a AS (
  SELECT *, CASE WHEN count(prediction) OVER w >= 20 THEN stddev_samp(prediction) OVER w END AS s63,
         stddev_samp(prediction) OVER e AS se
  FROM scored
  WINDOW w AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
         e AS (PARTITION BY series_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pos_b AS (
  SELECT *, CASE WHEN abs(coalesce(s63, se)) >= 1e-12 THEN coalesce(s63, se) END AS sd FROM pos_a),
pos_c AS (
  SELECT *, coalesce(
    last_value(sd IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(sd IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date_id
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    1.0) AS sd3
  FROM pos_b),
positioned AS (
  SELECT *, least(greatest(1 + prediction / sd3, 0), 2) AS position FROM pos_c),
returned AS (
  SELECT *, risk_free_rate * (1 - position) + position * forward_returns AS strategy_returns,
         risk_free_rate * (1 - position) + position * forward_returns - risk_free_rate AS excess,
         forward_returns - risk_free_rate AS market_excess
  FROM positioned)"""


def sql(body: str, *ctes: str) -> str:
    return f"WITH {','.join(ctes)}\n{body}" if ctes else body


def panel_sql(body: str, *more: str) -> str:
    return sql(body, PANEL, *more)


def market_sql(body: str, *more: str) -> str:
    return sql(body, MARKET, *more)


def scored_sql(body: str, *more: str) -> str:
    return sql(body, PANEL, SCORED, *more)


def positioned_sql(body: str, *more: str) -> str:
    return sql(body, PANEL, SCORED, POSITIONED, *more)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_scored(fx_panel(spark, sf_dir))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from serieswise.operators.scoring import map_positions

    return map_positions(scored(spark, sf_dir))


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from serieswise.operators.scoring import with_returns

    return with_returns(positioned(spark, sf_dir))


__all__ = [
    "QUERIES", "ORACLES", "query", "rnd", "quick_rnd", "out", "rsql", "cols_sql", "sql", "panel_sql", "market_sql", "POSITIONED",
    "scored_sql", "positioned_sql", "scored", "positioned", "returned", "fx_panel", "fx_market", "fx_scored",
]
