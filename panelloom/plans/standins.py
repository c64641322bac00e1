"""Panel-shaped tables derived from the driver's order, part and event tables.

actor = supplier, period = quarter of shipping, value = discounted share of sales (rounded, so that
sums taken in any order agree). Sectors are regions, layers come from the nation number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions import semantics as S
from panelloom.operators import autoregression as ar
from panelloom.operators import portfolio, windows
from panelloom.session import kept

TEST_YEARS = [1998, 1999, 2000, 2001]
TRAIN_YEARS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor, period, value). Computed once a run: windows, predictions and signals read it several times."""
    return kept(spark, sf_dir, "panel", lambda: _panel(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    share = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")
    return li.groupBy(F.col("l_suppkey").alias("actor"), S.quarter(F.col("l_shipdate")).alias("period")).agg(F.round(share, 9).alias("value"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with every seventh actor-quarter's value missing, for null behaviour."""
    hole = (F.col("actor") + F.year("period") * 4 + F.quarter("period")) % 7 == 0
    return panel(spark, sf_dir).withColumn("value", F.when(~hole, F.col("value")))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("actor"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("geography"), (F.col("s_nationkey") % 3).cast("int").alias("layer"), F.col("s_acctbal").alias("size"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions are blocks of their own; the others make the remainder."""
    return registry(spark, sf_dir).where(F.col("sector").isin("AMERICA", "ASIA", "EUROPE")).select("actor", F.col("sector").alias("block"))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows(panel(spark, sf_dir), TEST_YEARS, TRAIN_YEARS)


def dealt_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = registry(spark, sf_dir).select("actor", "layer", "sector")
    return windows.with_blocks(dealt(spark, sf_dir), blocks(spark, sf_dir)).join(reg, "actor")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quarter, actor_id, sector, actual, pred_g0, pred_g1, pred_m2, pred_ar1): pooled, layer, block and own slopes.

    Signals, scores and portfolios all start here, so it is computed once a run.
    """
    return kept(spark, sf_dir, "predictions", lambda: _predictions(spark, sf_dir))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"pred_g0": [], "pred_g1": ["layer"], "pred_m2": ["block"], "pred_ar1": ["actor"]}
    out = ar.forecasts(dealt_in_blocks(spark, sf_dir), levels)
    return out.select(
        F.col("test_year").alias("year"), F.col("period").alias("quarter"), F.col("actor").alias("actor_id"), "sector",
        F.col("value").alias("actual"), *(F.round(n, 9).alias(n) for n in levels),
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quarter, actor_id, return_q): change of the quarter's mean unit price. Computed once a run."""
    return kept(spark, sf_dir, "returns", lambda: _returns(spark, sf_dir))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("actor_id"), S.quarter(F.col("l_shipdate")).alias("quarter")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price"))
    before = F.lag("price").over(Window.partitionBy("actor_id").orderBy("quarter"))
    return li.withColumn("return_q", F.round(F.col("price") / before - 1, 9)).where("return_q is not null").select("quarter", "actor_id", "return_q")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a bitemporal store: published up to four days after the day they happened, some days before."""
    e = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    lag = (F.col("event_id") % 6 - 1).cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("actor_id"), F.col("event_type").alias("signal_id"), day.cast("timestamp_ntz").alias("event_date"),
        F.date_add(day, lag).cast("timestamp_ntz").alias("pub_date"), "value",
        F.when(F.col("event_type").isin("purchase", "refund"), "billing").otherwise("site").alias("source"), F.lit(None).cast("string").alias("vintage_id"),
    )


def sorted_signal(spark: SparkSession, sf_dir: str, name: str = "disagreement") -> DataFrame:
    from panelloom.operators.signals import SIGNALS

    signal = SIGNALS[name](predictions(spark, sf_dir), returns(spark, sf_dir))
    return portfolio.quintile_sort(signal.withColumn("score", F.round("score", 9)), returns(spark, sf_dir))


#: The same tables in the oracle's SQL, as common table expressions.
CTE = {
    "panel": "SELECT l_suppkey AS actor, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS value FROM lineitem GROUP BY 1, 2",
    "gappy": "SELECT actor, period, CASE WHEN (actor + year(period) * 4 + quarter(period)) % 7 <> 0 THEN value END AS value FROM panel",
    "registry": "SELECT s_suppkey AS actor, s_name AS name, r_name AS sector, n_name AS geography, CAST(s_nationkey % 3 AS INTEGER) AS layer, s_acctbal AS size FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "dealt0": "SELECT ty AS test_year, actor, period, value, year(period) < ty AS train FROM panel, (VALUES (1998), (1999), (2000), (2001)) AS t(ty) WHERE year(period) BETWEEN ty - 3 AND ty",
    "dealt1": "SELECT a.test_year, a.actor, p.period, d.value, year(p.period) < a.test_year AS train FROM (SELECT DISTINCT test_year, actor FROM dealt0 WHERE value IS NOT NULL) a JOIN (SELECT DISTINCT test_year, period FROM dealt0) p USING (test_year) LEFT JOIN dealt0 d USING (test_year, actor, period)",
    "good": "SELECT test_year FROM dealt1 GROUP BY 1 HAVING count(DISTINCT actor) >= 5 AND count(DISTINCT CASE WHEN train THEN period END) >= 4",
    "dealt": "SELECT test_year, actor, period, train, coalesce(value, avg(value) OVER (PARTITION BY test_year, actor), 0.5) AS value FROM dealt1 WHERE test_year IN (SELECT test_year FROM good)",
    "rows_": "SELECT d.*, CASE WHEN r.sector IN ('AMERICA', 'ASIA', 'EUROPE') THEN r.sector ELSE 'REMAINDER' END AS block, r.layer, r.sector FROM dealt d JOIN registry r USING (actor)",
    "dev0": "SELECT *, value - mean AS dev FROM (SELECT *, coalesce(avg(CASE WHEN train THEN value END) OVER (PARTITION BY test_year, actor), 0.5) AS mean FROM rows_)",
    "dev": "SELECT *, lag(dev) OVER (PARTITION BY test_year, actor ORDER BY period) AS prev FROM dev0",
    "rho0": "SELECT test_year, CASE WHEN sum(prev * prev) > 1e-12 THEN sum(dev * prev) / sum(prev * prev) ELSE 0 END AS rho, count(*) AS n FROM dev WHERE train AND prev IS NOT NULL GROUP BY 1",
    "rho1": "SELECT test_year, layer, CASE WHEN sum(prev * prev) > 1e-12 THEN sum(dev * prev) / sum(prev * prev) ELSE 0 END AS rho, count(*) AS n FROM dev WHERE train AND prev IS NOT NULL GROUP BY 1, 2",
    "rho2": "SELECT test_year, block, CASE WHEN sum(prev * prev) > 1e-12 THEN sum(dev * prev) / sum(prev * prev) ELSE 0 END AS rho, count(*) AS n FROM dev WHERE train AND prev IS NOT NULL GROUP BY 1, 2",
    "rho3": "SELECT test_year, actor, CASE WHEN sum(prev * prev) > 1e-12 THEN sum(dev * prev) / sum(prev * prev) ELSE 0 END AS rho, count(*) AS n FROM dev WHERE train AND prev IS NOT NULL GROUP BY 1, 2",
    "preds": "SELECT d.test_year AS year, d.period AS quarter, d.actor AS actor_id, d.sector, d.value AS actual, round(mean + a.rho * coalesce(prev, 0), 9) AS pred_g0, round(mean + b.rho * coalesce(prev, 0), 9) AS pred_g1, round(mean + c.rho * coalesce(prev, 0), 9) AS pred_m2, round(mean + e.rho * coalesce(prev, 0), 9) AS pred_ar1 FROM dev d JOIN rho0 a USING (test_year) JOIN rho1 b ON b.test_year = d.test_year AND b.layer = d.layer JOIN rho2 c ON c.test_year = d.test_year AND c.block = d.block JOIN rho3 e ON e.test_year = d.test_year AND e.actor = d.actor WHERE NOT train",
    "prices": "SELECT l_suppkey AS actor_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price FROM lineitem GROUP BY 1, 2",
    "rets": "SELECT quarter, actor_id, return_q FROM (SELECT quarter, actor_id, round(price / lag(price) OVER (PARTITION BY actor_id ORDER BY quarter) - 1, 9) AS return_q FROM prices) WHERE return_q IS NOT NULL",
    "obs": "SELECT CAST(user_id AS VARCHAR) AS actor_id, event_type AS signal_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_days(CAST(event_id % 6 - 1 AS INTEGER)) AS pub_date, value, CASE WHEN event_type IN ('purchase', 'refund') THEN 'billing' ELSE 'site' END AS source FROM events",
}
_NEEDS = {"gappy": ["panel"], "dealt0": ["panel"], "dealt1": ["dealt0"], "good": ["dealt1"], "dealt": ["good", "dealt1"], "rows_": ["dealt", "registry"], "dev0": ["rows_"], "dev": ["dev0"], "rho0": ["dev"], "rho1": ["dev"], "rho2": ["dev"], "rho3": ["dev"], "preds": ["dev", "rho0", "rho1", "rho2", "rho3"], "rets": ["prices"]}


def sql(select: str, *names: str, **more: str) -> str:
    """``select`` behind the expressions it names (and what they need), then those in ``more`` in their order."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
