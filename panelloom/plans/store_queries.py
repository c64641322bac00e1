"""Point-in-time store, audit, universe and flow queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import audit, flows, pit
from panelloom.operators import universe as U
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.plans.standins import sql
from panelloom.session import shared_dir

BOOK = Book()
page = BOOK.page

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, signal_id, event_date, source ORDER BY pub_date DESC NULLS LAST, value DESC NULLS LAST) AS k FROM {0}) WHERE k = 1"
_SHOWN = "actor_id, signal_id, CAST(event_date AS DATE) AS event_date, CAST(pub_date AS DATE) AS pub_date, round(value, 6) AS value, source"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("actor_id", "signal_id", F.col("event_date").cast("date").alias("event_date"), F.col("pub_date").cast("date").alias("pub_date"), F.round("value", 6).alias("value"), "source")


@page(sql(f"SELECT {_SHOWN} FROM ({_LATEST.format('obs')})", "obs"), dates="event_date pub_date")
def pit_dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return _shown(pit.latest(st.observations(spark, d)))


_AS_OF = "SELECT * FROM obs WHERE pub_date <= TIMESTAMP '2024-01-16' AND source IN ('billing', 'site') AND event_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-14'"


@page(sql(f"SELECT {_SHOWN} FROM ({_LATEST.format('q')})", "obs", q=_AS_OF), dates="event_date pub_date")
def pit_asof_query(spark: SparkSession, d: str) -> DataFrame:
    return _shown(pit.query(st.observations(spark, d), "2024-01-16", sources=["billing", "site"], date_range=("2024-01-03", "2024-01-14")))


@page(sql(f"SELECT {_SHOWN} FROM ({_LATEST.format('obs')}) WHERE pub_date <= TIMESTAMP '2024-01-16' AND signal_id = 'click'", "obs"), dates="event_date pub_date")
def pit_legacy_query(spark: SparkSession, d: str) -> DataFrame:
    return _shown(pit.query(st.observations(spark, d), "2024-01-16", signal_ids=["click"], legacy=True))


@page(sql("SELECT a.actor_id, CAST(e.t AS DATE) AS period_end, round((SELECT arg_max(value, (pub_date, event_date, value)) FROM obs o WHERE o.actor_id = a.actor_id AND o.pub_date <= e.t), 6) AS value FROM (SELECT DISTINCT actor_id FROM obs) a CROSS JOIN (SELECT unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-26']) AS t) e", "obs"), dates="period_end")
def pit_asof_panel(spark: SparkSession, d: str) -> DataFrame:
    ends = spark.range(4).select(F.date_add(F.lit("2024-01-05").cast("date"), (F.col("id") * 7).cast("int")).alias("t"))
    return rounded(pit.as_of_panel(st.observations(spark, d), ends), "value")


@page(sql("SELECT source, count(*) AS n FROM obs WHERE pub_date < event_date GROUP BY 1", "obs"))
def pit_leak_check(spark: SparkSession, d: str) -> DataFrame:
    return pit.leaks(st.observations(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@page(sql("SELECT DISTINCT 'actor_id' AS what, actor_id AS id FROM obs UNION ALL SELECT DISTINCT 'signal_id', signal_id FROM obs UNION ALL SELECT DISTINCT 'source', source FROM obs", "obs"))
def pit_catalog(spark: SparkSession, d: str) -> DataFrame:
    o = st.observations(spark, d)
    parts = [pit.catalogue(o, c).select(F.lit(c).alias("what"), F.col(c).alias("id")) for c in ("actor_id", "signal_id", "source")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@page(sql("SELECT actor_id, signal_id, CAST(event_date AS DATE) AS event_date, CAST(event_date AS DATE) + CASE WHEN source = 'site' THEN 7 ELSE 548 END AS pub_date FROM obs", "obs"), dates="event_date pub_date")
def publication_lag(spark: SparkSession, d: str) -> DataFrame:
    o = st.observations(spark, d).withColumn("pub_date", F.lit(None).cast("timestamp_ntz")).withColumn("family", F.when(F.col("source") == "site", "news_weekly").otherwise("io_tables"))
    return pit.with_publication_lag(o).select("actor_id", "signal_id", F.col("event_date").cast("date").alias("event_date"), F.col("pub_date").cast("date").alias("pub_date"))


@page(sql("SELECT signal_id, source, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM obs WHERE source = 'site' AND signal_id NOT IN (SELECT signal_id FROM obs WHERE value > 199) UNION ALL SELECT * FROM obs WHERE value > 199) GROUP BY 1, 2", "obs"))
def vintage_merge(spark: SparkSession, d: str) -> DataFrame:
    o = st.observations(spark, d)
    m = pit.merge_vintages(o.where("source = 'site'"), o.where("value > 199"))
    return rounded(m.groupBy("signal_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)


# --- the store's files: three frames, two of which overlap and one of which comes twice --------------------------------


#: Two frames of two thirds of the events each; where they meet the second counts, whose values are 1 greater.
_ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, signal_id, event_date, source, pub_date ORDER BY later DESC, value DESC) AS j FROM frames_) WHERE j = 1"
_STORED = {
    "frames_": "SELECT CAST(user_id AS VARCHAR) AS actor_id, event_type AS signal_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_days(CAST((event_id % 6) * 80 - 1 AS INTEGER)) AS pub_date, value + later AS value, CASE WHEN event_type IN ('purchase', 'refund') THEN 'billing' ELSE 'site' END AS source, later FROM events, (SELECT unnest([0, 1]) AS later) WHERE event_id % 3 <> 2 * (1 - later)",
    "stored_": _ONE,
}


def _store(spark: SparkSession, d: str) -> pit.PointInTimeStore:
    """A new store of all events, published over more than a year, in frames that overlap."""
    e = st.table(spark, d, "events").select("event_id", F.col("event_type").alias("signal_id"), F.col("ts").cast("date").alias("day"), F.col("user_id").cast("string").alias("actor_id"), "value")
    rows = e.select(
        "event_id", "actor_id", "signal_id", F.col("day").cast("timestamp_ntz").alias("event_date"), F.date_add("day", ((F.col("event_id") % 6) * 80 - 1).cast("int")).cast("timestamp_ntz").alias("pub_date"),
        "value", F.when(F.col("signal_id").isin("purchase", "refund"), "billing").otherwise("site").alias("source"),
    )
    first, second = rows.where("event_id % 3 <> 2").drop("event_id"), rows.where("event_id % 3 <> 0").withColumn("value", F.col("value") + 1).drop("event_id")
    store = pit.PointInTimeStore(spark, f"{shared_dir(spark)}/pit-{uuid.uuid4().hex}")
    store.ingest(first)
    store.bulk_ingest([second.where("source = 'site'"), second.where("source = 'billing'")])
    store.ingest(second)
    return store


@page(sql(f"SELECT {_SHOWN} FROM ({_LATEST.format('q')})", **_STORED, q="SELECT * FROM stored_ WHERE pub_date <= TIMESTAMP '2024-09-30'"), dates="event_date pub_date")
def store_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_store(spark, d).query("2024-09-30"))


@page(sql(f"SELECT {_SHOWN} FROM ({_LATEST.format('stored_')}) WHERE pub_date <= TIMESTAMP '2024-09-30'", **_STORED), dates="event_date pub_date")
def store_legacy(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_store(spark, d).query("2024-09-30", legacy=True))


@page(sql("SELECT source, year(pub_date) AS year, count(*) AS n, round(sum(value), 4) AS total FROM stored_ GROUP BY 1, 2", **_STORED))
def store_vintages(spark: SparkSession, d: str) -> DataFrame:
    """What lies in the files: one row a key and publication, however often it came."""
    g = _store(spark, d).table().groupBy("source", F.year("pub_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(g, "total", digits=4)


@page(sql(f"SELECT 'signal' AS what, {_SHOWN} FROM ({_LATEST.format('q')}) WHERE signal_id IN ('click', 'refund') UNION ALL SELECT 'actor', {_SHOWN} FROM ({_LATEST.format('q')}) WHERE actor_id IN ('3', '14')", **_STORED, q="SELECT * FROM stored_ WHERE pub_date <= TIMESTAMP '2024-12-31'"), dates="event_date pub_date")
def store_selections(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    by = {"signal": store.query_signals(["click", "refund"], as_of="2024-12-31"), "actor": store.query_intensity(["3", "14"], as_of="2024-12-31")}
    parts = [_shown(rows).select(F.lit(what).alias("what"), "*") for what, rows in by.items()]
    return parts[0].unionByName(parts[1])


# --- audits ----------------------------------------------------------------------------------------------------------


@page(sql("SELECT actor, count(value) AS n_obs, min(period) AS first_obs, max(period) AS last_obs, count(DISTINCT period) AS n_quarters, round(100 * count(DISTINCT period) / 28, 6) AS coverage_pct, count(DISTINCT period) >= 24 AS enough FROM gappy WHERE value IS NOT NULL GROUP BY 1", "gappy"), dates="first_obs last_obs")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.coverage(st.gappy(spark, d), ["actor"], "period", "value", 28, enough=24), "coverage_pct")


@page(sql("SELECT sector, geography, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(a AS INTEGER) AS first_year, CAST(b AS INTEGER) AS last_year, coalesce(b < 2001, true) AS stale FROM (SELECT DISTINCT sector FROM registry) CROSS JOIN (SELECT DISTINCT geography FROM registry) LEFT JOIN (SELECT sector, geography, count(*) AS n, min(year(period)) AS a, max(year(period)) AS b FROM panel JOIN registry USING (actor) GROUP BY 1, 2) USING (sector, geography)", "panel", "registry"))
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = st.panel(spark, d).join(st.registry(spark, d), "actor")
    return audit.coverage_matrix(rows, "sector", "geography", "period", 2001).select("sector", "geography", "n", "first_year", "last_year", "stale")


@page(sql('SELECT l_partkey, "from", "to", CAST("to" - "from" AS INTEGER) AS days FROM (SELECT l_partkey, t AS "to", lag(t) OVER (PARTITION BY l_partkey ORDER BY t) AS "from" FROM (SELECT DISTINCT l_partkey, CAST(l_shipdate AS DATE) AS t FROM lineitem)) WHERE "to" - "from" > 100'), dates="from to")
def gap_days(spark: SparkSession, d: str) -> DataFrame:
    return audit.date_gaps(st.table(spark, d, "lineitem"), ["l_partkey"], "l_shipdate", 100)


@page(sql("SELECT l_partkey, CAST(b + 7 AS DATE) AS first, CAST(w - 7 AS DATE) AS last, CAST((w - b) // 7 - 1 AS INTEGER) AS weeks FROM (SELECT l_partkey, w, lag(w) OVER (PARTITION BY l_partkey ORDER BY w) AS b FROM (SELECT DISTINCT l_partkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS w FROM lineitem)) WHERE (w - b) // 7 - 1 >= 4"), dates="first last")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return audit.missing_weeks(st.table(spark, d, "lineitem"), ["l_partkey"], "l_shipdate")


@page(sql("SELECT o_custkey, CASE WHEN y >= 15 THEN 'long' WHEN y >= 10 THEN 'medium' WHEN y >= 5 THEN 'short' ELSE 'insufficient' END AS regime FROM (SELECT o_custkey, (CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE)) / 365.25 AS y FROM orders GROUP BY 1)"))
def regime_class_span(spark: SparkSession, d: str) -> DataFrame:
    g = st.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return g.select("o_custkey", audit.span_class(F.col("a"), F.col("b")).alias("regime"))


@page(sql("SELECT sector, count(value) AS n, round(100 * (1 - count(value) / count(*)), 6) AS missing_pct, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(skewness(value), 4) AS skew, count(*) FILTER (value < -1e-9 OR value > 1 + 1e-9) AS out_of_range FROM gappy JOIN registry USING (actor) GROUP BY 1", "gappy", "registry"))
def panel_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = st.gappy(spark, d).join(st.registry(spark, d), "actor")
    return rounded(rounded(audit.distribution(rows, ["sector"]), "missing_pct", "mean", "sd"), "skew", digits=4)


@page(sql("SELECT count(*) AS n_units, count(*) FILTER (q >= 24) AS n_full, count(*) FILTER (q >= 12 AND q < 24) AS n_partial, CAST(round(count(*) FILTER (q >= 24) / count(*) * 600) AS BIGINT) AS projected, CASE WHEN count(*) FILTER (q >= 24) / count(*) >= 0.5 THEN 'PASS' WHEN count(*) FILTER (q >= 24) / count(*) >= 0.25 THEN 'PIVOT_A' WHEN count(*) FILTER (q >= 12) / count(*) >= 0.25 THEN 'PIVOT_B' ELSE 'KILL' END AS verdict FROM (SELECT l_suppkey, max(q) AS q FROM (SELECT l_suppkey, l_returnflag, count(DISTINCT date_trunc('quarter', l_shipdate)) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1)"))
def feasibility_gate(spark: SparkSession, d: str) -> DataFrame:
    c = audit.coverage(st.table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_shipdate", "l_quantity", 28)
    return audit.feasibility(c, "l_suppkey", "l_returnflag", "n_quarters", 24, 12)


@page(sql("SELECT l_suppkey, count(DISTINCT l_shipdate) AS days, round(count(DISTINCT l_shipdate) / (SELECT count(DISTINCT l_shipdate) FROM lineitem), 6) AS share, count(DISTINCT l_shipdate) / (SELECT count(DISTINCT l_shipdate) FROM lineitem) < 0.5 AS sparse FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1"))
def price_presence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.presence(st.table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice"), "share")


@page(sql("SELECT layer, count(DISTINCT sector) AS kinds FROM registry GROUP BY 1 HAVING count(DISTINCT sector) < 6 AND layer <> 0", "registry"))
def registry_thin_layers(spark: SparkSession, d: str) -> DataFrame:
    return audit.thin_layers(st.registry(spark, d), 6, kind="sector")


# --- universes -------------------------------------------------------------------------------------------------------


@page(sql("SELECT actor, name, sector, CAST(k - 1 AS INTEGER) AS sector_rank, k <= 2 AS leader FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY actor) AS k FROM registry)", "registry"))
def sector_rank_leader(spark: SparkSession, d: str) -> DataFrame:
    return U.rank_in_sector(st.registry(spark, d), position="actor").select("actor", "name", "sector", "sector_rank", "leader")


@page(sql("SELECT sector, actor, n FROM (SELECT sector, actor, n, row_number() OVER (PARTITION BY sector ORDER BY n DESC, actor) AS k FROM (SELECT sector, actor, count(value) AS n FROM gappy JOIN registry USING (actor) GROUP BY 1, 2)) WHERE k <= 5", "gappy", "registry"))
def topn_by_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = st.gappy(spark, d).join(st.registry(spark, d), "actor").groupBy("sector", "actor").agg(F.count("value").alias("n"))
    return U.top_per_group(n, "sector", F.col("n").desc(), "actor", 5)


@page(sql("SELECT c_custkey, c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1"))
def dedup_share_class(spark: SparkSession, d: str) -> DataFrame:
    c = st.table(spark, d, "customer").withColumn("isin", F.concat_ws("-", "c_nationkey", "c_mktsegment"))
    return U.one_per_share_class(c, "isin", [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_custkey", "c_nationkey", "c_mktsegment")


@page(sql("SELECT c_mktsegment, size, CAST(CASE WHEN row_number() OVER (ORDER BY size DESC, c_mktsegment) = 1 THEN q + 40 - sum(q) OVER () ELSE q END AS BIGINT) AS quota FROM (SELECT *, greatest(1, CAST(round_even(40 * size / sum(size) OVER (), 0) AS BIGINT)) AS q FROM (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1))"))
def stratified_quotas(spark: SparkSession, d: str) -> DataFrame:
    return U.quotas(st.table(spark, d, "customer"), "c_mktsegment", 40)


@page(sql("SELECT c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment, unnest(range(quota)) FROM (SELECT c_mktsegment, least(size, CAST(CASE WHEN row_number() OVER (ORDER BY size DESC, c_mktsegment) = 1 THEN q + 40 - sum(q) OVER () ELSE q END AS BIGINT)) AS quota FROM (SELECT *, greatest(1, CAST(round_even(40 * size / sum(size) OVER (), 0) AS BIGINT)) AS q FROM (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1)))) GROUP BY 1"))
def stratified_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    return U.stratified_sample(st.table(spark, d, "customer"), "c_mktsegment", "c_custkey", 40).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@page(sql("SELECT actor, any_value(layer) AS layer, min(part) AS part FROM (SELECT actor, layer, CASE layer WHEN 0 THEN 0 ELSE 1 END AS part FROM registry UNION ALL SELECT actor, layer, 2 FROM registry) GROUP BY 1", "registry"))
def combined_registry(spark: SparkSession, d: str) -> DataFrame:
    r = st.registry(spark, d)
    parts = [r.where("layer = 0").withColumn("part", F.lit(0)), r.where("layer <> 0").withColumn("part", F.lit(1)), r.withColumn("part", F.lit(2))]
    return U.first_wins(parts).select("actor", "layer", "part")


@page()
def capped_selection(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by size with at most 35 % of any region or nation."""
    r = st.registry(spark, d).withColumn("place__", -F.col("size"))
    return U.capped_selection(r, 20, ["place__"], {"sector": 0.35, "geography": 0.35})


# --- flows and news --------------------------------------------------------------------------------------------------

_TRADE = "SELECT sn.n_name AS source, cn.n_name AS target, round(l_extendedprice, 2) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey"
_COEF = "SELECT source, target, f / nullif(sum(f) OVER (PARTITION BY target), 0) AS coefficient FROM (SELECT source, target, sum(flow) AS f FROM trade GROUP BY 1, 2)"


def _trade(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: st.table(spark, d, n)
    li = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source"))
    b = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"))
    return li.join(a, "s_nationkey").join(b, "c_nationkey").select("source", "target", F.round("l_extendedprice", 2).alias("flow"))


@page(sql("SELECT source, target, round(coefficient, 6) AS coefficient FROM coef WHERE coefficient > 0", trade=_TRADE, coef=_COEF))
def io_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flows.coefficients(_trade(spark, d)), "coefficient")


@page(sql("SELECT a.r_name AS source_label, b.r_name AS target_label, round(avg(coefficient), 6) AS mean, count(*) AS n FROM coef JOIN nation x ON source = x.n_name JOIN region a ON x.n_regionkey = a.r_regionkey JOIN nation y ON target = y.n_name JOIN region b ON y.n_regionkey = b.r_regionkey WHERE coefficient > 0 GROUP BY 1, 2", trade=_TRADE, coef=_COEF))
def sector_pair_mean(spark: SparkSession, d: str) -> DataFrame:
    labels = st.table(spark, d, "nation").join(st.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    return rounded(flows.pair_means(flows.coefficients(_trade(spark, d)), labels, "n_name", "r_name"), "mean")


_DAILY = "SELECT event_type AS theme, CAST(ts AS DATE) AS event_date, count(*) AS article_count, round(avg(CASE WHEN user_id % 3 > 0 THEN value END), 6) AS avg_tone, any_value(t.total) AS total_docs_day FROM events JOIN (SELECT CAST(ts AS DATE) AS dd, count(*) AS total FROM events GROUP BY 1) t ON t.dd = CAST(ts AS DATE) GROUP BY 1, 2"


def daily_tone(events: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")
    total = events.groupBy(day.alias("event_date")).agg(F.count(F.lit(1)).alias("total_docs_day"))
    d = events.groupBy(F.col("event_type").alias("theme"), day.alias("event_date")).agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg(F.when(F.col("user_id") % 3 > 0, F.col("value"))), 6).alias("avg_tone"))
    return d.join(total, "event_date")


@page(sql("SELECT theme, CAST(date_trunc('week', event_date) AS DATE) AS week_start, CAST(sum(article_count) AS BIGINT) AS article_count, round(sum(CASE WHEN avg_tone IS NOT NULL THEN avg_tone * article_count END) / nullif(sum(CASE WHEN avg_tone IS NOT NULL THEN article_count END), 0), 4) AS avg_tone, round(sum(article_count) / sum(total_docs_day), 6) AS intensity FROM daily GROUP BY 1, 2", daily=_DAILY), dates="week_start")
def weekly_weighted_tone(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(flows.weekly(daily_tone(st.table(spark, d, "events"))), "intensity"), "avg_tone", digits=4)


_BASKETS = {"english": ["the", "and"], "german": ["der", "die"], "romance": ["la", "de"]}


@page(sql("SELECT signal, source, count(*) AS article_count, round(avg(n_chars), 4) AS avg_tone, any_value(total) AS total_docs_day, round(count(*) / any_value(total), 6) AS intensity FROM (SELECT d.*, total, unnest(list_filter([CASE WHEN list_has_any(w, ['the', 'and']) THEN 'english' END, CASE WHEN list_has_any(w, ['der', 'die']) THEN 'german' END, CASE WHEN list_has_any(w, ['la', 'de']) THEN 'romance' END], lambda x: x IS NOT NULL)) AS signal FROM (SELECT *, string_split(text, ' ') AS w FROM documents) d JOIN (SELECT source, count(*) AS total FROM documents GROUP BY 1) USING (source)) GROUP BY 1, 2"))
def news_baskets(spark: SparkSession, d: str) -> DataFrame:
    docs = st.table(spark, d, "documents").withColumn("themes", F.split("text", " ")).withColumn("tone", F.col("n_chars").cast("double"))
    return rounded(rounded(flows.daily(docs, _BASKETS, date="source"), "intensity"), "avg_tone", digits=4)


@page(sql("SELECT actor_id, CAST(date_trunc('quarter', event_date) AS DATE) AS period, round(sum(value), 4) AS value FROM obs WHERE signal_id = 'click' GROUP BY 1, 2", "obs"), dates="period")
def news_quarters(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flows.news_quarters(st.observations(spark, d), "click"), "value", digits=4)
