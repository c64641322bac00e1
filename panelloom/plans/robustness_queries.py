"""Robustness of the block slopes: other blocks, fewer actors, late filings, causal scaling, noise; each from kept sums, against SQL that goes over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators import normalise as N
from panelloom.operators import placebo, studies, sufficient
from panelloom.operators.inference import PRIME
from panelloom.plans import standins as st
from panelloom.plans import study_queries as sq
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded, t_p
from panelloom.plans.standins import CTE, sql
from panelloom.session import kept

BOOK = Book()
page = BOOK.page

_THREE = "sector IN ('AMERICA', 'ASIA', 'EUROPE')"
#: Variant -> the actor's block (null: none) and whether the actor is there; expressions that both engines read. place: number in its sector.
SET = {
    "three_blocks": (f"CASE WHEN {_THREE} THEN sector END", "true"),
    "without_europe": ("CASE WHEN sector IN ('AMERICA', 'ASIA') THEN sector END", "sector <> 'EUROPE'"),
    "moved_one": ("CASE WHEN sector = 'EUROPE' OR (sector = 'AFRICA' AND place <= 1) THEN 'EUROPE' WHEN sector = 'ASIA' OR (sector = 'AMERICA' AND place > 1) THEN sector END", "true"),
    "moved_two": ("CASE WHEN sector = 'EUROPE' OR (sector = 'AFRICA' AND place <= 2) THEN 'EUROPE' WHEN sector = 'ASIA' OR (sector = 'AMERICA' AND place > 2) THEN sector END", "true"),
    "moved_back": ("CASE WHEN sector = 'EUROPE' AND place = 1 THEN 'AMERICA' WHEN sector IN ('AMERICA', 'ASIA', 'EUROPE') THEN sector END", "true"),
    "four_blocks": (f"CASE WHEN {_THREE} THEN sector ELSE 'REST' END", "true"),
    "rest_only": (f"CASE WHEN {_THREE} THEN NULL ELSE 'REST' END", "true"),
}
#: One block a candidate.
CANDIDATES = {s.lower().replace(" ", "_"): (f"CASE WHEN sector = '{s}' THEN 'one' END", "true") for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")} | {
    "africa_and_europe": ("CASE WHEN sector IN ('AFRICA', 'EUROPE') THEN 'one' END", "true"), "asia_and_america": ("CASE WHEN sector IN ('ASIA', 'AMERICA') THEN 'one' END", "true"),
    "layer_0": ("CASE WHEN layer = 0 THEN 'one' END", "true"), "layer_2": ("CASE WHEN layer = 2 THEN 'one' END", "true"), "layers_0_1": ("CASE WHEN layer IN (0, 1) THEN 'one' END", "true"),
}


def _members(spark: SparkSession, d: str, variants: dict[str, tuple[str, str]]) -> DataFrame:
    r = st.registry(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy("actor")))
    return sufficient.membership(r, {k: (F.expr(b), F.expr(t)) for k, (b, t) in variants.items()})


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "sufficient", lambda: sufficient.statistics(st.dealt(spark, d)))


def _scores_sql(variants: dict[str, tuple[str, str]], dev: str, by: str = "") -> dict[str, str]:
    """Slopes and forecasts row by row."""
    k = f"{by}variant, test_year"
    slope = "CASE WHEN sum(prev * prev) {0} > 1e-12 THEN sum(dev * prev) {0} / sum(prev * prev) {0} ELSE 0 END"
    return {
        "placed_": "SELECT *, row_number() OVER (PARTITION BY sector ORDER BY actor) AS place FROM registry",
        "members_": " UNION ALL ".join(f"SELECT '{v}' AS variant, actor, {b} AS block FROM placed_ WHERE {t}" for v, (b, t) in variants.items()),
        "in_": f"SELECT * FROM ({dev}) JOIN members_ USING (actor)",
        "base_": f"SELECT {k}, {slope.format('')} AS g FROM in_ WHERE train AND prev IS NOT NULL GROUP BY ALL",
        "own_": f"SELECT {k}, block, {slope.format('')} AS b FROM in_ WHERE train AND prev IS NOT NULL AND block IS NOT NULL GROUP BY ALL",
        "said_": f"SELECT in_.*, mean + g * coalesce(prev, 0) AS p0, mean + coalesce(b, g) * coalesce(prev, 0) AS p1 FROM in_ JOIN base_ USING ({k}) LEFT JOIN own_ USING ({k}, block) WHERE NOT train",
        "scored_": f"SELECT {k}, count(DISTINCT actor) AS n_actors, 1 - sum(pow(value - p0, 2)) / (var_pop(value) * count(*)) AS base_r2, 1 - sum(pow(value - p1, 2)) / (var_pop(value) * count(*)) AS mixed_r2 FROM said_ GROUP BY ALL",
    }


_DEV = "SELECT test_year, actor, train, value, mean, dev, prev FROM dev"
_SCORED = "round(base_r2, 6) AS base_r2, round(mixed_r2, 6) AS mixed_r2, round(mixed_r2 - base_r2, 6) AS delta"


@page(sql(f"SELECT variant, test_year, n_actors, {_SCORED} FROM scored_", "dev", "registry", **_scores_sql(SET, _DEV)))
def robustness_set(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sufficient.scores(_statistics(spark, d), _members(spark, d, SET)), "base_r2", "mixed_r2", "delta")


@page(sql(f"SELECT variant, test_year, n_actors, {_SCORED} FROM scored_", "dev", "registry", **_scores_sql(CANDIDATES, _DEV)))
def candidate_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sufficient.scores(_statistics(spark, d), _members(spark, d, CANDIDATES)), "base_r2", "mixed_r2", "delta")


def _summary_sql(by: str) -> str:
    g = f"SELECT {by}, count(*) AS n, avg(mixed_r2 - base_r2) AS mean, stddev_samp(mixed_r2 - base_r2) / sqrt(count(*)) AS se, avg(base_r2) AS base_r2, avg(mixed_r2) AS mixed_r2, count(*) FILTER (mixed_r2 > base_r2) AS wins FROM scored_ GROUP BY ALL"
    return f"SELECT {by}, n, round(mean, 6) AS mean, round(t, 3) AS t, CASE WHEN t IS NOT NULL THEN round({t_p('t', '(n - 1)')}, 5) END AS p, round(base_r2, 6) AS base_r2, round(mixed_r2, 6) AS mixed_r2, wins FROM (SELECT *, CASE WHEN n >= 3 AND se >= 1e-15 THEN mean / se END AS t FROM ({g}))"


def _summary(found: DataFrame, by: list[str]) -> DataFrame:
    return rounded(rounded(rounded(sufficient.summary(found, by), "mean", "base_r2", "mixed_r2"), "t", digits=3), "p", digits=5)


@page(sql(_summary_sql("variant"), "dev", "registry", **_scores_sql(SET | CANDIDATES, _DEV)))
def robustness_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(sufficient.scores(_statistics(spark, d), _members(spark, d, SET | CANDIDATES)), ["variant"])


_PARTS_OF = {"africa": CANDIDATES["africa"], "europe": CANDIDATES["europe"], "africa_and_europe": CANDIDATES["africa_and_europe"]}


@page(sql(
    "SELECT n, round(first, 6) AS first, round(second, 6) AS second, round(first + second, 6) AS parts, round(merged, 6) AS merged, round(merged - first - second, 6) AS excess, CASE WHEN merged - first - second > 0.005 THEN 'shared' WHEN merged - first - second < -0.005 THEN 'apart' ELSE 'unclear' END AS finding FROM (SELECT count(DISTINCT test_year) AS n, avg(mixed_r2 - base_r2) FILTER (variant = 'africa') AS first, avg(mixed_r2 - base_r2) FILTER (variant = 'europe') AS second, avg(mixed_r2 - base_r2) FILTER (variant = 'africa_and_europe') AS merged FROM scored_)",
    "dev", "registry", **_scores_sql(_PARTS_OF, _DEV),
))
def merged_block_gain(spark: SparkSession, d: str) -> DataFrame:
    found = sufficient.scores(_statistics(spark, d), _members(spark, d, _PARTS_OF))
    return rounded(sufficient.merged_gain(found, "africa", "europe", "africa_and_europe"), "first", "second", "parts", "merged", "excess")


# --- placebos and halves: draws as rows of the kept sums -----------------------------------------------------------------

DRAWS, SPLITS = 1000, 30
_LAYERED = "sector = 'AMERICA'"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return st.registry(spark, d).select("actor", F.expr(SET["three_blocks"][0]).alias("block"), "sector", "layer")


def _drawn_sql(draw: str, place: str, n: str, seed: int) -> str:
    return f"(SELECT ((c * c + b) % {PRIME}) % {n} FROM (SELECT a, b, (b * b + a) % {PRIME} AS c FROM (SELECT a, (a * a + 12345) % {PRIME} AS b FROM (SELECT ({draw} * 7919 + {place} * 104729 + {seed}) % {PRIME} AS a))))"


def _placebo_sql(draws: int, stratum: str = "0", fixed: str = "false") -> dict[str, str]:
    """Each draw's permutation, a round an expression, then slopes and forecasts row by row."""
    before = {
        "at_": f"SELECT actor, block, f, s, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY f, s) AS total FROM (SELECT actor, {SET['three_blocks'][0]} AS block, {fixed} AS f, {stratum} AS s FROM registry) WINDOW w AS (PARTITION BY f, s ORDER BY block NULLS FIRST, actor)",
        "rounds_": f"SELECT draw, i, {_drawn_sql('draw', 'i', PRIME, placebo.SHIFT)} AS shift, {_drawn_sql('draw', 'i', PRIME, placebo.BIT)} AS key FROM (SELECT range AS draw FROM range({draws})), (SELECT range AS i FROM range({placebo.ROUNDS}))",
        "x0": f"SELECT draw, actor, f, s, total, place AS x FROM at_, (SELECT range AS draw FROM range(-1, {draws}))",
    }
    for i in range(placebo.ROUNDS):
        swap = f"SELECT x{i}.*, key, (((shift - x) % total) + total) % total AS p FROM x{i} LEFT JOIN rounds_ ON x{i}.draw = rounds_.draw AND i = {i}"
        before[f"x{i + 1}"] = f"SELECT draw, actor, f, s, total, CASE WHEN NOT f AND (h * h) % {PRIME} % 2 = 1 THEN p ELSE x END AS x FROM (SELECT *, (greatest(x, p) * 104729 + key) % {PRIME} AS h FROM ({swap}))"
    members = f"SELECT x.draw AS variant, x.actor, at_.block FROM x{placebo.ROUNDS} x JOIN at_ ON at_.f = x.f AND at_.s = x.s AND at_.place = x.x"
    means = {"means_": "SELECT variant AS draw, count(*) AS n_windows, round(avg(mixed_r2 - base_r2), 9) AS delta FROM scored_ GROUP BY 1"}
    return before | _scores_sql(SET, _DEV) | {"members_": members} | means


_AMONG = "SELECT round(real, 6) AS real, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS sd, round((real - avg(delta)) / stddev_pop(delta), 3) AS z, avg(CASE WHEN delta >= real THEN 1.0 ELSE 0.0 END)::DOUBLE AS p, count(*) AS n FROM means_, (SELECT delta AS real FROM means_ WHERE draw = -1) WHERE draw >= 0 GROUP BY real"


def _among(means: DataFrame) -> DataFrame:
    return rounded(rounded(placebo.placebo_summary(means), "real", "mean", "sd"), "z", digits=3)


@page(sql("SELECT draw, n_windows, round(delta, 6) AS delta FROM means_", "dev", "registry", **_placebo_sql(100)))
def block_placebo_draws(spark: SparkSession, d: str) -> DataFrame:
    return rounded(placebo.placebo_means(placebo.placebo_scores(_statistics(spark, d), _blocks(spark, d), 100)), "delta")


@page(sql(_AMONG, "dev", "registry", **_placebo_sql(DRAWS)))
def block_placebo(spark: SparkSession, d: str) -> DataFrame:
    """A thousand permutations of the actors' blocks."""
    return _among(placebo.placebo_means(placebo.placebo_scores(_statistics(spark, d), _blocks(spark, d), DRAWS)))


@page(sql(_AMONG, "dev", "registry", **_placebo_sql(DRAWS, "layer", _LAYERED)))
def stratified_block_placebo(spark: SparkSession, d: str) -> DataFrame:
    """A thousand permutations within layers; one sector's actors stay where they are."""
    found = placebo.placebo_scores(_statistics(spark, d), _blocks(spark, d), DRAWS, ["layer"], F.expr(_LAYERED))
    return _among(placebo.placebo_means(found))


_HALVES = {
    "numbered_": f"SELECT actor, {SET['three_blocks'][0]} AS block, row_number() OVER (ORDER BY {SET['three_blocks'][0]} NULLS FIRST, actor) - 1 AS place FROM registry",
} | _scores_sql(SET, _DEV) | {
    "members_": f"SELECT split || ':' || {_drawn_sql('split', 'place', '2', placebo.HALF)} AS variant, actor, block FROM numbered_, (SELECT range AS split FROM range({SPLITS}))",
    "halves_": "SELECT split_part(variant, ':', 1) AS split, test_year, max(mixed_r2) FILTER (variant LIKE '%:0') AS a, max(mixed_r2) FILTER (variant LIKE '%:1') AS b FROM scored_ GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL",
    "rhos_": "SELECT * FROM (SELECT split, corr(a, b) AS rho FROM halves_ GROUP BY 1) WHERE rho IS NOT NULL AND NOT isnan(rho)",
}


@page(sql("SELECT round(m, 6) AS rho, round(CASE WHEN m > 0 THEN 2 * m / (1 + m) ELSE 0 END, 6) AS reliability, n FROM (SELECT avg(rho) AS m, count(*) AS n FROM rhos_)", "dev", "registry", **_HALVES))
def split_half_of_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(placebo.split_half(_statistics(spark, d), _blocks(spark, d), SPLITS), "rho", "reliability")


# --- the panel itself changed: each version's sums are taken in the same run ------------------------------------------


def _versions_sql(panels: str, **before: str) -> dict[str, str]:
    """The windows of all versions (``panels``: panel, actor, period, value) and their scores by the three blocks."""
    chain = {"panel": f"SELECT {{'panel': panel, 'actor': actor}} AS actor, period, value FROM ({panels})"} | {c: CTE[c] for c in ("dealt0", "dealt1", "good", "dealt")}
    dev = {"rows_": "SELECT * FROM dealt", "dev0": CTE["dev0"], "dev": CTE["dev"], "registry": CTE["registry"]}
    return before | chain | dev | _scores_sql({"three_blocks": SET["three_blocks"]}, "SELECT actor.panel AS panel, test_year, actor.actor AS actor, train, value, mean, dev, prev FROM dev", "panel, ")


def _versions(spark: SparkSession, d: str, panels: DataFrame) -> DataFrame:
    s = sufficient.statistics_of_panels(panels, st.TEST_YEARS, st.TRAIN_YEARS)
    return sufficient.scores(s, _members(spark, d, {"three_blocks": SET["three_blocks"]}), ["panel"]).drop("variant")


_ROWS = f"SELECT panel, test_year, n_actors, {_SCORED} FROM scored_"
_BASE = {"panel0": CTE["panel"], "registry0": CTE["registry"]}


@page(sql(_ROWS, **_versions_sql(
    "SELECT 'now' AS panel, actor, period, value FROM panel0 UNION ALL SELECT 'late', actor, period, CASE WHEN layer = 2 THEN lag(value) OVER (PARTITION BY actor ORDER BY period) ELSE value END FROM panel0 LEFT JOIN registry0 USING (actor)", **_BASE
)))
def late_filings_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Firms' values a quarter late, against all values on time."""
    p = st.panel(spark, d)
    late = N.firm_lag(p, st.registry(spark, d)).select(F.lit("late").alias("panel"), "actor", "period", F.col("lagged").alias("value"))
    return rounded(_versions(spark, d, p.select(F.lit("now").alias("panel"), "actor", "period", "value").unionByName(late)), "base_r2", "mixed_r2", "delta")


_WHOLE = "PARTITION BY actor"
_SO_FAR = "PARTITION BY actor ORDER BY period ROWS UNBOUNDED PRECEDING"


@page(sql(_ROWS, **_versions_sql(
    f"SELECT 'whole' AS panel, actor, period, round((value - min(value) OVER ({_WHOLE})) / nullif(max(value) OVER ({_WHOLE}) - min(value) OVER ({_WHOLE}), 0), 9) AS value FROM panel0 UNION ALL SELECT 'so_far', actor, period, round(CASE WHEN max(value) OVER ({_SO_FAR}) - min(value) OVER ({_SO_FAR}) > 1e-10 THEN (value - min(value) OVER ({_SO_FAR})) / (max(value) OVER ({_SO_FAR}) - min(value) OVER ({_SO_FAR})) ELSE 0.5 END, 9) FROM panel0", **_BASE
)))
def causal_scaling_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Min-max over what was known then, against min-max over the whole history."""
    p = st.panel(spark, d)
    both = [f(p).select(F.lit(name).alias("panel"), "actor", "period", F.round("scaled", 9).alias("value")) for name, f in (("whole", N.time_series_minmax), ("so_far", N.recursive_minmax))]
    return rounded(_versions(spark, d, both[0].unionByName(both[1])), "base_r2", "mixed_r2", "delta")


@page(sql(_summary_sql("panel"), **_versions_sql("SELECT CAST(round(100 * sigma) AS BIGINT) AS panel, actor, period, noisy AS value FROM noisy_", **_BASE, **{
    "keyed": sq.NOISE["keyed"].replace("FROM panel", "FROM panel0"), "normal": sq.NOISE["normal"], "noisy_": sq.NOISE["noisy_"],
})))
def noise_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Slopes fitted anew on values with noise, in hundredths of sigma: the gain and what is left of it."""
    x = studies.perturbed(st.panel(spark, d), sq.SIGMAS)
    panels = x.select(F.round(100 * F.col("sigma")).cast("long").alias("panel"), "actor", "period", F.round("noisy", 9).alias("value"))
    return _summary(_versions(spark, d, panels), ["panel"])
