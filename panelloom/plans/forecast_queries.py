"""Queries of the window forecasts: no SQL form; tests hold the kernels to invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import forecast as fc
from panelloom.operators import scoring as sc
from panelloom.operators import windows as W
from panelloom.plans import standins as st
from panelloom.plans.book import Book
from panelloom.plans.panel_queries import rounded
from panelloom.session import kept

BOOK = Book()
page = BOOK.page
N_PLACEBO, N_SPLITS = 1000, 30
GRID_YEARS, GRID_FACTORS = (2, 3, 5), [2, 3, 4, 6]


def _rows(spark: SparkSession, d: str, years: int = st.TRAIN_YEARS) -> DataFrame:
    """The panel's windows with blocks, written once a run, as forecasts read them several times."""
    return kept(spark, d, f"windows_of_{years}", lambda: W.with_blocks(W.windows(st.panel(spark, d), st.TEST_YEARS, years), st.blocks(spark, d)))


def _whole(rows: DataFrame, years: int) -> DataFrame:
    """Windows whose training quarters aren't cut off by the panel's start."""
    held = rows.where("train").groupBy("test_year").agg(F.count_distinct("period").alias("n")).where(F.col("n") == 4 * years)
    return rows.join(F.broadcast(held.select("test_year")), "test_year", "left_semi")  # held: one row a year


@page(dates="period")
def eight_architectures(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.eight_architectures(_rows(spark, d)), "pred", "actual")


@page()
def eight_architectures_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.eight_scores(_rows(spark, d), ["test_year", "arch", "block"]), "r2", "mae")


@page()
def method_comparison_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.method_scores(_rows(spark, d), ["test_year", "arch"]), "r2", "mae")


@page()
def placebo_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.placebo_summary(kept(spark, d, "placebo", lambda: fc.placebo(_rows(spark, d), N_PLACEBO))), "real", "mean", "sd", "z", "p")


@page()
def stratified_placebo_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.placebo_summary(kept(spark, d, "stratified_placebo", lambda: fc.placebo(_rows(spark, d), N_PLACEBO, fixed=("REMAINDER",)))), "real", "mean", "sd", "z", "p")


@page()
def window_factor_grid(spark: SparkSession, d: str) -> DataFrame:
    parts = [fc.grid_scores(_whole(_rows(spark, d, t), t), GRID_FACTORS, ["test_year", "variant", "arch"]).withColumn("years", F.lit(t)) for t in GRID_YEARS]
    return rounded(reduce(DataFrame.unionByName, parts), "r2", "mae")


@page()
def boosted_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.boosted_scores(_rows(spark, d), ["test_year", "arch"]), "r2", "mae")


@page()
def gating_r2(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    policies = fc.gated(fc.eight_architectures(rows, wanted=("G0", "G1")), fc.gates(fc.gate_diagnostics(rows)))
    return rounded(sc.r_squared(policies, ["test_year", "arch"]), "r2", "mae")


@page(dates="period")
def subspace_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.subspace_accuracy(st.panel(spark, d)), "chordal", "frobenius", "correlation")


@page(dates="period")
def subspace_turning(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.subspace_turning(st.panel(spark, d)), "angle", "geodesic", "largest", "stability")


@page()
def split_half_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fc.split_half(_rows(spark, d), N_SPLITS), "rho", "reliability")
