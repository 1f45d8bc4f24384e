"""Tail probabilities against closed forms and table values."""

import math

import pytest
from pyspark.sql import functions as F

from tablescope.functions.pvalues import beta_tail, chi2_pvalue, gamma_tail, t_pvalue, z_pvalue


@pytest.mark.parametrize("t", [0.0, .3, 1.0, 4.0, 60.0])
def test_t_with_one_and_two_degrees(t):
    assert beta_tail(.5, .5, 1 / (1 + t * t)) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    assert beta_tail(1, .5, 2 / (2 + t * t)) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)


@pytest.mark.parametrize("x", [0.0, .1, 2.0, 9.0, 80.0])
def test_chi2_with_two_and_one_degrees(x):
    assert gamma_tail(1, x / 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert gamma_tail(.5, x / 2) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)


@pytest.mark.parametrize("t, freedom, p", [(2.228139, 10, .05), (2.749996, 30, .01), (1.959964, 10 ** 9, .05)])
def test_t_table(t, freedom, p):
    assert beta_tail(freedom / 2, .5, freedom / (freedom + t * t)) == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize("x, freedom, p", [(18.307038, 10, .05), (124.342113, 100, .05), (6.634897, 1, .01)])
def test_chi2_table(x, freedom, p):
    assert gamma_tail(freedom / 2, x / 2) == pytest.approx(p, rel=1e-5)


def test_columns(spark):
    row = spark.sql("select 1.959963984540054D z, 2.228139D t, cast(null as double) e").select(
        z_pvalue("z").alias("z"), t_pvalue("t", F.lit(10.0)).alias("t"),
        chi2_pvalue("e", "z").alias("e")).first()
    assert row["z"] == pytest.approx(.05) and row["t"] == pytest.approx(.05, rel=1e-5) and row["e"] is None
