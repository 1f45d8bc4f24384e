"""D'Agostino-Pearson omnibus test over population skewness and excess kurtosis.

Each quantity is used several times by the next one, and the optimizer would write it out every time until the generated
code is too large to compile.  The steps are therefore mapped one after the other over a one-element array of structs, whose
fields are evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _start(v: Column) -> dict[str, Column]:
    m, g1, g2 = v["m"], v["g1"], v["g2"]
    return {
        "y": g1 * F.sqrt((m + 1) * (m + 3) / (6.0 * (m - 2))),
        "beta": 3.0 * (m * m + 27.0 * m - 70.0) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)),
        "x": (g2 + 3.0 - 3.0 * (m - 1) / (m + 1)) / F.sqrt(24.0 * m * (m - 2) * (m - 3) / ((m + 1) * (m + 1) * (m + 3) * (m + 5))),
        "s": 6.0 * (m * m - 5.0 * m + 2.0) / ((m + 7) * (m + 9)) * F.sqrt(6.0 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))),
    }


def _middle(v: Column) -> dict[str, Column]:
    return {
        "y": v["y"], "x": v["x"], "w2": F.sqrt(2.0 * (v["beta"] - 1)) - 1.0,
        "a": 6.0 + 8.0 / v["s"] * (2.0 / v["s"] + F.sqrt(1.0 + 4.0 / (v["s"] * v["s"]))),
    }


def _late(v: Column) -> dict[str, Column]:
    return {
        "a": v["a"], "r": v["y"] / F.sqrt(2.0 / (v["w2"] - 1.0)), "delta": 1.0 / F.sqrt(0.5 * F.log(v["w2"])),
        "d": 1.0 + v["x"] * F.sqrt(2.0 / (v["a"] - 4.0)),
    }


def _scores(v: Column) -> dict[str, Column]:
    root = F.signum(v["d"]) * F.pow(F.try_divide(1.0 - 2.0 / v["a"], F.abs(v["d"])), F.lit(1.0 / 3.0))
    return {
        "z_skew": v["delta"] * F.log(v["r"] + F.sqrt(v["r"] * v["r"] + 1.0)),
        "z_kurt": (1.0 - 2.0 / (9.0 * v["a"]) - root) / F.sqrt(2.0 / (9.0 * v["a"])),
    }


def _as_struct(formula):
    return lambda v: F.struct(*[e.alias(name) for name, e in formula(v).items()])


def with_normality(df: DataFrame) -> DataFrame:
    """Add z_skew, z_kurt and k2 to a frame with n, g1 and g2; null below eight values."""
    enough = F.when(F.col("n") >= 8, F.col("n").cast("double"))
    steps = F.array(F.struct(enough.alias("m"), F.col("g1").alias("g1"), F.col("g2").alias("g2")))
    for formula in (_start, _middle, _late, _scores):
        steps = F.transform(steps, _as_struct(formula))
    out = df.select("*", F.get(steps, F.lit(0)).alias("_z"))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_z.z_skew").alias("z_skew"), F.col("_z.z_kurt").alias("z_kurt"))
    return out.withColumn("k2", F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt"))
