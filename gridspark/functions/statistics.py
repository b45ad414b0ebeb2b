"""Two-sided t test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def student_tail(cos2: str, df: int) -> Column:
    """Two-sided p-value for ``df`` (even) degrees of freedom; ``cos2`` names a column 1 / (1 + t^2 / df).

    For even df the distribution is a finite sum in cos(theta)^2 (Abramowitz and Stegun 26.7.4),
    written here as nested products.
    """
    total = "1D"
    for k in range(df // 2 - 1, 0, -1):
        total = f"(1D + {(2 * k - 1) / (2 * k)!r}D * {cos2} * {total})"
    # greatest() skips NULL, so a missing angle is kept missing explicitly
    return F.expr(f"CASE WHEN {cos2} IS NOT NULL THEN greatest(0D, 1D - sqrt(1D - {cos2}) * {total}) END")


def ttest_pvalue(df: DataFrame, mean1: Column, mean2: Column, std: Column, n: int, out: str = "p_value") -> DataFrame:
    """Add the p-value of equal means for two groups of ``n`` samples with a shared standard deviation.

    A zero deviation gives 1 for equal means and 0 otherwise.  The angle is its own column, so the long
    sum refers to it by name and stays inside generated code.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    free = 2 * n - 2
    t = (mean1 - mean2) / (F.nullif(std, F.lit(0.0)) * float((2.0 / n) ** 0.5))
    df = df.withColumns({"_diff": mean1 - mean2, "_std": std, "_ratio": t})
    df = df.withColumn("_cos2", 1 / (1 + F.col("_ratio") * F.col("_ratio") / free))
    exact = F.when(F.col("_diff") == 0, F.lit(1.0)).when(F.col("_diff") != 0, F.lit(0.0))
    p = F.when(F.col("_std") == 0, exact).otherwise(student_tail("_cos2", free))
    return df.withColumn(out, p).drop("_diff", "_std", "_ratio", "_cos2")
