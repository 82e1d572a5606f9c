"""Rank tests and correlations over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.special import NAN, student_two_sided
from ..session import staged
from .order import ALL, Ranking, _scoped, mid_ranks, order_summary, summary_quantiles, summary_rank_tests


def mann_whitney(df: DataFrame, scope: Sequence[str], group: str, value: str) -> DataFrame:
    """Two-sided rank test of every group against the rest of its scope.

    The pool is the same for all groups of a scope, so it is ranked once. Normal p with tie and continuity correction.
    """
    summary = order_summary(df, {"pool": Ranking(value, tuple(scope), group)})
    return summary_rank_tests(summary, "pool", scope, group)


def stratified_contrast(
    df: DataFrame, strata: Sequence[str], flag: str, value: str, least: int
) -> DataFrame:
    """Flagged rows against the others inside each stratum: sizes, difference of medians, rank-test p.

    A stratum needs at least ``least`` rows on both sides.
    """
    summary = order_summary(df, {"pool": Ranking(value, tuple(strata), flag), "side": Ranking(value, (*strata, flag))})
    test = summary_rank_tests(summary, "pool", strata, flag).where(F.col(flag)).withColumn("n_rest", F.col("n_pool") - F.col("n_group"))
    med = summary_quantiles(summary, "side", [*strata, flag], {"__m": 0.5})
    sides = med.groupBy(*strata).agg(
        F.max(F.when(F.col(flag), F.col("__m"))).alias("__a"), F.max(F.when(~F.col(flag), F.col("__m"))).alias("__b")
    )
    kept = test.where((F.col("n_group") >= least) & (F.col("n_rest") >= least)).join(sides, list(strata))
    return kept.select(
        *strata, F.col("n_group").alias("n_flagged"), "n_rest", (F.col("__a") - F.col("__b")).alias("delta"), "p"
    )


def contrast_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median delta over strata and how many are positive; one row per stratum comes in."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.median("delta").alias("median_delta"),
        F.sum((F.col("delta") > 0).cast("long")).alias("n_positive"),
    )


def correlation(df: DataFrame, x: str, y: str, scope: Sequence[str] = (), ranks: bool = False) -> DataFrame:
    """Pearson (or Spearman, on average ranks) correlation per scope with its t-test p; NaN where a side does not vary."""
    df, keys = _scoped(df, scope)
    if ranks:
        df = staged(df)
        for c in (x, y):
            table = mid_ranks(df, keys, c).select(*keys, c, F.col("rank").alias(f"__rank_{c}"))
            df = df.join(table, [*keys, c])
        x, y = f"__rank_{x}", f"__rank_{y}"
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    r = F.when(F.count_if(both) > 1, F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread)).otherwise(F.lit(NAN)))
    got = df.groupBy(*keys).agg(r.alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    p = F.when(F.col("n") > 2, student_two_sided(t, F.col("n") - 2)).otherwise(F.lit(NAN))
    return got.select(*[k for k in keys if k != ALL], "n", "r", p.alias("p"))
