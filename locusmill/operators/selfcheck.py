"""Checks a run can make of itself: joins against a nested loop, nulls against uniform p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .intervals import overlap_join
from .order import value_runs

#: Anchors that a self-check holds against all of the other side.
ANCHORS = 2000
#: Where the Kolmogorov-Smirnov distance times the root of the number of p-values lies in one of a hundred uniform samples.
ONE_PERCENT = 1.63


def _pairs(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> list[Column]:
    """How many pairs there are and a sum of their hashes, which hangs on the pairs and not on their order."""
    key = F.xxhash64(*[F.col(c) for c in (*left, *right)])
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")]


def overlap_self_check(
    left: DataFrame, right: DataFrame, left_id: Sequence[str], right_id: Sequence[str], chrom: str = "chrom", anchors: int = ANCHORS
) -> DataFrame:
    """One row: anchors looked at, pairs by the tiled join, pairs by a plain nested loop, and whether they are the same.

    The anchors are the ``anchors`` of the least hash, so another run looks at the same ones; each is held against every
    interval of its chromosome, without tiles. Intervals are start_pos to end_pos on both sides.
    """
    span = [chrom, "start_pos", "end_pos"]
    some = left.select(*left_id, *[c for c in span if c not in left_id]).distinct()
    some = some.orderBy(F.xxhash64(*some.columns), *some.columns).limit(anchors)
    other = right.select(
        *[F.col(c).alias(f"r_{c}") for c in right_id], F.col(chrom), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end")
    )
    ids = [f"r_{c}" for c in right_id]
    tiled = overlap_join(some, other).agg(*_pairs(other, left_id, ids))
    apart = other.withColumnRenamed(chrom, "__chrom")
    meets = (F.col(chrom) == F.col("__chrom")) & (F.col("start_pos") < F.col("r_end")) & (F.col("end_pos") > F.col("r_start"))
    plain = F.broadcast(some).join(apart, meets).agg(*_pairs(other, left_id, ids))
    both = tiled.withColumnsRenamed({"n": "n_tiled", "h": "__a"}).join(plain.withColumnsRenamed({"n": "n_plain", "h": "__b"}), F.lit(True))
    n = some.agg(F.count(F.lit(1))).scalar()
    return both.select(
        n.alias("n_anchors"), "n_tiled", "n_plain", ((F.col("n_tiled") == F.col("n_plain")) & (F.col("__a") == F.col("__b"))).alias("agree")
    )


def calibration_check(calibrated: DataFrame, p: str, q: str, q_cut: float = 0.05) -> DataFrame:
    """One row over a run whose observed arm is a draw of its null: is it as unremarkable as it should be?

    ``excess`` is how far the share of p-values at or below a value goes beyond that value; empirical p-values are steps,
    so only the upper side is looked at. The run is ``calibrated`` if no q is below the cut and the excess is one that
    uniform p-values reach in more than one of a hundred samples. Null and NaN p-values are left out.
    """
    rows = calibrated.where(F.col(p).isNotNull() & ~F.isnan(p))
    runs = value_runs(rows, [], p)
    over = (F.col("n_before") + F.col("n")) / F.col("n_total") - F.col(p)
    out = runs.agg(F.coalesce(F.max("n_total"), F.lit(0)).alias("n"), F.greatest(F.max(over), F.lit(0.0)).alias("excess"))
    low = rows.agg(F.count_if(F.col(q) < q_cut)).scalar()
    fine = (low == 0) & (F.coalesce("excess", F.lit(0.0)) * F.sqrt(F.col("n")) <= ONE_PERCENT)
    return out.select("n", low.alias("n_below_cut"), F.coalesce("excess", F.lit(0.0)).alias("excess"), fine.alias("calibrated"))
