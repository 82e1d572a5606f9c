"""Points-in-interval counting as a signed sweep.

An interval's count is the count below its end minus the count below its start. Points are collapsed per position and
appear once; interval ends are what multiplies with shifts. Both are scanned per block of positions, and a table with
one row per block supplies the count before the block. No pair of point and interval is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.intervals import floor_div
from ..session import staged
from .skew import HOT_ROWS, SALT, split_hot

BLOCK = 16_384


def counts_in_spans(
    points: DataFrame,
    spans: DataFrame,
    by: Sequence[str],
    codes: Sequence[str],
    keys: Sequence[str] = ("chrom",),
    block: int = BLOCK,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sum of each code column over the points in [start_pos, end_pos) of the spans, summed per ``by``.

    ``points`` has keys, ``pos`` and the numeric ``codes``; every ``by`` value of ``spans`` gets a row.
    """
    keys, by, codes = list(keys), list(by), list(codes)
    extra = [c for c in by if c not in keys]
    at = staged(points.groupBy(*keys, "pos").agg(*[F.sum(c).alias(c) for c in codes]))
    at = at.withColumn("__b", floor_div("pos", block))

    ends = F.explode(
        F.array(
            F.struct(F.col("end_pos").alias("pos"), F.lit(1).alias("__w")),
            F.struct(F.col("start_pos").alias("pos"), F.lit(-1).alias("__w")),
        )
    )
    marks = spans.select(*keys, *extra, ends.alias("__e")).select(
        *keys, *extra, F.col("__e.pos").alias("pos"), F.col("__e.__w").alias("__w")
    )
    marks = marks.withColumn("__b", floor_div("pos", block))

    cell = [*keys, "__b"]
    zero = [F.lit(0).cast("long").alias(c) for c in codes]
    sums = at.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in codes])
    touched = marks.select(*cell).distinct().select(*cell, *zero)
    blocks = sums.unionByName(touched).groupBy(*cell).agg(*[F.sum(c).alias(c) for c in codes])
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    base = blocks.select(*cell, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base_{c}") for c in codes])

    # A block holds at most one point row per position, so its points go whole to every part of its interval ends.
    marks, at, scan_keys = split_hot(marks, at, cell, hot_rows, split_right=False)
    if hot_rows is None:
        marks, at, scan_keys = marks.withColumn(SALT, F.lit(0)), at.withColumn(SALT, F.lit(0)), [*cell, SALT]
    nulls = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in extra]
    lanes = at.select(*scan_keys, "pos", F.lit(1).alias("__kind"), F.lit(0).alias("__w"), *nulls, *codes)
    asks = marks.select(*scan_keys, "pos", F.lit(0).alias("__kind"), "__w", *extra, *zero)
    # At equal positions interval ends come first, so a count takes the points strictly below.
    scan = W.partitionBy(*scan_keys).orderBy("pos", "__kind").rowsBetween(W.unboundedPreceding, 0)
    swept = lanes.unionByName(asks).select(
        *cell, *extra, "__kind", "__w", *[F.sum(c).over(scan).alias(f"__run_{c}") for c in codes]
    )
    asked = swept.where(F.col("__kind") == 0).join(base, cell)
    return asked.groupBy(*by).agg(
        *[F.sum(F.col("__w") * (F.col(f"__base_{c}") + F.col(f"__run_{c}"))).alias(c) for c in codes]
    )
