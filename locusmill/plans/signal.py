"""IP over input signal per element copy, tested per subfamily and orientation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.intervals import ANTISENSE, SENSE, clip_to, track_orientation
from ..operators.counting import lone_ids
from ..operators.coverage import clip_spans, library_totals, signal_sums, step_tiles, tile_sums
from ..session import staged
from ..operators.order import (
    Ranking, attach, benjamini_hochberg, exact_median, order_summary, quantile_strata, summary_quantiles, summary_rank_tests,
)
from ..operators.tiles import TILE_COL, WIDTH, meet, tiles_of

IP, INPUT = ("ip_r1", "ip_r2"), ("in_r1", "in_r2")


def copy_signal(features: DataFrame, track: DataFrame, sizes: DataFrame, samples: Sequence[str] = (*IP, *INPUT)) -> DataFrame:
    """Per copy, the signal of each sample in each orientation, absent signal as 0.

    A copy inside one tile whose id stands once gets its row there; only the others go by their ids.
    """
    samples = list(samples)
    length = (F.col("end_pos") - F.col("start_pos")).alias("length")
    names = [f"{s}_{o}" for s in samples for o in (SENSE, ANTISENSE)]
    listed = F.broadcast(sizes.where("chrom is not null").groupBy("chrom").agg(F.collect_list(F.struct("size")).alias("__sizes")))
    lo, hi = clip_to("start_pos", "end_pos", F.col("__sizes")[0]["size"])
    first, last = tiles_of("__lo", "__hi")
    marked = lone_ids(features).join(listed, "chrom", "left")
    marked = marked.withColumn("__lo", F.when(F.size("__sizes") == 1, lo)).withColumn("__hi", F.when(F.size("__sizes") == 1, hi))
    whole = F.coalesce(F.col("__alone") & (F.col("__lo") < F.col("__hi")) & (first == last), F.lit(False))
    keep = ["fid", "chrom", "strand", "subfamily", "family"]
    inside = marked.where(whole).select(*keep, length, F.col("__lo").alias("start_pos"), F.col("__hi").alias("end_pos"), first.alias(TILE_COL))
    schema = StructType([*inside.select(*keep, "length").schema, *[StructField(n, DoubleType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        plus, minus = (np.array([v == s for v in left.column("strand").to_pylist()], bool) for s in "+-")
        made = {n: np.zeros(left.num_rows) for n in names}
        for (sample, strand), sums, _ in tile_sums(left, right, ("sample", "track_strand"), WIDTH):
            if sample in samples:
                same = (plus & (strand == "pos")) | (minus & (strand == "neg"))
                signal = sums.fill_null(0.0).to_numpy()
                made[f"{sample}_{SENSE}"] += np.where(same, signal, 0.0)
                made[f"{sample}_{ANTISENSE}"] += np.where(same, 0.0, signal)
        return pa.table({**{c: left.column(c) for c in (*keep, "length")}, **made}).cast(arrow)

    found = meet(inside, step_tiles(track), ["chrom"], scan, schema)
    rest = marked.where(~whole).select(*features.columns)
    sums = signal_sums(clip_spans(rest, sizes), track, ["fid", "strand"])
    sums = sums.withColumn("orientation", track_orientation("track_strand", "strand"))
    wide = [
        F.sum(F.when((F.col("sample") == s) & (F.col("orientation") == o), F.col("signal"))).alias(f"{s}_{o}")
        for s in samples
        for o in (SENSE, ANTISENSE)
    ]
    per_copy = sums.groupBy("fid").agg(*wide)
    filled = [F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]
    return found.unionByName(rest.join(per_copy, "fid", "left").select(*keep, length, *filled))


def densities(signal: DataFrame, totals: DataFrame, samples: Sequence[str] = (*IP, *INPUT)) -> DataFrame:
    """One row per (copy, orientation) with each sample's density, scaled by the library file it was read from."""
    picks = [
        F.max(F.when((F.col("sample") == s) & (F.col("track_strand") == t), F.col("total"))).alias(f"__{s}_{t}")
        for s in samples
        for t in ("pos", "neg")
    ]
    lib = F.broadcast(totals.agg(*picks).withColumn("__all", F.lit(0)))
    both = F.explode(F.array(F.lit(SENSE), F.lit(ANTISENSE)))
    rows = signal.withColumn("orientation", both).withColumn("__all", F.lit(0)).join(lib, "__all")
    from_pos = (F.col("strand") == "+") == (F.col("orientation") == SENSE)

    def density(s: str) -> Column:
        v = F.when(F.col("orientation") == SENSE, F.col(f"{s}_{SENSE}")).otherwise(F.col(f"{s}_{ANTISENSE}"))
        total = F.when(from_pos, F.col(f"__{s}_pos")).otherwise(F.col(f"__{s}_neg"))
        return (v / (F.col("length") * total) * 1e9).alias(f"d_{s}")

    return rows.select("fid", "subfamily", "family", "length", "orientation", *[density(s) for s in samples])


def log_ratios(dens: DataFrame, min_input_frac: float = 0.25, ip=IP, inputs=INPUT) -> DataFrame:
    """Rows at or above the orientation's input floor, with the log2 ratio and the replicates' own ratios.

    What they are made of is written out, so the rows may be used several times.
    """
    total = lambda names: sum((F.col(f"d_{s}") for s in names[1:]), F.col(f"d_{names[0]}"))
    rows = dens.withColumn("input", total(inputs))
    # A floor above 0 keeps no row without input, and most copies have none. The ratios follow from these rows and the floor.
    rows = staged(rows.where("input > 0") if min_input_frac > 0 else rows)
    floor = staged(exact_median(rows.where("input > 0"), ["orientation"], "input", "__median"))
    rows = attach(rows, floor, ["orientation"]).withColumn("floor", F.col("__median") * min_input_frac).withColumn("ip", total(ip))
    eps = F.col("floor") * 0.5
    fold = lambda a, b, k=1.0: F.log2((F.col(a) * k + eps) / (F.col(b) * k + eps))
    scale = float(len(ip))
    reps = {f"l2_rep{i + 1}": fold(f"d_{a}", f"d_{b}", scale) for i, (a, b) in enumerate(zip(ip, inputs))}
    return rows.where(F.col("input") >= F.col("floor")).withColumns({"l2": fold("ip", "input"), **reps}).drop("__median")


def enrich(ratios: DataFrame, all_copies: DataFrame, min_copies: int = 20) -> DataFrame:
    """Subfamily medians against the orientation's background, rank test and q over the whole table."""
    key = ["orientation", "subfamily"]
    summary = order_summary(ratios, {
        "pool": Ranking("l2", ("orientation",), "subfamily"), "l2": Ranking("l2", tuple(key)), "input": Ranking("input", tuple(key)),
    })
    tests = summary_rank_tests(summary, "pool", ["orientation"], "subfamily")
    shape = ratios.groupBy(*key, "family").agg(F.avg((F.col("l2") > 0).cast("double")).alias("frac_positive"))
    out = (
        tests.where(F.col("n_group") >= min_copies)
        .join(shape, key)
        .join(summary_quantiles(summary, "l2", key, {"median_l2": 0.5}), key)
        .join(summary_quantiles(summary, "input", key, {"median_input": 0.5}), key)
        .join(summary_quantiles(summary, "pool", ["orientation"], {"bg_median_l2": 0.5}), "orientation")
        .join(all_copies.groupBy("subfamily").agg(F.count(F.lit(1)).alias("n_total")), "subfamily")
    )
    out = out.withColumn("delta", F.col("median_l2") - F.col("bg_median_l2"))
    return benjamini_hochberg(out, "p", "q").select(
        "subfamily", "family", "orientation", F.col("n_group").alias("n_copies"), "n_total", "median_l2",
        "bg_median_l2", "delta", "frac_positive", "median_input", "p", "q",
    )


def category_profile(ratios: DataFrame, min_copies: int = 20) -> DataFrame:
    """Per category: median ratio, input density, length and replicate ratios, for the correlation diagnostics."""
    key = ["orientation", "subfamily"]
    out = ratios.groupBy(*key).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") >= min_copies)
    columns = ("l2", "input", "length", "l2_rep1", "l2_rep2")
    summary = order_summary(ratios, {c: Ranking(c, tuple(key)) for c in columns})
    for column in columns:
        out = out.join(summary_quantiles(summary, column, key, {f"median_{column}": 0.5}), key)
    return out


def group_profile(rows: DataFrame, group: str) -> DataFrame:
    """Size, median length and median input density of named groups."""
    named = rows.where(F.col(group).isNotNull())
    sizes = named.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    summary = order_summary(named, {c: Ranking(c, (group,)) for c in ("length", "input")})
    for column in ("length", "input"):
        sizes = sizes.join(summary_quantiles(summary, column, [group], {f"median_{column}": 0.5}), group)
    return sizes


def length_band(length: str, edges: Sequence[float]) -> Column:
    """Index of the right-open length band, null outside the bands."""
    c = F.col(length)
    band = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        band = F.when((c >= edges[k]) & (c < edges[k + 1]), k).otherwise(band)
    return band


def input_strata(ratios: DataFrame, strata: int, scope: Sequence[str] = ("orientation",)) -> DataFrame:
    """Input-density quantile strata of the tested copies."""
    return quantile_strata(ratios, "input", strata, "stratum", scope=scope)
