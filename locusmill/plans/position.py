"""Binned signal axes against element copies, with confounder strata taken out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.intervals import floor_div, midpoint, overlap_bp
from ..functions.special import NAN, is_finite
from ..operators.coverage import bin_grid, bin_sums
from ..operators.intervals import tile
from ..operators.order import quantile_strata

BIN = ("chrom", "bin")


def base_composition(lines: DataFrame, binsize: int) -> DataFrame:
    """Letter counts per bin; a line over a bin edge is cut there."""
    spans = lines.withColumn("end_off", F.col("start_off") + F.length("seq")).where("end_off > start_off")
    cut = tile(spans, "start_off", "end_off", binsize, "bin")
    lo = F.greatest(F.col("start_off"), F.col("bin") * binsize)
    hi = F.least(F.col("end_off"), (F.col("bin") + 1) * binsize)
    piece = F.substring(F.col("seq"), (lo - F.col("start_off") + 1).cast("int"), (hi - lo).cast("int"))
    cut = cut.select(*BIN, piece.alias("piece"))
    count = lambda letters: F.length("piece") - F.length(F.translate("piece", letters, ""))
    return cut.groupBy(*BIN).agg(
        F.sum(count("GCgc")).alias("n_gc"), F.sum(count("ATat")).alias("n_at"), F.sum(F.length("piece")).alias("total")
    )


def covariates(sizes: DataFrame, lines: DataFrame, satellite: DataFrame, binsize: int) -> DataFrame:
    """GC share of called bases (NaN without any), share of uncalled bases (1 without any base), satellite share."""
    comp = base_composition(lines, binsize)
    sat = bin_sums(satellite.withColumn("__v", F.lit(1)), "__v", binsize).withColumnRenamed("amount", "__sat")
    full = bin_grid(sizes, binsize).join(comp, list(BIN), "left").join(sat, list(BIN), "left").na.fill(0)
    called = F.col("n_gc") + F.col("n_at")
    return full.select(
        *BIN,
        F.when(called > 0, F.col("n_gc") / called).otherwise(F.lit(NAN)).alias("gc_frac"),
        F.when(F.col("total") > 0, (F.col("total") - called) / F.col("total")).otherwise(F.lit(1.0)).alias("n_frac"),
        (F.col("__sat") / binsize).alias("sat_frac"),
    )


def timing(track: DataFrame, grid: DataFrame, fractions: Sequence[str], binsize: int) -> DataFrame:
    """Depth-scaled weighted mean of the ordered fractions per bin (null signal gives NaN) and the scaled total."""
    amounts = bin_sums(track.where(F.col("sample").isin(list(fractions))), "value", binsize, ["sample"])
    amounts = amounts.join(grid, list(BIN), "left_semi").withColumn("__f", F.col("amount") / binsize)
    scale = amounts.groupBy("sample").agg(F.sum("__f").alias("__s"))
    mean = scale.agg(F.avg("__s")).scalar()
    order = F.array_position(F.array(*[F.lit(f) for f in fractions]), F.col("sample"))
    scaled = amounts.join(scale, "sample").withColumn("__fn", F.col("__f") / F.col("__s") * mean)
    per_bin = scaled.groupBy(*BIN).agg(F.sum("__fn").alias("s_total"), F.sum(F.col("__fn") * order).alias("__w"))
    out = grid.join(per_bin, list(BIN), "left").na.fill(0.0, ["s_total", "__w"])
    rt = F.when(F.col("s_total") > 0, F.col("__w") / F.col("s_total")).otherwise(F.lit(NAN))
    return out.select(*BIN, rt.alias("rt"), "s_total")


def fraction_coverage(track: DataFrame, grid: DataFrame, binsize: int) -> DataFrame:
    """Share of bins with signal per fraction; a fraction well below half was misread rather than sparse."""
    amounts = bin_sums(track, "value", binsize, ["sample"]).join(grid, list(BIN), "left_semi")
    n = grid.select(F.count(F.lit(1))).scalar()
    return amounts.where("amount > 0").groupBy("sample").agg((F.count(F.lit(1)) / n).alias("covered"))


def check_coverage(coverage: DataFrame, least: float = 0.5) -> None:
    bad = [r["sample"] for r in coverage.where(F.col("covered") < least).select("sample").collect()]
    if bad:
        raise ValueError(f"fractions {bad} cover under {least:.0%} of the bins; check how their values were read")


def timing_direction(rt: DataFrame, cov: DataFrame) -> DataFrame:
    """Correlation of timing with GC and what it says: GC-rich bins replicate early."""
    both = rt.join(cov, list(BIN)).where(is_finite("rt") & is_finite("gc_frac") & (F.col("s_total") > 0))
    r = both.agg(F.corr("rt", "gc_frac").alias("r"), F.count(F.lit(1)).alias("n_bins"))
    says = F.when(F.col("r") < -0.2, "low_is_early").when(F.col("r") > 0.2, "low_is_late").otherwise("too_weak")
    return r.withColumn("direction", says)


def axis_means(track: DataFrame, axes: dict[str, Sequence[str]], binsize: int) -> DataFrame:
    """One column per axis: the mean over its replicates, only where every replicate covers the bin."""
    rows = track.select("sample", "chrom", "start_pos", "end_pos", "value")
    cut = tile(rows, "start_pos", "end_pos", binsize, "bin")
    bases = overlap_bp("start_pos", "end_pos", F.col("bin") * binsize, (F.col("bin") + 1) * binsize)
    per_rep = cut.groupBy("sample", *BIN).agg((F.sum(F.col("value") * bases) / F.sum(bases)).alias("v"))
    pick = lambda reps: F.when(F.col("sample").isin(list(reps)), F.col("v"))
    cols = [
        F.when(F.count(pick(reps)) == len(reps), F.avg(pick(reps))).alias(name) for name, reps in axes.items()
    ]
    return per_rep.groupBy(*BIN).agg(*cols)


def usable_bins(
    table: DataFrame, axes: Sequence[str], max_n: float = 0.1, max_sat: float = 0.1, with_timing: bool = False,
    min_s_total: float = 0.0,
) -> Column:
    """False for gap, satellite or GC-less bins and wherever an axis is missing or exactly 0."""
    ok = (F.col("n_frac") < max_n) & (F.col("sat_frac") < max_sat) & is_finite("gc_frac")
    for axis in axes:
        ok = ok & is_finite(axis) & (F.col(axis) != 0)
    if with_timing:
        ok = ok & is_finite("rt") & (F.col("s_total") >= min_s_total)
    return F.coalesce(ok, F.lit(False))


def expectations(
    table: DataFrame, axes: Sequence[str], covariate: str = "gc", strata: int = 50, joint: int = 10, min_cell: int = 20
) -> DataFrame:
    """Each usable bin's expected value per axis from its stratum.

    ``both`` crosses GC and timing strata; cells under ``min_cell`` bins take the mean of their GC stratum.
    """
    if covariate not in ("gc", "rt", "both"):
        raise ValueError(f"unknown covariate {covariate!r}; choose gc, rt or both")
    bins = table.where("usable")
    marginal = quantile_strata(bins, "gc_frac", strata, "__m")
    if covariate == "both":
        cells = quantile_strata(quantile_strata(marginal, "gc_frac", joint, "__g"), "rt", joint, "__r")
        cells = cells.withColumn("__cell", F.col("__g") * joint + F.col("__r")).drop("__g", "__r")
    elif covariate == "rt":
        cells = quantile_strata(marginal, "rt", strata, "__cell")
    else:
        cells = marginal.withColumn("__cell", F.col("__m"))
    need = min_cell if covariate == "both" else 1
    means = cells.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"), *[F.avg(a).alias(f"__c_{a}") for a in axes])
    means = means.where(F.col("__n") >= need).drop("__n")
    fallback = cells.groupBy("__m").agg(*[F.avg(a).alias(f"__f_{a}") for a in axes])
    out = cells.join(means, "__cell", "left").join(fallback, "__m")
    expect = [F.coalesce(f"__c_{a}", f"__f_{a}").alias(f"expect_{a}") for a in axes]
    return out.select(*BIN, *[c for c in table.columns if c not in BIN], F.col("__cell").alias("stratum"), *expect)


def copies_in_bins(features: DataFrame, bins: DataFrame, binsize: int) -> DataFrame:
    """Copies per (family, subfamily, bin) by midpoint, over the given bins."""
    placed = features.withColumn("bin", floor_div(midpoint("start_pos", "end_pos"), binsize))
    counts = placed.groupBy("family", "subfamily", *BIN).agg(F.count(F.lit(1)).alias("w"))
    return counts.join(bins, list(BIN))


def position_table(
    copies: DataFrame, bins: DataFrame, axes: Sequence[str], contrast: tuple[str, str] | None = None, min_bins: int = 30
) -> DataFrame:
    """Copy-weighted means with bin-clustered standard errors for the background, families and subfamilies.

    Every statistic comes raw and as a residual from the stratum expectation; ``contrast`` adds the difference of two
    axes. ``n_eff`` is the Kish effective size. Subfamilies need ``min_bins`` distinct bins.
    """
    values = {a: F.col(a) for a in axes} | {f"{a}_resid": F.col(a) - F.col(f"expect_{a}") for a in axes}
    if contrast:
        x, y = contrast
        values["contrast"] = F.col(x) - F.col(y)
        values["contrast_resid"] = (F.col(x) - F.col(f"expect_{x}")) - (F.col(y) - F.col(f"expect_{y}"))
    valued = copies.select("family", "subfamily", *BIN, "w", "gc_frac", *[c.alias(f"v_{n}") for n, c in values.items()])
    names = [f"v_{n}" for n in values]
    # A bin's values are the same on all its rows, so their minimum carries them through the grouping sets.
    sets = valued.groupingSets(
        [["family", *BIN], ["family", "subfamily", *BIN]], "family", "subfamily", *BIN
    ).agg(F.grouping("subfamily").alias("__g"), F.sum("w").alias("w"), F.min("gc_frac").alias("gc_frac"),
          *[F.min(n).alias(n) for n in names])
    level = F.when(F.col("__g") == 1, "family").otherwise("subfamily")
    per_bin = sets.withColumn("level", level).withColumn("name", F.coalesce("subfamily", "family"))
    key = ["level", "name", "family"]
    w = F.col("w").cast("double")
    chrom = per_bin.groupBy(*key, "chrom").agg(F.count(F.lit(1)).alias("__b"), F.sum(w).alias("__w"))
    top = chrom.groupBy(*key).agg((F.max("__b") / F.sum("__b")).alias("top_chrom_frac"))
    sums = per_bin.groupBy(*key).agg(
        F.sum("w").alias("n_copies"), F.count(F.lit(1)).alias("n_bins"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"),
        (F.sum(w * F.col("gc_frac")) / F.sum(w)).alias("gc_mean"),
        *[(F.sum(w * F.col(n)) / F.sum(w)).alias(n.replace("v_", "m_", 1)) for n in names],
    )
    spread = per_bin.join(sums.select(*key, *[n.replace("v_", "m_", 1) for n in names]), key).groupBy(*key).agg(*[
        F.when(F.count(F.lit(1)) > 1, F.sqrt(F.sum(w * w * F.pow(F.col(n) - F.col(n.replace("v_", "m_", 1)), 2))) / F.sum(w))
        .otherwise(F.lit(NAN)).alias(n.replace("v_", "se_", 1))
        for n in names
    ])
    out = sums.join(spread, key).join(top, key).where((F.col("level") != "subfamily") | (F.col("n_bins") >= min_bins))
    cols = [
        *key, "n_copies", "n_bins", "n_eff", (F.col("n_copies") / F.col("n_bins")).alias("copies_per_bin"),
        "top_chrom_frac", "gc_mean",
        *[c for n in values for c in (F.col(f"m_{n}").alias(f"{n}_mean"), F.col(f"se_{n}").alias(f"{n}_se"))],
    ]
    n = F.count(F.lit(1))
    back = bins.agg(
        F.lit("background").alias("level"), F.lit("all_usable_bins").alias("name"), F.lit("-").alias("family"),
        n.alias("n_copies"), n.alias("n_bins"), n.cast("double").alias("n_eff"), F.lit(1.0).alias("copies_per_bin"),
        F.lit(NAN).alias("top_chrom_frac"), F.avg("gc_frac").alias("gc_mean"),
        *[c for name, value in values.items() for c in (
            (F.lit(0.0) if name.endswith("_resid") else F.avg(value)).alias(f"{name}_mean"), F.lit(NAN).alias(f"{name}_se")
        )],
    )
    return back.unionByName(out.select(*cols))


def by_covariate_stratum(bins: DataFrame, covariate: str, axes: Sequence[str], strata: int = 10) -> DataFrame:
    """Mean axis values per covariate stratum."""
    cut = quantile_strata(bins, covariate, strata, "stratum")
    return cut.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_bins"), *[F.avg(a).alias(a) for a in axes])


def chromosome_driven(table: DataFrame, most: float = 0.15) -> DataFrame:
    """Subfamily rows whose bins sit on one chromosome too much to speak for the subfamily."""
    return table.where((F.col("level") == "subfamily") & (F.col("top_chrom_frac") > most))
