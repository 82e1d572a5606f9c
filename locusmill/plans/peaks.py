"""Peak sets against element subfamilies: replicates, enrichment screen, shift null, reports."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.special import INF, NAN, hypergeom_upper, is_finite, ratio
from ..operators.counting import CATEGORY, categories, dense_grid, distinct_loci, locus_counts, lone_ids, pooled
from ..operators.intervals import flat_offsets, intersect, merge, to_flat
from ..operators.order import benjamini_hochberg
from ..operators.shifts import moved_locus_counts
from ..session import staged

GROUP = ("cell_line", "sample")
POOL = ("cell_line",)
HIT = (*GROUP, *CATEGORY)

#: Peaks times permutations that one round of the shift null draws, unless its batch is given.
DRAWN = 200_000_000
#: The offset of a shift's number, a space's size and the columns that name what moves as one.
Offset = Callable[..., Column]


def hashed_offset(seed: int = 0) -> Offset:
    """A shift offset drawn afresh for every shift number and every key from a hash of the seed."""
    return lambda k, size, *key: F.pmod(F.xxhash64(F.lit(seed), k, *key), size)


def reproducible_peaks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(peaks present in both replicates, groups dropped with a reason)."""
    keys = [*GROUP, "chrom", "strand"]
    merged = staged(merge(raw, [*keys, "rep"]))
    shared = staged(intersect(merged.where("rep = 1"), merged.where("rep = 2"), keys))
    reps = raw.groupBy(*GROUP).agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    kept = shared.select(*GROUP).distinct().withColumn("__kept", F.lit(True))
    reason = F.when(F.size("reps") < 2, F.concat(F.lit("only replicate "), F.array_join("reps", "/"))).otherwise(
        "replicates share no peak"
    )
    dropped = reps.join(kept, list(GROUP), "left").where("__kept is null").select(*GROUP, reason.alias("reason"))
    return shared, dropped


def enrichment(features: DataFrame, peaks: DataFrame) -> DataFrame:
    """Loci per (group, category) against the other groups of the cell line, zero cells included.

    ``n_peaks`` counts every peak, also those on chromosomes without features.
    """
    totals = peaks.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_peaks"))
    pool_total = F.sum("n_peaks").over(W.partitionBy(*POOL))
    totals = totals.withColumn("n_pool", pool_total)
    grid = dense_grid(totals, categories(features))
    full = grid.join(locus_counts(features, peaks), list(HIT), "left").withColumn(
        "loci", F.coalesce("loci", F.lit(0).cast("long"))
    )
    full = pooled(full, POOL).withColumn("n_rest", F.col("n_pool") - F.col("n_peaks"))
    own, others = ratio("loci", "n_peaks"), ratio("rest", "n_rest")
    return full.withColumn("fold", ratio(own, others))


def screen(features: DataFrame, peaks: DataFrame) -> DataFrame:
    """Hypergeometric p and Benjamini-Hochberg q over all rows of a cell line."""
    table = enrichment(features, peaks)
    table = table.withColumn("p", hypergeom_upper("loci", "n_pool", "pooled", "n_peaks"))
    return benjamini_hochberg(table, "p", "q", POOL)


def significant(table: DataFrame, q_cut: float = 0.05) -> DataFrame:
    """Rows below the q cut with a finite fold above 1."""
    return table.where((F.col("q") < q_cut) & is_finite("fold") & (F.col("fold") > 1))


def robust(table: DataFrame, least_loci: int = 10, least_fold: float = 2.0, fold: str = "fold") -> DataFrame:
    """Rows on enough loci with a finite, large enough fold."""
    return table.where((F.col("loci") >= least_loci) & is_finite(fold) & (F.col(fold) >= least_fold))


def check_budget(max_perms: int, candidates: int, q_cut: float = 0.05) -> None:
    """Refuse a permutation budget whose smallest p cannot pass the correction."""
    if candidates and candidates / (max_perms + 1) >= q_cut:
        raise ValueError(
            f"{max_perms} permutations cannot resolve q < {q_cut} for {candidates} candidates; "
            f"use more than {int(candidates / q_cut)}"
        )


def shift_null(
    features: DataFrame,
    peaks: DataFrame,
    candidates: DataFrame,
    max_perms: int,
    stop_at: int = 25,
    batch: int | None = None,
    eligible: DataFrame | None = None,
    offset: Offset | None = None,
    scramble: int | None = None,
) -> DataFrame:
    """Rigid circular shifts of each candidate group's peaks through the eligible space.

    The space is the union of all peaks of the cell line, or ``eligible`` (cell_line, chrom, start_pos, end_pos). One
    offset per permutation moves the whole set, starts move in the space and widths extend on the genome. Wide tiles of the
    genome count the features that the moved peaks hit, with no row for a peak and permutation. A group stops when all its
    candidates have ``stop_at`` exceedances; ``scramble`` replaces the observed arm by that draw for calibration.

    Without ``batch`` the first round has twice ``stop_at`` permutations, after which most groups stop, and each round
    twice as many as the one before, as long as the peaks still moving make no more than DRAWN rows.
    """
    offset = offset or hashed_offset()
    space = staged(flat_offsets(merge(peaks if eligible is None else eligible, [*POOL, "chrom"]), POOL, ["chrom"]))
    size = space.groupBy(*POOL).agg(F.sum("seg_len").alias("__size"))

    cands = candidates.select(*HIT).distinct()
    mine = peaks.join(cands.select(*GROUP).distinct(), list(GROUP), "left_semi")
    starts = mine.select(
        *GROUP, "chrom", F.col("strand").alias("peak_strand"), F.col("start_pos").alias("pos"),
        (F.col("end_pos") - F.col("start_pos")).alias("width"),
    ).distinct()
    flat = to_flat(starts, space, [*POOL, "chrom"]).join(size, list(POOL))
    flat = staged(flat.select(*GROUP, "peak_strand", "flat", "width", "__size"))

    # The features and the peaks are the same in every round; only where the peaks stand is not.
    wanted = staged(lone_ids(features.join(cands.select("subfamily").distinct(), "subfamily", "left_semi")))
    sets = staged(flat.where("width is not null").groupBy(*GROUP).agg(
        F.first("__size").alias("size"), F.collect_list(F.struct("flat", "width", "peak_strand")).alias("items")
    ))

    counted = moved_locus_counts(wanted, sets, space, cands, GROUP, POOL)

    def loci(groups: DataFrame, first: int, past: int, stays: bool = False) -> DataFrame:
        numbered = sets.join(groups, list(GROUP), "left_semi").select(*GROUP, "size").withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(past - 1))))
        by_so = F.lit(0) if stays else offset(F.col("perm"), F.col("size"), *map(F.col, GROUP))
        moves = numbered.groupBy(*GROUP).agg(F.collect_list(F.struct("perm", by_so.cast("long").alias("offset"))).alias("draws"))
        return counted(moves)

    every = cands.select(*GROUP).distinct()
    observed = (loci(every, 0, 1, stays=True) if scramble is None else loci(every, scramble, scramble + 1)).drop("perm")
    zero = F.lit(0).cast("long")
    state = staged(cands.join(observed, list(HIT), "left").select(
        *HIT, F.coalesce("loci", zero).alias("observed"), zero.alias("exceed"), zero.alias("null_sum"), zero.alias("done")
    ))
    placed = staged(flat.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__peaks")))

    done, planned = 0, 2 * stop_at
    while done < max_perms:
        going = state.where(F.col("exceed") < stop_at).select(*GROUP).distinct().join(placed, list(GROUP))
        live = going.agg(F.sum("__peaks")).first()[0]
        if not live:
            break
        going = going.drop("__peaks")
        step = min(batch or max(1, min(planned, DRAWN // live)), max_perms - done)
        planned *= 2
        drawn = loci(going, done, done + step).join(state.select(*HIT, "observed"), list(HIT))
        tally = drawn.groupBy(*HIT).agg(
            F.count(F.lit(1)).alias("__seen"),
            F.sum((F.col("loci") >= F.col("observed")).cast("long")).alias("__over"),
            F.sum("loci").alias("__sum"),
        )
        active = going.withColumn("__step", F.lit(step).cast("long"))
        new = state.join(active, list(GROUP), "left").join(tally, list(HIT), "left")
        ran = F.coalesce("__step", zero)
        unseen = F.when(F.col("observed") == 0, ran - F.coalesce("__seen", zero)).otherwise(zero)
        state = staged(new.select(
            *HIT, "observed",
            (F.col("exceed") + F.coalesce("__over", zero) + unseen).alias("exceed"),
            (F.col("null_sum") + F.coalesce("__sum", zero)).alias("null_sum"),
            (F.col("done") + ran).alias("done"),
        ))
        done += step

    expected = ratio("null_sum", "done")
    out = state.select(
        *HIT, "observed", F.col("done").alias("n_perm"), "exceed",
        ((F.col("exceed") + 1) / (F.col("done") + 1)).alias("p_perm"),
        expected.alias("expected"),
        F.when(F.col("done") == 0, F.lit(NAN)).when(F.col("null_sum") == 0, F.lit(INF))
        .otherwise(ratio("observed", expected)).alias("fold_perm"),
    )
    return benjamini_hochberg(out, "p_perm", "q_perm", POOL)


def permutation_analysis(
    features: DataFrame,
    peaks: DataFrame,
    max_perms: int,
    q_cut: float = 0.05,
    candidate: Callable[[DataFrame], DataFrame] = significant,
    refuse: bool = True,
    **null,
) -> DataFrame:
    """Screen, candidates, budget, shift null and the final table, by cell line, p and falling fold.

    A budget too small for the candidates of a cell line is an error, or without ``refuse`` a warning: the table is right then,
    but its smallest q may be above the cut. ``significant`` marks the rows that the null keeps;
    the rest of ``null`` goes to ``shift_null``.
    """
    chosen = staged(candidate(screen(features, peaks)))
    most = chosen.groupBy(*POOL).count().agg(F.max("count")).first()[0]
    try:
        check_budget(max_perms, most or 0, q_cut)
    except ValueError as small:
        if refuse:
            raise
        warnings.warn(str(small), stacklevel=2)
    carried = chosen.select(*HIT, "pooled", F.col("fold").alias("fold_pooled"), F.col("q").alias("q_screen"))
    out = shift_null(features, peaks, chosen, max_perms, **null).join(carried, list(HIT))
    out = out.withColumn("significant", F.col("q_perm") < q_cut)
    return out.orderBy(*POOL, "p_perm", F.desc("fold_pooled"), *GROUP[len(POOL):], *CATEGORY)


def loci_report(features: DataFrame, peaks: DataFrame, hits: DataFrame, families: Sequence[str]) -> DataFrame:
    """Distinct loci behind the hits of each cell line, in total and per family."""
    loci = distinct_loci(features, peaks, hits, POOL, GROUP, "family")
    per_family = [F.sum((F.col("family") == f).cast("long") * F.col("n_loci")).alias(f"loci_{f}") for f in families]
    counted = loci.groupBy(*POOL).agg(F.sum("n_loci").alias("distinct_loci"), *per_family)
    sizes = hits.groupBy(*POOL).agg(
        F.count_distinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_hits")
    )
    return sizes.join(counted, list(POOL), "left")


def top_by_fold(table: DataFrame, n: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(top n rows per orientation by fold, totals per orientation and family)."""
    order = W.partitionBy("orientation").orderBy(F.col(fold).desc(), *GROUP, "subfamily")
    top = table.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    totals = table.groupBy("orientation", "family").agg(F.count(F.lit(1)).alias("n_hits"))
    return top, totals


def fold_bin(fold: str = "fold", edges: Sequence[float] = (1, 2, 4, 6, 10)) -> Column:
    """Colour-scale step of a fold: null for NaN, the last step for infinity."""
    f = F.col(fold)
    step = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        step = F.when(f < float(edges[k]), k).otherwise(step)
    return F.when(F.isnan(f) | f.isNull(), F.lit(None).cast("int")).when(f == F.lit(INF), len(edges)).otherwise(step)


def replication(
    table: DataFrame, confirmed: DataFrame, cells: Sequence[str], per_family: int, least_loci: int = 10,
    least_fold: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """(hit x cell line grid, top hits per family by the number of cell lines where they are robust, then fold)."""
    key = ["sample", *CATEGORY, "family"]
    marked = table.join(confirmed.select(*HIT).distinct().withColumn("__ok", F.lit(True)), list(HIT), "left")
    # A NaN fold compares above every number here, as Spark orders it; the confirmed hits never have one.
    solid = F.coalesce("__ok", F.lit(False)) & (F.col("loci") >= least_loci) & (F.col("fold") >= least_fold)
    marked = marked.withColumn("robust", solid & ~F.isnan("fold")).withColumn("fold_bin", fold_bin())
    cell = [
        F.first(F.struct("fold", "robust", "fold_bin")).alias("v"),
    ]
    grid = marked.groupBy(*key).pivot("cell_line", list(cells)).agg(*cell)
    wide = [c for name in cells for c in (
        F.col(f"`{name}`.fold").alias(f"fold_{name}"),
        F.col(f"`{name}`.robust").alias(f"robust_{name}"),
        F.col(f"`{name}`.fold_bin").alias(f"bin_{name}"),
    )]
    # One row per cell line at most, so the per-hit median is over a handful of values.
    ranked = marked.where("robust").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_cells"), F.median("fold").alias("median_fold")
    )
    best = W.partitionBy("family").orderBy(F.col("n_cells").desc(), F.col("median_fold").desc(), "sample", *CATEGORY)
    top = ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_family)
    return grid.select(*key, *wide), top


def key_changes(old: DataFrame, new: DataFrame, keys: Sequence[str] = HIT) -> DataFrame:
    """Keys lost from ``old`` and gained in ``new``."""
    lost = old.select(*keys).distinct().join(new.select(*keys), list(keys), "left_anti").withColumn("change", F.lit("lost"))
    gained = new.select(*keys).distinct().join(old.select(*keys), list(keys), "left_anti")
    return lost.unionByName(gained.withColumn("change", F.lit("gained")))


def off_index(peaks: DataFrame, features: DataFrame) -> DataFrame:
    """Peaks per chromosome that carries no feature."""
    return peaks.join(features.select("chrom").distinct(), "chrom", "left_anti").groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n_peaks")
    )
