"""Binned contact matrix: masking, compartments, and anchors against promoters over expected."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.intervals import floor_div, midpoint
from ..functions.special import INF, NAN, is_finite, ratio
from ..operators.coverage import point_bins
from ..operators.intervals import running_total
from ..operators.order import benjamini_hochberg, exact_median, sample_per_group
from ..session import staged
from .peaks import Offset, hashed_offset

#: A whole number for a step and the columns of what is drawn for.
Draw = Callable[..., Column]


def at_resolution(table: DataFrame, resolution: int) -> DataFrame:
    """Rows of one resolution; an unknown one is an error that lists those present."""
    got = table.where(F.col("resolution") == resolution)
    if got.isEmpty():
        known = sorted(r["resolution"] for r in table.select("resolution").distinct().collect())
        raise ValueError(f"resolution {resolution} not present; available: {known}")
    return got.drop("resolution")


def shared_chroms(features: DataFrame, sizes: DataFrame) -> DataFrame:
    """Usable and dropped elements per chromosome, for the loss report."""
    known = sizes.select("chrom").withColumn("__known", F.lit(True))
    counts = features.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, "chrom", "left").select("chrom", "n", F.col("__known").isNotNull().alias("usable"))


def element_bins(
    features: DataFrame, sizes: DataFrame, binsize: int, families: Sequence[str] | None = None,
    subfamilies: Sequence[str] | None = None, min_copies: int = 0,
) -> DataFrame:
    """Elements with the bin of their midpoint; positions past the chromosome end drop out."""
    rows = features
    if families:
        rows = rows.where(F.col("family").isin(list(families)))
    if subfamilies:
        rows = rows.where(F.col("subfamily").isin(list(subfamilies)))
    if min_copies:
        big = rows.groupBy("subfamily").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_copies)
        rows = rows.join(big, "subfamily", "left_semi")
    placed = rows.join(sizes.select("chrom", "size"), "chrom").withColumn("mid", midpoint("start_pos", "end_pos"))
    return point_bins(placed.where("mid >= 0 and mid < size"), binsize, "mid").drop("size")


def masking_report(elements: DataFrame, weights: DataFrame, group: str = "subfamily") -> DataFrame:
    """Copies per group in bins without a finite weight."""
    ok = weights.where(is_finite("weight")).select("chrom", "bin", F.lit(1).alias("__ok"))
    counts = elements.join(ok, ["chrom", "bin"], "left").groupBy(group).agg(
        F.count(F.lit(1)).alias("n_copies"), F.count("__ok").alias("n_valid")
    )
    masked = F.col("n_copies") - F.col("n_valid")
    return counts.withColumn("n_masked", masked).withColumn("frac_masked", masked / F.col("n_copies"))


def tss_per_bin(tss: DataFrame, bins: DataFrame, binsize: int) -> DataFrame:
    """Transcription start sites per bin, aligned to the bins."""
    counts = point_bins(tss, binsize).groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("n_tss"))
    return bins.join(counts, ["chrom", "bin"], "left").na.fill(0, ["n_tss"])


def phase_compartments(eigen: DataFrame, tss: DataFrame, binsize: int) -> DataFrame:
    """Flip the sign of E1 per chromosome so that it rises with the density of start sites."""
    dense = tss_per_bin(tss, eigen, binsize)
    signs = dense.where(is_finite("e1")).groupBy("chrom").agg(F.corr("e1", "n_tss").alias("__r"))
    sign = F.when(F.col("__r") < 0, -1.0).otherwise(1.0)
    return dense.join(signs, "chrom", "left").select("chrom", "bin", "n_tss", (F.col("e1") * sign).alias("e1"))


def compartments(elements: DataFrame, eigen: DataFrame, masking: DataFrame) -> DataFrame:
    """Share of each subfamily's copies in A bins against the share of bins, with mean and median E1."""
    scored = elements.join(eigen.where(is_finite("e1")).select("chrom", "bin", "e1"), ["chrom", "bin"])
    share = F.avg((F.col("e1") > 0).cast("double"))
    background = eigen.where(is_finite("e1")).agg(share.alias("b")).scalar()
    out = scored.groupBy("family", "subfamily").agg(
        F.count(F.lit(1)).alias("n_scored"), share.alias("frac_a"), F.avg("e1").alias("mean_e1")
    )
    out = out.withColumn("frac_a_minus_bg", F.col("frac_a") - background)
    out = out.join(exact_median(scored, ["subfamily"], "e1", "median_e1"), "subfamily")
    return out.join(masking.select("subfamily", "n_copies", "frac_masked"), "subfamily")


def _valid(weights: DataFrame) -> DataFrame:
    return weights.where(is_finite("weight")).select("chrom", "bin", "weight")


def expected_by_distance(pixels: DataFrame, weights: DataFrame, max_dist: int) -> DataFrame:
    """Mean balanced value per (chrom, separation) over all pairs of valid bins, absent pixels counting as 0.

    Pairs of valid bins are counted by taking away from all pairs of the chromosome's bins those with a masked end; only
    masked bins are paired with each other.
    """
    ok = _valid(weights)
    i = ok.withColumnsRenamed({"bin": "i", "weight": "__wi"})
    j = ok.withColumnsRenamed({"bin": "j", "weight": "__wj"})
    near = pixels.where(F.col("j") - F.col("i") <= max_dist).join(i, ["chrom", "i"]).join(j, ["chrom", "j"])
    sums = near.groupBy("chrom", (F.col("j") - F.col("i")).alias("dist")).agg(
        F.sum(F.col("n") * F.col("__wi") * F.col("__wj")).alias("total")
    )
    most = F.lit(max_dist).cast("long")
    spans = weights.groupBy("chrom").agg(F.min("bin").cast("long").alias("lo"), F.max("bin").cast("long").alias("hi"))
    grid = spans.select("chrom", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("bin"))
    masked = grid.join(ok, ["chrom", "bin"], "left_anti")
    # A masked bin is an end of pairs up to the chromosome's last bin and down to its first one.
    ends = masked.select("chrom", F.explode(F.array(F.col("hi") - F.col("bin"), F.col("bin") - F.col("lo"))).alias("far"))
    ends = ends.groupBy("chrom", F.least("far", most).alias("dist")).agg(F.count(F.lit(1)).alias("__ends"))
    reach = masked.select("chrom", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.least(most, F.col("hi") - F.col("bin")))).alias("dist"))
    other = masked.select("chrom", F.col("bin").alias("__other"))
    both = reach.withColumn("__other", F.col("bin") + F.col("dist")).join(other, ["chrom", "__other"], "left_semi")
    both = both.groupBy("chrom", "dist").agg(F.count(F.lit(1)).alias("__both"))
    table = spans.select("chrom", (F.col("hi") - F.col("lo") + 1).alias("__n"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.least(most, F.col("hi") - F.col("lo")))).alias("dist"))
    table = table.join(ends, ["chrom", "dist"], "left").join(both, ["chrom", "dist"], "left").join(sums, ["chrom", "dist"], "left")
    farther = W.partitionBy("chrom").orderBy(F.col("dist").desc()).rowsBetween(W.unboundedPreceding, 0)
    pairs = F.col("__n") - F.col("dist") - F.sum(F.coalesce("__ends", F.lit(0))).over(farther) + F.coalesce("__both", F.lit(0))
    out = table.select("chrom", "dist", pairs.alias("n_pairs"), F.coalesce("total", F.lit(0.0)).alias("total")).where("n_pairs > 0")
    return out.withColumn("expected", F.col("total") / F.col("n_pairs"))


def smooth_expected(expected: DataFrame, half_width: float = 0.1, pooled: bool = True) -> DataFrame:
    """Sums and pairs pooled over separations within ``half_width`` in log2, and over chromosomes unless not ``pooled``.

    The table is separations by chromosomes; pooled, its scan has one row per separation.
    """
    # Window ranges are whole numbers, so the logarithm is taken in millionths; separation 0 stands apart.
    step = 1_000_000
    x = F.when(F.col("dist") == 0, F.lit(-100 * step)).otherwise(F.round(F.log2(F.col("dist").cast("double")) * step))
    reach = round(half_width * step)
    scope = [] if pooled else ["chrom"]
    table = expected.groupBy(*scope, "dist").agg(F.sum("total").alias("__t"), F.sum("n_pairs").alias("__n")).withColumn("__x", x.cast("long"))
    near = W.partitionBy(*(scope or [F.lit(0)])).orderBy("__x").rangeBetween(-reach, reach)
    table = table.select(*scope, "dist", (F.sum("__t").over(near) / F.sum("__n").over(near)).alias("expected"))
    return expected.drop("expected").join(table, [*scope, "dist"])


def band_ranks(bins: DataFrame, tss_bins: DataFrame, min_dist: int, max_dist: int) -> tuple[DataFrame, DataFrame]:
    """(chrom, bin and the ranks r1 to r2 and r3 to r4, ends excluded, of the promoter bins in its band; promoter ranks).

    Promoter bins are numbered from 0 along their chromosome. A band is two runs of ranks, found by counting the promoter
    bins below its four ends; no bin meets its promoters.
    """
    starts = tss_bins.select("chrom", F.col("bin").cast("long").alias("__x")).distinct()
    # The bin itself is in the upper half.
    edges = [-max_dist, 1 - max(min_dist, 1), min_dist, max_dist + 1]
    own = bins.select("chrom", F.col("bin").cast("long").alias("bin")).distinct()
    asked = own.withColumn("__e", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("bin") + e).alias("x")) for k, e in enumerate(edges)])))
    asked = asked.select("chrom", "bin", "__e.k", F.col("__e.x").alias("__x"))
    places = starts.withColumn("__one", F.lit(1)).unionByName(asked.select("chrom", "__x", F.lit(0).alias("__one")))
    places = places.groupBy("chrom", "__x").agg(F.max("__one").cast("long").alias("__one"))
    below = running_total(places, ["chrom"], "__x", "__one", "rank")
    ranks = below.where("__one = 1").select("chrom", F.col("__x").alias("tss_bin"), "rank")
    held = asked.join(below.select("chrom", "__x", "rank"), ["chrom", "__x"]).groupBy("chrom", "bin").agg(
        *[F.max(F.when(F.col("k") == k, F.col("rank"))).alias(f"r{k + 1}") for k in range(4)]
    )
    return held, ranks


def hashed_draw(seed: int = 0) -> Draw:
    """A whole number from a hash of the seed, what is drawn for, and the step."""
    return lambda step, *key: F.pmod(F.xxhash64(F.lit(seed), *key, step), F.lit(1 << 53))


def band_pairs(
    anchors: DataFrame,
    tss_bins: DataFrame,
    min_dist: int,
    max_dist: int,
    per_anchor: int | None = None,
    draw: Draw | None = None,
    anchor_key: Sequence[str] = ("fid",),
) -> DataFrame:
    """Anchors with promoter bins between the two separations: all, or ``per_anchor`` of them drawn without replacement.

    The ranks of an anchor's promoters are known before any is looked up, so a sample is drawn among ranks and no pair
    outside it is formed. Promoters are looked up by (chrom, rank), one row each.
    """
    held, ranks = band_ranks(anchors, tss_bins, min_dist, max_dist)
    placed = anchors.join(held, ["chrom", "bin"])
    below, above = F.col("r2") - F.col("r1"), F.col("r4") - F.col("r3")
    placed = placed.withColumn("__m", below + above).where("__m > 0")
    every = F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)
    if per_anchor is not None:
        draw = draw or hashed_draw()
        key = [F.col(c) for c in anchor_key]
        none = F.array().cast("array<bigint>")

        def taken(held: Column, step: Column) -> Column:
            # Step m draws one of 0 .. m, or m itself where that one is held: every set comes out alike.
            one = draw(step, *key) % (step + 1)
            return F.array_append(held, F.when(F.array_contains(held, one), step).otherwise(one))

        some = F.aggregate(F.sequence(F.greatest(F.col("__m") - per_anchor, F.lit(0)), F.col("__m") - 1), none, taken)
        every = F.when(F.col("__m") > per_anchor, some).otherwise(every)
    placed = placed.withColumn("__k", F.explode(every))
    rank = F.when(F.col("__k") < below, F.col("r1") + F.col("__k")).otherwise(F.col("r3") + F.col("__k") - below)
    pairs = placed.withColumn("rank", rank).drop("__k", "__m", "r1", "r2", "r3", "r4").join(ranks, ["chrom", "rank"]).drop("rank")
    return pairs.withColumn("i", F.least("bin", "tss_bin")).withColumn("j", F.greatest("bin", "tss_bin"))


def band_means(pixels: DataFrame, weights: DataFrame, expected: DataFrame, tss_bins: DataFrame, min_dist: int, max_dist: int) -> DataFrame:
    """Per valid bin: the sum of observed over expected against the promoter bins of its band, and how many are finite.

    Sums come from the pixels that are there; absent ones add nothing. The finite ones are the band's valid promoter
    bins, counted by rank, but for those at separations whose expected value is not positive.
    """
    ok = _valid(weights)
    starts = staged(tss_bins.select("chrom", "bin").distinct().join(ok.select("chrom", "bin"), ["chrom", "bin"]))
    usable = expected.where((F.col("expected") > 0) & F.col("dist").between(min_dist, max_dist)).select("chrom", "dist", "expected")
    apart = F.col("j") - F.col("i")
    near = pixels.where(apart.between(min_dist, max_dist)).withColumn("dist", apart.cast("long")).join(usable, ["chrom", "dist"])
    near = near.join(ok.withColumnsRenamed({"bin": "i", "weight": "__wi"}), ["chrom", "i"])
    near = near.join(ok.withColumnsRenamed({"bin": "j", "weight": "__wj"}), ["chrom", "j"])
    oe = F.col("n") * F.col("__wi") * F.col("__wj") / F.col("expected")
    both = F.array(F.struct(F.col("i").alias("bin"), F.col("j").alias("other")), F.struct(F.col("j").alias("bin"), F.col("i").alias("other")))
    ways = F.when(F.col("dist") == 0, F.slice(both, 1, 1)).otherwise(both)
    seen = near.select("chrom", oe.alias("oe"), F.explode(ways).alias("__e")).select("chrom", "oe", "__e.*")
    seen = seen.join(starts.select("chrom", F.col("bin").alias("other")), ["chrom", "other"], "left_semi")
    sums = seen.groupBy("chrom", "bin").agg(F.sum("oe").alias("oe_sum"))

    held, _ = band_ranks(ok, starts, min_dist, max_dist)
    total = held.select("chrom", "bin", (F.col("r2") - F.col("r1") + F.col("r4") - F.col("r3")).alias("__m"))
    chroms = ok.select("chrom").distinct()
    lost = chroms.select("chrom", F.explode(F.sequence(F.lit(min_dist).cast("long"), F.lit(max_dist).cast("long"))).alias("dist"))
    lost = lost.join(usable, ["chrom", "dist"], "left_anti")
    sides = F.when(F.col("dist") == 0, F.array(F.col("__p"))).otherwise(F.array(F.col("__p") - F.col("dist"), F.col("__p") + F.col("dist")))
    lost = starts.withColumnRenamed("bin", "__p").join(lost, "chrom").select("chrom", F.explode(sides).alias("bin"))
    lost = lost.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("__lost"))
    out = total.join(lost, ["chrom", "bin"], "left").join(sums, ["chrom", "bin"], "left")
    n = F.col("__m") - F.coalesce("__lost", F.lit(0))
    return out.select("chrom", "bin", F.coalesce("oe_sum", F.lit(0.0)).alias("oe_sum"), n.alias("oe_n")).where("oe_n > 0")


def observed_over_expected(queries: DataFrame, pixels: DataFrame, weights: DataFrame, expected: DataFrame) -> DataFrame:
    """Add ``oe`` per (chrom, i, j): NaN when a bin is masked, 0 for an absent pixel of two valid bins."""
    ok = _valid(weights)
    q = queries.join(pixels.select("chrom", "i", "j", F.col("n").alias("__n")), ["chrom", "i", "j"], "left")
    q = q.join(ok.withColumnsRenamed({"bin": "i", "weight": "__wi"}), ["chrom", "i"], "left")
    q = q.join(ok.withColumnsRenamed({"bin": "j", "weight": "__wj"}), ["chrom", "j"], "left")
    q = q.withColumn("__d", (F.col("j") - F.col("i")).cast("long")).join(
        expected.select("chrom", F.col("dist").alias("__d"), F.col("expected").alias("__e")), ["chrom", "__d"], "left"
    )
    value = F.coalesce("__n", F.lit(0)) * F.col("__wi") * F.col("__wj")
    known = F.col("__wi").isNotNull() & F.col("__wj").isNotNull() & F.col("__e").isNotNull()
    oe = F.when(known, ratio(value, "__e")).otherwise(F.lit(NAN))
    return q.withColumn("oe", oe).drop("__n", "__wi", "__wj", "__d", "__e")


def relocate(anchors: DataFrame, sizes: DataFrame, binsize: int, shifts: int, offset: Offset, first: int = 1) -> DataFrame:
    """Anchors at rest (group 0) and under each rigid shift of their chromosome's bins."""
    n_bins = F.ceil(F.col("size") / F.lit(binsize))
    groups = F.explode(F.sequence(F.lit(0), F.lit(shifts)))
    moved = anchors.join(sizes.select("chrom", "size"), "chrom").withColumn("grp", groups)
    shifted = (F.col("bin") + offset(F.col("grp") - 1 + first, n_bins, F.col("chrom"))) % n_bins
    return moved.withColumn("bin", F.when(F.col("grp") == 0, F.col("bin")).otherwise(shifted)).drop("size")


def shift_pairs(pairs: DataFrame, sizes: DataFrame, binsize: int, shifts: int, offset: Offset) -> DataFrame:
    """Pairs at rest and rigidly shifted; pairs running past the chromosome end drop out."""
    n_bins = F.ceil(F.col("size") / F.lit(binsize))
    moved = pairs.join(sizes.select("chrom", "size"), "chrom").withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(shifts)))
    )
    apart = F.col("j") - F.col("i")
    i = F.when(F.col("grp") == 0, F.col("i")).otherwise((F.col("i") + offset(F.col("grp"), n_bins, F.col("chrom"))) % n_bins)
    moved = moved.withColumn("__n", n_bins).withColumn("__d", apart).withColumn("i", i)
    moved = moved.withColumn("j", F.col("i") + F.col("__d")).where(F.col("j") < F.col("__n"))
    return moved.drop("size", "__n", "__d")


def pair_means(queries: DataFrame, group: Sequence[str] = ("family", "subfamily")) -> DataFrame:
    """Mean observed over expected per group and shift, over pairs that stand for ``k`` equal ones each."""
    finite = queries.where(is_finite("oe"))
    return finite.groupBy(*group, "grp").agg((F.sum(F.col("oe") * F.col("k")) / F.sum("k")).alias("m"), F.sum("k").alias("n"))


def anchor_means(anchors: DataFrame, means: DataFrame, group: Sequence[str] = ("family", "subfamily")) -> DataFrame:
    """The same over all promoters of every anchor's band, from the means of bins; an anchor row stands for ``k``."""
    held = anchors.join(means, ["chrom", "bin"])
    n = F.sum(F.col("oe_n") * F.col("k"))
    return held.groupBy(*group, "grp").agg((F.sum(F.col("oe_sum") * F.col("k")) / n).alias("m"), n.alias("n"))


def contact_test(means: DataFrame, group: Sequence[str] = ("family", "subfamily")) -> DataFrame:
    """A group's mean at rest (shift 0) against its means under the shifts; needs two of these."""
    own = W.partitionBy(*group)
    at_rest = lambda c: F.max(F.when(F.col("grp") == 0, F.col(c))).over(own)
    beside = means.withColumns({"n_pairs": at_rest("n"), "obs_oe": at_rest("m")}).where("grp > 0 and obs_oe is not null")
    got = beside.groupBy(*group, "n_pairs", "obs_oe").agg(
        F.avg("m").alias("null_oe"), F.stddev_samp("m").alias("null_sd"), F.count(F.lit(1)).alias("n_shifts"),
        F.sum((F.col("m") >= F.col("obs_oe")).cast("long")).alias("exceed"),
    ).where("n_shifts >= 2")
    rel = (
        F.when(F.col("null_oe") <= 0, F.lit(NAN)).when(F.col("obs_oe") == 0, F.lit(-INF))
        .otherwise(F.log2(F.col("obs_oe") / F.col("null_oe")))
    )
    z = F.when(F.col("null_sd") > 0, (F.col("obs_oe") - F.col("null_oe")) / F.col("null_sd")).otherwise(F.lit(NAN))
    p = (F.col("exceed") + 1) / (F.col("n_shifts") + 1)
    out = got.withColumns({"log2_ratio": rel, "z": z, "p_emp": p})
    return benjamini_hochberg(out, "p_emp", "q_emp")


def floor_report(table: DataFrame, shifts: int) -> DataFrame:
    """How many groups were tested and how many have the least p that so many shifts can give; those have no order."""
    least = 1.0 / (shifts + 1)
    return table.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("p_emp") <= 1.5 * least).alias("n_at_floor"), F.lit(least).alias("p_floor")
    )


def promoter_contacts(
    elements: DataFrame,
    tss: DataFrame,
    pixels: DataFrame,
    weights: DataFrame,
    sizes: DataFrame,
    binsize: int,
    min_dist: int,
    max_dist: int,
    shifts: int,
    mode: str = "relocate",
    per_anchor: int | None = None,
    max_anchors: int | None = None,
    anchor_order: Sequence[Column] | None = None,
    draw: Draw | None = None,
    offset: Offset | None = None,
    scramble: int | None = None,
    smooth: float | None = 0.1,
) -> DataFrame:
    """Element anchors against promoters over expected, with a relocation or rigid-pair null.

    All anchors and all promoters of their bands count unless a sample size is given. Expected values are those of the
    genome, smoothed over ``smooth`` in log2 separation; with None each chromosome has its own. Observed over expected
    hangs on bins only, so all promoters of a band are summed once for each bin of the genome, and an anchor in any
    shift is one lookup.
    """
    if mode not in ("relocate", "pair"):
        raise ValueError(f"unknown mode {mode!r}; choose relocate or pair")
    offset = offset or hashed_offset()
    anchor_order = anchor_order or [F.xxhash64("fid"), F.col("fid")]
    anchors = elements
    if max_anchors is not None:
        anchors = sample_per_group(elements, ["subfamily"], max_anchors, anchor_order)
    anchors = anchors.select("fid", "family", "subfamily", "chrom", "bin")
    if scramble is not None:
        anchors = relocate(anchors, sizes, binsize, 1, offset, scramble).where("grp = 1").drop("grp")
    lo, hi = min_dist // binsize, max_dist // binsize
    starts = point_bins(tss, binsize).select("chrom", "bin").distinct()
    expected = staged(expected_by_distance(pixels, weights, hi))
    expected = expected if smooth is None else smooth_expected(expected, smooth)
    places = ["family", "subfamily", "chrom", "bin"]
    if mode == "relocate" and per_anchor is None:
        counted = anchors.groupBy(*places).agg(F.count(F.lit(1)).alias("k"))
        means = band_means(pixels, weights, expected, starts, lo, hi)
        return contact_test(anchor_means(relocate(counted, sizes, binsize, shifts, offset), means))
    if mode == "relocate":
        queries = band_pairs(relocate(anchors, sizes, binsize, shifts, offset), starts, lo, hi, per_anchor, draw, ["fid", "grp"])
        queries = queries.withColumn("k", F.lit(1))
    else:
        if per_anchor is None:
            pairs = band_pairs(anchors.groupBy(*places).agg(F.count(F.lit(1)).alias("k")), starts, lo, hi)
        else:
            pairs = band_pairs(anchors, starts, lo, hi, per_anchor, draw)
            pairs = pairs.groupBy(*places[:3], "i", "j").agg(F.count(F.lit(1)).alias("k"))
        queries = shift_pairs(pairs, sizes, binsize, shifts, offset)
    queries = queries.select("family", "subfamily", "grp", "chrom", "i", "j", "k")
    return contact_test(pair_means(observed_over_expected(queries, pixels, weights, expected)))
