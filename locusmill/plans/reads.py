"""Stranded read counts per element copy and two-condition contrasts per subfamily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.intervals import SENSE
from ..functions.special import NAN, normal_upper
from ..operators.assignment import on_each_copy, on_one_copy
from ..operators.intervals import islands
from ..operators.order import benjamini_hochberg
from ..session import staged

KEY = ("subfamily", "orientation")


PIECE = ("sample", "frag", "chrom", "strand")


def fragments(alignments: DataFrame) -> DataFrame:
    """Stretches of fragments, on the strand of their first read, from aligned blocks.

    The mates of a proper pair lie on opposite strands, so a second read's strand is turned. Blocks of a fragment on one
    chromosome and strand are united where mates overlap; the parts of a spliced read and mates apart stay apart. A
    null read number is that of a single read.
    """
    turned = F.when(F.col("strand") == "+", "-").otherwise("+")
    strand = F.when(F.col("read") == 2, turned).otherwise(F.col("strand"))
    return islands(alignments.select("sample", "frag", "chrom", strand.alias("strand"), "start_pos", "end_pos"), PIECE)


def count_reads(features: DataFrame, reads: DataFrame, setting: int = 1, multi: str = "drop") -> DataFrame:
    """Fragments per (sample, orientation, copy). reads: sample, frag, chrom, start_pos, end_pos, strand of an aligned
    block, and ``read`` (1 or 2) where there are mates.

    A fragment is on a copy if a base of any of its blocks is. Sense counting wants the copy's strand (setting 1) or
    the other (setting 2); antisense counting uses the strand-flipped copies. A fragment on several eligible copies is
    dropped, or counted on each with ``all``. Neither pairs fragments with copies.
    """
    if setting not in (1, 2):
        raise ValueError(f"strand setting must be 1 or 2, not {setting}")
    if multi not in ("drop", "all"):
        raise ValueError(f"unknown multi {multi!r}; choose drop or all")
    together = reads.repartition("sample", "frag")
    if "read" in reads.columns:
        stretches = fragments(together)
    else:
        known = together.where("start_pos is not null and end_pos is not null")
        stretches = islands(known.select(*PIECE, "start_pos", "end_pos"), PIECE)
    copies = features.select(
        "fid", "chrom", F.col("strand").alias("f_strand"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end")
    )
    return (on_one_copy if multi == "drop" else on_each_copy)(copies, stretches, setting)


def assignment_rates(counts: DataFrame, reads: DataFrame) -> DataFrame:
    """Assigned and total fragments per (sample, orientation)."""
    total = reads.select("sample", "frag").distinct().groupBy("sample").agg(F.count(F.lit(1)).alias("total"))
    assigned = counts.groupBy("sample", "orientation").agg(F.sum("n").alias("assigned"))
    return assigned.join(total, "sample").withColumn("rate", F.col("assigned") / F.col("total"))


def strandedness(genes: DataFrame, reads: DataFrame, least_ratio: float = 5.0) -> DataFrame:
    """Fragments on one gene only under both strand settings, and the setting to use."""
    counts = count_reads(genes.withColumnRenamed("gene_id", "fid"), reads)
    same = F.col("orientation") == SENSE
    counts = counts.groupBy("sample").agg(
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("s1"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("s2")
    )
    out = reads.select("sample").distinct().join(counts, "sample", "left").na.fill(0, ["s1", "s2"])
    hi, lo = F.greatest("s1", "s2"), F.least("s1", "s2")
    ratio = F.when(lo > 0, hi / lo).otherwise(hi.cast("double"))
    verdict = (
        F.when(hi == 0, "no reads").when(ratio < least_ratio, "unstranded")
        .when(F.col("s1") > F.col("s2"), "setting 1").otherwise("setting 2")
    )
    return out.withColumn("ratio", ratio).withColumn("verdict", verdict)


def size_factors(counts: DataFrame) -> DataFrame:
    """Library total over both orientations over the geometric mean of the totals.

    Takes all copies: the factors come before any class filter, so restricted runs stay on one scale.
    """
    totals = counts.groupBy("sample").agg(F.sum("n").alias("total"))
    gm = totals.where("total > 0").agg(F.exp(F.avg(F.log("total"))).alias("__gm")).scalar()
    return totals.withColumn("size_factor", F.col("total") / gm)


def subfamily_counts(counts: DataFrame, features: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Counts summed to (subfamily, orientation), one column per sample, with the copies that have reads."""
    named = counts.join(features.select("fid", "subfamily", "family"), "fid")
    per_copy = named.groupBy("fid", "family", *KEY).agg(
        *[F.sum(F.when(F.col("sample") == s, F.col("n")).otherwise(0)).alias(s) for s in samples],
        F.max((F.col("n") > 0).cast("int")).alias("__any"),
    )
    return per_copy.groupBy("family", *KEY).agg(
        *[F.sum(s).alias(s) for s in samples], F.sum("__any").alias("n_copies_with_reads")
    )


def retention(
    table: DataFrame, factors: DataFrame, a: Sequence[str], b: Sequence[str], others: Sequence[str] = (), pseudo: float = 1.0
) -> DataFrame:
    """log2 ratio of two conditions per replicate pair, its mean and whether the replicates agree in sign."""
    wide = factors.groupBy().agg(
        *[F.max(F.when(F.col("sample") == s, F.col("size_factor"))).alias(f"__sf_{s}") for s in (*a, *b, *others)]
    )
    rows = table.withColumn("__all", F.lit(0)).join(F.broadcast(wide.withColumn("__all", F.lit(0))), "__all").drop("__all")
    norm = lambda s: F.col(s) / F.col(f"__sf_{s}")
    reps = [F.log2((norm(x) + pseudo) / (norm(y) + pseudo)) for x, y in zip(a, b)]
    mean = lambda cols: sum(cols[1:], cols[0]) / float(len(cols))
    signs = [r > 0 for r in reps]
    agree = F.lit(True)
    for s in signs[1:]:
        agree = agree & (s == signs[0])
    extra = [mean([norm(s) for s in others]).alias("other_mean")] if others else []
    return rows.select(
        "family", *KEY, "n_copies_with_reads",
        mean([norm(s) for s in a]).alias("a_mean"), mean([norm(s) for s in b]).alias("b_mean"), *extra,
        *[r.alias(f"log2_rep{k + 1}") for k, r in enumerate(reps)], mean(reps).alias("log2_ratio"),
        agree.alias("reps_agree"),
    )


def count_contrast(table: DataFrame, a: Sequence[str], b: Sequence[str], least_reads: int = 10) -> DataFrame:
    """Two-condition contrast per orientation with negative-binomial spread.

    Size factors are medians of ratios to the row's geometric mean; the dispersion is the method-of-moments estimate
    from the pooled within-condition variance; p is a Wald test of the log ratio. The estimates are not shrunk.
    The table has one row per category.
    """
    samples = [*a, *b]
    total = sum((F.col(s) for s in samples[1:]), F.col(samples[0]))
    rows = staged(table.where(total >= least_reads).select("family", *KEY, *samples))
    logs = [F.log(F.col(s)) for s in samples]
    geo = sum(logs[1:], logs[0]) / float(len(samples))
    positive = F.lit(True)
    for s in samples:
        positive = positive & (F.col(s) > 0)
    factors = rows.where(positive).groupBy("orientation").agg(
        *[F.exp(F.median(lg - geo)).alias(f"__sf_{s}") for s, lg in zip(samples, logs)]
    )
    rows = rows.join(factors, "orientation")
    norm = {s: F.col(s) / F.col(f"__sf_{s}") for s in samples}

    def mean(names: Sequence[str], of=None) -> Column:
        cols = [norm[s] if of is None else of(s) for s in names]
        return sum(cols[1:], cols[0]) / float(len(cols))

    rows = rows.withColumns({"a_mean": mean(a), "b_mean": mean(b), "base_mean": mean(samples)})
    square = lambda s, m: (norm[s] - F.col(m)) * (norm[s] - F.col(m))
    within = [square(s, "a_mean") for s in a] + [square(s, "b_mean") for s in b]
    var = sum(within[1:], within[0]) / float(len(samples) - 2)
    inv = mean(samples, lambda s: F.lit(1.0) / F.col(f"__sf_{s}"))
    m = F.col("base_mean")
    rows = rows.withColumn("dispersion", F.greatest((var - m * inv) / (m * m), F.lit(1e-8))).withColumn("__inv", inv)
    part = lambda c, n: (F.col("__inv") / F.greatest(F.col(c), F.lit(0.5)) + F.col("dispersion")) / float(n)
    lfc = F.log((F.col("a_mean") + 0.5) / (F.col("b_mean") + 0.5))
    se = F.sqrt(part("a_mean", len(a)) + part("b_mean", len(b)))
    rows = rows.withColumn("log2fc", lfc / F.log(F.lit(2.0))).withColumn("lfc_se", se / F.log(F.lit(2.0)))
    rows = rows.withColumn("z", F.when(F.col("lfc_se") > 0, F.col("log2fc") / F.col("lfc_se")).otherwise(F.lit(NAN)))
    rows = rows.withColumn("p", F.least(normal_upper(F.abs("z")) * 2.0, F.lit(1.0)))
    out = benjamini_hochberg(rows, "p", "q", ["orientation"])
    return out.select("family", *KEY, "base_mean", "log2fc", "lfc_se", "dispersion", "p", "q")
