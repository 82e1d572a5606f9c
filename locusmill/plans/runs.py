"""Whole analyses that stop at a failed check and return their losses beside the result.

Called inside ``session.workspace``, a run's intermediates go with the folder; results are read before it closes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.intervals import statistic_parts
from ..operators.coverage import library_totals
from ..session import staged
from . import contacts as pairs, position, signal
from .peaks import Offset


class Run(NamedTuple):
    """The result, what was left out (what, n), and the checks that passed (check, outcome)."""

    result: DataFrame
    losses: DataFrame
    checks: DataFrame


def _losses(counts: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One row per loss: how many rows of a table fail."""
    rows = [df.agg(F.lit(what).alias("what"), F.count_if(lost).alias("n")) for what, df, lost in counts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return staged(out)


def _off(df: DataFrame, chrom: str, sizes: DataFrame) -> DataFrame:
    return df.join(sizes.select(F.col("chrom").alias(chrom)).distinct(), chrom, "left_anti")


def _checks(df: DataFrame, passed: dict[str, object]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, str(v)) for k, v in passed.items()], "check string, outcome string")


def contact_analysis(
    contacts: DataFrame,
    features: DataFrame,
    genes: DataFrame,
    exons: DataFrame,
    housekeeping: DataFrame,
    sizes: DataFrame,
    shifts: int = 1000,
    statistic: str = "distal",
    min_mapq: int = 0,
    min_mapq_dna: int | None = None,
    min_contacts: int = 200,
    least_signal: int = 1000,
    offset: Offset | None = None,
) -> Run:
    """Shift test of contacts of element copies, with copies per category and the rate of genes of like depth.

    Stops where the pairs' first end does not look like the RNA end, or where ``housekeeping`` genes do not agree on how
    reads lie to their strand; what they agree on is how sense and antisense are told apart. Both ends have a quality
    floor, the DNA end's being ``min_mapq`` unless given.
    """
    dna = min_mapq if min_mapq_dna is None else min_mapq_dna
    side = pairs.rna_side(staged(pairs.side_discriminators(contacts, genes, exons, least_signal=least_signal)))
    if side != 1:
        raise ValueError(f"end {side} of the pairs looks like the RNA end; give the pairs the other way round")
    ends = pairs.rna_ends(contacts, min_mapq, dna)
    convention = pairs.strand_convention(staged(pairs.strand_votes(ends, housekeeping)))
    inverted = convention == "inverted"
    tallies = staged(pairs.shift_tallies(features, ends, sizes, shifts, offset, inverted))
    introns = staged(pairs.gene_introns(genes, exons))
    deciles = pairs.baseline_deciles(staged(pairs.gene_baseline(introns, ends, inverted)), statistic)
    copies = features.groupBy("family", "subfamily").agg(F.count(F.lit(1)).alias("n_copies"))
    table = pairs.with_baseline(pairs.shift_test(tallies, statistic, min_contacts), deciles, "n_contacts", "premrna_ref")
    low = (F.col("mapq") < min_mapq) | (F.col("mapq_dna") < dna)
    losses = _losses([
        ("contacts below a quality floor", contacts, low),
        ("contacts on unknown chromosomes", _off(contacts.where(~low), "rna_chrom", sizes), F.lit(True)),
        ("copies on unknown chromosomes", _off(features, "chrom", sizes), F.lit(True)),
        ("categories with too few contacts", tallies.where("shift = -1"), statistic_parts(statistic)[1] < min_contacts),
    ])
    checks = _checks(contacts, {"RNA end": side, "strand convention": convention})
    return Run(table.join(copies, ["family", "subfamily"]), losses, checks)


def signal_analysis(
    features: DataFrame, track: DataFrame, sizes: DataFrame, ip: Sequence[str] = signal.IP, inputs: Sequence[str] = signal.INPUT,
    min_input_frac: float = 0.25, min_copies: int = 20,
) -> Run:
    """IP over input per subfamily and orientation. Stops where a sample has no signal on one of its strands."""
    samples = [*ip, *inputs]
    totals = staged(library_totals(track))
    have = {(r["sample"], r["track_strand"]) for r in totals.where("total > 0").collect()}
    empty = [f"{s} {t}" for s in samples for t in ("pos", "neg") if (s, t) not in have]
    if empty:
        raise ValueError(f"no signal in {empty}")
    dens = signal.densities(signal.copy_signal(features, track, sizes, samples), totals, samples)
    dens = staged(dens.withColumn("__input", sum((F.col(f"d_{s}") for s in inputs[1:]), F.col(f"d_{inputs[0]}"))))
    ratios = signal.log_ratios(dens.drop("__input"), min_input_frac, tuple(ip), tuple(inputs))
    few = ratios.groupBy("orientation", "subfamily").agg(F.count(F.lit(1)).alias("n"))
    kept = ratios.select("fid", "orientation", F.lit(True).alias("kept"))
    losses = _losses([
        ("copies on unknown chromosomes", _off(features, "chrom", sizes), F.lit(True)),
        ("copy orientations without input", dens, F.col("__input") <= 0),
        ("copy orientations below the input floor", dens.where("__input > 0").join(kept, ["fid", "orientation"], "left"), F.col("kept").isNull()),
        ("categories with too few copies", few, F.col("n") < min_copies),
    ])
    return Run(signal.enrich(ratios, features, min_copies), losses, _checks(track, {"samples with signal": len(samples)}))


def timing_analysis(
    track: DataFrame, grid: DataFrame, covariates: DataFrame, fractions: Sequence[str], binsize: int, least: float = 0.5,
) -> Run:
    """Replication timing per bin, with ``early``, which rises towards early replication.

    Stops where a fraction has no signal or covers less than ``least`` of the bins, and where timing and GC hang together
    too weakly to say which end is early.
    """
    coverage = staged(position.fraction_coverage(track, grid, binsize).where(F.col("sample").isin(list(fractions))))
    seen = {r["sample"] for r in coverage.collect()}
    if set(fractions) - seen:
        raise ValueError(f"fractions without signal: {sorted(set(fractions) - seen)}")
    position.check_coverage(coverage, least)
    rt = staged(position.timing(track, grid, fractions, binsize))
    says = position.timing_direction(rt, covariates).first()
    if says["direction"] == "too_weak":
        raise ValueError(f"timing and GC correlate by {says['r']}: too weak to tell early from late")
    sign = -1.0 if says["direction"] == "low_is_early" else 1.0
    losses = _losses([("bins without signal", rt, ~(F.coalesce("s_total", F.lit(0.0)) > 0))])
    return Run(rt.withColumn("early", F.col("rt") * sign), losses, _checks(track, {"direction": says["direction"]}))
