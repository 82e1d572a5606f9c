"""RNA-DNA contact pairs: distance classes, shift nulls, within-gene test, library checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.intervals import ANTISENSE, SENSE, distance_class, floor_div, host_orientation, statistic_parts
from ..functions.special import NAN, normal_upper, ratio
from ..operators.counting import distinct_by
from ..operators.intervals import clip_to_segments, complement, containing, introns as gene_introns, merge, to_flat
from ..operators.order import attach, benjamini_hochberg, exact_quantiles
from ..operators.shifts import shifted_sums
from ..operators.sweep import counts_in_spans
from ..session import staged
from .peaks import Offset, hashed_offset

CODES = tuple(f"{s}{d}" for s in "pm" for d in range(3))
TRIPLE = ("d0", "d1", "d2")
CATEGORY = ("family", "subfamily", "orientation")


def rna_ends(contacts: DataFrame, min_mapq: int = 0, min_mapq_dna: int = 0) -> DataFrame:
    """RNA ends with their distance class, above the mapping-quality floors."""
    kept = contacts.where((F.col("mapq") >= min_mapq) & (F.col("mapq_dna") >= min_mapq_dna))
    return kept.select(
        F.col("rna_chrom").alias("chrom"), F.col("rna_pos").alias("pos"), F.col("rna_strand").alias("read_strand"),
        distance_class("rna_chrom", "rna_pos", "dna_chrom", "dna_pos").alias("dclass"),
    )


def coded(ends: DataFrame) -> DataFrame:
    """One counter column per (read strand, distance class)."""
    flags = [
        ((F.col("read_strand") == s) & (F.col("dclass") == d)).cast("long").alias(f"{c}{d}")
        for s, c in (("+", "p"), ("-", "m"))
        for d in range(3)
    ]
    return ends.select("chrom", "pos", *flags)


def _oriented(counts: DataFrame, inverted: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Six strand-by-class sums per element strand to sense and antisense triples."""
    plus = F.col("strand") == "+"
    same = [F.when(plus, F.col(f"p{d}")).otherwise(F.col(f"m{d}")) for d in range(3)]
    opp = [F.when(plus, F.col(f"m{d}")).otherwise(F.col(f"p{d}")) for d in range(3)]
    names = (ANTISENSE, SENSE) if inverted else (SENSE, ANTISENSE)
    rows = [
        F.struct(F.lit(n).alias("orientation"), *[c.alias(f"d{d}") for d, c in enumerate(t)])
        for n, t in zip(names, (same, opp))
    ]
    keep = ["family", "subfamily", *extra]
    split = counts.select(*keep, F.explode(F.array(*rows)).alias("__t")).select(*keep, "__t.*")
    return split.groupBy(*keep, "orientation").agg(*[F.sum(c).alias(c) for c in TRIPLE])


def shift_tallies(
    anchors: DataFrame,
    ends: DataFrame,
    sizes: DataFrame,
    shifts: int,
    offset: Offset | None = None,
    inverted: bool = True,
    edge: str = "clip",
    scramble: int | None = None,
) -> DataFrame:
    """Distance-class triples per (subfamily, orientation, shift); shift -1 is the observed arm.

    The triples do not depend on the statistic, so one table serves every ratio. Ends past the chromosome are cut or carried
    round. ``scramble`` replaces the observed arm by that shift.
    """
    if edge not in ("clip", "wrap"):
        raise ValueError(f"unknown edge {edge!r}; choose clip or wrap")
    offset = offset or hashed_offset()
    sized = sizes.select("chrom", "size")
    drawn = offset(F.col("draw"), F.col("size"), F.col("chrom"))

    def draws(first: int, past: int, shift: Column) -> DataFrame:
        numbered = sized.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(past - 1))))
        return numbered.select("chrom", "size", shift.alias("shift"), drawn.cast("long").alias("offset"), F.lit(False).alias("stays"))

    null = draws(0, shifts, F.col("draw"))
    if scramble is None:
        seen = sized.select("chrom").distinct().select(
            "chrom", F.lit(None).cast("long").alias("size"), F.lit(-1).alias("shift"), F.lit(None).cast("long").alias("offset"), F.lit(True).alias("stays")
        )
    else:
        seen = draws(scramble, scramble + 1, F.lit(-1))
    counts = shifted_sums(anchors, coded(ends), sized, null.unionByName(seen), ["family", "subfamily", "strand"], CODES, edge)
    return _oriented(counts, inverted, ["shift"])


def gene_baseline(introns: DataFrame, ends: DataFrame, inverted: bool = True) -> DataFrame:
    """Sense-transcript triples over each gene's introns; genes without contacts drop out."""
    counts = counts_in_spans(coded(ends), introns, ["gene_id", "strand"], CODES)
    plus_reads = (F.col("strand") == "+") != F.lit(inverted)
    triple = [F.when(plus_reads, F.col(f"p{d}")).otherwise(F.col(f"m{d}")).alias(f"d{d}") for d in range(3)]
    return counts.select("gene_id", *triple).where("d0 + d1 + d2 > 0")


def baseline_deciles(baseline: DataFrame, statistic: str, strata: int = 10) -> DataFrame:
    """Pooled rate per abundance stratum of the statistic's own denominator; strata are closed on both sides."""
    num, den = statistic_parts(statistic)
    rows = baseline.select(num.alias("num"), den.alias("den")).where("den > 0")
    edges = exact_quantiles(rows, [], "den", [k / strata for k in range(strata + 1)], "edges")
    spread = attach(rows, edges)
    held = F.filter(
        F.sequence(F.lit(0), F.lit(strata - 1)),
        lambda i: (F.col("den") >= F.col("edges")[i]) & (F.col("den") <= F.col("edges")[i + 1]),
    )
    # The edges are the same on every row, so their minimum is just their value.
    return spread.withColumn("stratum", F.explode(held)).groupBy("stratum").agg(
        F.min(F.col("edges")[F.col("stratum")]).alias("lo"), F.min(F.col("edges")[F.col("stratum") + 1]).alias("hi"),
        (F.sum("num") / F.sum("den")).alias("rate"), F.count(F.lit(1)).alias("n_genes"),
    )


def with_baseline(rows: DataFrame, deciles: DataFrame, n: str, name: str) -> DataFrame:
    """Rate of the first stratum holding ``n``, else of the last one."""
    listed = deciles.agg(F.array_sort(F.collect_list(F.struct("stratum", "lo", "hi", "rate"))).alias("__dec"))
    out = attach(rows, listed)
    held = F.filter("__dec", lambda d: (d["lo"] <= F.col(n)) & (d["hi"] >= F.col(n)))
    last = F.try_element_at("__dec", F.lit(-1))
    return out.withColumn(name, F.coalesce(F.try_element_at(held, F.lit(1)), last)["rate"]).drop("__dec")


def shift_test(tallies: DataFrame, statistic: str = "distal", min_contacts: int = 200) -> DataFrame:
    """Observed ratio against the mean and spread of the shift null, with z, empirical and normal p, and q."""
    num, den = statistic_parts(statistic)
    rows = tallies.withColumn("__num", num).withColumn("__den", den).withColumn("__all", F.col("d0") + F.col("d1") + F.col("d2"))
    seen = rows.where("shift = -1").select(
        *CATEGORY, F.col("__den").alias("n_contacts"), F.col("__all").alias("n_all"), ratio("__num", "__den").alias("stat_frac")
    ).where(F.col("n_contacts") >= min_contacts)
    null = rows.where("shift >= 0 and __den > 0").select(*CATEGORY, (F.col("__num") / F.col("__den")).alias("__f"))
    joined = seen.join(null, list(CATEGORY), "left").groupBy(*CATEGORY, "n_contacts", "n_all", "stat_frac").agg(
        F.avg("__f").alias("null_mean"), F.stddev_samp("__f").alias("null_sd"), F.count("__f").alias("n_null"),
        F.sum((F.col("__f") >= F.col("stat_frac")).cast("long")).alias("__over"),
    )
    z = F.when(F.col("null_sd") > 0, (F.col("stat_frac") - F.col("null_mean")) / F.col("null_sd")).otherwise(F.lit(NAN))
    out = joined.withColumn("z", z).withColumn(
        "p_emp", (F.coalesce("__over", F.lit(0)) + 1) / (F.col("n_null") + 1)
    ).withColumn("p_z", normal_upper("z"))
    return benjamini_hochberg(out.drop("__over"), "p_z", "q")


def within_gene_tallies(
    features: DataFrame,
    classes: DataFrame,
    genes: DataFrame,
    exons: DataFrame,
    ends: DataFrame,
    shifts: int,
    offset: Offset | None = None,
    min_control: int = 20,
    min_length: int = 1000,
    inverted: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(per gene and category counts with the gene's control counts, per category and shift null triples).

    Counts run on each gene's introns laid end to end, over reads of the host-opposite channel. Controls are the
    bases no copy of any class covers. The null shifts a category's copies by one offset per gene and wraps round.
    """
    offset = offset or hashed_offset()
    segs = staged(gene_introns(genes, exons))
    length = segs.groupBy("gene_id").agg(F.sum("seg_len").alias("size")).where(F.col("size") >= min_length)
    segs = staged(segs.join(length, "gene_id"))

    wanted = F.col("read_strand") == F.col("strand") if inverted else F.col("read_strand") != F.col("strand")
    grouped = ends.groupBy("chrom", "pos", "read_strand").agg(
        *[F.sum((F.col("dclass") == d).cast("long")).alias(f"d{d}") for d in range(3)]
    )
    placed = to_flat(grouped, segs, carry=["gene_id", "strand"])
    points = staged(placed.where(wanted).select("gene_id", F.col("flat").alias("pos"), *TRIPLE))

    pieces = staged(clip_to_segments(
        features.select("fid", "family", "subfamily", "chrom", "start_pos", "end_pos"),
        segs.select("gene_id", "chrom", "start_pos", "end_pos", "seg_off", "size"), seg_keys=["gene_id", "size"],
    ).select("gene_id", "size", "fid", "family", "subfamily", F.col("flat_start").alias("start_pos"), F.col("flat_end").alias("end_pos")))

    span = length.select("gene_id", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    free = staged(complement(merge(pieces, ["gene_id"]), span, ["gene_id"]))
    control = counts_in_spans(points, free, ["gene_id"], TRIPLE, keys=["gene_id"])
    control = control.withColumnsRenamed({f"d{d}": f"c{d}" for d in range(3)})
    enough = points.groupBy("gene_id").agg(F.sum(F.col("d0") + F.col("d1") + F.col("d2")).alias("__n"))
    enough = enough.where(F.col("__n") >= min_control).select("gene_id")
    control = staged(control.join(enough, "gene_id", "left_semi"))

    tested = pieces.join(classes, "fid").withColumn("orientation", host_orientation("class")).where("orientation is not null")
    tested = staged(tested.join(control.select("gene_id"), "gene_id", "left_semi").drop("class"))
    by = ["gene_id", *CATEGORY]
    observed = counts_in_spans(points, tested, by, TRIPLE, keys=["gene_id"])
    copies = distinct_by(tested, by, ["fid"], "n_copies")
    genes_out = observed.join(copies, by).join(control, "gene_id")

    k = F.explode(F.sequence(F.lit(0), F.lit(shifts - 1)))
    moved = tested.withColumn("shift", k).withColumn("__len", F.col("end_pos") - F.col("start_pos"))
    drawn = offset(F.col("shift"), F.col("size"), F.col("gene_id"), F.col("subfamily"), F.col("orientation"))
    moved = moved.withColumn("start_pos", (F.col("start_pos") + drawn) % F.col("size"))
    end = F.col("start_pos") + F.col("__len")
    first = F.struct(F.col("start_pos").alias("s"), F.least(end, F.col("size")).alias("e"))
    rest = F.struct(F.lit(0).cast("long").alias("s"), (end - F.col("size")).alias("e"))
    parts = F.explode(F.when(end > F.col("size"), F.array(first, rest)).otherwise(F.array(first)))
    moved = moved.select("gene_id", *CATEGORY, "shift", parts.alias("__p")).select(
        "gene_id", *CATEGORY, "shift", F.col("__p.s").alias("start_pos"), F.col("__p.e").alias("end_pos")
    )
    null = counts_in_spans(points, moved, [*by, "shift"], TRIPLE, keys=["gene_id"])
    return genes_out, null


def within_gene_test(
    per_gene: DataFrame, null: DataFrame, statistic: str = "distal", min_contacts: int = 200, min_control: int = 20
) -> DataFrame:
    """Stratified expectation from each gene's own controls, and the within-gene shift null.

    The variance has the binomial spread and the uncertainty of the gene's estimated rate.
    """
    tn, td = statistic_parts(statistic)
    cn, cd = statistic_parts(statistic, "c0", "c1", "c2")
    rows = per_gene.select("gene_id", *CATEGORY, "n_copies", tn.alias("tn"), td.alias("td"), cn.alias("cn"), cd.alias("cd"))
    gated = rows.where(F.col("cd") >= min_control)
    p = F.col("cn") / F.col("cd")
    spread = p * (1 - p)
    n = F.col("td")
    used = n > 0
    sums = gated.groupBy(*CATEGORY).agg(
        F.sum(used.cast("long")).alias("n_genes"), F.sum("n_copies").alias("n_copies"), F.sum("td").alias("n_contacts"),
        F.sum("tn").alias("__on"), F.sum(F.when(used, n * p)).alias("__e"),
        F.sum(F.when(used, n * spread + n * n * spread / F.col("cd"))).alias("__v"),
    ).where(F.col("n_contacts") >= min_contacts)
    nn, nd = statistic_parts(statistic)
    kept = gated.select("gene_id", *CATEGORY).distinct()
    shifts = null.join(kept, ["gene_id", *CATEGORY], "left_semi").groupBy(*CATEGORY, "shift").agg(
        *[F.sum(c).alias(c) for c in TRIPLE]
    )
    shifts = shifts.where(nd > 0).groupBy(*CATEGORY).agg(
        F.avg(nn / nd).alias("shift_mean"), F.stddev_samp(nn / nd).alias("shift_sd")
    )
    out = sums.join(shifts, list(CATEGORY), "left").withColumn("te_frac", F.col("__on") / F.col("n_contacts"))
    out = out.withColumn("ctl_exp_frac", F.col("__e") / F.col("n_contacts"))
    out = out.withColumn("z_gene", F.when(F.col("__v") > 0, (F.col("__on") - F.col("__e")) / F.sqrt("__v")).otherwise(F.lit(NAN)))
    out = out.withColumn(
        "z_shift",
        F.when(F.col("shift_sd") > 0, (F.col("te_frac") - F.col("shift_mean")) / F.col("shift_sd")).otherwise(F.lit(NAN)),
    )
    out = out.withColumn("p_gene", normal_upper("z_gene")).withColumn("p_shift", normal_upper("z_shift"))
    out = benjamini_hochberg(out, "p_gene", "q_gene").drop("__on", "__e", "__v")
    return benjamini_hochberg(out, "p_shift", "q_shift")


def on_copies(contacts: DataFrame, features: DataFrame, mode: str = "innermost") -> DataFrame:
    """Contacts whose RNA end lies in a copy, with that copy's columns."""
    carry = ["fid", "family", "subfamily", "strand", "start_pos"]
    points = contacts.withColumnsRenamed({"rna_chrom": "chrom", "rna_pos": "pos"})
    copies = features.select("chrom", "end_pos", *carry)
    return containing(points, copies, carry, mode=mode)


def census(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """Contacts and distinct copies per subfamily, raw strand agreement and host class."""
    key = ["subfamily", "agreement", "class"]
    tagged = hits.withColumn("agreement", F.when(F.col("rna_strand") == F.col("strand"), "same").otherwise("opp"))
    per_copy = tagged.groupBy("fid", "subfamily", "agreement").agg(F.count(F.lit(1)).alias("n"))
    per_copy = per_copy.join(classes, "fid", "left").withColumn("class", F.coalesce("class", F.lit("unclassified")))
    return per_copy.groupBy(*key).agg(F.sum("n").alias("contacts"), F.count(F.lit(1)).alias("copies"))


def distance_split(hits: DataFrame) -> DataFrame:
    """Distance-class counts per family and raw strand agreement."""
    d = distance_class("chrom", "pos", "dna_chrom", "dna_pos")
    tagged = hits.withColumn("agreement", F.when(F.col("rna_strand") == F.col("strand"), "same").otherwise("opp"))
    return tagged.groupBy("family", "agreement").agg(*[F.sum((d == k).cast("long")).alias(f"d{k}") for k in range(3)])


def strand_votes(ends: DataFrame, genes: DataFrame) -> DataFrame:
    """Plus and minus reads over genes of known strand and how each votes; uncovered genes abstain."""
    counts = counts_in_spans(coded(ends), genes, ["gene_id", "strand"], CODES)
    plus, minus = F.col("p0") + F.col("p1") + F.col("p2"), F.col("m0") + F.col("m1") + F.col("m2")
    vote = F.when(plus + minus == 0, "abstains").when(
        F.when(plus > minus, "+").otherwise("-") == F.col("strand"), "matches"
    ).otherwise("inverted")
    return counts.select("gene_id", "strand", plus.alias("plus_reads"), minus.alias("minus_reads"), vote.alias("vote"))


def strand_convention(votes: DataFrame) -> str:
    """``inverted`` or ``matches`` when at least two covered genes agree; otherwise an error."""
    tally = {r["vote"]: r["count"] for r in votes.groupBy("vote").count().collect()}
    tally.pop("abstains", None)
    if sum(tally.values()) < 2:
        raise ValueError("strand convention undetermined: fewer than two covered genes")
    if len(tally) != 1:
        raise ValueError(f"strand convention in conflict: {tally}")
    return next(iter(tally))


def side_discriminators(
    contacts: DataFrame, genes: DataFrame, exons: DataFrame, binsize: int = 10_000, least_signal: int = 1000,
    mito: str = "chrM", top: float = 0.001,
) -> DataFrame:
    """Which end of the pairs looks like RNA: exon, gene, mitochondrial and top-bin shares of both ends, with votes."""
    ends = contacts.select(F.col("rna_chrom").alias("chrom"), F.col("rna_pos").alias("pos"), F.lit(1).alias("side")).unionByName(
        contacts.select(F.col("dna_chrom").alias("chrom"), F.col("dna_pos").alias("pos"), F.lit(2).alias("side"))
    )
    sides = ends.select("chrom", "pos", *[(F.col("side") == k).cast("long").alias(f"side{k}") for k in (1, 2)])
    cols = ["chrom", "start_pos", "end_pos"]
    spans = merge(genes.select(*cols), ["chrom"]).withColumn("kind", F.lit("gene")).unionByName(
        merge(exons.select(*cols), ["chrom"]).withColumn("kind", F.lit("exon"))
    )
    inside = counts_in_spans(sides, staged(spans), ["kind"], ["side1", "side2"])
    mito_rows = sides.where(F.col("chrom") == mito).agg(
        F.lit("chrM").alias("kind"), *[F.coalesce(F.sum(f"side{k}"), F.lit(0)).alias(f"side{k}") for k in (1, 2)]
    )
    n = contacts.select(F.count(F.lit(1))).scalar()
    a, b = F.col("side1"), F.col("side2")
    vote = F.when(F.greatest(a, b) < least_signal, F.lit(None).cast("int")).when(a > b, 1).otherwise(2)
    shares = inside.unionByName(mito_rows).select(
        F.col("kind").alias("discriminator"), (a / n).alias("share1"), (b / n).alias("share2"), vote.alias("vote")
    )

    bins = ends.groupBy("side", "chrom", floor_div("pos", binsize).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Bins collapse to (count, number of bins): distinct counts number at most the square root of twice the contacts.
    sizes = bins.groupBy("side", "n").agg(F.count(F.lit(1)).alias("bins"))
    side = W.partitionBy("side")
    down = side.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)
    keep = F.greatest(F.lit(1), F.floor(F.sum("bins").over(side) * top))
    room = F.greatest(F.least(F.col("bins"), F.col("__keep") - F.col("__before")), F.lit(0))
    ranked = sizes.withColumn("__keep", keep).withColumn("__before", F.coalesce(F.sum("bins").over(down), F.lit(0)))
    tops = ranked.groupBy("side").agg((F.sum(room * F.col("n")) / F.sum(F.col("n") * F.col("bins"))).alias("share"))
    tops = tops.agg(*[F.max(F.when(F.col("side") == k, F.col("share"))).alias(f"share{k}") for k in (1, 2)])
    top_vote = F.when(F.col("share1") > F.col("share2"), 1).otherwise(2)
    return shares.unionByName(tops.select(F.lit("top_bins").alias("discriminator"), "share1", "share2", top_vote.alias("vote")))


def rna_side(table: DataFrame) -> int:
    """The side all voting discriminators name; fewer than three votes or disagreement is an error."""
    votes = [r["vote"] for r in table.select("vote").collect() if r["vote"] is not None]
    if len(votes) < 3:
        raise ValueError(f"side underdetermined: {len(votes)} discriminators had signal")
    if len(set(votes)) != 1:
        raise ValueError(f"side ambiguous: votes {votes}")
    return votes[0]


def chrom_totals(contacts: DataFrame) -> DataFrame:
    """RNA ends per chromosome."""
    return contacts.groupBy(F.col("rna_chrom").alias("chrom")).agg(F.count(F.lit(1)).alias("n_rna_ends"))
