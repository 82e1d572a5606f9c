"""Interval joins, merges, complements, flat coordinates and positional order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import intervals as iv, order
from ..session import staged
from .registry import register


def span_r():
    """A table's span renamed for the right side of an overlap join."""
    return F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end")



@register(
    "overlap_pairs",
    with_views(["feature", "peak"], """
    select p.cell_line, p.sample, p.chrom, p.start_pos as peak_start, p.end_pos as peak_end, p.strand as peak_strand,
      f.fid, f.start_pos, f.end_pos, f.strand, f.subfamily,
      case when p.strand = f.strand then 'sense' else 'antisense' end as orientation
    from peak p join feature f on f.chrom = p.chrom and f.start_pos < p.end_pos and f.end_pos > p.start_pos"""),
)
def overlap_pairs(spark, sf):
    from ..functions.intervals import orientation

    peaks = view(spark, sf, "peak").select("cell_line", "sample", "chrom", *span_r(), F.col("strand").alias("peak_strand"))
    pairs = iv.overlap_join(view(spark, sf, "feature").drop("family"), peaks)
    return pairs.withColumn("orientation", orientation("peak_strand", "strand")).withColumnsRenamed(
        {"r_start": "peak_start", "r_end": "peak_end"}
    )


MERGED = """
    (select {k}, min(start_pos) as start_pos, max(end_pos) as end_pos from (
      select *, sum(opened) over (partition by {k} order by start_pos, end_pos rows unbounded preceding) as run from (
        select *, case when start_pos > max(end_pos) over (partition by {k} order by start_pos, end_pos
            rows between unbounded preceding and 1 preceding) then 1 else 0 end as opened from {t}) a) b
     group by {k}, run)"""


def merged_sql(table: str, keys: str) -> str:
    return MERGED.format(t=table, k=keys)


@register(
    "merge_intervals",
    with_views(["peak"], "select * from " + merged_sql("peak", "cell_line, chrom, strand") + " m"),
)
def merge_intervals(spark, sf):
    return iv.merge(view(spark, sf, "peak"), ["cell_line", "chrom", "strand"])


GAPS = """, merged as (select * from {m} m), gaps as (
    select s.chrom, m.end_pos as start_pos,
      coalesce(lead(m.start_pos) over (partition by m.chrom order by m.start_pos), s.size) as end_pos
    from merged m join chrom_size s on s.chrom = m.chrom
    union all
    select s.chrom, 0 as start_pos, coalesce(min(m.start_pos), max(s.size)) as end_pos
    from chrom_size s left join merged m on m.chrom = s.chrom group by s.chrom)"""


@register(
    "complement_gaps",
    with_views(["feature", "chrom_size"], GAPS.format(m=merged_sql("feature", "chrom"))
               + " select * from gaps where start_pos < end_pos"),
)
def complement_gaps(spark, sf):
    sizes = view(spark, sf, "chrom_size").select("chrom", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    return iv.complement(iv.merge(view(spark, sf, "feature"), ["chrom"]), sizes, ["chrom"])


INTRONS = """, ex as (select * from """ + merged_sql("exon", "gene_id") + """ m), raw as (
    select g.gene_id, e.end_pos as start_pos,
      coalesce(lead(e.start_pos) over (partition by g.gene_id order by e.start_pos), g.end_pos) as end_pos
    from ex e join gene g on g.gene_id = e.gene_id
    union all
    select g.gene_id, g.start_pos, coalesce(min(e.start_pos), max(g.end_pos)) as end_pos
    from gene g left join ex e on e.gene_id = g.gene_id group by g.gene_id, g.start_pos),
  intron as (
    select r.gene_id, g.chrom, g.strand, r.start_pos, r.end_pos, r.end_pos - r.start_pos as seg_len,
      cast(sum(r.end_pos - r.start_pos) over (partition by r.gene_id order by r.start_pos) - (r.end_pos - r.start_pos)
        as bigint) as seg_off,
      row_number() over (partition by r.gene_id order by r.start_pos) - 1 as ordinal
    from raw r join gene g on g.gene_id = r.gene_id where r.start_pos < r.end_pos)"""


@register("gene_introns", with_views(["gene", "exon"], INTRONS + " select * from intron"))
def gene_introns(spark, sf):
    return iv.introns(view(spark, sf, "gene"), view(spark, sf, "exon"))


@register(
    "clip_to_introns",
    with_views(["feature", "gene", "exon"], INTRONS + """
    select f.fid, i.gene_id, i.seg_off + greatest(f.start_pos, i.start_pos) - i.start_pos as flat_start,
      i.seg_off + least(f.end_pos, i.end_pos) - i.start_pos as flat_end
    from feature f join intron i on i.chrom = f.chrom and i.start_pos < f.end_pos and i.end_pos > f.start_pos"""),
)
def clip_to_introns(spark, sf):
    segments = staged(iv.introns(view(spark, sf, "gene"), view(spark, sf, "exon")))
    pieces = iv.clip_to_segments(
        view(spark, sf, "feature").select("fid", "chrom", "start_pos", "end_pos"), segments, seg_keys=["gene_id"]
    )
    return pieces.select("fid", "gene_id", "flat_start", "flat_end")


SPACE = """, space as (
    select cell_line, chrom, start_pos, end_pos, end_pos - start_pos as seg_len,
      cast(sum(end_pos - start_pos) over (partition by cell_line order by chrom, start_pos) - (end_pos - start_pos)
        as bigint) as seg_off
    from """ + merged_sql("peak", "cell_line, chrom") + """ m)"""


def eligible_space(peaks):
    """Union of a cell line's peaks laid end to end."""
    return iv.flat_offsets(iv.merge(peaks, ["cell_line", "chrom"]), ["cell_line"], ["chrom"])


@register("flat_offsets", with_views(["peak"], SPACE + " select * from space"))
def flat_offsets(spark, sf):
    return eligible_space(view(spark, sf, "peak"))


@register(
    "flat_coordinates",
    with_views(["peak"], SPACE + """
    select p.cell_line, p.sample, p.chrom, p.start_pos as pos, s.seg_off + p.start_pos - s.start_pos as flat
    from peak p join space s on s.cell_line = p.cell_line and s.chrom = p.chrom
      and p.start_pos >= s.start_pos and p.start_pos < s.end_pos"""),
)
def flat_coordinates(spark, sf):
    peaks = view(spark, sf, "peak")
    points = peaks.select("cell_line", "sample", "chrom", F.col("start_pos").alias("pos"))
    return iv.to_flat(points, eligible_space(peaks), ["cell_line", "chrom"])


@register(
    "flat_round_trip",
    with_views(["peak"], "select cell_line, sample, chrom, start_pos as pos from peak"),
)
def flat_round_trip(spark, sf):
    peaks = view(spark, sf, "peak")
    space = staged(eligible_space(peaks))
    flat = iv.to_flat(
        peaks.select("cell_line", "sample", "chrom", F.col("start_pos").alias("pos")), space, ["cell_line", "chrom"]
    )
    back = iv.from_flat(flat.select("cell_line", "sample", "flat"), space, ["cell_line"])
    return back.select("cell_line", "sample", "chrom", "pos")


@register(
    "replicate_intersection",
    with_views(["peak_rep"], ", m as (select * from " + merged_sql("peak_rep", "cell_line, sample, rep, chrom, strand")
               + """ x) select a.cell_line, a.sample, a.chrom, a.strand, greatest(a.start_pos, b.start_pos) as start_pos,
      least(a.end_pos, b.end_pos) as end_pos
    from m a join m b on a.rep = 1 and b.rep = 2 and a.cell_line = b.cell_line and a.sample = b.sample
      and a.chrom = b.chrom and a.strand = b.strand and a.start_pos < b.end_pos and a.end_pos > b.start_pos"""),
)
def replicate_intersection(spark, sf):
    keys = ["cell_line", "sample", "chrom", "strand"]
    merged = iv.merge(view(spark, sf, "peak_rep"), [*keys, "rep"])
    return iv.intersect(merged.where("rep = 1"), merged.where("rep = 2"), keys)


CONTACT_POINT = "rna_chrom as chrom, rna_pos as pos"


def contact_points(spark, sf):
    return view(spark, sf, "contact").select(F.col("rna_chrom").alias("chrom"), F.col("rna_pos").alias("pos"), "mapq")


@register(
    "containing_innermost",
    with_views(["feature", "contact"], """
    select c.chrom, c.pos, c.mapq, h.fid from (select rna_chrom as chrom, rna_pos as pos, mapq from contact) c
    join (select chrom, pos, fid from (
        select p.chrom, p.pos, f.fid, row_number() over (partition by p.chrom, p.pos
            order by f.start_pos desc, f.end_pos, f.fid desc) as rn
        from (select distinct rna_chrom as chrom, rna_pos as pos from contact) p
        join feature f on f.chrom = p.chrom and f.start_pos <= p.pos and f.end_pos > p.pos) x where rn = 1) h
    on h.chrom = c.chrom and h.pos = c.pos"""),
)
def containing_innermost(spark, sf):
    return iv.containing(contact_points(spark, sf), view(spark, sf, "feature"), ["fid"])


@register(
    "containing_last_start",
    with_views(["feature", "contact"], """, cand as (
      select chrom, start_pos, end_pos, fid from (select *, row_number() over (partition by chrom, start_pos
        order by end_pos, fid desc) as rn from feature) x where rn = 1)
    select c.chrom, c.pos, c.mapq, k.fid from (select rna_chrom as chrom, rna_pos as pos, mapq from contact) c
    asof join cand k on c.chrom = k.chrom and c.pos >= k.start_pos where k.end_pos > c.pos"""),
)
def containing_last_start(spark, sf):
    return iv.containing(contact_points(spark, sf), view(spark, sf, "feature"), ["fid"], mode="last_start_only")


@register(
    "overlap_existence",
    with_views(["feature", "gene"], """
    select f.fid, max(case when g.strand = '+' then 1 else 0 end) = 1 as on_plus,
      max(case when g.strand = '-' then 1 else 0 end) = 1 as on_minus
    from feature f join gene g on g.chrom = f.chrom and g.start_pos < f.end_pos and g.end_pos > f.start_pos
    group by f.fid"""),
)
def overlap_existence(spark, sf):
    genes = staged(iv.merge(view(spark, sf, "gene"), ["chrom", "strand"]))
    marks = genes.select("chrom", F.col("strand").alias("gene_strand"), *span_r())
    flags = {"on_plus": F.col("gene_strand") == "+", "on_minus": F.col("gene_strand") == "-"}
    return iv.overlap_flags(view(spark, sf, "feature").select("fid", "chrom", "start_pos", "end_pos"), marks, flags, "fid")


@register(
    "positional_rank",
    with_views(["feature"], """
    select fid, chrom, start_pos, row_number() over (order by chrom, start_pos, fid) as rank from feature"""),
)
def positional_rank(spark, sf):
    return order.positional_rank(view(spark, sf, "feature").select("fid", "chrom", "start_pos"), ties=["fid"])
