"""Stranded read counting and two-condition contrasts."""

from __future__ import annotations

from ..fixtures import view, with_views
from ..operators import hosts
from ..plans import reads as plan
from ..session import staged
from . import sqltext
from .contacts import HOST, classes
from .registry import register, rnd

SAMPLES = ("lib0", "lib1", "lib2", "lib3")
A, B = SAMPLES[:2], SAMPLES[2:]
FR = ["feature", "read_align"]
AT = """, held as (select distinct r.sample, r.frag, (r.strand = f.strand) = (r.read = 1) as agree, f.fid from read_align r
    join feature f on f.chrom = r.chrom and f.start_pos < r.end_pos and f.end_pos > r.start_pos)"""
COUNTS = AT + """, one as (select sample, frag, agree, max(fid) as fid from held group by all having count(*) = 1),
  cn as (select sample, case when agree then 'sense' else 'antisense' end as orientation, fid, count(*) as n from one group by all)"""
WIDE = COUNTS + """, w as (select f.family, f.subfamily, orientation, """ + ", ".join(
    f"cast(sum(case when sample = '{s}' then n else 0 end) as bigint) as {s}" for s in SAMPLES
) + """, count(distinct cn.fid) as n_copies_with_reads from cn join feature f on f.fid = cn.fid group by f.family, f.subfamily, orientation),
  tt as (select sample, cast(sum(n) as bigint) as total from cn group by sample),
  sf as (select sample, total, total / (select exp(avg(ln(total))) from tt) as size_factor from tt)"""


def counts(spark, sf, **how):
    return plan.count_reads(view(spark, sf, "feature"), view(spark, sf, "read_align"), **how)


@register("read_counts", with_views(FR, COUNTS + " select * from cn"))
def read_counts(spark, sf):
    return counts(spark, sf)


@register(
    "read_counts_multi",
    with_views(FR, AT + """ select sample, case when agree then 'antisense' else 'sense' end as orientation, fid, count(*) as n
      from held group by all"""),
)
def read_counts_multi(spark, sf):
    return counts(spark, sf, setting=2, multi="all")


@register("assignment_rates", with_views(FR, COUNTS + """ select a.sample, orientation, assigned, total, round(assigned / total, 6) as rate from (
    select sample, orientation, cast(sum(n) as bigint) as assigned from cn group by all) a
    join (select sample, count(distinct frag) as total from read_align group by sample) t on t.sample = a.sample"""))
def assignment_rates(spark, sf):
    return plan.assignment_rates(counts(spark, sf), view(spark, sf, "read_align")).withColumn("rate", rnd("rate"))


def strand_sql(table, genes="gene"):
    return f""", h as (select r.sample, r.frag, (r.strand = g.strand) = (r.read = 1) as agree, count(distinct g.gene_id) as k from {table} r
        join {genes} g on g.chrom = r.chrom and g.start_pos < r.end_pos and g.end_pos > r.start_pos group by all),
      c as (select sample, count(*) filter (agree) as s1, count(*) filter (not agree) as s2 from h where k = 1 group by sample),
      v as (select *, case when least(s1, s2) > 0 then greatest(s1, s2) / least(s1, s2) else greatest(s1, s2) end as x from c)
    select sample, s1, s2, round(x, 6) as ratio, case when greatest(s1, s2) = 0 then 'no reads' when x < 5 then 'unstranded'
      when s1 > s2 then 'setting 1' else 'setting 2' end as verdict from v"""


@register("strandedness", with_views(["gene", "read_align"], strand_sql("read_align")))
def strandedness(spark, sf):
    return plan.strandedness(view(spark, sf, "gene"), view(spark, sf, "read_align")).withColumn("ratio", rnd("ratio"))


@register("strandedness_of_kits", with_views(["gene_core", "gene_read"], strand_sql("gene_read", "gene_core")))
def strandedness_of_kits(spark, sf):
    """Paired libraries made forward, reverse and without regard to strand, mates on opposite strands."""
    return plan.strandedness(view(spark, sf, "gene_core"), view(spark, sf, "gene_read")).withColumn("ratio", rnd("ratio"))


@register("read_fragments", with_views(["read_align"], """, t as (select distinct sample, frag, chrom, case when read = 2 then
      case when strand = '+' then '-' else '+' end else strand end as strand, start_pos, end_pos from read_align),
    o as (select *, max(end_pos) over (partition by sample, frag, chrom, strand order by start_pos, end_pos rows between unbounded preceding
      and 1 preceding) as before from t),
    n as (select *, sum(case when before is null or start_pos > before then 1 else 0 end) over (partition by sample, frag, chrom, strand
      order by start_pos, end_pos) as run from o)
    select sample, frag, chrom, strand, min(start_pos) as start_pos, max(end_pos) as end_pos from n group by sample, frag, chrom, strand, run"""))
def read_fragments(spark, sf):
    return plan.fragments(view(spark, sf, "read_align"))


@register("subfamily_counts", with_views(FR, WIDE + " select * from w"))
def subfamily_counts(spark, sf):
    return plan.subfamily_counts(counts(spark, sf), view(spark, sf, "feature"), SAMPLES)


@register("size_factors", with_views(FR, WIDE + " select sample, total, round(size_factor, 6) as size_factor from sf"))
def size_factors(spark, sf):
    return plan.size_factors(counts(spark, sf)).withColumn("size_factor", rnd("size_factor"))


def retention_sql(table):
    n = {s: f"({s} / (select size_factor from sf where sample = '{s}'))" for s in SAMPLES}
    r1, r2 = (f"log2(({n[x]} + 1) / ({n[y]} + 1))" for x, y in zip(A, B))
    return f""" select family, subfamily, orientation, n_copies_with_reads, round(({n['lib0']} + {n['lib1']}) / 2, 6) as a_mean,
      round(({n['lib2']} + {n['lib3']}) / 2, 6) as b_mean, round({r1}, 6) as log2_rep1, round({r2}, 6) as log2_rep2,
      round(({r1} + {r2}) / 2, 6) as log2_ratio, ({r1} > 0) = ({r2} > 0) as reps_agree from {table}"""


def rounded(df, whole):
    return df.select(*[c if c in whole else rnd(c).alias(c) for c in df.columns])


KEYS = ("family", "subfamily", "orientation", "n_copies_with_reads", "reps_agree")


@register("retention", with_views(FR, WIDE + retention_sql("w")))
def retention(spark, sf):
    c = staged(counts(spark, sf))
    table = plan.subfamily_counts(c, view(spark, sf, "feature"), SAMPLES)
    return rounded(plan.retention(table, plan.size_factors(c), A, B), KEYS)


@register(
    "retention_by_class",
    with_views([*FR, "gene", "exon"], HOST + WIDE + """, k as (select f.family, f.subfamily, orientation, """ + ", ".join(
        f"cast(sum(case when sample = '{s}' then n else 0 end) as bigint) as {s}" for s in SAMPLES
    ) + """, count(distinct cn.fid) as n_copies_with_reads from cn join feature f on f.fid = cn.fid
      join cls on cls.fid = cn.fid and class = 'intergenic' group by f.family, f.subfamily, orientation)""" + retention_sql("k")),
)
def retention_by_class(spark, sf):
    c = staged(counts(spark, sf))
    kept = hosts.keep_classes(view(spark, sf, "feature"), staged(classes(spark, sf)), ["intergenic"])
    table = plan.subfamily_counts(c, kept, SAMPLES)
    return rounded(plan.retention(table, plan.size_factors(c), A, B), KEYS)


def _contrast_sql():
    geo = "(" + " + ".join(f"ln({s})" for s in SAMPLES) + ") / 4.0"
    n = {s: f"({s} / sf_{s})" for s in SAMPLES}
    return WIDE + f""", ok as (select * from w where lib0 + lib1 + lib2 + lib3 >= 10),
      fac as (select orientation, {", ".join(f"exp(median(ln({s}) - {geo})) as sf_{s}" for s in SAMPLES)} from ok
        where {" and ".join(f"{s} > 0" for s in SAMPLES)} group by orientation),
      m as (select ok.*, {", ".join(f"sf_{s}" for s in SAMPLES)}, ({n['lib0']} + {n['lib1']}) / 2 as am, ({n['lib2']} + {n['lib3']}) / 2 as bm,
        ({" + ".join(n.values())}) / 4 as mm, ({" + ".join(f"1 / sf_{s}" for s in SAMPLES)}) / 4 as inv
        from ok join fac on fac.orientation = ok.orientation),
      d as (select *, greatest(((pow({n['lib0']} - am, 2) + pow({n['lib1']} - am, 2) + pow({n['lib2']} - bm, 2) + pow({n['lib3']} - bm, 2)) / 2
        - mm * inv) / (mm * mm), 1e-8) as disp from m),
      e as (select *, ln((am + 0.5) / (bm + 0.5)) / ln(2.0) as lfc, sqrt((inv / greatest(am, 0.5) + disp) / 2 + (inv / greatest(bm, 0.5) + disp) / 2)
        / ln(2.0) as se from d),
      p as (select *, least(1.0, 2 * {sqltext.normal_upper("abs(lfc / se)")}) as p from e)
      select family, subfamily, orientation, round(mm, 6) as base_mean, round(lfc, 6) as log2fc, round(se, 6) as lfc_se,
        round(disp, 6) as dispersion, round(p, 6) as p, round(q, 6) as q from {sqltext.bh("p", "p", "q", "orientation")} y"""


@register("count_contrast", with_views(FR, _contrast_sql()))
def count_contrast(spark, sf):
    table = plan.subfamily_counts(counts(spark, sf), view(spark, sf, "feature"), SAMPLES)
    return rounded(plan.count_contrast(table, A, B), KEYS)
