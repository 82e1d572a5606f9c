"""Contact pairs: distance classes, tallies, shift nulls, within-gene test and library checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import hosts
from ..plans import contacts as plan, runs
from ..session import staged
from . import sqltext
from .algebra import INTRONS, merged_sql
from .registry import lcg_offset, lcg_sql, register, rnd

SHIFTS = 3
DCLASS = ("case when rna_chrom <> dna_chrom then 2 when abs(dna_pos - rna_pos) <= 1000000 then 0 else 1 end")
ENDS = f""", ends as (select rna_chrom as chrom, rna_pos as pos, rna_strand as read_strand, {DCLASS} as dclass
    from contact where mapq >= 10)"""
TRI = ", ".join(f"cast(count(*) filter (dclass = {d}) as bigint) as d{d}" for d in range(3))
ORIENT = "case when read_strand = strand then 'antisense' else 'sense' end"
LCG = lcg_sql("k.k", "size", "f.chrom")
GENE_LCG = lcg_sql("k.k", "size", "te.gene_id", "te.subfamily", "te.orientation")
SPANS = f""", span as (
    select f.fid, f.chrom, f.strand, f.family, f.subfamily, k.k as shift,
      case when k.k < 0 then f.start_pos else (f.start_pos + {LCG}) % size end as s,
      f.end_pos - f.start_pos as len, z.size from feature f join chrom_size z on z.chrom = f.chrom
    cross join (select unnest(range(-1, {SHIFTS})) as k) k),
  cnt as (select fid, sp.family, sp.subfamily, shift, {ORIENT} as orientation, dclass from span sp join ends e
    on e.chrom = sp.chrom and e.pos >= sp.s and e.pos < least(sp.s + sp.len, sp.size)),
  grid as (select distinct family, subfamily, shift, o.orientation from span
    cross join (select 'sense' as orientation union all select 'antisense') o),
  tal as (select g.family, g.subfamily, g.orientation, g.shift, {TRI} from grid g left join cnt c on c.subfamily = g.subfamily
    and c.orientation = g.orientation and c.shift = g.shift group by all)"""
FCS = ["feature", "contact", "chrom_size"]
#: Shifts of the whole run, as the reference has them. Its SQL finds the ends under a moved copy by bins of 1,000 bases.
RUN_SHIFTS = 1000
RUN_SPANS = SPANS.replace(f"range(-1, {SHIFTS})", f"range(-1, {RUN_SHIFTS})").replace("span sp join ends e", """(
      select *, unnest(range(s // 1000, (s + len - 1) // 1000 + 1)) as b from span) sp join (select *, pos // 1000 as b from ends) e""").replace(
    "on e.chrom = sp.chrom and", "on e.chrom = sp.chrom and e.b = sp.b and")


def ends(spark, sf, min_mapq=10):
    return plan.rna_ends(view(spark, sf, "contact"), min_mapq)


def tallies(spark, sf, **how):
    return plan.shift_tallies(
        view(spark, sf, "feature"), ends(spark, sf), view(spark, sf, "chrom_size"), SHIFTS, lcg_offset, **how
    )


@register("distance_classes", with_views(["contact"], f" select {DCLASS} as dclass, rna_strand, count(*) as n from contact group by all"))
def distance_classes(spark, sf):
    c = plan.rna_ends(view(spark, sf, "contact"))
    return c.groupBy("dclass", F.col("read_strand").alias("rna_strand")).agg(F.count(F.lit(1)).alias("n"))


@register("contact_tallies", with_views(FCS, ENDS + SPANS + " select family, subfamily, orientation, d0, d1, d2 from tal where shift = -1"))
def contact_tallies(spark, sf):
    from ..operators.sweep import counts_in_spans

    counts = counts_in_spans(plan.coded(ends(spark, sf)), view(spark, sf, "feature"), ["family", "subfamily", "strand"], plan.CODES)
    return plan._oriented(counts, True)


@register("shift_tallies", with_views(FCS, ENDS + SPANS + " select * from tal"))
def shift_tallies(spark, sf):
    return tallies(spark, sf)


@register(
    "wrapped_tallies",
    with_views(FCS, ENDS + SPANS + f""", w as (select sp.family, sp.subfamily, sp.shift, {ORIENT} as orientation, dclass
      from span sp join ends e on e.chrom = sp.chrom and sp.s + sp.len > sp.size and e.pos < sp.s + sp.len - sp.size
      where sp.shift >= 0), cw as (select family, subfamily, shift, orientation, dclass from cnt union all select * from w)
    select g.family, g.subfamily, g.orientation, g.shift, {TRI} from grid g left join cw c on c.subfamily = g.subfamily
      and c.orientation = g.orientation and c.shift = g.shift group by all"""),
)
def wrapped_tallies(spark, sf):
    return tallies(spark, sf, edge="wrap")


@register(
    "shift_calibrated_tallies",
    with_views(FCS, ENDS + SPANS + " select family, subfamily, orientation, d0, d1, d2 from tal where shift = 1"),
)
def shift_calibrated_tallies(spark, sf):
    return tallies(spark, sf, scramble=1).where("shift = -1").drop("shift")


PARTS = {"distal": ("d1 + d2", "d0 + d1 + d2"), "cisdistal": ("d1", "d0 + d1"), "trans": ("d2", "d0 + d1 + d2")}
BASE = INTRONS + f""", bc as (select i.gene_id, e.dclass from intron i join ends e on e.chrom = i.chrom
      and e.pos >= i.start_pos and e.pos < i.end_pos and e.read_strand <> i.strand),
  basel as (select gene_id, {TRI} from bc group by gene_id)"""


def decile_sql(stat):
    num, den = PARTS[stat]
    return f""", bn as (select {num} as num, {den} as den from basel where {den} > 0),
      be as (select quantile_cont(den, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) as e from bn),
      dec as (select i.i as stratum, e[i.i + 1] as lo, e[i.i + 2] as hi, sum(num) / sum(den) as rate, count(*) as n_genes
        from bn cross join be cross join (select unnest(range(10)) as i) i
        where den >= e[i.i + 1] and den <= e[i.i + 2] group by all)"""


def test_sql(stat):
    num, den = PARTS[stat]
    z = "case when null_sd > 0 then (stat_frac - null_mean) / null_sd else 'nan'::double end"
    return decile_sql(stat) + f""", ob as (select family, subfamily, orientation, {den} as n_contacts, d0 + d1 + d2 as n_all,
        ({num}) / ({den}) as stat_frac from tal where shift = -1 and {den} >= 50),
      nl as (select family, subfamily, orientation, ({num}) / ({den}) as f from tal where shift >= 0 and {den} > 0),
      st as (select o.*, avg(f) as null_mean, stddev_samp(f) as null_sd, count(f) as n_null,
          (1 + count(*) filter (f >= stat_frac)) / (count(f) + 1) as p_emp
        from ob o left join nl n on n.subfamily = o.subfamily and n.orientation = o.orientation group by all),
      zz as (select *, {z} as z from st), pz as (select *, {sqltext.normal_upper("z")} as p_z from zz),
      rf as (select pz.*, coalesce((select arg_min(rate, stratum) from dec where lo <= n_contacts and hi >= n_contacts),
        (select arg_max(rate, stratum) from dec)) as premrna_ref from pz)
      select family, subfamily, orientation, n_contacts, n_all, round(stat_frac, 6) as stat_frac,
        round(null_mean, 6) as null_mean, round(null_sd, 6) as null_sd, n_null, round(z, 4) as z, round(p_emp, 6) as p_emp,
        round(p_z, 6) as p_z, round(q, 6) as q, round(premrna_ref, 6) as premrna_ref from {sqltext.bh("rf", "p_z", "q")} y"""


def baseline(spark, sf):
    segs = staged(plan.gene_introns(view(spark, sf, "gene"), view(spark, sf, "exon")))
    return plan.gene_baseline(segs, ends(spark, sf))


ROUND = {"stat_frac": 6, "null_mean": 6, "null_sd": 6, "z": 4, "p_emp": 6, "p_z": 6, "q": 6, "premrna_ref": 6}
for _stat in PARTS:
    @register(
        f"shift_test_{_stat}",
        with_views(["feature", "contact", "chrom_size", "gene", "exon"], ENDS + SPANS + BASE + test_sql(_stat)),
    )
    def _shift_test(spark, sf, stat=_stat):
        table = plan.shift_test(staged(tallies(spark, sf)), stat, 50)
        deciles = plan.baseline_deciles(staged(baseline(spark, sf)), stat)
        out = plan.with_baseline(table, deciles, "n_contacts", "premrna_ref")
        return out.select(*[rnd(c, ROUND[c]).alias(c) if c in ROUND else c for c in out.columns])


RUN = re.sub(r"\bcontact\b", "contact_rna", ENDS).replace("mapq >= 10", "mapq >= 10 and mapq_dna >= 10")
RUN_VIEWS = ["feature", "contact_rna", "chrom_size", "gene", "exon"]


def contact_run(spark, sf):
    needs = [view(spark, sf, n) for n in ("contact_rna", "feature", "gene", "exon", "housekeeping", "chrom_size")]
    return runs.contact_analysis(*needs, shifts=RUN_SHIFTS, min_mapq=10, min_contacts=50, offset=lcg_offset)


@register(
    "contact_analysis",
    with_views(RUN_VIEWS, RUN + RUN_SPANS + BASE + test_sql("distal").replace(
        "select family, subfamily, orientation, n_contacts,",
        "select family, subfamily, orientation, (select count(*) from feature f where f.subfamily = y.subfamily) as n_copies, n_contacts,")),
)
def contact_analysis(spark, sf):
    out = contact_run(spark, sf).result
    return out.select(*[rnd(c, ROUND[c]).alias(c) if c in ROUND else c for c in out.columns])


@register("contact_losses", with_views(RUN_VIEWS, RUN + SPANS + """
    select 'contacts below a quality floor' as what, count(*) as n from contact_rna where mapq < 10 or mapq_dna < 10
    union all select 'contacts on unknown chromosomes', count(*) from contact_rna where rna_chrom not in (select chrom from chrom_size) and mapq >= 10 and mapq_dna >= 10
    union all select 'copies on unknown chromosomes', count(*) from feature where chrom not in (select chrom from chrom_size)
    union all select 'categories with too few contacts', count(*) from tal where shift = -1 and d0 + d1 + d2 < 50"""))
def contact_losses(spark, sf):
    return contact_run(spark, sf).losses


@register("gene_baseline", with_views(["contact", "gene", "exon"], ENDS + BASE + " select * from basel"))
def gene_baseline(spark, sf):
    return baseline(spark, sf)


@register(
    "baseline_deciles",
    with_views(["contact", "gene", "exon"], ENDS + BASE + decile_sql("distal")
               + " select stratum, round(lo, 6) as lo, round(hi, 6) as hi, round(rate, 6) as rate, n_genes from dec"),
)
def baseline_deciles(spark, sf):
    out = plan.baseline_deciles(staged(baseline(spark, sf)), "distal")
    return out.select("stratum", rnd("lo").alias("lo"), rnd("hi").alias("hi"), rnd("rate").alias("rate"), "n_genes")


HOST = """, fl as (select f.fid,
      bool_or(g.strand = f.strand) as gs, bool_or(g.strand <> f.strand) as go
    from feature f left join gene g on g.chrom = f.chrom and g.start_pos < f.end_pos and g.end_pos > f.start_pos group by f.fid),
  xl as (select f.fid, bool_or(e.strand = f.strand) as es, bool_or(e.strand <> f.strand) as eo
    from feature f left join exon e on e.chrom = f.chrom and e.start_pos < f.end_pos and e.end_pos > f.start_pos group by f.fid),
  cls as (select f.fid, case when f.chrom not in (select chrom from gene) then 'no_annotation'
      when gs and go then 'ambiguous' when gs then case when es then 'exonic_sense' else 'intronic_sense' end
      when go then case when eo then 'exonic_anti' else 'intronic_anti' end else 'intergenic' end as class
    from feature f join fl on fl.fid = f.fid join xl on xl.fid = f.fid)"""
FGE = ["feature", "gene", "exon"]


def classes(spark, sf):
    return hosts.host_class(view(spark, sf, "feature"), view(spark, sf, "gene"), view(spark, sf, "exon"))


@register("host_classes", with_views(FGE, HOST + " select * from cls"))
def host_classes(spark, sf):
    return classes(spark, sf)


@register(
    "unannotated_classes",
    with_views(["peak", "gene", "exon"], ", pk as (select distinct concat_ws(':', chrom, start_pos, end_pos, strand) as fid, chrom, start_pos, end_pos, strand from peak)"
               + HOST.replace("from feature f", "from pk f") + " select class, count(*) as n from cls group by class"),
)
def unannotated_classes(spark, sf):
    """Classes of peaks, some of which lie on a contig without genes."""
    place = ["chrom", "start_pos", "end_pos", "strand"]
    found = view(spark, sf, "peak").select(*place).distinct().withColumn("fid", F.concat_ws(":", *[F.col(c).cast("string") for c in place]))
    return hosts.host_class(found, view(spark, sf, "gene"), view(spark, sf, "exon")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@register(
    "class_by_family",
    with_views(FGE, HOST + """, c as (select class, family from cls join feature f on f.fid = cls.fid)
    select class, """ + ", ".join(f"count(*) filter (family = 'fam{x}') as \"fam{x}\"" for x in "ANR") + ", "
               + ", ".join(f"round(100.0 * count(*) filter (family = 'fam{x}') / (select count(*) from c where family = 'fam{x}'), 6) as \"pct_fam{x}\"" for x in "ANR")
               + " from c group by class"),
)
def class_by_family(spark, sf):
    families = ["famA", "famN", "famR"]
    out = hosts.class_table(view(spark, sf, "feature"), staged(classes(spark, sf)), families)
    return out.select("class", *families, *[rnd(f"pct_{f}").alias(f"pct_{f}") for f in families])


@register("kept_classes", with_views(FGE, HOST + " select f.fid, f.subfamily from feature f join cls on cls.fid = f.fid where class in ('intergenic', 'ambiguous')"))
def kept_classes(spark, sf):
    kept = hosts.keep_classes(view(spark, sf, "feature"), staged(classes(spark, sf)), ["intergenic", "ambiguous"])
    return kept.select("fid", "subfamily")


WITHIN = HOST + INTRONS + ENDS.replace("mapq >= 10", "mapq >= 0") + f""", gl as (select gene_id, cast(sum(seg_len) as bigint) as size
      from intron group by gene_id having sum(seg_len) >= 1000),
  sg as (select i.*, gl.size from intron i join gl on gl.gene_id = i.gene_id),
  pt as (select sg.gene_id, seg_off + pos - start_pos as fp, dclass from sg join ends e on e.chrom = sg.chrom
      and e.pos >= sg.start_pos and e.pos < sg.end_pos and e.read_strand = sg.strand),
  pc as (select sg.gene_id, sg.size, f.fid, f.family, f.subfamily,
      seg_off + greatest(f.start_pos, sg.start_pos) - sg.start_pos as fs, seg_off + least(f.end_pos, sg.end_pos) - sg.start_pos as fe
    from feature f join sg on sg.chrom = f.chrom and sg.start_pos < f.end_pos and sg.end_pos > f.start_pos),
  ct as (select p.gene_id, count(*) filter (dclass = 0) as c0, count(*) filter (dclass = 1) as c1, count(*) filter (dclass = 2) as c2
    from pt p where not exists (select 1 from pc where pc.gene_id = p.gene_id and p.fp >= pc.fs and p.fp < pc.fe)
    group by p.gene_id),
  ok as (select gene_id from pt group by gene_id having count(*) >= 2),
  ctl as (select o.gene_id, coalesce(c0, 0) as c0, coalesce(c1, 0) as c1, coalesce(c2, 0) as c2 from ok o left join ct on ct.gene_id = o.gene_id),
  te as (select pc.*, case class when 'intronic_sense' then 'antisense' else 'sense' end as orientation
    from pc join cls on cls.fid = pc.fid and class in ('intronic_sense', 'intronic_anti') join ctl on ctl.gene_id = pc.gene_id),
  ob as (select t.gene_id, family, subfamily, orientation, count(distinct t.fid) as n_copies, {TRI.replace("count(*)", "count(fp)")}
    from te t left join pt p on p.gene_id = t.gene_id and p.fp >= t.fs and p.fp < t.fe group by all),
  mv as (select gene_id, family, subfamily, orientation, k.k as shift, size, (fs + {GENE_LCG}) % size as s, fe - fs as len
    from te cross join (select unnest(range({SHIFTS})) as k) k),
  nu as (select m.gene_id, family, subfamily, orientation, shift, {TRI.replace("count(*)", "count(fp)")} from mv m left join pt p
    on p.gene_id = m.gene_id and ((p.fp >= m.s and p.fp < m.s + m.len) or p.fp < m.s + m.len - m.size) group by all),
  r as (select ob.*, d1 + d2 as tn, d0 + d1 + d2 as td, c1 + c2 as cn, c0 + c1 + c2 as cd from ob join ctl on ctl.gene_id = ob.gene_id),
  ga as (select *, cn / cd as p from r where cd >= 2),
  sm as (select family, subfamily, orientation, count(*) filter (td > 0) as n_genes, cast(sum(n_copies) as bigint) as n_copies,
      cast(sum(td) as bigint) as n_contacts, sum(tn) as o, sum(td * p) as e,
      sum(td * p * (1 - p) + td * td * p * (1 - p) / cd) as v from ga group by all having sum(td) >= 5),
  sh as (select family, subfamily, orientation, avg(f) as shift_mean, stddev_samp(f) as shift_sd from (
      select n.family, n.subfamily, n.orientation, shift, sum(d1 + d2) / sum(d0 + d1 + d2) as f from nu n
      join ga g on g.gene_id = n.gene_id and g.subfamily = n.subfamily and g.orientation = n.orientation
      group by all having sum(n.d0 + n.d1 + n.d2) > 0) x group by all)"""
WITHIN = WITHIN.replace("shift, sum(d1 + d2) / sum(d0 + d1 + d2) as f", "shift, sum(n.d1 + n.d2) / sum(n.d0 + n.d1 + n.d2) as f")


def within(spark, sf):
    return plan.within_gene_tallies(
        view(spark, sf, "feature"), staged(classes(spark, sf)), view(spark, sf, "gene"), view(spark, sf, "exon"),
        ends(spark, sf, 0), SHIFTS, lcg_offset, min_control=2,
    )


FCGE = ["feature", "contact", "gene", "exon"]


@register("within_gene_counts", with_views(FCGE, WITHIN + " select r.gene_id, family, subfamily, orientation, n_copies, d0, d1, d2, c0, c1, c2 from r join ctl on ctl.gene_id = r.gene_id"))
def within_gene_counts(spark, sf):
    return within(spark, sf)[0]


@register("within_gene_null", with_views(FCGE, WITHIN + " select * from nu"))
def within_gene_null(spark, sf):
    return within(spark, sf)[1]


_NU = sqltext.normal_upper
@register(
    "within_gene_test",
    with_views(FCGE, WITHIN + f""", z as (select sm.*, shift_mean, shift_sd, o / n_contacts as te_frac, e / n_contacts as ctl_exp_frac,
        case when v > 0 then (o - e) / sqrt(v) else 'nan'::double end as z_gene,
        case when shift_sd > 0 then (o / n_contacts - shift_mean) / shift_sd else 'nan'::double end as z_shift
      from sm left join sh on sh.subfamily = sm.subfamily and sh.orientation = sm.orientation),
      p as (select *, {_NU("z_gene")} as p_gene, {_NU("z_shift")} as p_shift from z),
      qg as (select * from {sqltext.bh("p", "p_gene", "q_gene")} a), qs as (select * from {sqltext.bh("(select * exclude (__ok, __m, __rk) from qg) b", "p_shift", "q_shift")} c)
    select family, subfamily, orientation, n_genes, n_copies, n_contacts, """ + ", ".join(
        f"round({c}, {d}) as {c}" for c, d in (("te_frac", 6), ("ctl_exp_frac", 6), ("z_gene", 4), ("p_gene", 6), ("q_gene", 6),
                                               ("shift_mean", 6), ("shift_sd", 6), ("z_shift", 4), ("p_shift", 6), ("q_shift", 6))) + " from qs"),
)
def within_gene_test(spark, sf):
    per_gene, null = within(spark, sf)
    out = plan.within_gene_test(staged(per_gene), null, "distal", 5, 2)
    digits = {"z_gene": 4, "z_shift": 4}
    whole = ("family", "subfamily", "orientation", "n_genes", "n_copies", "n_contacts")
    return out.select(*[c if c in whole else rnd(c, digits.get(c, 6)).alias(c) for c in out.columns])


INNER = """, hit as (select c.*, h.* exclude (chrom, pos) from contact c join (
      select p.chrom, p.pos, f.fid, f.family, f.subfamily, f.strand, f.start_pos, row_number() over (partition by p.chrom, p.pos
        order by f.start_pos desc, f.end_pos, f.fid desc) as rn
      from (select distinct rna_chrom as chrom, rna_pos as pos from contact) p
      join feature f on f.chrom = p.chrom and f.start_pos <= p.pos and f.end_pos > p.pos) h
    on h.rn = 1 and h.chrom = c.rna_chrom and h.pos = c.rna_pos)"""
AGREE = "case when rna_strand = strand then 'same' else 'opp' end"


def copies(spark, sf):
    return plan.on_copies(view(spark, sf, "contact"), view(spark, sf, "feature"))


@register(
    "contact_census",
    with_views(FCGE, HOST + INNER + f""" select subfamily, {AGREE} as agreement, class, count(*) as contacts,
      count(distinct hit.fid) as copies from hit join cls on cls.fid = hit.fid group by all"""),
)
def contact_census(spark, sf):
    return plan.census(copies(spark, sf), classes(spark, sf))


@register(
    "distance_by_family",
    with_views(["feature", "contact"], INNER + f" select family, {AGREE} as agreement, {TRI.replace('dclass', '(' + DCLASS + ')')} from hit group by all"),
)
def distance_by_family(spark, sf):
    return plan.distance_split(copies(spark, sf))


@register(
    "strand_votes",
    with_views(["contact", "gene"], ENDS + """, v as (select g.gene_id, g.strand, count(*) filter (read_strand = '+') as plus_reads,
        count(*) filter (read_strand = '-') as minus_reads from gene g left join ends e on e.chrom = g.chrom
        and e.pos >= g.start_pos and e.pos < g.end_pos group by all)
    select *, case when plus_reads + minus_reads = 0 then 'abstains' when (plus_reads > minus_reads) = (strand = '+')
      then 'matches' else 'inverted' end as vote from v"""),
)
def strand_votes(spark, sf):
    return plan.strand_votes(ends(spark, sf), view(spark, sf, "gene"))


SIDE = """, en as (select rna_chrom as chrom, rna_pos as pos, 1 as side from contact union all select dna_chrom, dna_pos, 2 from contact),
  mk as (select 'gene' as kind, * from """ + merged_sql("gene", "chrom") + """ a union all select 'exon', * from """ + merged_sql("exon", "chrom") + """ b),
  ins as (select m.kind, count(*) filter (side = 1) as a, count(*) filter (side = 2) as b from mk m join en on en.chrom = m.chrom
    and en.pos >= m.start_pos and en.pos < m.end_pos group by m.kind union all select 'chrM', 0, 0),
  bins as (select side, count(*) as n, row_number() over (partition by side order by count(*) desc) as rk,
      count(*) over (partition by side) as nb from en group by side, chrom, cast(floor(pos/10000) as bigint)),
  tp as (select side, sum(n) filter (rk <= greatest(1, floor(nb * 0.001))) / sum(n) as share from bins group by side)
  select kind as discriminator, round(a / (select count(*) from contact), 6) as share1, round(b / (select count(*) from contact), 6) as share2,
    case when greatest(a, b) < 1000 then null when a > b then 1 else 2 end as vote from ins
  union all select 'top_bins', round(max(share) filter (side = 1), 6), round(max(share) filter (side = 2), 6),
    case when max(share) filter (side = 1) > max(share) filter (side = 2) then 1 else 2 end from tp"""


@register("side_discriminators", with_views(["contact", "gene", "exon"], SIDE))
def side_discriminators(spark, sf):
    out = plan.side_discriminators(view(spark, sf, "contact"), view(spark, sf, "gene"), view(spark, sf, "exon"))
    return out.withColumn("share1", rnd("share1")).withColumn("share2", rnd("share2"))


@register("rna_ends_per_chrom", with_views(["contact"], " select rna_chrom as chrom, count(*) as n_rna_ends from contact group by 1"))
def rna_ends_per_chrom(spark, sf):
    return plan.chrom_totals(view(spark, sf, "contact"))
