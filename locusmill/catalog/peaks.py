"""Peak enrichment: screen, shift null and reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions.special import is_finite
from ..operators import counting
from ..plans import peaks as plan
from ..session import staged
from .algebra import SPACE, merged_sql
from .registry import lcg_offset, lcg_sql, register, rnd

HITS = """, hit as (
    select distinct p.cell_line, p.sample, f.fid, f.subfamily, f.family,
      case when p.strand = f.strand then 'sense' else 'antisense' end as orientation
    from {p} p join feature f on f.chrom = p.chrom and f.start_pos < p.end_pos and f.end_pos > p.start_pos)"""
ENRICH = HITS.format(p="peak") + """, a as (
    select cell_line, sample, subfamily, orientation, count(*) as loci from hit group by all),
  n as (select cell_line, sample, count(*) as n_peaks, cast(sum(count(*)) over (partition by cell_line) as bigint) as n_pool
        from peak group by cell_line, sample),
  cat as (select distinct family, subfamily, o.orientation from feature,
          (select 'sense' as orientation union all select 'antisense') o),
  g as (select n.*, cat.*, coalesce(a.loci, 0) as loci from n cross join cat left join a on a.cell_line = n.cell_line
        and a.sample = n.sample and a.subfamily = cat.subfamily and a.orientation = cat.orientation),
  e0 as (select *, cast(sum(loci) over (partition by cell_line, subfamily, orientation) as bigint) as pooled from g),
  enr as (select *, pooled - loci as rest, n_pool - n_peaks as n_rest,
      case when pooled = loci then case when loci = 0 then 'nan'::double else 'infinity'::double end
           else (loci / n_peaks) / ((pooled - loci) / (n_pool - n_peaks)) end as fold from e0)"""
# Log of a binomial coefficient, and the upper hypergeometric tail as a plain sum of terms.
LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma(({n}) - ({k}) + 1))"
TAIL = ("case when loci = 0 then 1.0 else least(1.0, list_sum(list_transform(range(greatest(loci, n_peaks + pooled - n_pool),"
        " least(pooled, n_peaks) + 1), lambda k : exp(" + LC.format(n="pooled", k="k") + " + "
        + LC.format(n="(n_pool - pooled)", k="(n_peaks - k)") + " - " + LC.format(n="n_pool", k="n_peaks") + ")))) end")
COLUMNS = "cell_line, sample, family, subfamily, orientation, n_peaks, loci, rest, n_rest, pooled"
CANDIDATE = "isfinite(fold) and fold > 1.05 and loci >= 3"


def candidates(table):
    return table.where(is_finite("fold") & (F.col("fold") > 1.05) & (F.col("loci") >= 3))


def enrichment(spark, sf):
    return plan.enrichment(view(spark, sf, "feature"), view(spark, sf, "peak"))


FV = ["feature", "peak"]


@register("enrichment_fold", with_views(FV, ENRICH + f" select {COLUMNS}, round(fold, 6) as fold from enr"))
def enrichment_fold(spark, sf):
    return enrichment(spark, sf).select(*COLUMNS.split(", "), rnd("fold").alias("fold"))


@register("locus_counts", with_views(FV, ENRICH + " select * from a"))
def locus_counts(spark, sf):
    return counting.locus_counts(view(spark, sf, "feature"), view(spark, sf, "peak"))


SCREEN = ENRICH + f""", scr as (select *, {TAIL} as p from enr), ranked as (
    select *, count(*) over (partition by cell_line) as m,
      count(*) over (partition by cell_line order by p) as rk from scr),
  q as (select *, least(1.0, min(p * m / rk) over (partition by cell_line order by p desc)) as q from ranked)"""


@register(
    "hypergeometric_screen",
    with_views(FV, SCREEN + f" select {COLUMNS}, round(fold, 6) as fold, round(p, 6) as p, round(q, 6) as q from q"),
)
def hypergeometric_screen(spark, sf):
    table = plan.screen(view(spark, sf, "feature"), view(spark, sf, "peak"))
    return table.select(*COLUMNS.split(", "), rnd("fold").alias("fold"), rnd("p").alias("p"), rnd("q").alias("q"))


@register(
    "significant_rows",
    with_views(["feature", "peak_near"], re.sub(r"\bpeak\b", "peak_near", SCREEN) + """ select cell_line, sample, subfamily, orientation, loci,
      round(q, 6) as q from q where q < 0.05 and isfinite(fold) and fold > 1"""),
)
def significant_rows(spark, sf):
    """Peaks with some laid on copies of one subfamily: few of the rows pass."""
    table = plan.significant(plan.screen(view(spark, sf, "feature"), view(spark, sf, "peak_near")), 0.05)
    return table.select("cell_line", "sample", "subfamily", "orientation", "loci", rnd("q").alias("q"))


CELLS = ("cell0", "cell1")
PERMS, BATCH, STOP = 12, 4, 2
SHIFTED = ENRICH + SPACE + f""", cand as (select cell_line, sample, subfamily, orientation, loci as observed
      from enr where {CANDIDATE}),
  size as (select cell_line, cast(sum(seg_len) as bigint) as total from space group by cell_line),
  flat as (select distinct p.cell_line, p.sample, p.strand, p.end_pos - p.start_pos as width, z.total,
      s.seg_off + p.start_pos - s.start_pos as flat
    from peak p join space s on s.cell_line = p.cell_line and s.chrom = p.chrom
      and p.start_pos >= s.start_pos and p.start_pos < s.end_pos
    join size z on z.cell_line = p.cell_line
    where exists (select 1 from cand c where c.cell_line = p.cell_line and c.sample = p.sample)),
  moved as (select cell_line, sample, strand, width, k.k as k, (flat + {lcg_sql("k.k", "total", "cell_line", "sample")}) % total as at
    from flat, (select unnest(range({PERMS})) as k) k),
  placed as (select m.*, s.chrom, s.start_pos + m.at - s.seg_off as g
    from moved m asof join space s on m.cell_line = s.cell_line and m.at >= s.seg_off),
  nul as (select cell_line, sample, subfamily, orientation, k, count(*) as loci from (
      select distinct p.cell_line, p.sample, p.k, f.fid, f.subfamily,
        case when p.strand = f.strand then 'sense' else 'antisense' end as orientation
      from placed p join feature f on f.chrom = p.chrom and f.start_pos < p.g + p.width and f.end_pos > p.g) x
    group by all),
  perm as (select c.*, k.k as k, coalesce(n.loci, 0) as loci from cand c
    cross join (select unnest(range({PERMS})) as k) k left join nul n on n.cell_line = c.cell_line
      and n.sample = c.sample and n.subfamily = c.subfamily and n.orientation = c.orientation and n.k = k.k)"""
#: Permutations at most, exceedances that settle a candidate, and permutations between looks; the first two are the reference's.
MOST, SETTLED, ROUND = 25_000, 25, 1_000
#: The same null until a group's candidates are settled. Moved peaks find their segment by bins of 100 bases and features by bins of 1,000.
STOPPED = SHIFTED[:SHIFTED.index(",\n  moved as")] + f""", near as (
    select fid, chrom, start_pos, end_pos, strand, subfamily, unnest(range(start_pos // 1000, (end_pos - 1) // 1000 + 1)) as b from feature),
  laid as (select *, unnest(range(seg_off // 100, (seg_off + seg_len - 1) // 100 + 1)) as a from space),
  rounds as (with recursive rd as (
    select *, 0::bigint as done, 0::bigint as exceed, 0::bigint as total from cand
    union all
    select g.cell_line, g.sample, g.subfamily, g.orientation, g.observed, g.done + {ROUND}, g.exceed + coalesce(n.over_n, 0)
        + case when g.observed = 0 then {ROUND} - coalesce(n.seen, 0) else 0 end, g.total + coalesce(n.loci, 0)
    from (select * from (select *, min(exceed) over (partition by cell_line, sample) as least from rd) x where least < {SETTLED} and done < {MOST}) g
    left join (select cell_line, sample, subfamily, orientation, count(*) as seen, count(*) filter (loci >= observed) as over_n,
        cast(sum(loci) as bigint) as loci from (
      select h.cell_line, h.sample, h.subfamily, h.orientation, h.observed, h.k, count(*) as loci from (
        select distinct m.cell_line, m.sample, m.k, f.fid, c.subfamily, c.orientation, c.observed from (
          select *, unnest(range(g // 1000, (g + width - 1) // 1000 + 1)) as b from (
            select d.cell_line, d.sample, d.strand, d.width, d.k, s.chrom, s.start_pos + d.at - s.seg_off as g from (
              select t.cell_line, t.sample, t.strand, t.width, w.k, (t.flat + {lcg_sql("w.k", "t.total", "t.cell_line", "t.sample")}) % t.total as at
              from flat t join (select cell_line, sample, done + unnest(range({ROUND})) as k from rd group by cell_line, sample, done
                having min(exceed) < {SETTLED} and done < {MOST}) w on w.cell_line = t.cell_line and w.sample = t.sample) d
            join laid s on d.cell_line = s.cell_line and d.at // 100 = s.a and d.at >= s.seg_off and d.at < s.seg_off + s.seg_len) y) m
        join near f on f.chrom = m.chrom and f.b = m.b and f.start_pos < m.g + m.width and f.end_pos > m.g
        join cand c on c.cell_line = m.cell_line and c.sample = m.sample and c.subfamily = f.subfamily
          and c.orientation = case when m.strand = f.strand then 'sense' else 'antisense' end) h group by all) z group by all) n
    on n.cell_line = g.cell_line and n.sample = g.sample and n.subfamily = g.subfamily and n.orientation = g.orientation)
    select * from rd),
  res as (select cell_line, sample, subfamily, orientation, observed, max(done) as n_perm, arg_max(exceed, done) as exceed,
      arg_max(total, done) as total from rounds group by all),
  resp as (select *, (exceed + 1) / (n_perm + 1) as p_perm from res),
  ranked as (select *, count(*) over (partition by cell_line) as m,
      count(*) over (partition by cell_line order by p_perm) as rk from resp)
  select cell_line, sample, subfamily, orientation, observed, n_perm, exceed, round(p_perm, 6) as p_perm,
    round(total / n_perm, 6) as expected,
    round(case when total = 0 then 'infinity'::double else observed / (total / n_perm) end, 6) as fold_perm,
    round(least(1.0, min(p_perm * m / rk) over (partition by cell_line order by p_perm desc)), 6) as q_perm
  from ranked"""


def shifted(spark, sf, most=MOST, settled=SETTLED, batch=ROUND, **how):
    features, peaks = view(spark, sf, "feature"), view(spark, sf, "peak")
    cands = staged(candidates(enrichment(spark, sf)))
    return plan.shift_null(features, peaks, cands, most, settled, batch, offset=lcg_offset, **how)


MANY = 100
LIKELY = "p < 0.05 and isfinite(fold) and fold > 1"
_MANY_DRAWS = SHIFTED[len(ENRICH + SPACE):].replace(f"from enr where {CANDIDATE}", f"from q where {LIKELY}").replace(
    f"range({PERMS})", f"range({MANY})"
)


@register(
    "permutation_table",
    with_views(FV, SCREEN + SPACE + _MANY_DRAWS + f""", res as (select cell_line, sample, subfamily, orientation, observed,
      cast({MANY} as bigint) as n_perm, cast(sum(case when loci >= observed then 1 else 0 end) as bigint) as exceed,
      cast(sum(loci) as bigint) as total from perm group by all),
  resp as (select r.*, (exceed + 1) / (n_perm + 1) as p_perm, q.pooled, q.fold as fold_pooled, q.q as q_screen from res r
    join q on q.cell_line = r.cell_line and q.sample = r.sample and q.subfamily = r.subfamily and q.orientation = r.orientation),
  ranked2 as (select *, count(*) over (partition by cell_line) as m2, count(*) over (partition by cell_line order by p_perm) as rk2 from resp),
  fin as (select *, least(1.0, min(p_perm * m2 / rk2) over (partition by cell_line order by p_perm desc)) as q_perm from ranked2)
  select cell_line, sample, subfamily, orientation, observed, n_perm, exceed, pooled, round(p_perm, 6) as p_perm,
    round(total / n_perm, 6) as expected, round(case when total = 0 then 'infinity'::double else observed / (total / n_perm) end, 6) as fold_perm,
    round(q_perm, 6) as q_perm, round(fold_pooled, 6) as fold_pooled, round(q_screen, 6) as q_screen, q_perm < 0.2 as significant
  from fin"""),
)
def permutation_table(spark, sf):
    """The table for every number of candidates, as the SQL has it; a budget too small for them is a warning."""
    out = plan.permutation_analysis(
        view(spark, sf, "feature"), view(spark, sf, "peak"), MANY, 0.2, lambda t: t.where(LIKELY.replace("isfinite(fold)", "fold < double('inf')")),
        refuse=False, stop_at=MANY + 1, batch=MANY, offset=lcg_offset,
    )
    doubles = ("p_perm", "expected", "fold_perm", "q_perm", "fold_pooled", "q_screen")
    return out.select(*[rnd(c).alias(c) if c in doubles else c for c in out.columns])


@register("shift_permutation", with_views(FV, STOPPED))
def shift_permutation(spark, sf):
    out = shifted(spark, sf)
    doubles = ("p_perm", "expected", "fold_perm", "q_perm")
    return out.select(*[rnd(c).alias(c) if c in doubles else c for c in out.columns])


@register(
    "shift_calibration",
    with_views(FV, SHIFTED + " select cell_line, sample, subfamily, orientation, loci as observed from perm where k = 3"),
)
def shift_calibration(spark, sf):
    return shifted(spark, sf, PERMS, STOP, BATCH, scramble=3).select("cell_line", "sample", "subfamily", "orientation", "observed")


@register(
    "external_space_loci",
    with_views([*FV, "gene"], ENRICH + f""", cand as (select * from enr where {CANDIDATE}), inside as (
      select distinct p.cell_line, p.sample, p.chrom, p.start_pos, p.end_pos, p.strand from peak p join gene g
        on g.chrom = p.chrom and p.start_pos >= g.start_pos and p.start_pos < g.end_pos),
      h2 as (select distinct p.cell_line, p.sample, f.fid, f.subfamily, case when p.strand = f.strand then 'sense' else 'antisense' end
          as orientation from inside p join feature f on f.chrom = p.chrom and f.start_pos < p.end_pos and f.end_pos > p.start_pos)
    select c.cell_line, c.sample, c.subfamily, c.orientation, count(h2.fid) as observed from cand c left join h2
      on h2.cell_line = c.cell_line and h2.sample = c.sample and h2.subfamily = c.subfamily and h2.orientation = c.orientation group by all"""),
)
def external_space_loci(spark, sf):
    features, peaks = view(spark, sf, "feature"), view(spark, sf, "peak")
    cands = staged(candidates(enrichment(spark, sf)))
    cells = F.explode(F.array(*[F.lit(c) for c in CELLS])).alias("cell_line")
    space = view(spark, sf, "gene").select(cells, "chrom", "start_pos", "end_pos")
    out = plan.shift_null(features, peaks, cands, 1, 1, 1, eligible=space, offset=lcg_offset)
    return out.select("cell_line", "sample", "subfamily", "orientation", "observed")


@register(
    "distinct_loci_per_cell",
    with_views(FV, ENRICH + f""", c as (select * from enr where {CANDIDATE}), l as (
      select distinct h.cell_line, h.fid, h.family from hit h join c on c.cell_line = h.cell_line
        and c.sample = h.sample and c.subfamily = h.subfamily and c.orientation = h.orientation)
    select s.*, t.* exclude (cell_line) from (
      select cell_line, count(distinct sample) as n_samples, count(*) as n_hits from c group by cell_line) s
    join (select cell_line, count(*) as distinct_loci, count(*) filter (family = 'famA') as "loci_famA",
      count(*) filter (family = 'famN') as "loci_famN", count(*) filter (family = 'famR') as "loci_famR"
      from l group by cell_line) t on t.cell_line = s.cell_line"""),
)
def distinct_loci_per_cell(spark, sf):
    features, peaks = view(spark, sf, "feature"), view(spark, sf, "peak")
    hits = staged(candidates(enrichment(spark, sf)))
    return plan.loci_report(features, peaks, hits, ["famA", "famN", "famR"])


@register(
    "top_by_fold",
    with_views(FV, ENRICH + """, r as (select * from enr where loci >= 3 and isfinite(fold) and fold >= 1.1),
      t as (select *, row_number() over (partition by orientation order by fold desc, cell_line, sample, subfamily)
        as place from r)
    select orientation, place, cell_line, sample, subfamily, loci, round(fold, 6) as fold from t where place <= 12"""),
)
def top_by_fold(spark, sf):
    top, _ = plan.top_by_fold(plan.robust(enrichment(spark, sf), 3, 1.1), 12)
    return top.select("orientation", "place", "cell_line", "sample", "subfamily", "loci", rnd("fold").alias("fold"))


@register(
    "hit_totals",
    with_views(FV, ENRICH + """ select orientation, family, count(*) as n_hits from enr
      where loci >= 3 and isfinite(fold) and fold >= 1.1 group by all"""),
)
def hit_totals(spark, sf):
    return plan.top_by_fold(plan.robust(enrichment(spark, sf), 3, 1.1), 12)[1]


REPLICATED = ENRICH + f""", m as (select *, coalesce({CANDIDATE} and loci >= 4 and fold >= 1.25, false) as robust,
      case when isnan(fold) then null when fold < 1 then 0 when fold < 2 then 1 when fold < 4 then 2 when fold < 6 then 3
           when fold < 10 then 4 else 5 end as bin from enr)"""


@register(
    "replication_grid",
    with_views(FV, REPLICATED + " select sample, subfamily, orientation, family, " + ", ".join(
        f"""round(max(case when cell_line = '{c}' then fold end), 6) as fold_{c},
        bool_or(case when cell_line = '{c}' then robust end) as robust_{c},
        max(case when cell_line = '{c}' then bin end) as bin_{c}""" for c in CELLS)
               + " from m group by sample, subfamily, orientation, family"),
)
def replication_grid(spark, sf):
    table = staged(enrichment(spark, sf))
    grid, _ = plan.replication(table, candidates(table), CELLS, 5, 4, 1.25)
    return grid.select(*[rnd(c).alias(c) if c.startswith("fold_") else c for c in grid.columns])


@register(
    "top_replicated",
    with_views(FV, REPLICATED + """, k as (select sample, subfamily, orientation, family, count(*) as n_cells,
        median(fold) as median_fold from m where robust group by all),
      r as (select *, row_number() over (partition by family order by n_cells desc, median_fold desc, sample, subfamily,
        orientation) as place from k)
    select * replace (round(median_fold, 6) as median_fold) from r where place <= 5"""),
)
def top_replicated(spark, sf):
    table = staged(enrichment(spark, sf))
    top = plan.replication(table, candidates(table), CELLS, 5, 4, 1.25)[1]
    return top.withColumn("median_fold", rnd("median_fold"))


LATER = HITS.format(p="peak_rep").replace("hit as", "hit2 as")[:-1] + " and p.rep = 2)"


@register(
    "lost_and_gained_keys",
    with_views(["feature", "peak", "peak_rep"], HITS.format(p="peak") + LATER + """,
      o as (select distinct cell_line, sample, subfamily, orientation from hit),
      w as (select distinct cell_line, sample, subfamily, orientation from hit2)
    select *, 'lost' as change from (select * from o except select * from w) x
    union all select *, 'gained' as change from (select * from w except select * from o) y"""),
)
def lost_and_gained_keys(spark, sf):
    features, reps = view(spark, sf, "feature"), view(spark, sf, "peak_rep")
    tables = [staged(counting.locus_counts(features, reps.where(F.col("rep") == r))) for r in (1, 2)]
    return plan.key_changes(*tables)


@register(
    "reproducible_peaks",
    with_views(["peak_rep"], ", m as (select * from "
               + merged_sql("peak_rep", "cell_line, sample, rep, chrom, strand") + """ x)
    select a.cell_line, a.sample, a.chrom, a.strand, greatest(a.start_pos, b.start_pos) as start_pos,
      least(a.end_pos, b.end_pos) as end_pos from m a join m b on a.rep = 1 and b.rep = 2
      and a.cell_line = b.cell_line and a.sample = b.sample and a.chrom = b.chrom and a.strand = b.strand
      and a.start_pos < b.end_pos and a.end_pos > b.start_pos"""),
)
def reproducible_peaks(spark, sf):
    return plan.reproducible_peaks(view(spark, sf, "peak_rep"))[0]


@register(
    "dropped_groups",
    with_views(["peak_rep"], """ select cell_line, sample, 'only replicate 1' as reason from peak_rep
      group by cell_line, sample having count(distinct rep) = 1"""),
)
def dropped_groups(spark, sf):
    return plan.reproducible_peaks(view(spark, sf, "peak_rep"))[1]


@register(
    "off_index_chromosomes",
    with_views(FV, " select chrom, count(*) as n_peaks from peak where chrom not in (select chrom from feature) group by chrom"),
)
def off_index_chromosomes(spark, sf):
    return plan.off_index(view(spark, sf, "peak"), view(spark, sf, "feature"))
