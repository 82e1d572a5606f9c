"""Target concentration of copies and its nulls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import order
from ..operators.redraw import quantile_split
from ..plans import contacts as pairs, targets as plan
from ..session import staged
from . import sqltext
from .contacts import INNER
from .registry import register, rnd

BIN, PROX, LEAST, DRAWS, EXCLUDE = 1_000_000, 1_000_000, 2, 4, "chr2:3000000-4500000,chr6:0-10"
TARGET = INNER + f""", ft as (select *, rna_chrom as chrom,
      cast(floor(dna_pos / {BIN}) as bigint) as tbin, cast(floor(start_pos / {BIN}) as bigint) as sbin,
      case when rna_strand = strand then 'antisense' else 'sense' end as orientation from hit),
  b0 as (select z.chrom, b.b as bin, (select count(*) from ft where dna_chrom = z.chrom and tbin = b.b) as n
    from chrom_size z cross join (select unnest(range(21)) as b) b),
  b1 as (select *, n / (select sum(n) from b0) as density from b0),
  b2 as (select *, (density > 1.5 * (select median(density) from b1 where n > 0)) or (chrom = 'chr2' and bin between 3 and 4)
      or (chrom = 'chr6' and bin = 0) as masked from b1),
  b3 as (select *, case when masked then 0.0 else density end as w from b2),
  b4 as (select *, w / (select sum(w) from b3) as weight, row_number() over (order by chrom, bin) - 1 as g from b3),
  src as (select ft.*, ft.dna_chrom <> ft.chrom or abs(dna_pos - start_pos) > {PROX} as far, t.masked as tm from ft
    join b4 s on s.chrom = ft.chrom and s.bin = ft.sbin and not s.masked
    join b4 t on t.chrom = ft.dna_chrom and t.bin = ft.tbin),
  pb as (select fid, orientation, family, subfamily, chrom, start_pos, dna_chrom, tbin, count(*) as n_all,
      count(*) filter (far) as n_far, count(*) filter (far and not tm) as n from src group by all),
  cell as (select fid, orientation, family, subfamily, chrom, start_pos, cast(sum(n) as bigint) as n_contacts,
      max(n) as top1, count(*) filter (n > 0) as n_bins, sum(n * n) / (sum(n) * sum(n) * 1.0) as h from pb group by all
    having sum(n_all) >= {LEAST} and sum(n_far) >= {LEAST} and sum(n) >= {LEAST})"""
RANDOM = """((t.fid % 1000003) * 48271 + (t.stratum + 1) * 7919 + t.node * 104729 + t.d * 1299709
      + case t.orientation when 'sense' then 0 else 15485863 end) % 1000003 / 1000003.0"""
#: The least x whose binomial distribution function exceeds the draw.
QUANTILE = """case when p >= 1 then n else len(list_filter(range(0, n), lambda j: list_sum(list_transform(range(0, j + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) * pow(p, i) * pow(1 - p, n - i))) <= r)) end"""


def redraw_sql(target):
    return target + f""", st as (select s.fid, s.orientation, s.chrom, s.start_pos, c.n_contacts, case when dna_chrom <> s.chrom then -1
      else cast(floor(log2(abs(dna_pos - s.start_pos) / {PROX}.0)) as bigint) end as stratum, count(*) as k
    from src s join cell c on c.fid = s.fid and c.orientation = s.orientation where far and not tm group by all),
  cd as (select st.*, b.g, b.weight, case when b.masked then 0.0 else 1.0 end as free from st join b4 b on case when stratum = -1
      then b.chrom <> st.chrom else b.chrom = st.chrom and abs(b.bin * {BIN} + {BIN // 2} - st.start_pos) > {PROX} * pow(2, stratum)
        and abs(b.bin * {BIN} + {BIN // 2} - st.start_pos) <= {PROX} * pow(2, stratum + 1) end),
  emp as (select st.* from st where not exists (select 1 from cd where cd.fid = st.fid and cd.orientation = st.orientation
      and cd.stratum = st.stratum and cd.free > 0)),
  ca as (select cd.* from cd join (select fid, orientation, stratum from cd group by all having sum(free) > 0) x using (fid, orientation, stratum)
    union all select e.*, b.g, b.weight, case when b.masked then 0.0 else 1.0 end from emp e join b4 b on b.chrom = e.chrom),
  cb as (select *, case when sum(weight) over w > 0 then weight else free end as v, row_number() over (partition by fid, orientation, stratum
      order by g) as x, count(*) over w as m from ca window w as (partition by fid, orientation, stratum)),
  cw as (select *, sum(v) over (partition by fid, orientation, stratum order by g) as c1 from cb),
  mass as (select fid, orientation, stratum, x, c1 from cw union all select distinct fid, orientation, stratum, 0, 0.0 from cw)"""


def null_sql(target):
    return redraw_sql(target) + f""", tree as (
    with recursive tr as (
      select st.fid, st.orientation, st.stratum, st.n_contacts, d.d, 0::bigint as lo, z.m as hi, st.k as n, 1::bigint as node
      from st join (select distinct fid, orientation, stratum, m from cw) z using (fid, orientation, stratum)
        cross join (select unnest(range({DRAWS})) as d) d
      union all
      select fid, orientation, stratum, n_contacts, d, case when s.s = 0 then lo else mid end, case when s.s = 0 then mid else hi end,
        case when s.s = 0 then l else n - l end, 2 * node + s.s
      from (select *, {QUANTILE} as l from (
          select t.*, cast(floor((lo + hi) / 2) as bigint) as mid, (b.c1 - a.c1) / (c.c1 - a.c1) as p, {RANDOM} as r
          from tr t join mass a on a.fid = t.fid and a.orientation = t.orientation and a.stratum = t.stratum and a.x = t.lo
            join mass b on b.fid = t.fid and b.orientation = t.orientation and b.stratum = t.stratum and b.x = cast(floor((lo + hi) / 2) as bigint)
            join mass c on c.fid = t.fid and c.orientation = t.orientation and c.stratum = t.stratum and c.x = t.hi
          where hi - lo > 1) y) x cross join (select unnest([0, 1]) as s) s where case when s.s = 0 then l else n - l end > 0)
    select * from tr where hi - lo = 1),
  hd as (select fid, orientation, n_contacts, d, sum(n * n) / (n_contacts * n_contacts * 1.0) as h, max(n) as top from (
      select t.fid, t.orientation, t.n_contacts, d, g, sum(n) as n from tree t join cw on cw.fid = t.fid and cw.orientation = t.orientation
        and cw.stratum = t.stratum and cw.x = t.hi group by all) x group by fid, orientation, n_contacts, d),
  nul as (select fid, orientation, avg(h) as h_null, stddev_samp(h) as h_null_sd, avg(top) as top1_null from hd group by all)"""


REDRAW = null_sql(TARGET)
VIEWS = ["feature", "contact", "chrom_size"]


def lcg_uniform(fid, orientation, stratum, node, draw):
    side = np.where(orientation == "sense", 0, 15485863)
    return ((fid % 1000003) * 48271 + (stratum + 1) * 7919 + node * 104729 + draw * 1299709 + side) % 1000003 / 1000003.0


LCG = quantile_split(lcg_uniform)


def hits(spark, sf):
    return staged(pairs.on_copies(view(spark, sf, "contact"), view(spark, sf, "feature")))


def bins(spark, sf, on):
    return staged(plan.target_bins(on, view(spark, sf, "chrom_size"), BIN, 1.5, EXCLUDE))


@register("target_bins", with_views(VIEWS, TARGET + " select chrom, bin, n, masked, round(density, 8) as density, round(weight, 8) as weight from b4"))
def target_bins(spark, sf):
    out = bins(spark, sf, hits(spark, sf))
    return out.select("chrom", "bin", "n", "masked", rnd("density", 8).alias("density"), rnd("weight", 8).alias("weight"))


@register("target_concentration", with_views(VIEWS, TARGET + " select * replace (round(h, 6) as h), round(1 / h, 6) as eff_bins from cell"))
def target_concentration(spark, sf):
    on = hits(spark, sf)
    out = plan.concentration(plan.distant_counts(on, bins(spark, sf, on), BIN, PROX), LEAST)
    return out.withColumn("h", rnd("h")).withColumn("eff_bins", rnd("eff_bins"))


@register(
    "target_redraw_null",
    with_views(VIEWS, REDRAW + " select fid, orientation, round(h_null, 6) as h_null, round(h_null_sd, 6) as h_null_sd, round(top1_null, 6) as top1_null from nul"),
)
def target_redraw_null(spark, sf):
    on = hits(spark, sf)
    table = bins(spark, sf, on)
    cells = staged(plan.concentration(plan.distant_counts(on, table, BIN, PROX), LEAST))
    out = plan.redraw_null(on, cells, table, BIN, PROX, DRAWS, LCG)
    return out.select("fid", "orientation", *[rnd(c).alias(c) for c in ("h_null", "h_null_sd", "top1_null")])


@register(
    "redraw_expectation",
    with_views(VIEWS, redraw_sql(TARGET) + """, pr as (select st.fid, st.orientation, n_contacts, st.k, cw.g,
        v / sum(v) over (partition by st.fid, st.orientation, st.stratum) as p from st join (select fid, orientation, stratum, g, v from cw) cw
        on cw.fid = st.fid and cw.orientation = st.orientation and cw.stratum = st.stratum),
      pb2 as (select fid, orientation, n_contacts, g, sum(k * p) as e, sum(k * p * (1 - p)) as o from pr group by all)
    select fid, orientation, round((sum(e * e) + sum(o)) / (n_contacts * n_contacts * 1.0), 6) as h_expected, true as near
    from pb2 group by fid, orientation, n_contacts"""),
)
def redraw_expectation(spark, sf):
    """Production draws beside the mean they tend to: within six standard errors, and half a hundredth for rare draws."""
    on = hits(spark, sf)
    table = bins(spark, sf, on)
    cells = staged(plan.concentration(plan.distant_counts(on, table, BIN, PROX), LEAST))
    drawn = plan.redraw_null(on, cells, table, BIN, PROX, 1000)
    out = drawn.join(plan.expected_null(on, cells, table, BIN, PROX), ["fid", "orientation"])
    near = F.abs(F.col("h_null") - F.col("h_expected")) <= F.col("h_null_sd") * 6.0 / F.sqrt(F.lit(1000.0)) + 0.005
    return out.select("fid", "orientation", rnd("h_expected").alias("h_expected"), near.alias("near"))


TEST = REDRAW + f""", t0 as (select c.*, h_null, h_null_sd, top1_null, case when h_null_sd > 0 then (h - h_null) / h_null_sd
      else 'nan'::double end as z, floor(log2(n_contacts) * 2) / 2 as ds from cell c join nul n on n.fid = c.fid and n.orientation = c.orientation),
  t1 as (select *, case when count(*) over w >= 20 then avg(h) over w else 'nan'::double end as peer_mean,
      case when count(*) over w >= 20 and stddev_samp(h) over w > 0 then (h - avg(h) over w) / stddev_samp(h) over w
        else 'nan'::double end as z_peer from t0 window w as (partition by ds)),
  t2 as (select *, {sqltext.normal_upper("z")} as p, {sqltext.normal_upper("z_peer")} as p_peer from t1),
  t3 as (select * from {sqltext.bh("t2", "p", "q")} a), t4 as (select * from {sqltext.bh("(select * exclude (__ok, __m, __rk) from t3) b", "p_peer", "q_peer")} c)"""
DOUBLES = ("h_null", "z", "p", "q", "peer_mean", "z_peer", "p_peer", "q_peer")


@register(
    "target_test",
    with_views(VIEWS, TEST + " select fid, orientation, n_contacts, n_bins, top1, " + ", ".join(f"round({c}, 4) as {c}" for c in DOUBLES) + " from t4"),
)
def target_test(spark, sf):
    out = plan.target_test(hits(spark, sf), view(spark, sf, "chrom_size"), BIN, PROX, LEAST, DRAWS, 1.5, EXCLUDE, LCG)
    return out.select("fid", "orientation", "n_contacts", "n_bins", "top1", *[rnd(c, 4).alias(c) for c in DOUBLES])


@register(
    "row_scale_correction",
    with_views(["contact"], f""" , p as (select dna_pos as id, cast((mapq * 61 + mapq_dna) * 61 + dna_pos % 61 as double) / 226981.0::double as p from contact)
    select id, round(p, 8) as p, round(q, 8) as q from {sqltext.bh("p", "p", "q")} y"""),
)
def row_scale_correction(spark, sf):
    p = ((F.col("mapq") * 61 + F.col("mapq_dna")) * 61 + F.col("dna_pos") % 61).cast("double") / 226981.0
    rows = view(spark, sf, "contact").select(F.col("dna_pos").alias("id"), p.alias("p"))
    out = order.benjamini_hochberg(rows, "p", "q", bounded=False)
    return out.select("id", rnd("p", 8).alias("p"), rnd("q", 8).alias("q"))
