"""Signal per copy, ratios, rank tests and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import contrasts, coverage
from ..plans import runs, signal as plan
from ..session import staged
from . import sqltext
from .registry import SQL, register, rnd

SAMPLES = ("ip_r1", "ip_r2", "in_r1", "in_r2")
FT = ["feature", "track", "chrom_size"]
SUMS = """, sums as (
    select f.fid, f.strand, t.sample, t.track_strand,
      sum(t.value * (least(f.end_pos, t.end_pos) - greatest(f.start_pos, t.start_pos))) as signal
    from feature f join track t on t.chrom = f.chrom and t.start_pos < f.end_pos and t.end_pos > f.start_pos
    group by all), tot as (
    select sample, track_strand, sum(value * (end_pos - start_pos)) as total from track group by all)"""
DENS = SUMS + """, o as (select 'sense' as orientation union all select 'antisense'),
  src as (select f.*, o.orientation, f.end_pos - f.start_pos as length,
      case when (f.strand = '+') = (o.orientation = 'sense') then 'pos' else 'neg' end as track_strand
    from feature f cross join o),
  dens as (select s.fid, s.subfamily, s.family, s.length, s.orientation, """ + ", ".join(
    f"coalesce(max(case when u.sample = '{x}' then u.signal end), 0) / (s.length * max(case when t.sample = '{x}' then t.total end)) * 1e9 as d_{x}"
    for x in SAMPLES
) + """ from src s join tot t on t.track_strand = s.track_strand
    left join sums u on u.fid = s.fid and u.track_strand = s.track_strand and u.sample = t.sample
    group by s.fid, s.subfamily, s.family, s.length, s.orientation),
  io as (select *, d_ip_r1 + d_ip_r2 as ip, d_in_r1 + d_in_r2 as input from dens),
  fl as (select orientation, 0.25 * median(input) as floor from io where input > 0 group by orientation),
  l as (select io.*, floor, log2((ip + floor/2) / (input + floor/2)) as l2,
      log2((2*d_ip_r1 + floor/2) / (2*d_in_r1 + floor/2)) as l2_rep1,
      log2((2*d_ip_r2 + floor/2) / (2*d_in_r2 + floor/2)) as l2_rep2
    from io join fl on fl.orientation = io.orientation where input >= floor)"""


def signal(spark, sf):
    return plan.copy_signal(view(spark, sf, "feature"), view(spark, sf, "track"), view(spark, sf, "chrom_size"))


def ratios(spark, sf):
    totals = coverage.library_totals(view(spark, sf, "track"))
    return plan.log_ratios(plan.densities(signal(spark, sf), totals))


@register("library_totals", with_views(["track"], " select sample, track_strand, round(sum(value * (end_pos - start_pos)), 3) as total from track group by all"))
def library_totals(spark, sf):
    return coverage.library_totals(view(spark, sf, "track")).withColumn("total", rnd("total", 3))


@register("signal_sums", with_views(FT, SUMS + " select * replace (round(signal, 4) as signal) from sums"))
def signal_sums(spark, sf):
    spans = coverage.clip_spans(view(spark, sf, "feature"), view(spark, sf, "chrom_size"))
    return coverage.signal_sums(spans, view(spark, sf, "track"), ["fid", "strand"]).withColumn("signal", rnd("signal", 4))


COPY_COLUMNS = [f"{s}_{o}" for s in SAMPLES for o in ("sense", "antisense")]


@register(
    "copy_signal",
    with_views(FT, SUMS + " select f.fid, f.chrom, f.strand, f.subfamily, f.family, f.end_pos - f.start_pos as length, "
               + ", ".join(
                   f"""round(coalesce(sum(case when u.sample = '{s}' and ((u.track_strand = 'pos') = (f.strand = '+'))
                     = {str(o == 'sense').lower()} then u.signal end), 0), 4) as {s}_{o}"""
                   for s in SAMPLES for o in ("sense", "antisense"))
               + " from feature f left join sums u on u.fid = f.fid group by all"),
)
def copy_signal(spark, sf):
    df = signal(spark, sf)
    return df.select(*[rnd(c, 4).alias(c) if c in COPY_COLUMNS else c for c in df.columns])


@register("log_ratios", with_views(FT, DENS + " select fid, orientation, round(input, 6) as input, round(floor, 6) as floor, round(l2, 6) as l2 from l"))
def log_ratios(spark, sf):
    return ratios(spark, sf).select("fid", "orientation", *[rnd(c).alias(c) for c in ("input", "floor", "l2")])


LEAST = 10
RANKED = DENS + """, rk as (select *, rank() over (partition by orientation order by l2) +
      (count(*) over (partition by orientation, l2) - 1) / 2.0 as r,
      count(*) over (partition by orientation, l2) as t, count(*) over (partition by orientation) as nn from l),
  pool as (select orientation, sum(t*t - 1.0) as ties, max(nn) as nn, median(l2) as bg from rk group by orientation),
  g as (select k.subfamily, k.family, k.orientation, count(*) as n1, sum(r) as rsum, median(l2) as med, median(input) as med_in,
      avg(case when l2 > 0 then 1.0 else 0.0 end) as fp from rk k group by all having count(*) >= %d),
  u as (select g.*, p.ties, p.nn, p.bg, rsum - n1*(n1+1)/2.0 as uu, n1 * 1.0 * (nn - n1) as nm,
      (select count(*) from feature f where f.subfamily = g.subfamily) as n_total
    from g join pool p on p.orientation = g.orientation),
  z as (select *, (greatest(uu, nm - uu) - nm/2 - 0.5) / sqrt(nm/12 * ((nn + 1) - ties / (nn * (nn - 1.0)))) as z from u),
  pv as (select *, least(1.0, 2 * %s) as p from z)""" % (LEAST, sqltext.normal_upper("z"))


@register(
    "signal_enrichment",
    with_views(FT, RANKED + f""" select subfamily, family, orientation, n1 as n_copies, n_total, round(med, 6) as median_l2,
      round(bg, 6) as bg_median_l2, round(med - bg, 6) as delta, round(fp, 6) as frac_positive,
      round(med_in, 6) as median_input, round(p, 6) as p, round(q, 6) as q from {sqltext.bh('pv', 'p', 'q')} y"""),
)
def signal_enrichment(spark, sf):
    out = plan.enrich(ratios(spark, sf), view(spark, sf, "feature"), LEAST)
    whole = ("subfamily", "family", "orientation", "n_copies", "n_total")
    return out.select(*[c if c in whole else rnd(c).alias(c) for c in out.columns])


@register("signal_analysis", SQL["signal_enrichment"])
def signal_analysis(spark, sf):
    out = runs.signal_analysis(view(spark, sf, "feature"), view(spark, sf, "track"), view(spark, sf, "chrom_size"), min_copies=LEAST).result
    whole = ("subfamily", "family", "orientation", "n_copies", "n_total")
    return out.select(*[c if c in whole else rnd(c).alias(c) for c in out.columns])


@register("rank_test_u", with_views(FT, RANKED + " select subfamily, orientation, n1 as n_group, nn as n_pool, round(uu, 3) as u, round(p, 6) as p from pv"))
def rank_test_u(spark, sf):
    out = contrasts.mann_whitney(ratios(spark, sf), ["orientation"], "subfamily", "l2").where(F.col("n_group") >= LEAST)
    return out.withColumn("u", rnd("u", 3)).withColumn("p", rnd("p"))


@register(
    "mid_ranks",
    with_views(FT, DENS + """ select orientation, l2 as value, round(r, 1) as rank, n from (
      select orientation, round(l2, 2) + 0.0 as l2, rank() over (partition by orientation order by round(l2, 2))
        + (count(*) over (partition by orientation, round(l2, 2)) - 1) / 2.0 as r,
        count(*) over (partition by orientation, round(l2, 2)) as n from l) x group by all"""),
)
def mid_ranks(spark, sf):
    from ..operators.order import mid_ranks as ranks

    df = ratios(spark, sf).select("orientation", rnd("l2", 2).alias("value"))
    return ranks(df, ["orientation"], "value").select("orientation", "value", "rank", "n")


PROFILE = DENS + f""", prof as (select orientation, subfamily, count(*) as n_copies, median(l2) as median_l2,
      median(input) as median_input, median(length) as median_length, median(l2_rep1) as median_l2_rep1,
      median(l2_rep2) as median_l2_rep2 from l group by all having count(*) >= {LEAST})"""


@register("category_profile", with_views(FT, PROFILE + """ select * replace (round(median_l2, 6) as median_l2,
    round(median_input, 6) as median_input, round(median_length, 6) as median_length,
    round(median_l2_rep1, 6) as median_l2_rep1, round(median_l2_rep2, 6) as median_l2_rep2) from prof"""))
def category_profile(spark, sf):
    out = plan.category_profile(ratios(spark, sf), LEAST)
    return out.select(*[rnd(c).alias(c) if c.startswith("median") else c for c in out.columns])


RANKS_2 = "rank() over (partition by orientation order by {c}) + (count(*) over (partition by orientation, {c}) - 1) / 2.0"


@register("spearman_input_delta", with_views(FT, PROFILE + f""" select orientation, count(*) as n, round(corr(a, b), 6) as r from (
    select orientation, {RANKS_2.format(c='median_input')} as a, {RANKS_2.format(c='median_l2')} as b from prof) x group by orientation"""))
def spearman_input_delta(spark, sf):
    prof = staged(plan.category_profile(ratios(spark, sf), LEAST))
    out = contrasts.correlation(prof, "median_input", "median_l2", ["orientation"], ranks=True)
    return out.select("orientation", "n", rnd("r").alias("r"))


@register("pearson_replicates", with_views(FT, PROFILE + """ select orientation, count(*) as n,
    round(corr(median_l2_rep1, median_l2_rep2), 6) as r from prof group by orientation"""))
def pearson_replicates(spark, sf):
    prof = staged(plan.category_profile(ratios(spark, sf), LEAST))
    out = contrasts.correlation(prof, "median_l2_rep1", "median_l2_rep2", ["orientation"])
    return out.select("orientation", "n", rnd("r").alias("r"))


BANDS = (100, 400, 700, 1000)
STRATA = 4
EDGED = DENS + """, ed as (select orientation, quantile_cont(input, [0.25, 0.5, 0.75]) as e from l group by orientation),
  st as (select l.*, family = 'famN' as flagged, len(list_filter(ed.e, lambda x : x <= input)) as stratum,
      case when length < 400 then 0 when length < 700 then 1 when length < 1000 then 2 end as band
    from l join ed on ed.orientation = l.orientation),
  stk as (select *, rank() over (partition by {k} order by l2) + (count(*) over (partition by {k}, l2) - 1) / 2.0 as r,
      count(*) over (partition by {k}, l2) as t from st where {w}),
  cell as (select {k}, count(*) as nn, sum(t*t - 1.0) as ties, count(*) filter (flagged) as n1,
      sum(r) filter (flagged) as rsum, median(l2) filter (flagged) - median(l2) filter (not flagged) as delta
    from stk group by {k} having count(*) filter (flagged) >= 5 and count(*) filter (not flagged) >= 5),
  cz as (select *, rsum - n1*(n1+1)/2.0 as uu, n1 * 1.0 * (nn - n1) as nm from cell),
  cp as (select *, (greatest(uu, nm - uu) - nm/2 - 0.5) / sqrt(nm/12 * ((nn + 1) - ties / (nn * (nn - 1.0)))) as z from cz)"""


def stratified(spark, sf, keys):
    rows = plan.input_strata(ratios(spark, sf), STRATA).withColumn("flagged", F.col("family") == "famN")
    rows = rows.withColumn("band", plan.length_band("length", BANDS))
    rows = staged(rows.where("band is not null") if "band" in keys else rows)
    return contrasts.stratified_contrast(rows, keys, "flagged", "l2", 5)


for _name, _keys in (("stratum_contrast", ["orientation", "stratum"]), ("band_stratum_contrast", ["orientation", "band", "stratum"])):
    _sql = EDGED.format(k=", ".join(_keys), w="band is not null" if "band" in _keys else "true") + f""" select {", ".join(_keys)}, n1 as n_flagged, nn - n1 as n_rest,
      round(delta, 6) as delta, round(least(1.0, 2 * {sqltext.normal_upper("z")}), 6) as p from cp"""

    @register(_name, with_views(FT, _sql))
    def _contrast(spark, sf, keys=tuple(_keys)):
        return stratified(spark, sf, list(keys)).withColumn("delta", rnd("delta")).withColumn("p", rnd("p"))


@register("contrast_summary", with_views(FT, EDGED.format(k="orientation, stratum", w="true") + """ select orientation, count(*) as n_cells,
    round(median(delta), 6) as median_delta, count(*) filter (delta > 0) as n_positive from cell group by orientation"""))
def contrast_summary(spark, sf):
    out = contrasts.contrast_summary(stratified(spark, sf, ["orientation", "stratum"]), ["orientation"])
    return out.withColumn("median_delta", rnd("median_delta"))


@register("group_profile", with_views(FT, DENS + """ select family as name, count(*) as n, round(median(length), 6) as median_length,
    round(median(input), 6) as median_input from l group by family"""))
def group_profile(spark, sf):
    out = plan.group_profile(ratios(spark, sf).withColumn("name", F.col("family")), "name")
    return out.withColumn("median_length", rnd("median_length")).withColumn("median_input", rnd("median_input"))


@register("exact_quantiles", with_views(["feature"], """ select subfamily, round(q[1], 6) as q10, round(q[2], 6) as q50, round(q[3], 6) as q99
    from (select subfamily, quantile_cont(start_pos, [0.1, 0.5, 0.99]) as q from feature group by subfamily) x"""))
def exact_quantiles(spark, sf):
    from ..operators.order import exact_quantiles as quantiles

    out = quantiles(view(spark, sf, "feature"), ["subfamily"], "start_pos", [0.1, 0.5, 0.99], "q")
    return out.select("subfamily", *[rnd(F.col("q")[k]).alias(n) for k, n in enumerate(("q10", "q50", "q99"))])
