"""Bin covariates, replication timing and confounder-stratified position of element copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import coverage, order
from ..plans import position as plan
from ..session import staged
from .registry import register, rnd

BIN = 200_000
FRACTIONS = ("ip_r1", "ip_r2", "in_r1", "in_r2")
AXES = {"ax_ip": ("ip_r1", "ip_r2"), "ax_in": ("in_r1", "in_r2")}
GRID = f""", gr as (select chrom, b.b as bin from chrom_size cross join (select unnest(range(101)) as b) b),
  pieces as (select s.chrom, g.b as bin, substring(seq, cast(greatest(start_off, g.b * {BIN}) - start_off + 1 as bigint),
      cast(least(start_off + length(seq), (g.b + 1) * {BIN}) - greatest(start_off, g.b * {BIN}) as bigint)) as piece
    from seq_line s join (select unnest(range(200)) as b) g on start_off < (g.b + 1) * {BIN} and start_off + length(seq) > g.b * {BIN}),
  comp as (select chrom, bin, cast(sum(length(piece) - length(translate(piece, 'GCgc', ''))) as bigint) as n_gc,
      cast(sum(length(piece) - length(translate(piece, 'ATat', ''))) as bigint) as n_at, cast(sum(length(piece)) as bigint) as total
    from pieces group by chrom, bin)"""


def shared(table, by):
    return f"""select {by}s.chrom, g.b as bin, {{v}} as amount from {table} s join (select unnest(range(101)) as b) g
      on s.start_pos < (g.b + 1) * {BIN} and s.end_pos > g.b * {BIN} group by all"""


BP = f"(least(s.end_pos, (g.b + 1) * {BIN}) - greatest(s.start_pos, g.b * {BIN}))"
COV = GRID + ", sat as (" + shared("satellite", "").format(v=f"sum({BP})") + f"""),
  cov as (select gr.chrom, gr.bin, case when coalesce(n_gc + n_at, 0) > 0 then n_gc / (n_gc + n_at) else 'nan'::double end as gc_frac,
      case when coalesce(total, 0) > 0 then (total - n_gc - n_at) / total else 1.0 end as n_frac, coalesce(amount, 0) / {BIN} as sat_frac
    from gr left join comp on comp.chrom = gr.chrom and comp.bin = gr.bin left join sat on sat.chrom = gr.chrom and sat.bin = gr.bin)"""
RT = ", am as (" + shared("track", "s.sample, ").format(v=f"sum(s.value * {BP})") + f"""),
  sc as (select sample, sum(amount / {BIN}) as tot from am group by sample),
  fn as (select am.*, amount / {BIN} / tot * (select avg(tot) from sc) as f, list_position(['ip_r1', 'ip_r2', 'in_r1', 'in_r2'], am.sample) as ix
    from am join sc on sc.sample = am.sample),
  rt as (select gr.chrom, gr.bin, coalesce(sum(f), 0) as s_total, case when coalesce(sum(f), 0) > 0 then sum(f * ix) / sum(f)
      else 'nan'::double end as rt from gr left join fn on fn.chrom = gr.chrom and fn.bin = gr.bin group by all)"""
AX = ", rep as (" + shared("track", "s.sample, ").format(v=f"sum(s.value * {BP}) / sum({BP})") + """),
  ax as (select chrom, bin, """ + ", ".join(
    f"case when count(*) filter (sample in {reps}) = 2 then avg(amount) filter (sample in {reps}) end as {name}"
    for name, reps in AXES.items()
) + " from rep group by chrom, bin)"
VIEWS = ["feature", "chrom_size", "seq_line", "satellite", "track"]
MAX_N, MIN_S = 0.9, 1.0


def covariates(spark, sf):
    return plan.covariates(view(spark, sf, "chrom_size"), view(spark, sf, "seq_line"), view(spark, sf, "satellite"), BIN)


def grid(spark, sf):
    return coverage.bin_grid(view(spark, sf, "chrom_size"), BIN)


def timing(spark, sf):
    return plan.timing(view(spark, sf, "track"), grid(spark, sf), FRACTIONS, BIN)


def rounded(df, whole):
    return df.select(*[c if c in whole else rnd(c).alias(c) for c in df.columns])


@register("base_composition", with_views(VIEWS, GRID + " select * from comp"))
def base_composition(spark, sf):
    return plan.base_composition(view(spark, sf, "seq_line"), BIN)


@register(
    "bin_covariates",
    with_views(VIEWS, COV + " select chrom, bin, round(gc_frac, 6) as gc_frac, round(n_frac, 6) as n_frac, round(sat_frac, 6) as sat_frac from cov"),
)
def bin_covariates(spark, sf):
    return rounded(covariates(spark, sf), ("chrom", "bin"))


@register("apportioned_signal", with_views(VIEWS, GRID + RT + " select sample, chrom, bin, round(amount, 4) as amount from am"))
def apportioned_signal(spark, sf):
    return coverage.bin_sums(view(spark, sf, "track"), "value", BIN, ["sample"]).withColumn("amount", rnd("amount", 4))


@register("replication_timing", with_views(VIEWS, GRID + RT + " select chrom, bin, round(rt, 6) as rt, round(s_total, 5) as s_total from rt"))
def replication_timing(spark, sf):
    return timing(spark, sf).withColumn("rt", rnd("rt")).withColumn("s_total", rnd("s_total", 5))


@register("fraction_coverage", with_views(VIEWS, GRID + RT + " select sample, round(count(*) filter (amount > 0) / (select count(*) from gr), 6) as covered from am group by sample"))
def fraction_coverage(spark, sf):
    out = plan.fraction_coverage(view(spark, sf, "track"), grid(spark, sf), BIN)
    return out.withColumn("covered", rnd("covered"))


@register(
    "timing_direction",
    with_views(VIEWS, COV + RT + """, r as (select corr(rt, gc_frac) as r, count(*) as n_bins from rt join cov on cov.chrom = rt.chrom
      and cov.bin = rt.bin where not isnan(rt) and not isnan(gc_frac) and s_total > 0)
    select round(r, 6) as r, n_bins, case when r < -0.2 then 'low_is_early' when r > 0.2 then 'low_is_late' else 'too_weak' end as direction from r"""),
)
def timing_direction(spark, sf):
    return plan.timing_direction(timing(spark, sf), covariates(spark, sf)).withColumn("r", rnd("r"))


@register("axis_means", with_views(VIEWS, GRID + AX + " select chrom, bin, round(ax_ip, 6) as ax_ip, round(ax_in, 6) as ax_in from ax"))
def axis_means(spark, sf):
    return rounded(plan.axis_means(view(spark, sf, "track"), AXES, BIN), ("chrom", "bin"))


JOINED = COV + RT + AX + f""", tb as (select cov.*, rt.rt, rt.s_total, ax_ip, ax_in, coalesce(n_frac < {MAX_N} and sat_frac < 0.1
      and not isnan(gc_frac) and ax_ip is not null and ax_ip <> 0 and ax_in is not null and ax_in <> 0 and not isnan(rt.rt)
      and s_total >= {MIN_S}, false) as usable
    from cov join rt on rt.chrom = cov.chrom and rt.bin = cov.bin left join ax on ax.chrom = cov.chrom and ax.bin = cov.bin)"""


def table(spark, sf):
    key = ["chrom", "bin"]
    rows = covariates(spark, sf).join(timing(spark, sf), key)
    rows = rows.join(plan.axis_means(view(spark, sf, "track"), AXES, BIN), key, "left")
    return staged(rows.withColumn("usable", plan.usable_bins(rows, list(AXES), MAX_N, 0.1, True, MIN_S)))


@register("usable_bins", with_views(VIEWS, JOINED + " select chrom, bin, usable from tb"))
def usable_bins(spark, sf):
    return table(spark, sf).select("chrom", "bin", "usable")


def cut(name, column, n):
    probs = ", ".join(repr(k / n) for k in range(1, n))
    return f"""(select len(list_filter(e.q, lambda x : x <= {column})) from (select quantile_cont({column}, [{probs}]) as q
        from tb where usable) e) as {name}"""


STRATA, JOINT, MIN_CELL = 8, 3, 20
EXPECT = JOINED + f""", s0 as (select tb.*, {cut('m', 'tb2.gc_frac', STRATA).replace('tb2.gc_frac, [', 'gc_frac, [').replace('tb2.', 'tb.')},
      {cut('g', 'tb2.gc_frac', JOINT).replace('tb2.gc_frac, [', 'gc_frac, [').replace('tb2.', 'tb.')},
      {cut('r', 'tb2.rt', JOINT).replace('tb2.rt, [', 'rt, [').replace('tb2.', 'tb.')} from tb where usable),
  s1 as (select *, g * {JOINT} + r as cell from s0),
  ex as (select *, case when count(*) over c >= {MIN_CELL} then avg(ax_ip) over c else avg(ax_ip) over m end as e_ip,
      case when count(*) over c >= {MIN_CELL} then avg(ax_in) over c else avg(ax_in) over m end as e_in,
      case when count(*) over c >= {MIN_CELL} then false else true end as thin
    from s1 window c as (partition by cell), m as (partition by m))"""


def expected(spark, sf, covariate="both"):
    return plan.expectations(table(spark, sf), list(AXES), covariate, STRATA, JOINT, MIN_CELL)


@register(
    "stratum_expectations",
    with_views(VIEWS, EXPECT + " select chrom, bin, cell as stratum, round(e_ip, 6) as expect_ax_ip, round(e_in, 6) as expect_ax_in from ex"),
)
def stratum_expectations(spark, sf):
    return rounded(expected(spark, sf).select("chrom", "bin", "stratum", "expect_ax_ip", "expect_ax_in"), ("chrom", "bin", "stratum"))


@register("gc_stratum_expectations", with_views(VIEWS, EXPECT + """ select chrom, bin, m as stratum,
    round(avg(ax_ip) over (partition by m), 6) as expect_ax_ip from ex"""))
def gc_stratum_expectations(spark, sf):
    return rounded(expected(spark, sf, "gc").select("chrom", "bin", "stratum", "expect_ax_ip"), ("chrom", "bin", "stratum"))


VALUES = {"ax_ip": "ax_ip", "ax_ip_resid": "ax_ip - e_ip", "ax_in": "ax_in", "ax_in_resid": "ax_in - e_in",
          "contrast": "ax_ip - ax_in", "contrast_resid": "(ax_ip - e_ip) - (ax_in - e_in)"}
POSITION = EXPECT + f""", fb as (select family, subfamily, chrom, cast(floor(floor((start_pos + end_pos) / 2) / {BIN}) as bigint) as bin, count(*) as w
      from feature group by all),
  lv as (select 'family' as level, family as name, family, chrom, bin, cast(sum(w) as bigint) as w from fb group by all
    union all select 'subfamily', subfamily, family, chrom, bin, w from fb),
  bv as (select lv.*, gc_frac, {", ".join(f"{v} as v_{n}" for n, v in VALUES.items())} from lv join ex on ex.chrom = lv.chrom and ex.bin = lv.bin),
  mn as (select level, name, family, cast(sum(w) as bigint) as n_copies, count(*) as n_bins, sum(w) * sum(w) / sum(w * w) as n_eff,
      sum(w * gc_frac) / sum(w) as gc_mean, {", ".join(f"sum(w * v_{n}) / sum(w) as m_{n}" for n in VALUES)} from bv group by level, name, family),
  tc as (select level, name, max(b) / sum(b) as top_chrom_frac from (select level, name, chrom, count(*) as b from bv group by all) x group by level, name),
  se as (select bv.level, bv.name, {", ".join(f"sqrt(sum(w * w * pow(v_{n} - m_{n}, 2))) / sum(w) as se_{n}" for n in VALUES)}
    from bv join mn on mn.level = bv.level and mn.name = bv.name group by bv.level, bv.name)
  select mn.level, mn.name, mn.family, n_copies, n_bins, round(n_eff, 6) as n_eff, round(n_copies / n_bins, 6) as copies_per_bin,
    round(top_chrom_frac, 6) as top_chrom_frac, round(gc_mean, 6) as gc_mean,
    {", ".join(f"round(m_{n}, 6) as {n}_mean, round(se_{n}, 6) as {n}_se" for n in VALUES)}
  from mn join tc on tc.level = mn.level and tc.name = mn.name join se on se.level = mn.level and se.name = mn.name
  where mn.level <> 'subfamily' or n_bins >= 10
  union all select 'background', 'all_usable_bins', '-', count(*), count(*), count(*), 1.0, 'nan'::double, round(avg(gc_frac), 6),
    {", ".join((f"0.0" if n.endswith("_resid") else f"round(avg({v}), 6)") + ", 'nan'::double" for n, v in VALUES.items())} from ex"""
WHOLE = ("level", "name", "family", "n_copies", "n_bins")


def position(spark, sf):
    bins = staged(expected(spark, sf))
    copies = plan.copies_in_bins(view(spark, sf, "feature"), bins, BIN)
    return plan.position_table(copies, bins, list(AXES), ("ax_ip", "ax_in"), 10)


@register("position_table", with_views(VIEWS, POSITION))
def position_table(spark, sf):
    return rounded(position(spark, sf), WHOLE)


@register(
    "chromosome_driven",
    with_views(VIEWS, f"{POSITION.split('select mn.level')[0]} select mn.name, round(top_chrom_frac, 6) as top_chrom_frac from mn join tc"
               " on tc.level = mn.level and tc.name = mn.name where mn.level = 'subfamily' and n_bins >= 10 and top_chrom_frac > 0.13"),
)
def chromosome_driven(spark, sf):
    out = plan.chromosome_driven(position(spark, sf), 0.13)
    return out.select("name", rnd("top_chrom_frac").alias("top_chrom_frac"))


@register(
    "signal_by_stratum",
    with_views(VIEWS, EXPECT + " select m as stratum, count(*) as n_bins, round(avg(ax_ip), 6) as ax_ip, round(avg(ax_in), 6) as ax_in from ex group by m"),
)
def signal_by_stratum(spark, sf):
    out = plan.by_covariate_stratum(table(spark, sf).where("usable"), "gc_frac", list(AXES), STRATA)
    return rounded(out, ("stratum", "n_bins"))


@register(
    "length_strata",
    with_views(["feature"], """, e as (select family, quantile_cont(end_pos - start_pos, [0.2, 0.4, 0.6, 0.8]) as q from feature group by family)
    select fid, len(list_filter(e.q, lambda x : x <= end_pos - start_pos)) as stratum from feature f join e on e.family = f.family"""),
)
def length_strata(spark, sf):
    rows = view(spark, sf, "feature").withColumn("length", F.col("end_pos") - F.col("start_pos"))
    return order.quantile_strata(rows, "length", 5, "stratum", scope=["family"]).select("fid", "stratum")
