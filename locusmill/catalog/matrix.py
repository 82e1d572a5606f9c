"""Contact matrix: masking, compartments, expected values and promoter contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import selfcheck
from ..plans import matrix as plan
from ..session import staged
from . import sqltext
from .registry import lcg_offset, lcg_sql, register, rnd

BIN, EIGEN_BIN = 200_000, 250_000
LO, HI, PER, MOST, SHIFTS, SMOOTH = 1, 5, 2, 60, 3, 0.5
VIEWS = ["feature", "pixel", "bin_weight", "tss", "chrom_size"]


def binned(size):
    return f", el as (select f.*, cast(floor(floor((start_pos + end_pos) / 2) / {size}) as bigint) as bin from feature f)"


EXPECTED = f""", ok as (select * from bin_weight where weight is not null),
  tot as (select p.chrom, p.j - p.i as dist, sum(p.n * a.weight * b.weight) as total from pixel p join ok a on a.chrom = p.chrom
    and a.bin = p.i join ok b on b.chrom = p.chrom and b.bin = p.j where p.j - p.i <= {HI} group by all),
  np as (select a.chrom, b.bin - a.bin as dist, count(*) as n_pairs from ok a join ok b on b.chrom = a.chrom and b.bin >= a.bin
    and b.bin - a.bin <= {HI} group by all),
  ex as (select np.*, coalesce(total, 0) as total, coalesce(total, 0) / n_pairs as expected from np left join tot
    on tot.chrom = np.chrom and tot.dist = np.dist)"""
def within(a, b):
    return f"(({a}.dist = 0 and {b}.dist = 0) or ({a}.dist > 0 and {b}.dist > 0 and abs(log2({a}.dist) - log2({b}.dist)) <= {SMOOTH}))"


POOLED = EXPECTED + f""", po as (select dist, sum(total) as t, sum(n_pairs) as n from ex group by dist),
  ps as (select a.dist, sum(b.t) / sum(b.n) as expected from po a join po b on {within('a', 'b')} group by a.dist),
  ep as (select ex.chrom, ex.dist, ex.n_pairs, ps.expected from ex join ps on ps.dist = ex.dist)"""
HASH = "(fid * 48271 + 11) % 1000003"
DRAW = "((fid % 1000003 * 7919 + j * 104729) % 1000003) % (j + 1)"
ANCHORS = binned(BIN) + f""", an as (select fid, family, subfamily, chrom, bin from (select *, row_number() over (partition by subfamily
      order by {HASH}, fid) as rn from el) x where rn <= {MOST}),
  tb as (select distinct chrom, cast(floor(pos / {BIN}) as bigint) as tss_bin from tss),
  k as (select unnest(range({SHIFTS} + 1)) as grp)"""
#: Steps m - k to m - 1 each draw one of the numbers so far, or the step's own where that one is taken.
DRAWN = f"list_reduce(range(greatest(m - {PER}, 0), m), lambda s, j: list_append(s, case when list_contains(s, {DRAW}) then j else {DRAW} end), []::bigint[])"
PAIRS = f"""select fid, family, subfamily, chrom, least(bin, tss_bin) as i, greatest(bin, tss_bin) as j from (
      select m.*, tss_bin, row_number() over (partition by fid order by tss_bin) - 1 as x, count(*) over (partition by fid) as m from an m
      join tb on tb.chrom = m.chrom and abs(tss_bin - bin) between {LO} and {HI}) x where m <= {PER} or list_contains({DRAWN}, x)"""
ALL_PAIRS = f"""select {{g}}fid, family, subfamily, m.chrom, least(bin, tss_bin) as i, greatest(bin, tss_bin) as j from {{t}} m
      join tb on tb.chrom = m.chrom and abs(tss_bin - bin) between {LO} and {HI}"""
LCG = lcg_sql("grp", "101", "chrom")
REST = lcg_sql("2", "101", "chrom")
RELOCATED = ANCHORS + f""", mv as (select fid, family, subfamily, chrom, grp, case when grp = 0 then bin else (bin + {LCG}) % 101 end as bin
    from el an cross join k), qr as ({ALL_PAIRS.format(g='grp, ', t='mv')})"""
RIGID = ANCHORS + f""", pr as ({ALL_PAIRS.format(g='', t='el')}), qr as (select grp, fid, family, subfamily, chrom, ni as i, ni + j - i as j from (
    select *, case when grp = 0 then i else (i + {LCG}) % 101 end as ni from pr cross join k) x where ni + j - i < 101)"""
SCRAMBLED = RELOCATED.replace("case when grp = 0 then bin else", f"case when grp = 0 then (bin + {REST}) % 101 else").replace(
    f"(bin + {LCG}) % 101 end", f"((bin + {REST}) % 101 + {LCG}) % 101 end")
OE_SQL = """, oe as (select q.*, case when a.weight is null or b.weight is null or e.expected is null then null
      when e.expected = 0 then case when coalesce(p.n, 0) = 0 then null else 'infinity'::double end
      else coalesce(p.n, 0) * a.weight * b.weight / e.expected end as oe
    from qr q left join pixel p on p.chrom = q.chrom and p.i = q.i and p.j = q.j left join ok a on a.chrom = q.chrom and a.bin = q.i
    left join ok b on b.chrom = q.chrom and b.bin = q.j left join ex e on e.chrom = q.chrom and e.dist = q.j - q.i)"""
OE = EXPECTED + OE_SQL
TEST = POOLED + OE_SQL.replace("join ex e", "join ep e") + """, me as (select family, subfamily, grp, avg(oe) as m, count(*) as n from oe where oe is not null and isfinite(oe) group by all),
  t0 as (select r.family, r.subfamily, r.n as n_pairs, r.m as obs_oe, avg(n.m) as null_oe, stddev_samp(n.m) as null_sd,
      count(*) as n_shifts, count(*) filter (n.m >= r.m) as exceed from me r join me n on r.grp = 0 and n.grp > 0
      and n.subfamily = r.subfamily group by all having count(*) >= 2),
  t1 as (select *, case when null_oe <= 0 then 'nan'::double when obs_oe = 0 then '-infinity'::double else log2(obs_oe / null_oe) end as log2_ratio,
      case when null_sd > 0 then (obs_oe - null_oe) / null_sd else 'nan'::double end as z, (exceed + 1) / (n_shifts + 1) as p_emp from t0)
  select family, subfamily, n_pairs, round(obs_oe, 6) as obs_oe, round(null_oe, 6) as null_oe, round(null_sd, 6) as null_sd, n_shifts,
    exceed, round(log2_ratio, 6) as log2_ratio, round(z, 4) as z, round(p_emp, 6) as p_emp, round(q_emp, 6) as q_emp from """ + sqltext.bh("t1", "p_emp", "q_emp") + " y"
WHOLE = ("family", "subfamily", "n_pairs", "n_shifts", "exceed")


def order_columns():
    return [(F.col("fid") * 48271 + 11) % 1000003, F.col("fid")]


def lcg_draw(step, fid):
    return (fid % 1000003 * 7919 + step * 104729) % 1000003


def elements(spark, sf, size=BIN, **how):
    return plan.element_bins(view(spark, sf, "feature"), view(spark, sf, "chrom_size"), size, **how)


def matrix(spark, sf):
    return view(spark, sf, "pixel"), view(spark, sf, "bin_weight")


def promoter(spark, sf, **how):
    out = plan.promoter_contacts(
        elements(spark, sf), view(spark, sf, "tss"), *map(staged, matrix(spark, sf)), view(spark, sf, "chrom_size"), BIN, LO * BIN, HI * BIN,
        SHIFTS, offset=lcg_offset, smooth=SMOOTH, **how)
    return out.select(*[c if c in WHOLE else rnd(c, 4 if c == "z" else 6).alias(c) for c in out.columns])


@register("promoter_contacts", with_views(VIEWS, RELOCATED + TEST))
def promoter_contacts(spark, sf):
    return promoter(spark, sf)


@register("promoter_contacts_rigid", with_views(VIEWS, RIGID + TEST))
def promoter_contacts_rigid(spark, sf):
    return promoter(spark, sf, mode="pair")


@register("promoter_contacts_calibration", with_views(VIEWS, SCRAMBLED + TEST))
def promoter_contacts_calibration(spark, sf):
    return promoter(spark, sf, scramble=2)


@register("band_pairs", with_views(VIEWS, ANCHORS + f" {PAIRS}"))
def band_pairs(spark, sf):
    from ..operators.coverage import point_bins
    from ..operators.order import sample_per_group

    anchors = sample_per_group(elements(spark, sf), ["subfamily"], MOST, order_columns()).select("fid", "family", "subfamily", "chrom", "bin")
    starts = point_bins(view(spark, sf, "tss"), BIN).select("chrom", "bin")
    out = plan.band_pairs(anchors, starts, LO, HI, PER, lcg_draw)
    return out.select("fid", "family", "subfamily", "chrom", "i", "j")


@register("sampled_anchors", with_views(["feature"], ANCHORS.split("tb as")[0].rstrip().rstrip(",") + " select * from an"))
def sampled_anchors(spark, sf):
    from ..operators.order import sample_per_group

    out = sample_per_group(elements(spark, sf), ["subfamily"], MOST, order_columns())
    return out.select("fid", "family", "subfamily", "chrom", "bin")


@register("expected_by_distance", with_views(VIEWS, EXPECTED + " select chrom, dist, n_pairs, round(total, 6) as total, round(expected, 6) as expected from ex"))
def expected_by_distance(spark, sf):
    out = plan.expected_by_distance(*matrix(spark, sf), HI)
    return out.withColumn("total", rnd("total")).withColumn("expected", rnd("expected"))


@register(
    "smoothed_expected",
    with_views(VIEWS, EXPECTED + f""" select a.chrom, a.dist, round(sum(b.total) / sum(b.n_pairs), 6) as expected from ex a
      join ex b on b.chrom = a.chrom and {within('a', 'b')} group by a.chrom, a.dist"""),
)
def smoothed_expected(spark, sf):
    out = plan.smooth_expected(plan.expected_by_distance(*matrix(spark, sf), HI), SMOOTH, pooled=False)
    return out.select("chrom", "dist", rnd("expected").alias("expected"))


@register("pooled_expected", with_views(VIEWS, POOLED + " select chrom, dist, n_pairs, round(expected, 6) as expected from ep"))
def pooled_expected(spark, sf):
    out = plan.smooth_expected(staged(plan.expected_by_distance(*matrix(spark, sf), HI)), SMOOTH)
    return out.select("chrom", "dist", "n_pairs", rnd("expected").alias("expected"))


@register("calibration_check", with_views(VIEWS, SCRAMBLED + TEST.replace("select family, subfamily, n_pairs, round(obs_oe", ", res as (select family, subfamily, n_pairs, round(obs_oe")
    + """), ecdf as (select p_emp, count(*) over (order by p_emp) as upto, count(*) over () as n from res)
    select max(n) as n, (select count(*) from res where q_emp < 0.05) as n_below_cut, round(greatest(max(upto / n - p_emp), 0.0), 6) as excess,
      (select count(*) from res where q_emp < 0.05) = 0 and greatest(max(upto / n - p_emp), 0.0) * sqrt(max(n)) <= 1.63 as calibrated from ecdf"""))
def calibration_check(spark, sf):
    out = selfcheck.calibration_check(promoter(spark, sf, scramble=2), "p_emp", "q_emp")
    return out.withColumn("excess", rnd("excess"))


@register("contact_floor", with_views(VIEWS, RELOCATED + TEST.rsplit("select family, subfamily, n_pairs", 1)[0] + f""" select count(*) as n_groups,
    count(*) filter (p_emp <= 1.5 / ({SHIFTS} + 1)) as n_at_floor, 1.0::double / ({SHIFTS} + 1) as p_floor from t1"""))
def contact_floor(spark, sf):
    return plan.floor_report(promoter(spark, sf), SHIFTS)


@register("observed_over_expected", with_views(VIEWS, ANCHORS + f", qr as ({ALL_PAIRS.format(g='', t='el')})" + OE
                                              + " select fid, chrom, i, j, round(oe, 6) as oe from oe"))
def observed_over_expected(spark, sf):
    from ..operators.coverage import point_bins

    pairs = staged(plan.band_pairs(elements(spark, sf), point_bins(view(spark, sf, "tss"), BIN).select("chrom", "bin"), LO, HI))
    expected = staged(plan.expected_by_distance(*matrix(spark, sf), HI))
    out = plan.observed_over_expected(pairs, *matrix(spark, sf), expected)
    return out.select("fid", "chrom", "i", "j", rnd("oe").alias("oe"))


MASKING = """, mr as (select el.subfamily, count(*) as n_copies, count(w.weight) as n_valid, count(*) - count(w.weight) as n_masked,
    (count(*) - count(w.weight)) / count(*) as frac_masked from el left join bin_weight w on w.chrom = el.chrom and w.bin = el.bin group by el.subfamily)"""


@register("masking_report", with_views(VIEWS, binned(BIN) + MASKING + " select * replace (round(frac_masked, 6) as frac_masked) from mr"))
def masking_report(spark, sf):
    out = plan.masking_report(elements(spark, sf), view(spark, sf, "bin_weight"))
    return out.withColumn("frac_masked", rnd("frac_masked"))


PHASE = f""", td as (select e.chrom, e.bin, e.e1, count(t.pos) as n_tss from eigen e left join tss t on t.chrom = e.chrom
      and cast(floor(t.pos / {EIGEN_BIN}) as bigint) = e.bin group by all),
  sg as (select chrom, case when corr(e1, n_tss) < 0 then -1.0 else 1.0 end as s from td where e1 is not null group by chrom),
  ph as (select td.chrom, bin, n_tss, e1 * s as e1 from td join sg on sg.chrom = td.chrom)"""


def phased(spark, sf):
    return plan.phase_compartments(view(spark, sf, "eigen"), view(spark, sf, "tss"), EIGEN_BIN)


@register("phased_compartments", with_views(["eigen", "tss"], PHASE + " select chrom, bin, n_tss, round(e1, 6) as e1 from ph"))
def phased_compartments(spark, sf):
    return phased(spark, sf).withColumn("e1", rnd("e1"))


@register(
    "compartments",
    with_views([*VIEWS, "eigen"], binned(EIGEN_BIN) + f", ev as (select chrom, cast(floor(bin * {EIGEN_BIN} / {BIN}) as bigint) as b2 from eigen)"
               + MASKING.replace("w.bin = el.bin", f"w.bin = el.bin") + PHASE + """
    select el.family, el.subfamily, count(*) as n_scored, round(avg(case when e1 > 0 then 1.0 else 0.0 end), 6) as frac_a,
      round(avg(e1), 6) as mean_e1, round(median(e1), 6) as median_e1, round(avg(case when e1 > 0 then 1.0 else 0.0 end)
        - (select avg(case when e1 > 0 then 1.0 else 0.0 end) from ph where e1 is not null), 6) as frac_a_minus_bg,
      max(mr.n_copies) as n_copies, round(max(mr.frac_masked), 6) as frac_masked
    from el join ph on ph.chrom = el.chrom and ph.bin = el.bin and e1 is not null join mr on mr.subfamily = el.subfamily
    group by el.family, el.subfamily"""),
)
def compartments(spark, sf):
    el = staged(elements(spark, sf, EIGEN_BIN))
    report = plan.masking_report(el, view(spark, sf, "bin_weight"))
    out = plan.compartments(el, staged(phased(spark, sf)), report)
    return out.select(*[c if c in ("family", "subfamily", "n_scored", "n_copies") else rnd(c).alias(c) for c in out.columns])


@register("shared_chromosomes", with_views(["peak", "chrom_size"], " select chrom, count(*) as n, chrom in (select chrom from chrom_size) as usable from peak group by chrom"))
def shared_chromosomes(spark, sf):
    return plan.shared_chroms(view(spark, sf, "peak"), view(spark, sf, "chrom_size"))


@register(
    "filtered_elements",
    with_views(["feature"], binned(BIN) + """, b as (select * from el where family in ('famA', 'famN'))
    select fid, bin from b where subfamily in (select subfamily from b group by subfamily
      having count(*) >= (select count(*) / 24 from feature))"""),
)
def filtered_elements(spark, sf):
    features = view(spark, sf, "feature")
    least = features.count() / 24
    return elements(spark, sf, families=["famA", "famN"], min_copies=least).select("fid", "bin")
