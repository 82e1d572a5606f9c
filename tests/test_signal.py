"""Signal under copies against pairs, and quantiles without a full order."""

import math
import random

import numpy as np
import pytest

from locusmill.operators import coverage, order
from locusmill.plans import signal

TRACK = "sample string, track_strand string, chrom string, start_pos long, end_pos long, value double"
COPY = "fid long, chrom string, start_pos long, end_pos long, strand string, subfamily string, family string"


def test_sums_are_exact_beside_large_values():
    rng = np.random.default_rng(4)
    for width in (16, 64):
        n = 30
        start, low = rng.integers(-20, 64, n), rng.integers(-20, 64, n)
        end, high = start + rng.integers(-5, 40, n), low + rng.integers(-5, 40, n)
        value, has = rng.choice([0.1, -3.75, 1e15, 1e-3, 7.0], n), rng.random(n) < 0.9
        touch = [(np.maximum(a, 0) < width) & (np.maximum(np.maximum(a, b - 1), a) >= 0) & ((a < b) | ((a >= 0) & (a < width))) for a, b in ((start, end), (low, high))]
        start, end, value, has, low, high = start[touch[0]], end[touch[0]], value[touch[0]], has[touch[0]], low[touch[1]], high[touch[1]]
        for v in (value, np.where(value == 7.0, np.nan, value), np.where(value == 7.0, np.inf, value)):
            sums, met = coverage.step_sums(start, end, v, has, low, high, width)
            for k, (a, b, got, hit) in enumerate(zip(low, high, sums.to_pylist(), met)):
                over = (a < end) & (b > start)
                assert hit == over.any() and (got is None) == (not (over & has).any())
                cut = np.minimum(np.minimum(b, end), width if b > a else 1 << 40) - np.maximum(np.maximum(a, start), 0 if b > a else -(1 << 40))
                cut = np.where((start >= end) | (a >= b), np.minimum(b, end) - np.maximum(a, start), cut)
                with np.errstate(invalid="ignore"):
                    want = math.fsum((v * cut)[over & has]) if np.isfinite(v[over & has]).all() else (v * cut)[over & has & ~np.isfinite(v)].sum()
                bare = a >= b or (over & (start >= end)).any()
                if got is not None and not (bare and not np.isfinite(v[over & has]).all()):
                    assert math.isnan(got) and math.isnan(want) or got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    copies = [(k % 70, rnd.choice(("c1", "c2", "un", None)), s, s + rnd.choice((5, 400, 300_000)), rnd.choice(("+", "-", None)), rnd.choice("st"), "f")
              for k in range(80) for s in [rnd.randrange(600_000)]] + [(None, "c1", 5, 90, "+", "s", "f"), (80, "c1", None, None, "+", "s", "f")]
    steps = [(rnd.choice(("ip_r1", "in_r2", "x", None)), rnd.choice(("pos", "neg")), rnd.choice(("c1", "c2")), s, s + rnd.choice((0, 30, 9_000)), rnd.choice((0.5, 2.25, None)))
             for _ in range(300) for s in [rnd.randrange(700_000)]]
    size = {"c1": 500_000, "c2": 700_000}
    return copies, steps, size, (spark.createDataFrame(copies, COPY), spark.createDataFrame(steps, TRACK), spark.createDataFrame(list(size.items()), "chrom string, size long"))


def test_signal_per_copy_forms_no_pairs(tables):
    copies, steps, size, (features, track, sizes) = tables
    names = [f"{s}_{o}" for s in ("ip_r1", "in_r2") for o in ("sense", "antisense")]
    by_id = {}
    for fid, chrom, a, b, strand, *_ in copies:
        for sample, ts, c, s, e, v in steps:
            if fid is not None and a is not None and c == chrom and v is not None and s < min(b, size[c]) and e > a and a < size[c]:
                same = (ts, strand) in (("pos", "+"), ("neg", "-"))
                key = f"{sample}_{'sense' if same else 'antisense'}"
                cell = by_id.setdefault(fid, {})
                cell[key] = cell.get(key, 0.0) + v * (min(b, size[c], e) - max(a, s))
    want = sorted(str((fid, chrom, b - a if a is not None else None, *[by_id.get(fid, {}).get(n, 0.0) for n in names])) for fid, chrom, a, b, *_ in copies)
    out = signal.copy_signal(features, track, sizes, ("ip_r1", "in_r2"))
    assert sorted(str((r.fid, r.chrom, r.length, *[r[n] for n in names])) for r in out.collect()) == want
    sums = coverage.signal_sums(coverage.clip_spans(features, sizes), track, ["fid", "strand"])
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and plan.count("Join ") == 1, plan  # with the sizes


def test_quantiles_do_not_order_every_value(spark, monkeypatch):
    rnd = random.Random(8)
    values = [rnd.choice((rnd.gauss(0, 9), -4.0, 0.0, 1e-9, math.inf, -math.inf, None, float(rnd.randrange(5)))) for _ in range(600)]
    df = spark.createDataFrame([("ab"[k % 2], v) for k, v in enumerate(values)], "s string, v double")
    probs = [0.0, 0.1, 0.35, 0.5, 0.9]
    plain = {r.s: r.q for r in order.exact_quantiles(df.where("v is not null"), ["s"], "v", probs, "q").orderBy("s").collect()}
    monkeypatch.setattr(order, "SORTED", 0)
    assert str(plain) == str({r.s: r.q for r in order.exact_quantiles(df.where("v is not null"), ["s"], "v", probs, "q").orderBy("s").collect()})
    monkeypatch.undo()
    ordered = []
    monkeypatch.setattr(order, "ordered_runs", lambda *args, run=order.ordered_runs: ordered.append(args) or run(*args))
    rankings = {"m": order.Ranking("v", ("s",))}
    got = {r.s: r.m for r in order.summary_quantiles(order.order_summary(df, rankings), "m", ["s"], {"m": 0.5}).collect()}
    assert got == {s: q[3] for s, q in plain.items()} and not ordered
