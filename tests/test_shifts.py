"""Moving intervals and peak sets against brute force."""

import random

import pytest

from locusmill.catalog import SQL, contacts as contact_queries, peaks as peak_queries
from locusmill.operators import shifts
from locusmill.operators.counting import lone_ids
from locusmill.plans import runs


@pytest.mark.parametrize("edge", ["clip", "wrap"])
@pytest.mark.parametrize("block", [64, 1 << 25])
def test_sums_under_moving_intervals(spark, edge, block):
    rnd = random.Random(6)
    size = {"c1": 300, "c2": 64}
    rows = [(c, s, s + rnd.choice((1, 9, 70)), rnd.choice(("k", "l", None))) for c in ("c1", "c2", "un") for _ in range(60) for s in [rnd.randrange(size.get(c, 90))]]
    points = [(rnd.choice(("c1", "c2", "un")), rnd.randrange(320), rnd.randrange(3)) for _ in range(200)]
    lost = [("c1", None, 5), ("c2", None, 7)]  # under no interval
    draws = [(c, size[c], k, off, False) for c in size for k, off in enumerate((0, 41, 299))] + [(c, None, -1, None, True) for c in size]
    want = {}
    for chrom, a, b, key in rows:
        for c, z, k, off, stays in draws:
            if c != chrom:
                continue
            x = a if stays else (a + off) % z
            y = x + b - a
            pieces = [(x, y)] if stays else [(x, min(y, z))] + ([(0, y - z)] if edge == "wrap" and y > z else [])
            n = sum(v for pc, p, v in points for s, e in pieces if pc == chrom and s <= p < e)
            want[key, k] = want.get((key, k), 0) + n
    df = spark.createDataFrame(rows, "chrom string, start_pos long, end_pos long, g string").repartition(3)
    got = shifts.shifted_sums(
        df, spark.createDataFrame(points + lost, "chrom string, pos long, n long"), spark.createDataFrame(list(size.items()), "chrom string, size long"),
        spark.createDataFrame(draws, "chrom string, size long, shift int, offset long, stays boolean"), ["g"], ["n"], edge, block,
    )
    assert {(r.g, r.shift): r.n for r in got.collect()} == want


def test_the_whole_run_has_every_shift(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(runs, "contact_analysis", lambda *tables, **how: seen.update(how))
    contact_queries.contact_run(spark, "/root/testdata/sf0.001")
    assert seen["shifts"] == 1000 and "range(-1, 1000)" in SQL["contact_analysis"]


@pytest.mark.parametrize("block", [500, 1 << 25])
def test_features_under_moving_peaks(spark, block):
    rnd = random.Random(9)
    rows = [(k % 70, f"c{k % 2}", s, s + rnd.choice((1, 30, 400)), rnd.choice(("+", "-", None)), rnd.choice("st")) for k in range(80) for s in [rnd.randrange(1800)]]
    space = [("x", "c0", 100, 700, 600, 0), ("x", "c0", 900, 1500, 600, 600), ("x", "c1", 50, 250, 200, 1200), ("y", "c0", 0, 900, 900, 0)]
    size = {"x": 1400, "y": 900}
    sets = {(c, n): [(rnd.randrange(size[c]), rnd.choice((1, 40)), rnd.choice(("+", "-", None))) for _ in range(12)] for c, n in (("x", "a"), ("x", "b"), ("y", "a"))}
    moves = {g: [(k, off) for k, off in enumerate((0, 333, 899, 5))] for g in list(sets)[:2]}
    want = {}
    for (cell, sample), draws in moves.items():
        for perm, off in draws:
            found = set()
            for flat, width, strand in sets[cell, sample]:
                at = (flat + off) % size[cell]
                chrom, g = next((c, s + at - o) for p, c, s, e, n, o in space if p == cell and o <= at < o + n)
                found |= {(fid, sub, "sense" if strand == own and own else "antisense") for fid, c, s, e, own, sub in rows if c == chrom and s < g + width and e > g}
            for _, sub, side in found:
                if (sample, sub) != ("b", "t"):
                    want[cell, sample, perm, sub, side] = want.get((cell, sample, perm, sub, side), 0) + 1
    features = lone_ids(spark.createDataFrame(rows, "fid long, chrom string, start_pos long, end_pos long, strand string, subfamily string"))
    wanted = [(c, n, s, o) for c, n in sets for s in "st" for o in ("sense", "antisense") if (n, s) != ("b", "t")]
    counted = shifts.moved_locus_counts(
        features, spark.createDataFrame([(*g, size[g[0]], items) for g, items in sets.items()], "cell_line string, sample string, size long, "
                                        "items array<struct<flat: long, width: long, peak_strand: string>>"),
        spark.createDataFrame(space, "cell_line string, chrom string, start_pos long, end_pos long, seg_len long, seg_off long"),
        spark.createDataFrame(wanted, "cell_line string, sample string, subfamily string, orientation string"), ["cell_line", "sample"], ["cell_line"], block,
    )
    got = counted(spark.createDataFrame([(*g, d) for g, d in moves.items()], "cell_line string, sample string, draws array<struct<perm: int, offset: long>>"))
    assert {(r.cell_line, r.sample, r.perm, r.subfamily, r.orientation): r.loci for r in got.collect()} == want


def test_the_null_has_every_permutation(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(peak_queries.plan, "shift_null", lambda features, peaks, cands, most, settled, batch, **how: seen.update(most=most, settled=settled))
    peak_queries.shifted(spark, "/root/testdata/sf0.001")
    assert seen == {"most": 25_000, "settled": 25} and "< 25000" in SQL["shift_permutation"]
