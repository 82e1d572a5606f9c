"""Redraws by binomial splitting, and the target test's layout of bins."""

import math
import warnings

import numpy as np
import pytest

from locusmill.operators import redraw
from locusmill.plans import targets


def test_quantile_is_the_inverse_of_the_distribution():
    rng = np.random.default_rng(1)
    n, p, u = rng.integers(0, 30, 2000), rng.random(2000), rng.random(2000)
    p[:50], p[50:100] = 0.0, 1.0
    got = redraw.binomial_quantile(u, n, p)
    for k in range(2000):
        total, x = 0.0, 0
        while x <= n[k]:
            total += math.comb(int(n[k]), x) * p[k] ** x * (1 - p[k]) ** (n[k] - x)
            if total > u[k]:
                break
            x += 1
        assert got[k] == min(x, n[k])


def counts(k, runs, weights, draws, seed=0):
    sums = np.array([np.concatenate(([0.0], np.cumsum(w))) for w in weights])
    split = redraw.hashed_split(seed)(12345)
    return redraw.tree_counts(np.array(k), np.array(runs), sums, np.arange(draws), split)


def test_every_draw_keeps_the_counts_and_stays_inside():
    rng = np.random.default_rng(2)
    weights = rng.random((2, 40))
    weights[:, 5:9] = 0
    bins, draw, count = counts([1000, 7], [(0, 10, 20, 30), (33, 34, 35, 40)], weights, 50)
    assert (np.bincount(draw, weights=count) == 1007).all()
    inside = (bins < 5) | (bins == 9) | ((bins >= 20) & (bins < 30)) | (bins == 33) | (bins >= 35)
    assert inside.all() and (count > 0).all()


def test_draws_follow_the_weights():
    weights = np.array([[1.0, 2.0, 0.0, 4.0, 3.0, 0.5, 0.5]])
    draws, k = 4000, 20
    bins, draw, count = counts([k], [(0, 4, 5, 7)], weights, draws)
    table = np.zeros((draws, 7))
    np.add.at(table, (draw, bins), count)
    p = np.array([1, 2, 0, 4, 0, 0.5, 0.5]) / 8
    mean, var = table.mean(axis=0), table.var(axis=0)
    assert np.abs(mean - k * p).max() < 5 * math.sqrt(k / 4 / draws)
    assert np.abs(var - k * p * (1 - p)).max() < 0.4
    cov = np.cov(table[:, 1], table[:, 3])[0, 1]
    assert abs(cov + k * p[1] * p[3]) < 0.3


def test_work_does_not_grow_with_the_counts():
    weights = np.ones((1, 256))
    bins, draw, count = counts([10**9], [(0, 256, 256, 256)], weights, 3)
    assert len(bins) == 3 * 256 and count.sum() == 3 * 10**9


def test_draws_depend_on_the_cell_alone():
    a = redraw.hashed_split(1)(7)(np.full(9, 50), np.full(9, 0.3), None, None, None)
    b = redraw.hashed_split(1)(7)(np.full(9, 50), np.full(9, 0.3), None, None, None)
    c = redraw.hashed_split(1)(8)(np.full(9, 50), np.full(9, 0.3), None, None, None)
    big = [redraw.hashed_split()((1 << 62) + k)(np.full(9, 50), np.full(9, 0.3), None, None, None) for k in range(2)]
    assert (big[0] != big[1]).any()
    d = redraw.hashed_split(2)(-7)(np.full(9, 50), np.full(9, 0.3), None, None, None)
    assert (a == b).all() and (a != c).any() and (a != d).any()


def test_statistics_add_groups_of_one_bin():
    squares, top = redraw.draw_statistics(np.array([3, 3, 1, 2]), np.array([0, 0, 0, 1]), np.array([2, 1, 1, 5]), 10, 3)
    assert squares.tolist() == [10, 25, 0] and top.tolist() == [3, 5, 0]


def layout(spark, weights, masked):
    rows = [("chr1", k, float(w), bool(m)) for k, (w, m) in enumerate(zip(weights, masked))] + [("chr2", 0, 0.5, False), ("chr2", 1, 0.0, True)]
    return targets._Layout(spark.createDataFrame(rows[::-1], "chrom string, bin long, weight double, masked boolean"), 100, 100)


def test_reach_without_weight(spark):
    # Centres 50, 150, ...: from 40, distance stratum 0 is (100, 200], stratum 1 (200, 400].
    some = layout(spark, [0.2, 0.1, 0.0, 0.0, 0.2], [0, 0, 0, 1, 0])
    runs, by = some.runs("chr1", 40, 0)
    assert (runs[2], runs[3], by) == (1, 2, 0)
    runs, by = some.runs("chr1", 40, 1)
    assert (runs[2], runs[3], by) == (2, 4, 1)
    assert np.diff(some.sums[1])[2:4].tolist() == [1.0, 0.0]
    none = layout(spark, [0.2, 0.1, 0.0, 0.0, 0.2], [0, 0, 1, 1, 0])
    assert none.runs("chr1", 40, 1) == ((0, 5, 5, 5), 0)
    assert none.runs("chr1", 40, targets.TRANS) == ((0, 0, 5, 7), 0)


def test_too_many_bins_are_refused(spark, monkeypatch):
    monkeypatch.setattr(targets, "MOST_BINS", 3)
    with pytest.raises(ValueError, match="wider bins"):
        layout(spark, [0.5] * 5, [0] * 5)


HITS = ("fid long, family string, subfamily string, chrom string, start_pos long, strand string, rna_strand string, "
        "dna_chrom string, dna_pos long, mapq int, mapq_dna int")


def test_floors_and_absent_chromosomes(spark):
    rows = [(1, "f", "s", "chr1", 0, "+", "+", "chr1", 1000 + 100 * (k % 8), 10 * (k % 2), 30) for k in range(40)]
    hits = spark.createDataFrame(rows, HITS)
    sizes = spark.createDataFrame([("chr1", 2000)], "chrom string, size long")
    how = dict(binsize=100, proximal=100, min_contacts=5, draws=20, mask_mult=0)
    all_of_them = targets.target_test(hits, sizes, **how).first()
    some = targets.target_test(hits, sizes, **how, min_mapq=5, min_mapq_dna=30).first()
    assert (all_of_them.n_contacts, some.n_contacts) == (40, 20)
    assert targets.target_test(hits, sizes, **how, min_mapq=5, min_mapq_dna=31).count() == 0
    with pytest.warns(UserWarning, match="chr9"):
        targets.target_bins(hits, sizes, 100, 0, "chr9:0-500")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert targets.target_bins(hits, sizes, 100, 0, "chr1:0-150").where("masked").count() == 2


def test_many_cells_at_once_are_the_cells_alone(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(f), "f", "s", "chr1", 200 * int(f), "+", "+", f"chr{rng.integers(1, 3)}", int(rng.integers(0, 4000)), 30, 30) for f in rng.integers(0, 9, 240)]
    hits = spark.createDataFrame(rows, HITS).repartition(2)
    sizes = spark.createDataFrame([("chr1", 4000), ("chr2", 4000)], "chrom string, size long")
    bins = targets.target_bins(hits, sizes, 100, 0, "chr1:1900-3900")
    cells = targets.concentration(targets.distant_counts(hits, bins, 100, 300), 2)
    split = redraw.quantile_split(lambda fid, o, stratum, node, draw: (fid * 48271 + stratum * 7919 + node * 104729 + draw * 1299709) % 1000003 / 1000003.0)
    read = lambda df: {r.fid: (round(r.h_null, 12), round(r.h_null_sd, 12), r.top1_null) for r in df.collect()}
    together = read(targets.redraw_null(hits, cells, bins, 100, 300, 6, split))
    expected = {r.fid: r.h_expected for r in targets.expected_null(hits, cells, bins, 100, 300).collect()}
    singly = read(targets.redraw_null(hits, cells, bins, 100, 300, 3000))
    monkeypatch.setattr(targets, "DRAWN", 0)
    assert together == read(targets.redraw_null(hits, cells, bins, 100, 300, 6, split)) and len(together) > 3
    monkeypatch.undo()
    monkeypatch.setattr(targets, "FEW", 0)
    tree = read(targets.redraw_null(hits, cells, bins, 100, 300, 3000))
    for drawn in (singly, tree):
        assert all(abs(drawn[f][0] - h) < 6 * drawn[f][1] / 3000**0.5 + 1e-9 for f, h in expected.items())
    assert singly != tree


def test_rows_of_single_draws():
    squares, top = redraw.row_statistics(np.array([[4, 1, 4], [2, 2, 2], [0, 1, 2]]))
    assert squares.tolist() == [5, 9, 3] and top.tolist() == [2, 3, 1]
    u = redraw.hashed_uniform(1, np.repeat(np.arange(-50, 50), 100), np.tile(np.arange(100), 100), np.zeros(10_000))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and len(np.unique(u)) == len(u)
