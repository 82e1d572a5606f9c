"""Rank index, expected values and means of bands against plain loops."""

import math
import random
from collections import Counter

import pytest

from locusmill.plans import matrix


def bins(spark, rows):
    return spark.createDataFrame(rows, "chrom string, bin long")


def made(seed, chroms=("a", "b"), size=40):
    rnd = random.Random(seed)
    weights = [(c, b, rnd.choice([None, float("nan"), *[0.5 + rnd.random()] * 5])) for c in chroms for b in range(3, size) if rnd.random() < 0.9]
    pixels = {}
    for c in chroms:
        for _ in range(300):
            i, j = sorted((rnd.randrange(size), rnd.randrange(size)))
            pixels[c, i, j] = pixels.get((c, i, j), 0) + rnd.randint(1, 4)
    starts = [(c, rnd.randrange(size)) for c in chroms for _ in range(12)]
    return weights, pixels, starts


def frames(spark, weights, pixels, starts):
    return (
        spark.createDataFrame(weights, "chrom string, bin long, weight double"),
        spark.createDataFrame([(*k, n) for k, n in pixels.items()], "chrom string, i long, j long, n long"),
        bins(spark, starts),
    )


def valid(weights):
    return {(c, b): w for c, b, w in weights if w is not None and not math.isnan(w)}


def brute_expected(weights, pixels, most):
    ok, out = valid(weights), {}
    for (c, i) in ok:
        for d in range(most + 1):
            if (c, i + d) in ok:
                n, t = out.get((c, d), (0, 0.0))
                out[c, d] = (n + 1, t + pixels.get((c, i, i + d), 0) * ok[c, i] * ok[c, i + d])
    return out


@pytest.mark.parametrize("most", [0, 5, 100])
def test_expected_counts_every_pair_of_valid_bins(spark, most):
    weights, pixels, _ = made(most)
    weights += [("one", 7, 1.0), ("none", 1, None), ("none", 2, None)]
    w, p, _ = frames(spark, weights, pixels, [("a", 1)])
    got = {(r.chrom, r.dist): (r.n_pairs, r.total) for r in matrix.expected_by_distance(p, w, most).collect()}
    want = brute_expected(weights, pixels, most)
    assert got.keys() == want.keys()
    for k, (n, t) in want.items():
        assert got[k] == (n, pytest.approx(t))


def test_pooled_expected(spark):
    weights, pixels, _ = made(3)
    w, p, _ = frames(spark, weights, pixels, [("a", 1)])
    raw = brute_expected(weights, pixels, 30)
    got = {(r.chrom, r.dist): r.expected for r in matrix.smooth_expected(matrix.expected_by_distance(p, w, 30), 0.4).collect()}
    for (c, d), e in got.items():
        near = [v for (_, x), v in raw.items() if (x == 0 and d == 0) or (x and d and abs(math.log2(x) - math.log2(d)) <= 0.4 + 1e-6)]
        assert e == pytest.approx(sum(t for _, t in near) / sum(n for n, _ in near))
    assert got.keys() == raw.keys()


@pytest.mark.parametrize("lo,hi", [(0, 0), (0, 6), (1, 6), (4, 9)])
def test_band_means_are_those_of_all_pairs(spark, lo, hi):
    weights, pixels, starts = made(lo + hi)
    pixels = {k: n for k, n in pixels.items() if k[2] - k[1] != 5}
    w, p, s = frames(spark, weights, pixels, starts)
    ok, raw = valid(weights), brute_expected(weights, pixels, hi)
    want = {}
    for (c, b) in ok:
        for (d, t) in set(starts):
            apart = abs(t - b)
            if d != c or not lo <= apart <= hi or (c, t) not in ok:
                continue
            n, total = raw[c, apart]
            if total > 0:
                have, sums = want.get((c, b), (0, 0.0))
                value = pixels.get((c, min(b, t), max(b, t)), 0) * ok[c, b] * ok[c, t] / (total / n)
                want[c, b] = (have + 1, sums + value)
    expected = matrix.expected_by_distance(p, w, hi)
    got = {(r.chrom, r.bin): (r.oe_n, r.oe_sum) for r in matrix.band_means(p, w, expected, s, lo, hi).collect()}
    assert got.keys() == want.keys()
    for k, (n, t) in want.items():
        assert got[k] == (n, pytest.approx(t))


def test_all_pairs_of_a_band(spark):
    starts = [("a", b) for b in (0, 3, 4, 9, 10, 11, 30)] + [("b", 5)]
    anchors = spark.createDataFrame([(k, "a", b) for k, b in enumerate((0, 4, 10, 10, 50))] + [(9, "b", 5), (10, "c", 5)], "fid long, chrom string, bin long")
    for lo, hi in ((0, 6), (1, 1), (2, 100)):
        got = Counter((r.fid, r.tss_bin) for r in matrix.band_pairs(anchors, bins(spark, starts), lo, hi).collect())
        rows = [(r.fid, r.chrom, r.bin) for r in anchors.collect()]
        assert got == Counter((f, t) for f, c, b in rows for d, t in starts if c == d and lo <= abs(t - b) <= hi)


def test_samples_are_distinct_and_even(spark):
    starts = bins(spark, [("a", b) for b in range(0, 60, 3)])
    anchors = spark.range(3000).selectExpr("id as fid", "'a' as chrom", "30L as bin")
    rows = matrix.band_pairs(anchors, starts, 1, 12, 3).collect()
    own = Counter(r.fid for r in rows)
    assert set(own.values()) == {3} and len({(r.fid, r.tss_bin) for r in rows}) == 9000
    each = Counter(r.tss_bin for r in rows)
    assert sorted(each) == [18, 21, 24, 27, 33, 36, 39, 42]
    assert all(abs(n - 9000 / 8) < 5 * math.sqrt(9000 / 8) for n in each.values())
    few = matrix.band_pairs(anchors.limit(2), starts, 1, 4, 3)
    assert few.count() == 4


def test_sampled_and_whole_runs_agree_where_the_sample_is_all(spark):
    weights, pixels, starts = made(8)
    w, p, _ = frames(spark, weights, pixels, starts)
    rnd = random.Random(1)
    elements = spark.createDataFrame([(k, "f", "s" + str(k % 2), rnd.choice("ab"), rnd.randrange(40)) for k in range(80)],
                                     "fid long, family string, subfamily string, chrom string, bin long")
    tss = spark.createDataFrame([(c, b * 10 + 3) for c, b in starts], "chrom string, pos long")
    sizes = spark.createDataFrame([("a", 400), ("b", 400)], "chrom string, size long")
    for mode in ("relocate", "pair"):
        whole, sampled = ({r.subfamily: r for r in matrix.promoter_contacts(
            elements, tss, p, w, sizes, 10, 10, 90, 4, mode, per_anchor=k).collect()} for k in (None, 50))
        for name in ("s0", "s1"):
            assert whole[name].n_pairs == sampled[name].n_pairs > 0
            for c in ("obs_oe", "null_oe", "p_emp"):
                assert whole[name][c] == pytest.approx(sampled[name][c])
