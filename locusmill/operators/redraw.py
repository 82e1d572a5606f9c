"""Weighted redraws of many counts at once, by binomial splitting.

To redraw k things over bins of given weights, the bins are halved again and again: how many of a node's things fall to
its left half is one binomial draw. So a count costs at most twice its bins or its size times the depth, whichever is
less, however many things it stands for, and bins that get nothing cost nothing. Where a cell has few things to redraw, drawing
each is cheaper than splitting. Many cells are worked on at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Left counts from counts, chances, groups, nodes and draws.
Split = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: A split for one cell from a hash of it, its two key values and its groups' names.
Splitter = Callable[[int, object, object, np.ndarray], Split]


def hashed_split(seed: int = 0) -> Splitter:
    """Binomial draws of a counter-based generator, keyed by the seed and the cell, not by where a cell is worked on."""

    def for_cell(key: int, *_) -> Split:
        rng = np.random.Generator(np.random.Philox(key=np.array([seed, key & (1 << 64) - 1], np.uint64)))
        return lambda n, p, group, node, draw: rng.binomial(n, p)

    for_cell.uniform = lambda key, thing, draw: hashed_uniform(seed, key, thing, draw)
    return for_cell


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_uniform(seed: int, key: np.ndarray, thing: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) that hang on a cell's hash, the thing redrawn in it and the draw alone."""
    start = _mixed(key.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (1 << 64) - 1))
    step = thing.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + draw.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return (_mixed(start + step) >> np.uint64(11)) * 2.0**-53


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The least x with P(Binomial(n, p) <= x) > u, counted up from 0; for counts whose chance of 0 is no underflow."""
    x = np.where(p >= 1, n, 0)
    odds = np.where(p < 1, p / np.where(p < 1, 1 - p, 1), 0)
    here = np.where(p < 1, (1 - np.minimum(p, 1)) ** n, 1.0)
    total = here.copy()
    live = np.flatnonzero((total <= u) & (x < n))
    while len(live):
        here[live] *= (n[live] - x[live]) / (x[live] + 1.0) * odds[live]
        x[live] += 1
        total[live] += here[live]
        live = live[(total[live] <= u[live]) & (x[live] < n[live])]
    return x


def quantile_split(uniform: Callable[..., np.ndarray]) -> Splitter:
    """Binomial quantiles of ``uniform(key values..., group name, node, draw)``, which SQL can repeat; key values may be arrays."""

    def for_cell(key: int, a, b, names: np.ndarray) -> Split:
        return lambda n, p, group, node, draw: binomial_quantile(uniform(a, b, names[group], node, draw), n, p)

    for_cell.many = lambda a, b, names: lambda n, p, group, node, draw: binomial_quantile(uniform(a[group], b[group], names[group], node, draw), n, p)
    return for_cell


def tree_counts(
    k: np.ndarray, runs: np.ndarray, sums: np.ndarray, draws: np.ndarray, split: Split
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, draw, count) of groups of ``k`` things, each over two runs of bins (from, to, from, to), for every draw.

    ``sums[i]`` has group i's running weights: the weight of bins a to b is ``sums[i][b] - sums[i][a]``, and the runs of a
    group have weight. A (bin, draw) may come from several groups.
    """
    _, *found = group_counts(k, runs, sums, np.arange(len(k)), draws, split)
    return tuple(found)


def group_counts(
    k: np.ndarray, runs: np.ndarray, sums: np.ndarray, of: np.ndarray, draws: np.ndarray, split: Split
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, bin, draw, count) as ``tree_counts`` has them, group i's running weights being ``sums[of[i]]``."""
    a1, b1, a2, b2 = runs.T
    left = b1 - a1

    def mass(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        own = np.minimum(rank, left[group])
        first, then, by = a1[group], a2[group], of[group]
        return sums[by, first + own] - sums[by, first] + sums[by, then + rank - own] - sums[by, then]

    group = np.repeat(np.arange(len(k)), len(draws))
    draw = np.tile(draws, len(k))
    n, node = np.repeat(k, len(draws)), np.ones(len(group), np.int64)
    lo, hi = np.zeros(len(group), np.int64), (left + b2 - a2)[group]
    out = []
    while len(n):
        leaf = hi - lo == 1
        g, rank = group[leaf], lo[leaf]
        out.append((g, np.where(rank < left[g], a1[g] + rank, a2[g] + rank - left[g]), draw[leaf], n[leaf]))
        group, draw, n, node, lo, hi = (x[~leaf] for x in (group, draw, n, node, lo, hi))
        mid = (lo + hi) // 2
        before, after = mass(group, lo), mass(group, hi)
        whole = after - before
        p = np.clip((mass(group, mid) - before) / np.where(whole > 0, whole, 1), 0, 1)
        less = split(n, p, group, node, draw)
        n = np.concatenate((less, n - less))
        node = np.concatenate((2 * node, 2 * node + 1))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        live = n > 0
        group, draw = np.tile(group, 2)[live], np.tile(draw, 2)[live]
        n, node, lo, hi = n[live], node[live], lo[live], hi[live]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def single_draws(
    runs: np.ndarray, sums: np.ndarray, of: np.ndarray, group: np.ndarray, uniform: np.ndarray
) -> np.ndarray:
    """A bin for each uniform number, of the runs of its group by the running weights ``sums[of]``."""
    a1, b1, a2, b2 = runs.T
    low, then = sums[of, a1], sums[of, a2]
    first = sums[of, b1] - low
    whole = first + sums[of, b2] - then
    at = uniform * whole[group]
    early = at < first[group]
    target = np.where(early, low[group] + at, then[group] + at - first[group])
    bins = np.zeros(len(group), np.int64)
    for k in np.unique(of):
        mine = of[group] == k
        bins[mine] = np.searchsorted(sums[k], target[mine], "right") - 1
    # A sum's last digit may lead one bin too far.
    return np.where(early, np.clip(bins, a1[group], b1[group] - 1), np.clip(bins, a2[group], np.maximum(b2[group], a2[group] + 1) - 1))


def row_statistics(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of bins: the sum of the squared counts per bin, and the largest one."""
    bins = np.sort(bins, axis=1)
    run = np.ones(len(bins), np.int64)
    squares, top = np.ones(len(bins), np.int64), np.ones(len(bins), np.int64)
    for j in range(1, bins.shape[1]):
        run = np.where(bins[:, j] == bins[:, j - 1], run + 1, 1)
        squares += 2 * run - 1
        top = np.maximum(top, run)
    return squares, top


def draw_statistics(bins: np.ndarray, draw: np.ndarray, count: np.ndarray, n_bins: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Per draw (0 .. draws - 1): the sum of the squared counts per bin, and the largest one."""
    cell, at = np.unique(draw * n_bins + bins, return_inverse=True)
    total = np.bincount(at, weights=count)
    owner = cell // n_bins
    top = np.zeros(draws)
    np.maximum.at(top, owner, total)
    return np.bincount(owner, weights=total * total, minlength=draws), top
