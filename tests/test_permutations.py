"""Rounds of the shift null."""

import random

import pytest

from locusmill.catalog import peaks as queries
from locusmill.plans import peaks

SPAN = "chrom string, start_pos long, end_pos long, strand string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    features = spark.createDataFrame(
        [(i, "chr1", 900 * i, 900 * i + 250, "+", f"s{i % 2}", "f") for i in range(50)], f"fid long, {SPAN}, subfamily string, family string")
    rows = [("c", s, "chr1", x, x + 40, "+") for s in "ab" for x in rnd.sample(range(45_000), 60)]
    rows += [("c", "a", "chr1", 1800 * i + 20, 1800 * i + 60, "+") for i in range(25)]
    found = spark.createDataFrame(rows, f"cell_line string, sample string, {SPAN}")
    table = peaks.enrichment(features, found)
    return features, found, table.where("loci > 0 and orientation = 'sense'")


def rows(table):
    return sorted((r.sample, r.subfamily, r.n_perm, r.exceed, round(r.expected, 9)) for r in table.collect())


def test_planned_rounds_double_and_stop(tables):
    got = rows(peaks.shift_null(*tables, 60, stop_at=4))
    assert {n for _, _, n, *_ in got} <= {8, 24, 56, 60}
    for sample in "ab":
        mine = [r for r in got if r[0] == sample]
        done = mine[0][2]
        assert all(r[2] == done for r in mine)
        assert mine == [r for r in rows(peaks.shift_null(*tables, done, stop_at=10**6, batch=done)) if r[0] == sample]
        if done < 60:
            assert min(r[3] for r in mine) >= 4
    assert {n for _, _, n, *_ in got} != {60}


def test_rounds_shrink_with_the_rows_they_draw(tables, monkeypatch):
    whole = rows(peaks.shift_null(*tables, 12, stop_at=10**6))
    monkeypatch.setattr(peaks, "DRAWN", 700)
    assert rows(peaks.shift_null(*tables, 12, stop_at=10**6)) == whole


def test_a_small_budget_is_a_warning_where_it_is_not_refused(tables):
    features, found, _ = tables
    every = lambda t: t.where("loci > 0")
    with pytest.raises(ValueError, match="cannot resolve"):
        peaks.permutation_analysis(features, found, 4, 0.2, every, stop_at=5, batch=4)
    with pytest.warns(UserWarning, match="4 permutations cannot resolve q < 0.2"):
        out = peaks.permutation_analysis(features, found, 4, 0.2, every, refuse=False, stop_at=5, batch=4)
    assert {r.n_perm for r in out.collect()} == {4} and out.where("significant").isEmpty()


def test_the_registered_table_has_rows_for_every_number_of_candidates(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.plan, "permutation_analysis", lambda *tables, **how: seen.update(how) or spark.range(0).selectExpr(
        *[f"0.0 as {c}" for c in ("p_perm", "expected", "fold_perm", "q_perm", "fold_pooled", "q_screen")]))
    queries.permutation_table(spark, "/root/testdata/sf0.001")
    assert seen["refuse"] is False
