"""Interval algebra against hand cases and brute force."""

import random

from pyspark.sql import functions as F

from locusmill.operators import intervals as iv, selfcheck
from locusmill.operators.sweep import counts_in_spans

SPAN = "chrom string, start_pos long, end_pos long"


def spans(spark, rows, schema=SPAN):
    return spark.createDataFrame(rows, schema)


def random_spans(n, seed, chroms=2, length=60_000, longest=9_000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = r.randrange(length)
        out.append((k, f"chr{r.randrange(chroms)}", s, s + r.randrange(1, longest)))
    return out


def right(df):
    return df.withColumnsRenamed({"start_pos": "r_start", "end_pos": "r_end"})


def test_touching_spans_do_not_overlap(spark):
    f = spans(spark, [("c", 0, 10), ("c", 20, 30)])
    p = right(spans(spark, [("c", 10, 20)]))
    assert iv.overlap_join(f, p).count() == 0


def test_span_over_two_tiles_pairs_once(spark):
    f = spans(spark, [("c", 4000, 9000)])
    p = right(spans(spark, [("c", 3000, 9500)]))
    assert iv.overlap_join(f, p).count() == 1


def test_overlap_join_equals_nested_loop_with_and_without_splitting(spark):
    left, right_rows = random_spans(80, 1), random_spans(70, 2)
    want = sorted((a, b) for a, c, s, e in left for b, d, t, u in right_rows if c == d and s < u and e > t)
    lf = spans(spark, left, "a long, " + SPAN)
    rt = right(spans(spark, right_rows, "b long, " + SPAN))
    for hot in (None, 3, 1_000_000):
        got = iv.overlap_join(lf, rt, hot_rows=hot)
        assert sorted((r["a"], r["b"]) for r in got.select("a", "b").collect()) == want


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_joins_bookended_spans(spark):
    got = iv.merge(spans(spark, [("c", 0, 5), ("c", 5, 9), ("c", 8, 12), ("c", 20, 21)]))
    assert sorted(tuple(r) for r in got.collect()) == [("c", 0, 12), ("c", 20, 21)]


def test_merge_across_blocks_and_idempotent(spark):
    rows = random_spans(120, 3, chroms=2, length=400_000, longest=9_000)
    df = spans(spark, [r[1:] for r in rows])
    once = iv.merge(df, block=1000)
    want = sorted((c, *x) for c in {r[1] for r in rows} for x in merged([r[2:] for r in rows if r[1] == c]))
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in iv.merge(once, block=1000).collect()) == want


def test_merge_and_complement_partition_the_chromosome(spark):
    df = spans(spark, [r[1:] for r in random_spans(30, 4, length=500_000)])
    m = iv.merge(df, block=5000)
    bounds = spark.createDataFrame([("chr0", 0, 600_000), ("chr1", 0, 600_000), ("chr9", 0, 50)], "chrom string, lo long, hi long")
    gaps = iv.complement(m, bounds, block=5000)
    total = m.unionByName(gaps).groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("n"))
    assert {r["chrom"]: r["n"] for r in total.collect()} == {"chr0": 600_000, "chr1": 600_000, "chr9": 50}
    assert iv.intersect(m, gaps, ["chrom"]).count() == 0


def test_innermost_and_last_start(spark):
    copies = spark.createDataFrame([("outer", "c", 100, 500), ("inner", "c", 200, 300)], "fid string, " + SPAN)
    points = spark.createDataFrame([("c", 250), ("c", 400), ("c", 99)], "chrom string, pos long")
    inner = iv.containing(points, copies, ["fid"])
    assert {(r["pos"], r["fid"]) for r in inner.collect()} == {(250, "inner"), (400, "outer")}
    last = iv.containing(points, copies, ["fid"], mode="last_start_only")
    assert {(r["pos"], r["fid"]) for r in last.collect()} == {(250, "inner")}


def test_innermost_forms_no_pairs(spark):
    r = random.Random(5)
    rows = [(k % 170, f"chr{k % 2}", s, s + r.choice((1, 7, 300, 140_000))) for k in range(200) for s in [r.randrange(200_000)]]
    rows += [(None, "chr0", 5, 9), (7, "chr0", None, 9), (8, "chr0", 5, None), (9, None, 5, 9)]
    asked = [(f"chr{k % 3}", r.randrange(340_000)) for k in range(400)] + [("chr0", None), (None, 6), ("chr0", 6)]
    got = iv.containing(spans(spark, asked, "chrom string, pos long"), spans(spark, rows, "fid long, " + SPAN), ["fid"])
    want = []
    for chrom, pos in asked:
        held = [x for x in rows if None not in (chrom, pos, *x[1:]) and x[1] == chrom and x[2] <= pos < x[3]]
        if held:
            want.append((chrom, pos, max(held, key=lambda x: (x[2], -x[3], -1 if x[0] is None else x[0]))[0]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("Join Inner, ((chrom", "") and "CoGroup" in plan


def test_last_start_carries_over_blocks(spark):
    copies = spark.createDataFrame([("far", "c", 10, 400_000)], "fid string, " + SPAN)
    points = spark.createDataFrame([("c", 390_000), ("c", 400_000)], "chrom string, pos long")
    got = iv.containing(points, copies, ["fid"], mode="last_start_only").collect()
    assert [(r["pos"], r["fid"]) for r in got] == [(390_000, "far")]


def test_flat_round_trip_drops_outside_positions(spark):
    seg = iv.flat_offsets(spans(spark, [("a", 10, 20), ("a", 100, 130), ("b", 5, 15)]), [], ["chrom"])
    points = spark.createDataFrame([("a", 12), ("a", 129), ("b", 5), ("a", 50)], "chrom string, pos long")
    flat = iv.to_flat(points, seg)
    assert {(r["chrom"], r["pos"], r["flat"]) for r in flat.collect()} == {("a", 12, 2), ("a", 129, 39), ("b", 5, 40)}
    back = iv.from_flat(flat.select("flat"), seg)
    assert {(r["chrom"], r["pos"]) for r in back.collect()} == {("a", 12), ("a", 129), ("b", 5)}


def test_introns_of_gene_without_exons_is_its_span(spark):
    genes = spark.createDataFrame([(1, "c", 100, 200, "+"), (2, "c", 0, 50, "-")], "gene_id long, " + SPAN + ", strand string")
    exons = spark.createDataFrame([(1, "c", 100, 120, "+"), (1, "c", 120, 130, "+"), (1, "c", 150, 160, "+")], "gene_id long, " + SPAN + ", strand string")
    got = {(r["gene_id"], r["start_pos"], r["end_pos"], r["seg_off"], r["ordinal"]) for r in iv.introns(genes, exons).collect()}
    assert got == {(1, 130, 150, 0, 0), (1, 160, 200, 20, 1), (2, 0, 50, 0, 0)}


def test_sweep_equals_brute_force_and_ignores_splitting(spark):
    rows = random_spans(60, 5)
    r = random.Random(6)
    pts = [(f"chr{r.randrange(2)}", r.randrange(70_000)) for _ in range(400)] + [("chr0", 777)] * 50
    points = spark.createDataFrame(pts, "chrom string, pos long").withColumn("n", F.lit(1))
    df = spans(spark, rows, "k long, " + SPAN)
    want = {k: sum(c == d and s <= p < e for d, p in pts) for k, c, s, e in rows}
    for hot in (None, 4, 1_000_000):
        got = counts_in_spans(points, df, ["k"], ["n"], hot_rows=hot)
        assert {x["k"]: x["n"] for x in got.collect()} == want


def test_self_check_sees_a_lost_pair(spark, monkeypatch):
    rnd = random.Random(6)
    make = lambda n, w: [(k, rnd.choice("ab"), s := rnd.randrange(5000), s + rnd.randint(1, w)) for k in range(n)]
    schema = "fid long, chrom string, start_pos long, end_pos long"
    left, right = spark.createDataFrame(make(200, 900), schema), spark.createDataFrame(make(300, 300), schema)
    row = selfcheck.overlap_self_check(left, right, ["fid"], ["fid"], anchors=50).first()
    assert row.agree and row.n_anchors == 50 and row.n_tiled == row.n_plain > 0
    monkeypatch.setattr(selfcheck, "overlap_join", lambda a, b: iv.overlap_join(a, b).where("r_fid <> 7 and fid % 5 <> 0"))
    row = selfcheck.overlap_self_check(left, right, ["fid"], ["fid"], anchors=50).first()
    assert not row.agree and row.n_tiled < row.n_plain


def test_calibration(spark):
    frame = lambda ps: spark.createDataFrame([(p, 0.5) for p in ps], "p double, q double")
    good = selfcheck.calibration_check(frame([(k + 1) / 200 for k in range(200)] + [float("nan"), None]), "p", "q").first()
    assert good.calibrated and good.n == 200 and good.excess < 1e-9
    bad = selfcheck.calibration_check(frame([(k + 1) / 800 for k in range(200)]), "p", "q").first()
    assert not bad.calibrated and bad.excess > 0.7
    low = spark.createDataFrame([(0.5, 0.01), (1.0, 1.0)], "p double, q double")
    assert not selfcheck.calibration_check(low, "p", "q").first().calibrated
    assert selfcheck.calibration_check(low.where("false"), "p", "q").first().n == 0
