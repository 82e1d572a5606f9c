"""Small hand-made cases for the composed analyses and the registered queries at the smallest scale."""

import math
import random
from collections import Counter

import pytest

from locusmill.catalog import QUERIES, SQL
from locusmill.functions import text as tx
from locusmill.operators import hosts
from locusmill.operators.counting import locus_counts
from locusmill.plans import peaks, reads
from locusmill.sources import readers

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"
F_SCHEMA = "fid long, chrom string, start_pos long, end_pos long, strand string, subfamily string, family string"
P_SCHEMA = "cell_line string, sample string, chrom string, start_pos long, end_pos long, strand string"


def test_locus_counted_once_per_orientation(spark):
    f = spark.createDataFrame([(1, "c", 100, 200, "+", "s", "F")], F_SCHEMA)
    p = spark.createDataFrame([("x", "a", "c", 110, 120, "+"), ("x", "a", "c", 150, 160, "+"), ("x", "a", "c", 150, 160, "-")], P_SCHEMA)
    got = {r["orientation"]: r["loci"] for r in locus_counts(f, p).collect()}
    assert got == {"sense": 1, "antisense": 1}


def test_loci_and_distinct_loci_form_no_pairs(spark):
    r = random.Random(8)
    f = [(k % 70, f"c{k % 2}", s, s + r.choice((5, 400, 300_000)), r.choice(("+", "-", None)), r.choice("st"), r.choice("FG"))
         for k in range(90) for s in [r.randrange(600_000)]] + [(None, "c0", 5, 90, "+", "s", "F"), (None, "c0", 9, 95, "+", "s", "F")]
    p = [("x", r.choice("ab"), f"c{r.randrange(3)}", s, s + r.choice((1, 60, 5_000)), r.choice(("+", "-")))
         for _ in range(120) for s in [r.randrange(900_000)]]
    hits = {(c, n, fid, sub, fam, "sense" if ps == st else "antisense") for fid, chrom, s, e, st, sub, fam in f
            for c, n, pc, a, b, ps in p if pc == chrom and a < e and b > s}
    features, found = spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(p, P_SCHEMA)
    out = locus_counts(features, found)
    want = Counter((c, n, sub, o) for c, n, fid, sub, o in {(c, n, fid, sub, o) for c, n, fid, sub, fam, o in hits})
    assert {tuple(x)[:4]: x["loci"] for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    cells = spark.createDataFrame([("x", "a", "s", "sense"), ("x", "b", "t", "antisense")], "cell_line string, sample string, subfamily string, orientation string")
    report = peaks.loci_report(features, found, cells, ["F", "G"]).collect()[0]
    behind = {(fid, fam) for c, n, fid, sub, fam, o in hits if (n, sub, o) in (("a", "s", "sense"), ("b", "t", "antisense"))}
    assert report["distinct_loci"] == len(behind) and report["loci_F"] == sum(fam == "F" for _, fam in behind)


def test_folds_without_background(spark):
    f = spark.createDataFrame([(1, "c", 100, 200, "+", "s", "F"), (2, "c", 900, 950, "+", "t", "F")], F_SCHEMA)
    p = spark.createDataFrame([("x", "a", "c", 110, 120, "+"), ("x", "b", "zz", 1, 5, "+")], P_SCHEMA)
    table = peaks.screen(f, p)
    rows = {(r["sample"], r["subfamily"], r["orientation"]): r for r in table.collect()}
    assert rows[("a", "s", "sense")]["fold"] == math.inf
    assert math.isnan(rows[("a", "t", "sense")]["fold"])
    assert rows[("b", "s", "sense")]["n_peaks"] == 1 and rows[("b", "s", "sense")]["loci"] == 0
    assert peaks.significant(table, 2.0).count() == 0


def test_host_classes(spark):
    f = spark.createDataFrame([(k, c, s, s + 10, "+", "s", "F") for k, c, s in
                               [(1, "c", 150), (2, "c", 350), (3, "c", 550), (4, "c", 105), (5, "c", 900), (6, "d", 5)]], F_SCHEMA)
    iv = "chrom string, start_pos long, end_pos long, strand string"
    genes = spark.createDataFrame([("c", 100, 200, "+"), ("c", 300, 400, "-"), ("c", 500, 600, "+"), ("c", 500, 600, "-")], iv)
    exons = spark.createDataFrame([("c", 100, 110, "+")], iv)
    got = {r["fid"]: r["class"] for r in hosts.host_class(f, genes, exons).collect()}
    assert got == {1: "intronic_sense", 2: "intronic_anti", 3: "ambiguous", 4: "exonic_sense", 5: "intergenic", 6: "no_annotation"}
    with pytest.raises(ValueError):
        hosts.keep_classes(f, hosts.host_class(f, genes, exons), ["nonsense"])


def test_read_over_two_copies_is_dropped(spark):
    f = spark.createDataFrame([(1, "c", 0, 100, "+", "s", "F"), (2, "c", 50, 150, "+", "s", "F"), (3, "c", 50, 150, "-", "s", "F")], F_SCHEMA)
    r = spark.createDataFrame([("l", 1, "c", 60, 61, "+"), ("l", 2, "c", 10, 11, "+")],
                              "sample string, frag long, chrom string, start_pos long, end_pos long, strand string")
    got = {(x["orientation"], x["fid"]): x["n"] for x in reads.count_reads(f, r).collect()}
    assert got == {("sense", 1): 1, ("antisense", 3): 1}
    assert reads.count_reads(f, r, multi="all").where("orientation = 'sense'").count() == 2


def test_packed_attributes_match_whole_keys(spark):
    df = spark.createDataFrame([("gene_id|7|subfamily_id|AluY|class_id|SINE|family_id|Alu|",)], "a string")
    row = df.select(*[tx.packed_value("a", k).alias(k) for k in ("family_id", "subfamily_id", "none")]).first()
    assert (row["family_id"], row["subfamily_id"], row["none"]) == ("Alu", "AluY", None)


def test_raw_file_names_and_strand_fallback(spark, tmp_path):
    (tmp_path / "SAMP_X_CELLA_2_chr.bed").write_text("chr1\t5\t9\tn\t0\t+ \nchr1\t7\t8\tn\t0\t.\n")
    (tmp_path / "oddname.bed").write_text("chr1\t5\t9\tn\t0\t+\n")
    df = readers.read_raw_peaks(spark, str(tmp_path))
    got = {(r["sample"], r["cell_line"], r["rep"], r["start_pos"], r["strand"]) for r in df.collect()}
    assert got == {("SAMP_X", "CELLA", 2, 5, "+"), ("SAMP_X", "CELLA", 2, 7, "-"), (None, None, None, 5, "+")}
    assert readers.unparsed_files(df).count() == 1


def test_fasta_offsets_across_file_blocks(spark, tmp_path):
    text = "".join(f">c{k} x\n" + ("ACGTN" * 12 + "\n") * 40 + "AC\n" for k in range(3))
    (tmp_path / "g.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r["chrom"], []).append((r["start_off"], len(r["seq"])))
    assert sorted(got) == ["c0", "c1", "c2"]
    for lines in got.values():
        assert sorted(lines) == [(60 * k, 60) for k in range(40)] + [(2400, 2)]


@pytest.mark.parametrize("name", [
    "enrichment_fold", "merge_intervals", "containing_innermost", "contact_tallies", "host_classes", "read_counts",
    "retention", "replication_timing", "masking_report", "expected_by_distance", "signal_sums", "streamed_tallies",
])
def test_query_equals_sql(spark, name):
    rows, _, verdict = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert verdict.startswith("ok"), verdict


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
