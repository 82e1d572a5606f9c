"""Text readers with fixed schemas. Convert once to Parquet for repeated use."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx
from ..functions.intervals import from_one_based

# Column layouts of the input formats.
RMSK = (
    "bin int, sw_score int, milli_div int, milli_del int, milli_ins int, chrom string, start_pos long, end_pos long, "
    "left_over int, strand string, rep_name string, rep_class string, rep_family string, rep_start int, rep_end int, "
    "rep_left int, id int"
)
GTF = (
    "chrom string, source string, feature string, start_pos long, end_pos long, score string, strand string, "
    "frame string, attributes string"
)
BED6 = "chrom string, start_pos long, end_pos long, name string, score string, strand string"
PAIRS = (
    "read_id string, rna_chrom string, rna_pos long, dna_chrom string, dna_pos long, rna_strand string, "
    "dna_strand string, pair_type string, mapq int, mapq_dna int"
)
BEDGRAPH = "chrom string, start_pos long, end_pos long, value double"
COUNTS = "fid string, chrom string, start_pos string, end_pos string, strand string, length string, n double"
SAM = "name string, flag int, chrom string, start_pos long, mapq int, cigar string"
#: Formats whose lines may be wider than the columns read here; the others have just these columns.
WIDER = {PAIRS, BED6, COUNTS, SAM}


def _lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Tab-separated lines by the schema, with ``path`` and ``fault``: why a line is no row, else null.

    Every column of the schema is looked at whatever is selected later, so the rows do not depend on the plan. Blank and
    comment lines are no lines; an empty field is null. Lines of a format in WIDER may have more columns.
    """
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    raw = raw.where((F.trim("value") != "") & ~F.col("value").startswith("@" if schema == SAM else "#"))
    # A line is split once: what depends on a generated column is not looked at before it, where each field would split anew.
    raw = raw.select("path", F.explode(F.array(F.split("value", "\t", -1))).alias("__p"))
    text = {name: F.nullif(F.get("__p", F.lit(k)), F.lit("")) for k, (name, _) in enumerate(fields)}
    typed = {name: text[name] if kind == "string" else text[name].try_cast(kind) for name, kind in fields}
    wrong = [text[name].isNotNull() & typed[name].isNull() for name, kind in fields if kind != "string"]
    width = F.size("__p") < len(fields) if schema in WIDER else F.size("__p") != len(fields)
    fault = F.when(width, "columns")
    if wrong:
        fault = fault.when(reduce(lambda x, y: x | y, wrong), "number")
    rest = F.slice("__p", len(fields) + 1, F.greatest(F.size("__p") - len(fields), F.lit(0)))
    return raw.select(*[typed[name].alias(name) for name, _ in fields], "path", fault.alias("fault"), rest.alias("rest"))


def _rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return _lines(spark, path, schema).where("fault is null").drop("path", "fault", "rest")


def lost_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines per file and fault (columns, number) that the reader of ``schema`` leaves out."""
    lost = _lines(spark, path, schema).where("fault is not null")
    return lost.groupBy("path", "fault").agg(F.count(F.lit(1)).alias("n_lines"))


def read_rmsk(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Repeat table: 17 tab-separated columns, plain or gzipped; a header is a lost line."""
    return _rows(spark, path, RMSK)


def canonical_elements(rmsk: DataFrame, rules=tx.CANONICAL_RULES) -> DataFrame:
    """Repeats a rule selects, with their element label; chromosomes are not filtered."""
    label = tx.element_label("rep_class", "rep_family", "rep_name", rules)
    return rmsk.withColumn("element", label).where(F.col("element").isNotNull())


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Element GTF with pipe-packed attributes; records without a subfamily or strand drop out."""
    raw = _rows(spark, path, GTF)
    sub = tx.packed_value("attributes", "subfamily_id")
    rows = raw.select(
        tx.packed_value("attributes", "gene_id").alias("gene_id"), "chrom",
        from_one_based("start_pos").alias("start_pos"), "end_pos", "strand", sub.alias("subfamily"),
        tx.packed_value("attributes", "class_id").alias("rep_class"),
        tx.packed_value("attributes", "family_id").alias("rep_family"),
    )
    return rows.where(F.col("subfamily").isNotNull() & F.col("strand").isin("+", "-"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """BED6 or wider; a strand other than plus reads as minus."""
    raw = _lines(spark, path, BED6).where("fault is null")
    strand = F.when(tx.strand_sign("strand") == 1, "+").otherwise("-")
    return raw.select("chrom", "start_pos", "end_pos", "name", strand.alias("strand"), "path")


def _named(path: Column, pattern: str, k: int) -> Column:
    # The pattern is looked for in the last file or directory name that fits, as Spark writes a directory per table.
    got = F.regexp_extract(path, pattern, k)
    return F.when(got != "", got)


def read_raw_peaks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Replicate peak files ``<sample>_<cell>_<rep>_chr.bed``; rows of unparsed names keep a null sample."""
    bed = read_bed(spark, path)
    pattern = r"([^/=]+)_([^_/=]+)_([12])_chr\.bed(?:/|$)"
    sample, cell, rep = (_named(F.col("path"), pattern, k) for k in (1, 2, 3))
    return bed.select(
        cell.alias("cell_line"), sample.alias("sample"), rep.cast("int").alias("rep"), "chrom", "start_pos", "end_pos",
        "strand", "path",
    )


def unparsed_files(peaks: DataFrame) -> DataFrame:
    """Files whose name does not parse, with their row counts."""
    return peaks.where("sample is null").groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))


def read_prepared_peaks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prepared peak files ``<sample>_<cell>.bed``."""
    bed = read_bed(spark, path)
    pattern = r"([^/=]+)_([^_/=]+)\.bed(?:/|$)"
    sample, cell = (_named(F.col("path"), pattern, k) for k in (1, 2))
    return bed.select(cell.alias("cell_line"), sample.alias("sample"), "chrom", "start_pos", "end_pos", "strand")


def read_gene_model(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gene-model records with the attributes in use; only records on a strand."""
    raw = _rows(spark, path, GTF).where(F.col("strand").isin("+", "-"))
    return raw.select(
        "feature", "chrom", from_one_based("start_pos").alias("start_pos"), "end_pos", "strand",
        *[tx.gtf_value("attributes", k).alias(k) for k in ("gene_id", "gene_type", "gene_name")],
    )


def genes_and_exons(model: DataFrame, protein_coding: bool = False) -> tuple[DataFrame, DataFrame]:
    if protein_coding:
        model = model.where("gene_type = 'protein_coding'")
    cols = ["gene_id", "chrom", "start_pos", "end_pos", "strand"]
    return model.where("feature = 'gene'").select(*cols), model.where("feature = 'exon'").select(*cols)


def transcription_starts(model: DataFrame, protein_coding: bool = False) -> DataFrame:
    """One 5' end per transcript, one row per position; the smallest gene name stands for shared positions."""
    rows = model.where("feature = 'transcript'")
    if protein_coding:
        rows = rows.where("gene_type = 'protein_coding'")
    pos = F.greatest(F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("end_pos") - 1), F.lit(0))
    first = F.min(F.struct("gene_name", "gene_type", "strand")).alias("__f")
    return rows.withColumn("pos", pos).groupBy("chrom", "pos").agg(first).select("chrom", "pos", "__f.*")


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Contact pairs, several files pooled; lines may go on after the second mapping quality, shorter ones are lost lines."""
    raw = _rows(spark, path, PAIRS).where("mapq_dna is not null and rna_pos is not null and dna_pos is not null")
    return raw.select(
        "rna_chrom", from_one_based("rna_pos").alias("rna_pos"), "rna_strand", "mapq", "dna_chrom",
        from_one_based("dna_pos").alias("dna_pos"), "mapq_dna",
    )


def read_chrom_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chromosome lengths from the header lines of pairs files."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").startswith("#chromsize"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(parts) >= 3).select(
        parts[1].alias("chrom"), parts[2].cast("long").alias("size")
    ).distinct()


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Signal steps with the file they come from; track lines are lost lines."""
    return _lines(spark, path, BEDGRAPH).where("fault is null").drop("fault", "rest")


def read_manifest_tracks(spark: SparkSession, manifest: str, root: str, assay: str) -> DataFrame:
    """Tracks of one assay listed in a manifest (path, assay, label), labelled by the manifest."""
    listed = spark.read.schema("path string, assay string, label string").option("sep", "\t").option("header", True).csv(manifest)
    wanted = listed.where(F.col("assay") == assay).select(F.col("path").alias("listed"), F.col("label").alias("sample"))
    rel = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "/part-[^/]*$", "")
    return read_bedgraph(spark, root).withColumn("listed", rel).join(wanted, "listed").drop("listed", "path")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sequence lines with their chromosome and offset.

    A line's place is its file block and its order in the block. Offsets run inside a block; a table with one row per
    block carries the open record and its length into the next.
    """
    raw = spark.read.text(path).select(
        F.trim("value").alias("seq"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("blk"), F.monotonically_increasing_id().alias("ln"),
    ).where("seq <> ''")
    head = F.col("seq").startswith(">")
    lines = raw.withColumn("name", F.when(head, F.regexp_extract("seq", r"^>(\S+)", 1))).withColumn(
        "bases", F.when(head, 0).otherwise(F.length("seq")).cast("long")
    )
    along = W.partitionBy("file", "blk").orderBy("ln")
    rec = F.sum(F.col("name").isNotNull().cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("rec", rec)
    before = W.partitionBy("file", "blk", "rec").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns({
        "chrom": F.last("name", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)),
        "off": F.coalesce(F.sum("bases").over(before), F.lit(0)),
    })
    tails = lines.groupBy("file", "blk", "rec").agg(F.sum("bases").alias("bases"), F.max("chrom").alias("chrom"))
    tails = tails.groupBy("file", "blk").agg(F.max(F.struct("rec", "bases", "chrom")).alias("t")).select("file", "blk", "t.*")
    blocks = W.partitionBy("file").orderBy("blk")
    tails = tails.withColumn("run", F.sum((F.col("rec") > 0).cast("int")).over(blocks.rowsBetween(W.unboundedPreceding, 0)))
    open_run = W.partitionBy("file", "run").orderBy("blk").rowsBetween(W.unboundedPreceding, 0)
    tails = tails.withColumn("open_len", F.sum("bases").over(open_run)).withColumn(
        "open_chrom", F.last("chrom", ignorenulls=True).over(blocks.rowsBetween(W.unboundedPreceding, 0))
    )
    carry = tails.select(
        "file", "blk", F.lag("open_len", 1, 0).over(blocks).alias("c_len"), F.lag("open_chrom").over(blocks).alias("c_chrom")
    )
    out = lines.where("name is null").join(carry, ["file", "blk"])
    first = F.col("rec") == 0
    return out.select(
        F.when(first, F.col("c_chrom")).otherwise(F.col("chrom")).alias("chrom"),
        (F.col("off") + F.when(first, F.col("c_len")).otherwise(0)).alias("start_off"), "seq",
    )


def read_count_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per-copy count tables ``<sample>.<orientation>.txt``; a header has no count and is a lost line."""
    raw = _lines(spark, path, COUNTS).where("fault is null and n is not null")
    name = F.regexp_extract("path", r"([^/=]+)\.(sense|antisense)\.txt(?:/|$)", 0)
    parts = F.split(F.regexp_replace(name, "/$", ""), r"\.")
    return raw.select(
        F.element_at(parts, 1).alias("sample"), F.element_at(parts, 2).alias("orientation"), "fid", "n",
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Aligned blocks of SAM text files ``<sample>.sam``: sample, frag, read, chrom, start_pos, end_pos, strand, mapq.

    A read is cut at skipped reference (N); deletions stay inside a block, insertions and clipped ends take no reference.
    ``frag`` is the read's name with its hit number (tag HI, else 0), so the places of a multi-mapped pair are fragments
    of their own. ``read`` is 2 for a pair's second read, else 1. Unmapped reads have no block; header lines are no lines.
    """
    raw = _lines(spark, path, SAM).where("fault is null and chrom <> '*' and cigar <> '*'").where(F.col("flag").bitwiseAND(4) == 0)
    tag = F.get(F.filter("rest", lambda t: t.startswith("HI:i:")), F.lit(0))
    hit = F.coalesce(F.substring(tag, 6, 20), F.lit("0"))

    def length(part: Column, kinds: str) -> Column:
        found = F.regexp_extract_all(part, F.lit(f"([0-9]+)[{kinds}]"), F.lit(1))
        return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))

    parts = F.transform(
        F.split("cigar", "(?<=N)"), lambda p: F.struct(length(p, "MD=X").alias("own"), length(p, "N").alias("skip"))
    )
    rows = raw.withColumns({"__p": parts, "start_pos": from_one_based("start_pos")})
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.size("__p") - 1)))
    before = F.aggregate(F.slice("__p", 1, F.col("__k")), F.lit(0).cast("long"), lambda n, x: n + x["own"] + x["skip"])
    rows = rows.withColumn("start_pos", F.col("start_pos") + before)
    own = F.get("__p", F.col("__k"))["own"]
    bit = lambda n: F.col("flag").bitwiseAND(n) != 0
    return rows.where(own > 0).select(
        _named(F.col("path"), r"([^/=]+)\.sam(?:/|$)", 1).alias("sample"), F.concat_ws(":", "name", hit).alias("frag"),
        F.when(bit(1) & bit(128), 2).otherwise(1).alias("read"), "chrom", "start_pos", (F.col("start_pos") + own).alias("end_pos"),
        F.when(bit(16), "-").otherwise("+").alias("strand"), "mapq",
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated table with a header: run sheets, results, library totals."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def primary_only(df: DataFrame, chrom: str = "chrom", keep: Sequence[str] = tx.PRIMARY) -> tuple[DataFrame, DataFrame]:
    """(rows on the primary assembly, rows skipped per other chromosome)."""
    inside = F.col(chrom).isin(list(keep))
    skipped = df.where(~inside).groupBy(F.col(chrom).alias("chrom")).agg(F.count(F.lit(1)).alias("n_skipped"))
    return df.where(inside), skipped
