"""Formats: tables written by Spark from the derived views and read back through the readers; and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import text as tx
from ..operators.order import positional_rank
from ..plans import contacts as pairs, peaks as peak_plan
from ..session import scratch_path, staged
from ..sources import readers, writers
from ..streaming import contacts as streaming
from .contacts import ENDS, FCS, INNER, SPANS, tallies
from .peaks import ENRICH, enrichment
from .registry import register, rnd

NAMED = """, el as (select fid, chrom, start_pos, end_pos, strand,
    case family when 'famA' then 'SINE' when 'famN' then 'LINE' else case when subfamily in ('famR_0', 'famR_1') then 'Simple_repeat'
      else 'Retroposon' end end as rep_class,
    case family when 'famA' then 'Alu' when 'famN' then 'L1' else 'SVA' end as rep_family,
    replace(replace(replace(subfamily, 'famA', 'AluY'), 'famN', case when strand = '+' then 'L1H' else 'HAL1' end), 'famR', 'SVA') as rep_name
    from {feature})"""


def named_elements(spark, sf):
    """Features dressed as repeat records, some of which no selection rule takes."""
    text = NAMED.lstrip(", ").replace("el as (", "", 1)[:-1]
    return spark.sql(text, feature=view(spark, sf, "feature"))


SQL_NAMED = NAMED.format(feature="feature")
CHOSEN = ("(rep_class = 'SINE' and rep_family = 'Alu' and starts_with(rep_name, 'Alu')) or (rep_class = 'LINE' and rep_family = 'L1'"
          " and starts_with(rep_name, 'L1')) or (rep_class = 'Retroposon' and rep_family = 'SVA')")


def write_text(df, path):
    df.write.option("sep", "\t").csv(path)


def rmsk(spark, sf):
    path = scratch_path(spark, "rmsk")
    zero = [F.lit(0).alias(f"z{k}") for k in range(5)]
    rows = named_elements(spark, sf).select(
        *zero, "chrom", "start_pos", "end_pos", F.lit(0).alias("left"), "strand", "rep_name", "rep_class", "rep_family",
        *[F.lit(0).alias(f"y{k}") for k in range(3)], F.lit(1).alias("id"),
    )
    rows.write.option("sep", "\t").option("compression", "gzip").csv(path)
    return readers.read_rmsk(spark, path)


@register(
    "canonical_elements",
    with_views(["feature"], SQL_NAMED + f""", r as (select *, row_number() over (order by chrom, start_pos, end_pos, strand, rep_name) as rank from el)
    select rank, chrom, start_pos, end_pos, strand, rep_name, rep_family as element from r where {CHOSEN}"""),
)
def canonical_elements(spark, sf):
    ranked = positional_rank(rmsk(spark, sf), ties=["end_pos", "strand", "rep_name"])
    return readers.canonical_elements(ranked).select("rank", "chrom", "start_pos", "end_pos", "strand", "rep_name", "element")


@register(
    "canonical_by_name",
    with_views(["feature"], SQL_NAMED + """ select rep_name, case when starts_with(rep_name, 'SVA') then 'SVA' when rep_class = 'SINE' then 'Alu'
      else 'L1' end as element, count(*) as n from el where starts_with(rep_name, 'SVA') or (rep_class = 'SINE' and starts_with(rep_name, 'Alu'))
      or (rep_class = 'LINE' and starts_with(rep_name, 'L1')) group by all"""),
)
def canonical_by_name(spark, sf):
    chosen = readers.canonical_elements(rmsk(spark, sf), tx.CANONICAL_RULES_BY_NAME)
    return chosen.groupBy("rep_name", "element").agg(F.count(F.lit(1)).alias("n"))


@register(
    "element_gtf",
    with_views(["feature"], SQL_NAMED + """ select cast(fid as varchar) as gene_id, chrom, start_pos, end_pos, strand, rep_name as subfamily,
      rep_class, rep_family, case when starts_with(rep_name, 'Alu') then 'Alu' when starts_with(rep_name, 'L1') then 'L1' else 'SVA' end as family from el"""),
)
def element_gtf(spark, sf):
    path = scratch_path(spark, "gtf")
    rows = named_elements(spark, sf).withColumnsRenamed({"fid": "gene_id", "rep_name": "subfamily"})
    writers.write_gtf(rows, path)
    return readers.read_elements(spark, path).withColumn("family", tx.family_by_prefix("subfamily"))


@register(
    "raw_peak_files",
    with_views(["peak_rep"], " select cell_line, sample, rep, chrom, start_pos, end_pos, strand from peak_rep"),
)
def raw_peak_files(spark, sf):
    path = scratch_path(spark, "raw-peaks")
    file = F.concat_ws("_", "sample", "cell_line", F.col("rep").cast("string"), F.lit("chr.bed"))
    writers.write_bed(view(spark, sf, "peak_rep").withColumn("file", file), path, "sample", "file")
    return readers.read_raw_peaks(spark, path).drop("path")


@register("prepared_peak_files", with_views(["peak"], " select * from peak"))
def prepared_peak_files(spark, sf):
    path = scratch_path(spark, "peaks")
    named = view(spark, sf, "peak").withColumn("name", F.concat_ws("_", "sample", "cell_line"))
    writers.write_bed(named.withColumn("file", F.concat("name", F.lit(".bed"))), path, "name", "file")
    return readers.read_prepared_peaks(spark, path)


def gene_model(spark, sf):
    path = scratch_path(spark, "genes")
    kind = F.when(F.col("end_pos") - F.col("start_pos") < 10000, "lncRNA").otherwise("protein_coding")
    genes = view(spark, sf, "gene").withColumn("type", kind)
    exons = view(spark, sf, "exon").join(genes.select("gene_id", "type"), "gene_id")
    cols = ["gene_id", "chrom", "start_pos", "end_pos", "strand", "type"]
    rows = None
    for kind, table in (("gene", genes), ("transcript", genes), ("exon", exons)):
        part = table.select(F.lit(kind).alias("kind"), *cols)
        rows = part if rows is None else rows.unionByName(part)
    attributes = F.format_string('gene_id "%d"; gene_type "%s"; gene_name "N%d";', F.col("gene_id"), F.col("type"), F.col("gene_id"))
    writers._text(rows.select(
        "chrom", F.lit("x"), "kind", F.col("start_pos") + 1, "end_pos", F.lit("."), "strand", F.lit("."), attributes
    ), path)
    return readers.read_gene_model(spark, path)


@register("gene_model_exons", with_views(["exon"], " select cast(e.gene_id as varchar) as gene_id, e.chrom, e.start_pos, e.end_pos, e.strand from exon e join gene g on g.gene_id = e.gene_id where g.end_pos - g.start_pos >= 10000"))
def gene_model_exons(spark, sf):
    return readers.genes_and_exons(gene_model(spark, sf), protein_coding=True)[1]


@register("gene_model_genes", with_views(["gene"], " select cast(gene_id as varchar) as gene_id, chrom, start_pos, end_pos, strand from gene"))
def gene_model_genes(spark, sf):
    return readers.genes_and_exons(gene_model(spark, sf))[0]


@register(
    "transcription_starts",
    with_views(["gene"], """ select chrom, case when strand = '+' then start_pos else end_pos - 1 end as pos,
      min(concat('N', cast(gene_id as varchar))) as gene_name from gene group by all"""),
)
def transcription_starts(spark, sf):
    return readers.transcription_starts(gene_model(spark, sf)).select("chrom", "pos", "gene_name")


def pairs_text(spark, sf):
    path = scratch_path(spark, "pairs")
    c = view(spark, sf, "contact")
    text = F.concat_ws("\t", F.lit("r"), "rna_chrom", (F.col("rna_pos") + 1).cast("string"), "dna_chrom",
                       (F.col("dna_pos") + 1).cast("string"), "rna_strand", F.lit("+"), F.lit("UU"),
                       F.col("mapq").cast("string"), F.col("mapq_dna").cast("string"), F.lit("x"))
    sizes = view(spark, sf, "chrom_size").select(F.format_string("#chromsize: %s %d", F.col("chrom"), F.col("size")))
    sizes.union(c.select(text)).write.text(path)
    return path


@register("pairs_text", with_views(["contact"], " select rna_chrom, rna_pos, rna_strand, mapq, dna_chrom, dna_pos, mapq_dna from contact"))
def pairs_text_rows(spark, sf):
    return readers.read_pairs(spark, pairs_text(spark, sf))


@register("sam_alignments", with_views(["read_align", "contact"], """ select sample, concat(frag, ':1') as frag, read, r.chrom, r.start_pos, r.end_pos, strand
    from read_align r"""))
def sam_alignments(spark, sf):
    """The alignments written as SAM text, one line a read, spliced reads and second mates among them, and read again."""
    root = scratch_path(spark, "sam")
    c = view(spark, sf, "contact").withColumn("file", F.concat(F.lit("lib"), F.col("lib").cast("string"), F.lit(".sam")))
    back = F.col("rna_strand") == "-"
    odd = F.col("dna_pos") % 2 == 1
    one = F.struct(
        (F.when(odd, 0).otherwise(65) + F.when(back, 16).otherwise(0)).alias("flag"), (F.col("rna_pos") + 1).alias("pos"),
        F.when(F.col("dna_pos") % 5 == 0, "5S20M1I10D20M100N25M").otherwise("75M3H").alias("cigar"))
    two = F.struct((F.lit(129) + F.when(back, 0).otherwise(16)).alias("flag"), (F.col("rna_pos") + 61 + F.col("dna_pos") % 300).alias("pos"), F.lit("70M5D").alias("cigar"))
    lines = c.withColumn("r", F.explode(F.when(odd, F.array(one)).otherwise(F.array(one, two))))
    name = F.col("rna_pos") * 1000000 + F.col("dna_pos") % 1000000
    text = F.concat_ws("\t", name.cast("string"), F.col("r.flag").cast("string"), "rna_chrom", F.col("r.pos").cast("string"),
                       F.lit("60"), "r.cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NH:i:1"), F.lit("HI:i:1"))
    lines.select(text.alias("value"), "file").write.partitionBy("file").text(root)
    return readers.read_sam(spark, root).drop("mapq")


@register("pairs_chrom_sizes", with_views(["chrom_size"], " select * from chrom_size"))
def pairs_chrom_sizes(spark, sf):
    return readers.read_chrom_sizes(spark, pairs_text(spark, sf))


@register(
    "primary_assembly",
    with_views(["peak"], " select chrom, count(*) as n_skipped from peak where chrom = 'chrUn_1' group by 1"),
)
def primary_assembly(spark, sf):
    return readers.primary_only(view(spark, sf, "peak"))[1]


@register(
    "manifest_tracks",
    with_views(["track"], " select case sample when 'in_r2' then 'other' else 'repliseq' end as assay, sample, chrom, start_pos, end_pos, value from track"),
)
def manifest_tracks(spark, sf):
    root = scratch_path(spark, "tracks")
    t = view(spark, sf, "track").withColumn("file", F.concat("sample", F.lit(".bedgraph")))
    t.select("chrom", "start_pos", "end_pos", "value", "file").write.option("sep", "\t").partitionBy("file").csv(f"{root}/d")
    listed = t.select("sample", "file").distinct().select(
        F.concat(F.lit("file="), "file").alias("path"),
        F.when(F.col("sample") == "in_r2", "other").otherwise("repliseq").alias("assay"), F.col("sample").alias("label"),
    )
    writers.write_tsv(listed, f"{root}/manifest")
    read = [
        readers.read_manifest_tracks(spark, f"{root}/manifest", f"{root}/d", assay).select(
            F.lit(assay).alias("assay"), "sample", "chrom", "start_pos", "end_pos", "value")
        for assay in ("repliseq", "other")
    ]
    return read[0].unionByName(read[1])


@register(
    "fasta_lines",
    """ select concat('doc', cast(doc_id as varchar)) as chrom, cast(60 * (i.i) as bigint) as start_off,
      substring(s, cast(1 + 60 * i.i as bigint), 60) as seq from (select doc_id, regexp_replace(lower(text), '[^a-z]', 'n', 'g') as s from documents) d
      join (select unnest(range(20000)) as i) i on 60 * i.i < length(s)""",
)
def fasta_lines(spark, sf):
    path = scratch_path(spark, "fasta")
    seq = F.regexp_replace(F.lower("text"), "[^a-z]", "n")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", seq.alias("s")).where("s <> ''")
    starts = F.sequence(F.lit(0), ((F.length("s") - 1) / 60).cast("int"))
    body = F.array_join(F.transform(starts, lambda k: F.substring(F.col("s"), k * 60 + 1, F.lit(60))), "\n")
    docs.select(F.concat(F.lit(">doc"), "doc_id", F.lit(" text\n"), body).alias("value")).write.text(path)
    return readers.read_fasta(spark, path)


@register(
    "count_tables",
    with_views(["feature", "contact"], INNER + """ select concat('lib', cast(lib as varchar)) as sample,
      case when rna_strand = strand then 'sense' else 'antisense' end as orientation, cast(fid as varchar) as fid, cast(count(*) as double) as n from hit group by all"""),
)
def count_tables(spark, sf):
    path = scratch_path(spark, "counts")
    hits = pairs.on_copies(view(spark, sf, "contact"), view(spark, sf, "feature"))
    o = F.when(F.col("rna_strand") == F.col("strand"), "sense").otherwise("antisense")
    file = F.concat(F.lit("lib"), F.col("lib").cast("string"), F.lit("."), o, F.lit(".txt"))
    rows = hits.groupBy("fid", file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    dots = [F.lit(".").alias(f"x{k}") for k in range(5)]
    rows.select("fid", *dots, "n", "file").write.option("sep", "\t").partitionBy("file").csv(path)
    return readers.read_count_tables(spark, path)


@register(
    "count_annotation",
    with_views(["feature"], """ select cast(f.fid as varchar) as gene_id, subfamily, family, chrom, start_pos + 1 as start, end_pos as end,
      strand as sense_strand, case when strand = '+' then '-' else '+' end as antisense_strand from feature f"""),
)
def count_annotation(spark, sf):
    root = scratch_path(spark, "annotation")
    writers.write_count_annotation(view(spark, sf, "feature"), root)
    saf = "GeneID string, Chr string, Start long, End long, Strand string"
    key = readers.read_table(spark, f"{root}/key", "gene_id string, subfamily string, family string, chrom string, start long, end long, strand string")
    sides = [readers.read_table(spark, f"{root}/{o}", saf).select(F.col("GeneID").alias("gene_id"), F.col("Strand").alias(f"{o}_strand"))
             for o in ("sense", "antisense")]
    return key.drop("strand").join(sides[0], "gene_id").join(sides[1], "gene_id")


@register("sorted_shards", with_views(["contact"], " select rna_chrom as chrom, count(*) as n, min(rna_pos) as first_pos, max(rna_pos) as last_pos from contact group by 1"))
def sorted_shards(spark, sf):
    path = scratch_path(spark, "shards")
    writers.write_sorted_shards(pairs.rna_ends(view(spark, sf, "contact")), path)
    return spark.read.parquet(path).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@register(
    "result_export",
    with_views(["feature", "peak"], ENRICH + """ select cell_line, sample, subfamily, orientation, loci, round(fold, 4) as fold from enr"""),
)
def result_export(spark, sf):
    path = scratch_path(spark, "result")
    table = enrichment(spark, sf)
    writers.write_tsv(table.select("cell_line", "sample", "subfamily", "orientation", "loci", "fold"), path, {"fold": "%.4f"})
    schema = "cell_line string, sample string, subfamily string, orientation string, loci long, fold double"
    return readers.read_table(spark, path, schema).withColumn("fold", rnd("fold", 4))


@register(
    "split_results",
    with_views(["feature", "peak"], ENRICH + """ select cell_line, 'all' as part, count(*) as n from enr group by all
      union all select cell_line, 'significant', count(*) from enr where isfinite(fold) and fold > 1 group by all"""),
)
def split_results(spark, sf):
    root = scratch_path(spark, "split")
    table = enrichment(spark, sf)
    writers.write_split_results(table, table.where(peak_plan.is_finite("fold") & (F.col("fold") > 1)), root)
    parts = [spark.read.parquet(f"{root}/{p}").groupBy("cell_line").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
             for p in ("all", "significant")]
    return parts[0].unionByName(parts[1])


@register("tally_table", with_views(FCS, ENDS + SPANS + " select subfamily, orientation, shift, d0, d1, d2, 'all' as class, 10 as min_mapq from tal"))
def tally_table(spark, sf):
    path = scratch_path(spark, "tallies")
    writers.write_tallies(tallies(spark, sf), path, "all", 10)
    return spark.read.parquet(path).where("class = 'all' and min_mapq = 10").select(
        "subfamily", "orientation", "shift", "d0", "d1", "d2", "class", "min_mapq")


STREAM_SCHEMA = "fid long, rna_chrom string, rna_pos long, rna_strand string, mapq long, dna_chrom string, dna_pos long"


STREAMED = INNER + """ select subfamily, case when rna_strand = strand then 'antisense' else 'sense' end as orientation,
      case when rna_chrom <> dna_chrom then 2 when abs(dna_pos - rna_pos) <= 1000000 then 0 else 1 end as dclass, count(*) as n
    from hit where mapq >= 10 group by all"""


def arrivals(spark, sf, parts):
    """A folder, and functions that each let another part of the contacts arrive in it."""
    source = scratch_path(spark, "arrivals")
    features = view(spark, sf, "feature")
    hits = pairs.on_copies(view(spark, sf, "contact"), features).withColumnsRenamed({"chrom": "rna_chrom", "pos": "rna_pos"})
    hits = staged(hits.select(*[c.split()[0] for c in STREAM_SCHEMA.split(", ")]))
    part = F.pmod(F.xxhash64(*hits.columns), F.lit(parts))
    steps = [lambda k=k: hits.where(part == k).repartition(3).write.mode("append").parquet(source) for k in range(parts)]
    return source, features, steps


@register("streamed_tallies", with_views(["feature", "contact"], STREAMED))
def streamed_tallies(spark, sf):
    source, features, (arrive,) = arrivals(spark, sf, 1)
    arrive()
    stream = streaming.stream_contacts(spark, source, STREAM_SCHEMA, files_per_trigger=2)
    return streaming.run_tally(stream, features, scratch_path(spark, "totals"), scratch_path(spark, "tally"), 10)


@register("resumed_tallies", with_views(["feature", "contact"], STREAMED))
def resumed_tallies(spark, sf):
    """Two runs over arriving files, the second going on from the checkpoint of the first."""
    source, features, steps = arrivals(spark, sf, 2)
    out, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "tally")
    for arrive in steps:
        arrive()
        stream = streaming.stream_contacts(spark, source, STREAM_SCHEMA, files_per_trigger=2)
        totals = streaming.run_tally(stream, features, out, checkpoint, 10)
    return totals


@register("changed_tallies", with_views(["feature", "contact"], STREAMED))
def changed_tallies(spark, sf):
    """The last total in a log of changes that two runs wrote."""
    source, features, steps = arrivals(spark, sf, 2)
    out, checkpoint = scratch_path(spark, "changes"), scratch_path(spark, "tally")
    for arrive in steps:
        arrive()
        stream = streaming.stream_contacts(spark, source, STREAM_SCHEMA, files_per_trigger=2)
        log = streaming.changed_tallies(stream, features, out, checkpoint, 10)
    return streaming.latest(log)
