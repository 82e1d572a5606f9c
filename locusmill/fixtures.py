"""Interval-shaped views derived from the star-schema tables.

Every view is one SQL text that Spark and DuckDB both accept. Placeholders in braces name either a base table or an
earlier view, so the same text feeds ``spark.sql`` (with DataFrames) and a DuckDB ``WITH`` chain (with names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import staged

CHROM_LENGTH = 20_050_000
SPAN = 20_000_000
TABLES = ("lineitem", "orders", "part", "events", "documents")

VIEWS: dict[str, str] = {
    "feature": """
        select distinct
          (((((l_suppkey % 8) * 20000000 + (l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 20000000) * 1000
             + (100 + (l_partkey*31 + l_linenumber) % 900)) * 2 + l_linenumber % 2) * 6 + l_partkey % 6) * 3
            + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as fid,
          concat('chr', cast(1 + l_suppkey % 8 as string)) as chrom,
          (l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 20000000 as start_pos,
          (l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 20000000
            + 100 + (l_partkey*31 + l_linenumber) % 900 as end_pos,
          case when l_linenumber % 2 = 0 then '+' else '-' end as strand,
          concat('fam', l_returnflag, '_', cast(l_partkey % 6 as string)) as subfamily,
          concat('fam', l_returnflag) as family
        from {lineitem}""",
    "peak_rep": """
        select concat('cell', cast(o_custkey % 2 as string)) as cell_line,
          concat('S', cast(cast(floor(o_custkey/2) as bigint) % 12 as string)) as sample, r.rep as rep,
          case when o_orderkey % 97 = 0 then 'chrUn_1' else concat('chr', cast(1 + o_orderkey % 8 as string)) end as chrom,
          (o_orderkey*15485863 + o_custkey*32452843) % 20000000
            + case when r.rep = 2 then o_custkey % 40 else 0 end as start_pos,
          (o_orderkey*15485863 + o_custkey*32452843) % 20000000
            + case when r.rep = 2 then o_custkey % 40 else 0 end + 20 + o_custkey % 80 as end_pos,
          case when o_orderpriority < '3' then '+' else '-' end as strand
        from {orders}, (select 1 as rep union all select 2 as rep) r
        where r.rep = 1 or (o_orderkey % 3 <> 0 and cast(floor(o_custkey/2) as bigint) % 12 <> 3)""",
    "peak": """
        select cell_line, sample, chrom, start_pos, end_pos, strand from {peak_rep} where rep = 1""",
    "peak_near": """
        select cell_line, sample, chrom, start_pos, end_pos, strand from {peak} union all
        select 'cell0' as cell_line, 'S1' as sample, chrom, start_pos, end_pos, strand from {feature}
        where subfamily = 'famA_0' and start_pos % 3 = 0""",
    "gene": """
        select p_partkey as gene_id, concat('chr', cast(1 + p_partkey % 8 as string)) as chrom,
          (p_partkey*86028121) % 19900000 as start_pos,
          (p_partkey*86028121) % 19900000 + 5000 + (p_size*997) % 40000 as end_pos,
          case when cast(floor(p_partkey/8) as bigint) % 2 = 0 then '+' else '-' end as strand
        from {part}""",
    "exon": """
        select gene_id, chrom,
          start_pos + k.k * cast(floor((end_pos - start_pos)/4) as bigint) as start_pos,
          start_pos + k.k * cast(floor((end_pos - start_pos)/4) as bigint) + 200 as end_pos, strand
        from {gene}, (select 0 as k union all select 1 union all select 2 union all select 3) k""",
    "contact": """
        select rna_chrom, rna_pos, rna_strand, mapq, dna_chrom,
          case when l_discount < 0.05 then (rna_pos + (l_partkey*7919) % 900000) % 20000000
               else (l_partkey*15485863 + l_orderkey*17) % 20000000 end as dna_pos, mapq_dna, l_orderkey % 4 as lib
        from (select concat('chr', cast(1 + l_suppkey % 8 as string)) as rna_chrom,
                (l_orderkey*49979687 + l_linenumber*611953) % 20000000 as rna_pos,
                case when l_partkey % 2 = 0 then '+' else '-' end as rna_strand,
                (l_partkey*13) % 61 as mapq,
                case when l_quantity <= 25 then concat('chr', cast(1 + l_suppkey % 8 as string))
                     else concat('chr', cast(1 + l_partkey % 8 as string)) end as dna_chrom,
                (l_suppkey*17) % 61 as mapq_dna, l_partkey, l_orderkey, l_discount
              from {lineitem}) x""",
    "contact_rna": """
        select g.chrom as rna_chrom,
          g.start_pos + (l_linenumber % 4) * cast(floor((g.end_pos - g.start_pos)/4) as bigint) + (l_orderkey*13) % 400 as rna_pos,
          case when g.strand = '+' then '-' else '+' end as rna_strand, (l_partkey*13 + l_orderkey) % 61 as mapq,
          case when l_quantity <= 25 then g.chrom else concat('chr', cast(1 + l_suppkey % 8 as string)) end as dna_chrom,
          (l_partkey*15485863 + l_orderkey*49979687) % 20000000 as dna_pos, (l_suppkey*17) % 61 as mapq_dna
        from {lineitem} join {gene} g on g.gene_id = l_partkey""",
    "housekeeping": """
        select gene_id, chrom, start_pos, end_pos, strand from {gene_core} where gene_id in (11, 22, 33, 44)""",
    "track": """
        select case event_type when 'click' then 'ip_r1' when 'view' then 'ip_r2'
                    when 'purchase' then 'in_r1' else 'in_r2' end as sample,
          case when event_id % 2 = 0 then 'pos' else 'neg' end as track_strand,
          concat('chr', cast(1 + user_id % 8 as string)) as chrom,
          (event_id*179424673 + user_id*15487469) % 20000000 as start_pos,
          (event_id*179424673 + user_id*15487469) % 20000000 + 500 + user_id % 500 as end_pos, value
        from {events}""",
    "pixel": """
        select rna_chrom as chrom, least(cast(floor(rna_pos/200000) as bigint), cast(floor(dna_pos/200000) as bigint)) as i,
          greatest(cast(floor(rna_pos/200000) as bigint), cast(floor(dna_pos/200000) as bigint)) as j,
          count(*) as n
        from {contact} where rna_chrom = dna_chrom group by 1, 2, 3""",
    "read_align": """
        select concat('lib', cast(lib as string)) as sample, rna_chrom as chrom, rna_pos * 1000000 + dna_pos % 1000000 as frag,
          case when m.m = 1 then 2 else 1 end as read,
          rna_pos + case m.m when 0 then 0 when 1 then 60 + dna_pos % 300 else 150 end as start_pos,
          rna_pos + case m.m when 1 then 135 + dna_pos % 300 when 2 then 175
                    else case when dna_pos % 5 = 0 then 50 else 75 end end as end_pos,
          case when (rna_strand = '+') = (m.m <> 1) then '+' else '-' end as strand
        from {contact}, (select 0 as m union all select 1 union all select 2) m
        where m.m = 0 or (m.m = 1 and dna_pos % 2 = 0) or (m.m = 2 and dna_pos % 5 = 0)""",
    "gene_core": """
        select gene_id, chrom, start_pos, start_pos + 400 as end_pos, strand from {gene}""",
    "gene_read": """
        select case l_orderkey % 3 when 0 then 'kit_fr' when 1 then 'kit_rf' else 'kit_un' end as sample, g.chrom as chrom,
          l_orderkey * 10 + l_linenumber as frag, 1 + m.m as read,
          g.start_pos + (l_orderkey*13) % 150 + m.m * 150 as start_pos,
          g.start_pos + (l_orderkey*13) % 150 + m.m * 150 + 75 as end_pos,
          case when ((g.strand = '+') = ((l_orderkey % 3 = 0 or (l_orderkey % 3 = 2 and l_linenumber % 2 = 0))
            = (l_orderkey % 50 <> 7))) = (m.m = 0) then '+' else '-' end as strand
        from {lineitem} join {gene} g on g.gene_id = l_partkey, (select 0 as m union all select 1) m""",
    "seq_line": """
        select concat('chr', cast(1 + doc_id % 8 as string)) as chrom,
          cast(floor(doc_id/8) as bigint) * 160000 % 20000000 as start_off, text as seq from {documents}""",
    "satellite": """
        select chrom, start_pos, end_pos from {feature} where subfamily = 'famR_0'""",
    "bin_weight": """
        select chrom, bin, case when (bin*37 + cast(replace(chrom, 'chr', '') as bigint)*5) % 11 = 0 then null
            else cast(0.5 as double) + cast((bin*13) % 17 as double) / 17 end as weight
        from (select distinct chrom, cast(floor(start_pos/200000) as bigint) as bin from {feature}) b""",
    "eigen": """
        select chrom, bin, case when (bin*7 + n) % 13 = 0 then null
            else cast((n*7919 + bin*104729) % 2001 - 1000 as double) / 1000 end as e1
        from (select chrom, cast(floor(start_pos/250000) as bigint) as bin, count(*) as n from {feature} group by 1, 2) b""",
    "tss": """
        select distinct chrom, case when strand = '+' then start_pos else end_pos - 1 end as pos from {gene}""",
    "chrom_size": """
        select chrom, cast(20050000 as bigint) as size from {feature} group by chrom""",
}


def _needs(name: str) -> list[str]:
    """Views ``name`` is built from, in build order, itself last."""
    found: list[str] = []
    for other in VIEWS:
        if other != name and "{" + other + "}" in VIEWS[name]:
            found += [v for v in _needs(other) if v not in found]
    return found + [name]


# The annotation is derived once per application and folder and then read from files, as a real one would be.
ANNOTATION = ("feature",)
_written: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view as a DataFrame over ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _written:
        return _written[key]
    if name in ANNOTATION:
        _written[key] = staged(_derive(spark, sf_dir, name), keep=True)
        return _written[key]
    return _derive(spark, sf_dir, name)


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    built: dict[str, DataFrame] = {}

    def source(ref: str) -> DataFrame:
        if ref in VIEWS:
            return built[ref]
        return spark.read.parquet(f"{sf_dir}/{ref}.parquet")

    for step in _needs(name):
        text = VIEWS[step]
        refs = [r for r in (*TABLES, *VIEWS) if "{" + r + "}" in text]
        if step in ANNOTATION and step != name:
            built[step] = view(spark, sf_dir, step)
            continue
        built[step] = spark.sql(text, **{r: source(r) for r in refs})
    return built[name]


def with_views(names: list[str], body: str) -> str:
    """``body`` behind a DuckDB ``WITH`` chain; a body that starts with a comma adds its own steps to the chain."""
    order: list[str] = []
    for name in names:
        order += [v for v in _needs(name) if v not in order]
    plain = {n: n for n in (*TABLES, *VIEWS)}
    parts = [f"{n} as materialized ({VIEWS[n].format(**plain)})" for n in order]
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body
