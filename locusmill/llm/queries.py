"""The registered queries of this folder, beside SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversation_repair, decontaminate, html_blocks, minhash, pii, repeated_windows, reputation, search, sharding, substrings, toxicity, vector_codes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.encode_checked(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


# The rules of the URL filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; a page's outcome is the quality label that has its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.join(labels, "page_id").select("url", "good")
    return reputation.judge(pages, outcomes, URL_RULES).drop("bound")


SQL["op2_url_reputation"] = """
WITH p AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (
    SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS good
    FROM u LEFT JOIN labels ON labels.doc_id = u.page_id GROUP BY host),
l AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM c),
k AS (SELECT *, string_split(name, '.') AS part FROM l),
w AS (
    SELECT *, CASE WHEN len(part) < 2 OR regexp_full_match(name, '[0-9.]+') THEN 0
        WHEN len(part) > 2 AND length(part[-1]) = 2 AND part[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2
        ELSE 1 END AS wide FROM k),
h AS (
    SELECT host, n, good, CASE WHEN wide = 0 THEN name ELSE array_to_string(part[-(wide + 1):], '.') END AS domain,
        CASE WHEN wide = 0 THEN name ELSE array_to_string(part[-wide:], '.') END AS suffix FROM w),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
g AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM s),
sr AS (
    SELECT 1 / least(0.5, greatest(1.0 / 1001, coalesce(sum((good - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS k
    FROM s, g),
sm AS (SELECT suffix, (k * m + good) / (k + n) AS m FROM s, g, sr),
dr AS (
    SELECT 1 / least(0.5, greatest(1.0 / 1001, coalesce(sum((good - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS k
    FROM d JOIN sm USING (suffix)),
dm AS (SELECT domain, suffix, (k * m + good) / (k + n) AS m FROM d JOIN sm USING (suffix), dr),
hr AS (
    SELECT 1 / least(0.5, greatest(1.0 / 1001, coalesce(sum((good - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS k
    FROM h JOIN dm USING (domain, suffix)),
hm AS (SELECT host, (k * m + good) / (k + n) AS m, k + n AS held FROM h JOIN dm USING (domain, suffix), hr),
hb AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (held + 1)) AS bound FROM hm),
r AS (
    SELECT u.*, bound, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM u JOIN hb USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM r
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of 13 benchmark words."""
    return hit_digests(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def hit_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS words
    FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
    SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS words
    FROM (SELECT * FROM d, sizes), unnest(range(1, len(w) - size + 2)) AS t(p)),
m AS (SELECT rid, size, p, item_id FROM dw JOIN iw USING (size, words)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + size)) AS t(q) GROUP BY rid),
its AS (
    SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
    FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


@query
def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxic_columns(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))))


def toxic_columns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a set similarity of 0.75."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "leads")


@query
def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, as counts and span lists."""
    return span_columns(pii.find(table(spark, sf_dir, "documents")))


def span_columns(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts)]
    counts.append((F.size("spans") - F.size("base")).cast("long").alias("n_context"))
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query
def op4_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents with equal counts, equal texts together where the counts allow."""
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op7_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that are in a string of 200 bytes found elsewhere too."""
    return removed_columns(substrings.dedup(table(spark, sf_dir, "documents")))


def removed_columns(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op8_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, its whole text being the query."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


SQL["op5_block_max_search"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n),
q AS (SELECT rid AS qid, doc_id AS query_id, term FROM d JOIN tf USING (rid) WHERE doc_id % 100 = 0),
s AS (
    SELECT qid, query_id, tf.rid, CAST(sum(round(1000 * idf * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN d ON d.rid = tf.rid, n GROUP BY qid, query_id, tf.rid),
r AS (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (rid) WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in windows of 20 words that start earlier too."""
    return kept_columns(repeated_windows.dedup(table(spark, sf_dir, "documents")))


def kept_columns(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_repeated_windows"] = """
WITH d AS (
    SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (
    SELECT rid, p, rank() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id NULLS FIRST, p) AS nth
    FROM d, unnest(range(1, len(w) - 18)) AS t(p)),
gone AS (SELECT DISTINCT rid, p + k AS p FROM x, unnest(range(20)) AS t(k) WHERE nth > 1),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
    SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
    FROM words WHERE (rid, p) NOT IN (SELECT (rid, p) FROM gone) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 16 parts, 64 entries, two rounds."""
    return code_columns(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def code_columns(coded: DataFrame, books: vector_codes.Books) -> DataFrame:
    digest = F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


def _nearest_sql(books: str) -> str:
    return f"""
    SELECT rid, pos, part, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
        SELECT p.rid, p.pos, p.part, b.e, coalesce(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.part, b.part)]), 0)::BIGINT AS d
        FROM p JOIN {books} AS b USING (pos)) GROUP BY ALL"""


def _means_sql(assigned: str, books: str) -> str:
    return f"""
    SELECT b.pos, b.e, coalesce(m.part, b.part) AS part FROM {books} AS b LEFT JOIN (
        SELECT pos, e, list(x ORDER BY k) AS part FROM (
            SELECT pos, e, k, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
            FROM (SELECT pos, e, unnest(part) AS x, generate_subscripts(part, 1) AS k FROM {assigned}) GROUP BY ALL)
        GROUP BY ALL) AS m USING (pos, e)"""


SQL["op11_vector_codes"] = f"""
WITH v AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT rid, pos, v[pos * (len(v) // 16) + 1:(pos + 1) * (len(v) // 16)] AS part FROM v, unnest(range(16)) AS t(pos)),
b0 AS (SELECT pos, rid - 1 AS e, part FROM p WHERE rid <= 64),
a0 AS ({_nearest_sql("b0")}),
b1 AS ({_means_sql("a0", "b0")}),
a1 AS ({_nearest_sql("b1")}),
b2 AS ({_means_sql("a1", "b1")}),
a2 AS ({_nearest_sql("b2")}),
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, e, k)) AS codebooks_sha256
    FROM (SELECT pos, e, unnest(part) AS x, generate_subscripts(part, 1) AS k FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN c USING (rid), h
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.Repair(conversation_repair.damaged(rows), rows).digests()


def _more(value: str, cost: str, edit: str) -> str:
    return f"lpad(CAST(CAST(left({value}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{edit}'"


# A state's cheapest (cost, audit) is one string, cost first; least() leaves out states not reached yet.
_TO_USER = ", ".join(_more(f"z.{q}", "5", "I") for q in "nsa")
_INSERTED = f"{{'n': z.n, 's': z.s, 'u': least(z.u, {_TO_USER}), 'a': least(z.a, {_more(f'least(z.u, {_TO_USER})', '5', 'I')})}}"


def _taken(state: str, sources: str, initial: str) -> str:
    ways = [_more(f"z.{state}", "2", "D")]
    for q in sources:
        ways.append(f"CASE WHEN NOT r.must AND r.initial = '{initial}' THEN {_more(f'z.{q}', 'r.more', 'K')} END")
        if state in "ua":
            ways.append(f"CASE WHEN NOT r.must THEN {_more(f'z.{q}', '1 + r.more', 'R')} END")
    return f"least({', '.join(ways)}, NULL)"


_CONSUMED = f"{{'n': {_taken('n', '', '')}, 's': {_taken('s', 'n', 's')}, 'u': {_taken('u', 'nsa', 'u')}, 'a': {_taken('a', 'u', 'a')}}}"

SQL["op12_conversation_repair"] = f"""
WITH k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations),
h AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda crc, b: list_reduce(
        [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS harm
    FROM k),
d AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE harm <> 0),
n AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM n),
f AS (
    SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
        bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM o),
g AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        list_reduce(flatten(list([
            {{'row': false, 'initial': '', 'must': true, 'more': 0}},
            {{'row': true, 'initial': initial, 'must': blank OR duplicate, 'more': CASE WHEN truncated THEN 5 ELSE 0 END}}
        ] ORDER BY pos)) || [{{'row': false, 'initial': '', 'must': true, 'more': 0}}],
            lambda z, r: CASE WHEN r.row THEN {_CONSUMED} ELSE {_INSERTED} END,
            {{'n': '000000000', 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR}}) AS ends
    FROM f GROUP BY conv_id),
c AS (SELECT * EXCLUDE (ends), least(ends.n, ends.a) AS goal, substr(goal, 10) AS audit FROM g),
e AS (
    SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS pos,
        length(replace(left(audit, p), 'D', '')) AS place FROM c, unnest(range(1, length(audit) + 1)) AS t(p)),
r AS (
    SELECT e.conv_id, p, place, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role,
        max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
    FROM e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.pos = f.pos),
m AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - 1 - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY p) AS rows FROM r WHERE edit <> 'D' GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(goal, 9) AS BIGINT), 0) AS cost,
    coalesce(audit, '') AS audit, sha256(coalesce(rows, '')) AS repaired_sha256
FROM ids LEFT JOIN c ON ids.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN m ON ids.conv_id IS NOT DISTINCT FROM m.conv_id
"""
