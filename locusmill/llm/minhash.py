"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles becomes a signature of SYMBOLS b-bit minima. Two signatures within RADIUS wrong symbols
agree, by pigeonhole, in one of CHUNKS chunks but for ERRORS symbols at most. So each signature is filed under every
choice of ERRORS symbols left out of every chunk, and all pairs within the radius meet in a bucket. A pair of a set
similarity of 0.75 lies within the radius but in about 1 of 10,000 cases, and shares a bucket but in 1 of a million.

Sets, not documents, are filed, so equal texts are one entry. Pairs in a bucket are never all formed: members are held
against the bucket's leader, the member that meets most others; what was linked is one component; and only pairs from
different components are compared after that, found among the nodes of buckets with several components by their rare shingles,
which loses no pair that is alike enough, whatever its signatures' distance; a parity map of each set refutes most of
those that are not. Every link is confirmed on the full sets of 64-bit shingle hashes. A set is known by a 64-bit hash of its own.

Cases: null and empty texts have no set and are linked with nothing; a text of fewer words than a shingle is one
shingle; texts are read whole; rows with equal text are linked at no cost; a null id takes part, is never a component's
id unless all its ids are null, and only then is kept; rows that repeat an id are kept or not together; an empty table gives
no rows; columns other than text and id are left out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..session import staged
from .arrow import map_slices, slices, texts
from .components import components

SYMBOLS, BITS, CHUNKS, ERRORS = 48, 14, 8, 2
WIDTH = SYMBOLS // CHUNKS
#: Wrong symbols within which pigeonhole leaves some chunk with ERRORS at most.
RADIUS = CHUNKS * (ERRORS + 1) - 1

#: Longs of a set's parity map.
MARKS = 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240501)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_BLOCK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, _BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word; words are cut by ASCII white space, A-Z lower-cased."""
    text = text.translate(_LOWER)
    out, start = [], 0
    while start < len(text):
        stop = min(len(text), start + _BLOCK)
        while stop < len(text) and not _GAP[text[stop]]:
            stop += 1
        out.append(_block_hashes(np.frombuffer(text, np.uint8, stop - start, start)))
        start = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(block: np.ndarray) -> np.ndarray:
    word = np.concatenate(([False], ~_GAP[block], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, after = edge[::2], edge[1::2]
    n = len(block)
    up, down = (_UP, _DOWN) if n <= _BLOCK else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[block] * up[:n], out=total[1:])
    return mixed((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; the whole sequence where there are fewer words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    total = np.full(n - take + 1, np.uint64(take), np.uint64)
    for k in range(take):
        total += words[k:n - take + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of SYMBOLS numbers of BITS bits, one for each set; none of the sets is empty."""
    out = np.zeros((len(sets), SYMBOLS), np.int32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    for k in range(SYMBOLS):
        low = np.minimum.reduceat(flat * _FACTOR[k] + _SHIFT[k], starts)
        out[:, k] = mixed(low) >> np.uint64(64 - BITS)
    return out


_KEPT = [tuple(c * WIDTH + k for k in kept) for c in range(CHUNKS) for kept in combinations(range(WIDTH), WIDTH - ERRORS)]


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature a key for every chunk and choice of symbols left out: that choice's number, then the symbols."""
    sig = signatures.astype(np.int64)
    keys = np.zeros((len(sig), len(_KEPT)), np.int64)
    for j, places in enumerate(_KEPT):
        key = np.full(len(sig), j, np.int64)
        for p in places:
            key = (key << BITS) | sig[:, p]
        keys[:, j] = key
    return keys


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the set's hash (node) and its signature (null for an empty set)."""
    added = StructType([
        StructField("n_shingles", LongType()), StructField("node", LongType()), StructField("sig", ArrayType(IntegerType())),
    ])

    def run(part: pa.RecordBatch) -> list:
        sets = [shingles(t, size) for t in texts(part, "text")]
        full = [s for s in sets if len(s)]
        made = iter(signature(full))
        nodes = [
            int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None
            for s in sets
        ]
        return [[len(s) for s in sets], nodes, [next(made) if len(s) else None for s in sets]]

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return map_slices(source, run, added, "text", ["doc_id", "text_key"])


def _filed(nodes: DataFrame) -> DataFrame:
    """key and node for every bucket a node is filed in."""
    schema = "key long, node long"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sig = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, SYMBOLS)
                node = part.column(1).to_numpy(zero_copy_only=False)
                keys = bucket_keys(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(node, keys.shape[1]))], names=["key", "node"]
                )

    return nodes.select("sig", "node").mapInArrow(run, schema)


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """Rows of buckets with two members at least.

    Keys that are frequent in a sample of the nodes are known to be shared and skip the count, so that no large bucket
    meets in one task. Their number is bounded: 2000 times a signature's keys.
    """
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0)
    at_least = max(8, some.count() // 2000)
    hot = _filed(some).groupBy("key").count().where(F.col("count") >= at_least).select("key", F.lit(True).alias("hot"))
    filed = _filed(nodes).join(F.broadcast(hot), "key", "left")
    rest = filed.where("hot is null").select("key", "node").selectExpr("key", "node", "count(1) over (partition by key) as n")
    return rest.where("n > 1").select("key", "node").unionByName(filed.where("hot").select("key", "node"))


def _sets(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """node and its sorted shingle hashes, read again from one document of each node."""
    added = StructType([StructField("shingles", ArrayType(LongType()))])

    def run(part: pa.RecordBatch) -> list:
        sets = [shingles(t, size).view(np.int64) for t in texts(part, "text")]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))]

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    wanted = nodes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    found = own.join(wanted, (F.col("text_key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return map_slices(found.select("node", "text"), run, added, "text", ["node"]).dropDuplicates(["node"])


def distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _within(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures lie within the radius."""
    sig = lambda side: nodes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").where(distance("sig_a", "sig_b") <= RADIUS).select("a", "b")


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as asked."""
    own = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"))
    both = near.join(own("a"), "a").join(own("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def _towards_leaders(buckets: DataFrame, order: Column) -> DataFrame:
    """One pair for each node: with the foremost of its buckets' leaders. order: of nodes, over score and node."""
    lead = buckets.groupBy("key").agg(F.max(F.struct(order.alias("order"), F.col("node").alias("b"))).alias("lead"))
    met = buckets.join(lead, "key").where("node != lead.b")
    return met.groupBy("node").agg(F.max("lead").alias("lead")).select(F.col("node").alias("a"), F.col("lead.b").alias("b"))


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """MARKS longs with a bit for each of 64 * MARKS classes of hashes: whether an odd number of the set's are in it.

    A class in which two maps differ holds a hash that one of the sets has alone, so the sets differ in as many hashes at
    least as their maps do in bits.
    """
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(64 * MARKS), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rare_first(sets: DataFrame, percent: int, listed: int = 200_000) -> DataFrame:
    """token, node, comp, pos, size and marks (m0, m1 ...): of each set the shingles of which two sets that are alike enough share one at least.

    In any one order of all shingles, sets that share ``percent`` of a hundred share one of the first n - ceil(percent n /
    100) + 1 of each. The order here puts those first that are rare in a sample; the table of frequent ones is bounded, as
    a shorter one changes what the join costs and not what it finds.
    """
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).select(F.explode("shingles").alias("token"))
    often = some.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(listed)
    rows = sorted((r["token"], r["count"]) for r in often.collect())
    shared = sets.sparkSession.sparkContext.broadcast((np.array([t for t, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)))

    def run(batches):
        tokens, counts = shared.value
        for batch in batches:
            for part in slices([batch], "shingles", 1 << 24):
                node, comp, found = (part.column(part.schema.get_field_index(c)) for c in ("node", "comp", "shingles"))
                out, repeats, sizes, marks = [], [], [], []
                for x in found:
                    own = x.values.to_numpy(zero_copy_only=False)
                    n = len(own) - -(-percent * len(own) // 100) + 1
                    if len(tokens):
                        place = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        own = own[np.lexsort((own, np.where(tokens[place] == own, counts[place], 0)))]
                    else:
                        own = np.sort(own)
                    out.append(own[:n])
                    repeats.append(n)
                    sizes.append(len(own))
                    marks.append(parity_map(own))
                maps = np.array(marks).reshape(-1, MARKS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out)), pa.array(np.repeat(node.to_numpy(zero_copy_only=False), repeats)),
                     pa.array(np.repeat(comp.to_numpy(zero_copy_only=False), repeats)),
                     pa.array(np.concatenate([np.arange(n) for n in repeats])), pa.array(np.repeat(sizes, repeats)),
                     *(pa.array(np.repeat(maps[:, m], repeats)) for m in range(MARKS))],
                    names=["token", "node", "comp", "pos", "size", *(f"m{m}" for m in range(MARKS))],
                )

    schema = "token long, node long, comp long, pos long, size long, " + ", ".join(f"m{m} long" for m in range(MARKS))
    return sets.select("node", "comp", "shingles").mapInArrow(run, schema)


def _several(rows: DataFrame, by: str) -> DataFrame:
    """Rows of the values of ``by`` that have several components, with the largest of these."""
    sizes = rows.groupBy(by, "comp").count()
    mixed_keys = sizes.groupBy(by).agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("n")).where("n > 1")
    return staged(rows.join(mixed_keys.select(by, F.col("top.comp").alias("main")), by))


def _across(buckets: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that may be alike: all that share a bucket are among the nodes of buckets with
    several components, and all that are alike share a rare shingle. The first one they share leaves enough behind it in
    both sets for what they must have in common, so other meetings are left out, and so are pairs inside the largest
    component of those that have the shingle. Sets whose parity maps differ in more bits than they may in shingles are no
    pair."""
    nodes = _several(staged(_with_component(buckets, comps)), "key").select("node", "comp").distinct()
    rows = _several(staged(_rare_first(sets.join(nodes, "node"), percent)), "token")
    marks = [f"m{m}" for m in range(MARKS)]
    minor = rows.where("comp != main").selectExpr(
        "token", "node as x", "comp as x_comp", "pos as x_pos", "size as x_size", *(f"{m} as x_{m}" for m in marks)
    )
    both = F.col("size") + F.col("x_size")
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"x_{m}"))) for m in marks), F.lit(0))
    few = (100 + percent) * apart <= (100 - percent) * both
    behind = F.least(F.col("size") - F.col("pos"), F.col("x_size") - F.col("x_pos"))
    enough = (100 + percent) * behind >= percent * both
    met = minor.join(rows, "token").where(F.expr("comp != x_comp and (comp = main or x < node)") & enough & few)
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def links(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """Confirmed pairs of nodes (a, b) that connect all nodes whose sets are linked."""
    buckets = staged(_shared_buckets(nodes))
    counts = buckets.groupBy("key").agg(F.count("*").alias("n"))
    scores = buckets.join(counts, "key").groupBy("node").agg(F.sum("n").alias("score"))
    met = staged(nodes.join(scores, "node"))
    sets = staged(_sets(docs, met, text, doc_id, size))
    scored = staged(buckets.join(met.select("node", "score"), "node"))
    found = staged(_confirmed(_within(_towards_leaders(scored, F.col("score")), met), sets, percent))
    comps = components(found)
    for seed in (1, 2):
        held = _with_component(scored, comps)
        several = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
        open_rows = staged(held.join(several.select("key"), "key").select("key", "node", "comp"))
        pairs = _towards_leaders(open_rows, F.xxhash64("node", F.lit(seed)))
        apart = _with_component(pairs.withColumnRenamed("a", "node"), comps).select(F.col("node").alias("a"), "b", F.col("comp").alias("ca"))
        apart = _with_component(apart.withColumnRenamed("b", "node"), comps).where("comp != ca").select("a", F.col("node").alias("b"))
        found = staged(found.unionByName(_confirmed(_within(apart, met), sets, percent)))
        comps = components(found)
    return staged(found.unionByName(_confirmed(_across(buckets, comps, sets, percent), sets, percent)))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 75
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept, text_key and leads for every row.

    text_key is a hash of the text. leads is true for the rows of one doc_id and text of every component, an id before null,
    and for rows without a set.
    """
    signed = staged(signatures(docs, text, doc_id, size))
    nodes = staged(
        signed.where("node is not null").groupBy("node")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig"))
    )
    comps = components(links(docs, nodes, text, doc_id, size, percent))
    held = staged(_with_component(nodes.select("node", "rep"), comps))
    ids = held.join(held.groupBy("comp").agg(F.min("rep").alias("lead")), "comp").select("node", "lead")
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(ids, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & F.col("text_key").eqNullSafe(F.col("lead.text_key"))
    return out.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key",
        (F.col("node").isNull() | leads).alias("leads"),
    )
