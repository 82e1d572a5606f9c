import random
import zlib
from collections import Counter, defaultdict

import pytest

from locusmill.llm import sharding
from locusmill.llm.queries import op4_label_shards


def lawful(rows, texts, shards):
    """Counts, slots, sizes and checksums; texts: doc_id -> text."""
    n = Counter(r.shard for r in rows)
    assert sum(n.values()) == len(texts) and set(n) <= set(range(shards))
    counts = [n.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 400])
def test_laws(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 50)
    rnd = random.Random(n)
    texts = {i: rnd.choice([None, "", "é" * 9, f"t{rnd.randrange(40)}", f"u{i}", f"v{i}"]) for i in range(n)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, rid int")
    lawful(sharding.assign(df).collect(), texts, 16)


def test_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 300)
    monkeypatch.setattr(sharding, "HUB", 8)
    texts = {i: f"pair{i // 3}" if i < 900 else "hot" if i < 1900 else f"u{i}" for i in range(4000)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    rows = sharding.assign(df).collect()
    lawful(rows, texts, 16)
    at = {r.doc_id: r.shard for r in rows}
    cut = sum(len({at[3 * g + k] for k in range(3)}) - 1 for g in range(300))
    assert cut < 0.5 * 300 * 2 * 15 / 16


def test_hot_group_has_bounded_stars(spark):
    rows = sharding.numbered(spark.range(3000).selectExpr("id as doc_id", "if(id < 2500, 'hot', null) as text"))
    links = sharding.group_links(rows).collect()
    degree = Counter(x for r in links for x in (r.a, r.b))
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for r in links:
        up[root(r.a)] = root(r.b)
    assert len({root(x) for x in degree}) == 1 and len(degree) == 2500
    assert max(degree.values()) < 4 * sharding.HUB and len(links) < 2 * 2500


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = op4_label_shards(spark, "/root/testdata/sf0.001").collect()
    lawful(rows, {r.doc_id: r.text for r in docs.collect()}, 16)


@pytest.mark.parametrize("sizes", [[2] * 400, [2] * 150 + [5] * 60 + [20] * 10 + [1] * 150])
def test_groups_that_fit_are_whole(spark, monkeypatch, sizes):
    """In the first case no row is free: groups must give way to each other."""
    monkeypatch.setattr(sharding, "BLOCK", 50)
    texts = dict(enumerate(f"t{g}" for g, n in enumerate(sizes) for _ in range(n)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.assign(df).collect()
    lawful(rows, texts, 16)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert max(len(s) for s in shards.values()) == 1


def test_large_groups_are_packed(spark):
    """Halves of a shard before, between and after a group of more than two shards; none of them may be split."""
    sizes = [50] * 6 + [230] + [49] * 12 + [7] * 8 + [1] * 626
    texts = dict(enumerate(f"t{g}" for g, n in enumerate(sizes) for _ in range(n)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.assign(df).collect()
    lawful(rows, texts, 16)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(shards[f"t{g}"]) == 1 for g, n in enumerate(sizes) if n != 230) and len(shards["t6"]) == 3


def test_groups_without_room_are_in_few_shards(spark):
    """23 groups of 50 into 16 shards of 75: one fits into each, the others must share what is left."""
    texts = {i: f"t{i // 50}" if i < 1150 else f"u{i}" for i in range(1200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = sharding.assign(df).collect()
    lawful(rows, texts, 16)
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    parts = Counter(len(shards[f"t{g}"]) for g in range(23))
    assert parts[1] == 16 and max(parts) <= 3
