import glob
import hashlib
import random
from collections import Counter

import numpy as np

from locusmill.llm import substrings as sub
from locusmill.llm.queries import removed_columns


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (gone[0] if len(x) else 0))
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    got = {r.doc_id: r for r in removed_columns(sub.dedup(df)).collect()}
    return [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))]


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé ", k=rnd.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rnd.choice([20, 33, 40, 80])) for _ in range(5)]
    texts = []
    for i in range(60):
        parts = [prose(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 20)
            parts += [s[a:len(s) - rnd.randint(0, 20)], prose(rnd.randint(0, 30))]
        texts.append("".join(parts))
    for t in texts[:12]:
        w = t.split(" ")
        for _ in range(len(w) // 40):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    exact = prose(40)[:200].ljust(200, "q")
    texts += [texts[0], None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 900, exact, "p" + exact + "r", prose(50)[:199], "ab" * 300]
    texts += [texts[1]] * 5
    return texts


def test_brute(spark, monkeypatch):
    for seed in (1, 2):
        texts = made(seed)
        assert result(spark, texts) == brute(texts)


def test_blocks_do_not_matter():
    texts = [(t or "").encode() for t in made(3)]
    rnd = np.random.default_rng(1)
    long = bytes(rnd.integers(97, 123, 1_300_000, dtype=np.uint8))
    parts = sub._parts([long, *texts])
    assert sum(max(0, len(p[2]) - sub.SIZE + 1) for p in parts) == sum(max(0, len(x) - sub.SIZE + 1) for x in [long, *texts])
    one = {}
    for block in ([p] for p in parts):
        data, starts, ends = sub._joined(block)
        low, high, gram, stretch = sub.anchors(data, ends)
        assert (high - low).sum() + len(low) == len(data) - sub.SIZE + 1
        one[block[0][0], block[0][1]] = list(zip(low, high, gram, stretch))
    for block in sub._blocks(parts):
        data, starts, ends = sub._joined(block)
        low, high, gram, stretch = sub.anchors(data, ends)
        which = np.searchsorted(starts, low, side="right") - 1
        for k, p in enumerate(block):
            mine = which == k
            assert list(zip(low[mine] - starts[k], high[mine] - starts[k], gram[mine], stretch[mine])) == one[p[0], p[1]]


def test_ids(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(150)) * 3
    rows = [(None, text), (4, text), (4, text), (4, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in removed_columns(sub.dedup(df)).collect())
    assert out == sorted([("None", 450, 450), ("4", 450, 450), ("4", 450, 450), ("4", 5, 0), ("None", 0, 0)])
    assert sub.dedup(df.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in removed_columns(sub.dedup(docs)).collect()}
    want = brute([r.text for r in rows])
    assert [(got[r.doc_id].n_bytes, got[r.doc_id].n_removed, got[r.doc_id].n_spans, got[r.doc_id].kept_sha256) for r in rows] == want
    assert sum(w[1] for w in want) > 0


def test_common_passage(spark, monkeypatch):
    """Anchors of a passage known from the sample are found in one pass, and no join makes more rows of them."""
    rnd = random.Random(5)
    passage = "".join(rnd.choices("abcdefgh ", k=420))
    texts = [f"{i} {rnd.random()}" + passage[:300 + i % 120] + f"{rnd.random()} {i}" for i in range(1800)] + made(6)
    assert result(spark, texts) == brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = sub._shared_anchors(sub._keyed(df, "text", "doc_id"))
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join Inner" not in plan
    rows = shared.collect()
    done = {r[:4] for r in rows if r.done}
    assert done & {r[:4] for r in rows if r.first and not r.done}


def test_shuffles_go(spark):
    """What a settled step shuffled is off the disks when it ends, and the session's setting is as before."""
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*"))
    before, old = files(), spark.conf.get(sub._CLEANUP, "false")
    df = spark.range(10_000).selectExpr("id % 977 as k").groupBy("k").count()
    out = sub._settled(df)
    assert not files() - before and spark.conf.get(sub._CLEANUP, "false") == old
    assert out.count() == df.count() == 977
