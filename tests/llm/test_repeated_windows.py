import random

import pytest
from pyspark.sql import functions as F

from locusmill.llm import repeated_windows as rw

from .oracle import check


def brute(docs, size):
    place, out = {}, []
    cut = [(d, (t or "").encode().split()) for d, t in docs]
    rank = lambda d, p: (d is not None, d or 0, p)
    for d, w in cut:
        for p in range(len(w) - size + 1):
            key = tuple(w[p:p + size])
            place[key] = min(place.get(key, rank(d, p)), rank(d, p))
    for d, w in cut:
        gone = set()
        for p in range(len(w) - size + 1):
            if place[tuple(w[p:p + size])] < rank(d, p):
                gone |= set(range(p, p + size))
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def rows(df, size):
    got = rw.dedup(df, size=size).withColumn("n", F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]))
    return sorted([(r.doc_id, r.n_words, r.n, r.kept) for r in got.collect()], key=str)


SCHEMA = "doc_id long, text string, low string, range int, kept string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA)


@pytest.mark.parametrize("size", [6, 20])
def test_brute(spark, size):
    rnd = random.Random(size)
    some = lambda n, k=9: " ".join(rnd.choice("abcdefghijklmnop"[:k]) for _ in range(n))
    passages = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(size, 60))) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        parts.insert(1, rnd.choice([*passages, ""]))
        docs.append((i, rnd.choice([" ", "\n", "\t \x0b"]).join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(0, 60, 3)]
    docs += [(300, None), (301, ""), (302, "Ünïcode   " * 30), (None, passages[0]), (5, passages[1] + " z"), docs[7], docs[7]]
    docs += [(303, some(400, 2)), (304, "x " * 300), (305, "x y " * 40), (306, some(3000, 3))]
    assert rows(frame(spark, docs), size) == brute(docs, size)


def test_long_text_is_read_in_parts(spark, monkeypatch):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    hashes = rw.word_hashes(" ".join(words).encode())
    assert hashes.shape == (2, 3000)
    monkeypatch.setattr(rw, "_WORDS", 64)
    parts = [(o, p.shape[1]) for o, p in rw._parts(hashes, 20)]
    starts = [s for o, n in parts for s in range(o, o + n - 19)]
    assert starts == list(range(3000 - 19))
    monkeypatch.setattr(rw, "_BYTES", 100)
    assert (rw.word_hashes(" ".join(words).encode()) == hashes).all()


def test_very_long_text(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(300_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[rw._WORDS - 30:rw._WORDS + 30])), (0, "q " + " ".join(words[290_000:]))]
    assert rows(frame(spark, docs), 20) == brute(docs, 20)


def test_stretches_cover_every_window_once():
    rnd = random.Random(4)
    words = rw.word_hashes(" ".join(rnd.choice("abc") for _ in range(500)).encode())
    low, high, *_ = rw.stretches(words, 20)
    assert [p for a, b in zip(low, high) for p in range(a, b + 1)] == list(range(481))


def test_many_copies_of_one_passage(spark):
    rnd = random.Random(5)
    line = " ".join(f"c{k}" for k in range(25))
    docs = [(i, f"w{rnd.random()} w{rnd.random()} {line} v{rnd.random()} " + " ".join(f"u{rnd.random()}" for _ in range(20))) for i in range(1500)]
    docs += [(2000 + i, "same text " * 30) for i in range(1500)]
    df = frame(spark, docs).repartition(4)
    assert rows(df, 20) == brute(docs, 20)


def test_empty_table(spark):
    assert rows(frame(spark, []), 20) == []


def test_sql(spark):
    check(spark, "op13_repeated_windows")
