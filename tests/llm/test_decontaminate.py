import random
import re

import pytest

from locusmill.llm import decontaminate as dc

from .oracle import check

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(text)


def brute(docs, items, n=13):
    out = []
    windows = []
    for item, text in items:
        w = plain(text)
        size = min(n, len(w))
        windows += [(item, w[p:p + size]) for p in range(len(w) - size + 1) if size]
    for doc, text in docs:
        w, hit, names = plain(text), set(), set()
        for item, window in windows:
            for p in range(len(w) - len(window) + 1):
                if w[p:p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    names.add(item)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [2_000_000, 40])
def test_brute(spark, block_chars):
    rnd = random.Random(3)
    some = lambda k: " ".join(rnd.choice(["Ab", "b", "É", "d9", "e"]) for _ in range(k))
    items = [(i, some(rnd.choice([1, 3, 5, 9]))) for i in range(8)] + [(9, None), (10, ""), (None, "q r s t"), (3, "b b e")]
    docs = [(i, some(rnd.randint(0, 60)) + rnd.choice(["", "-Q, r.S!T"])) for i in range(60)]
    docs += [(60, None), (61, ""), (None, some(30)), (5, some(30)), (62, "x " * 5000 + items[0][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in dc.scan(d, b, n=5, block_chars=block_chars).collect()]
    assert sorted(got, key=str) == brute(docs, items, 5)
    assert dc.scan(d.where("false"), b).count() == 0
    assert {r.n_hit for r in dc.scan(d, b.where("false")).collect()} == {0}


def test_spans_are_cut(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"Début. ({passage.upper()}) fin"), (2, "clean text"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = dc.scan(d, b, keep=("doc_id", "text"))
    got = {r.doc_id: r.t for r in found.select("doc_id", dc.without_spans("text", "spans").alias("t")).collect()}
    assert got == {1: "Début. () fin", 2: "clean text", 3: None}


def test_sql(spark):
    check(spark, "op10_decontaminate")
