import base64
import random

import public_tokenizers

import corpus_pipeline as cp
from locusmill.llm.queries import RANKS

from .test_decontaminate import brute as hits
from .test_minhash import brute as groups
from .test_pii import brute as found


def made(spark, folder):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(900)]
    prose = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    items = [(i, prose(rnd.choice([6, 20, 30]))) for i in range(12)]
    rows, labels = [], []
    for i in range(300):
        text = prose(rnd.randint(15, 120))
        kind = rnd.choice(["toxic", "copy", "near", "bench", "little", "pii", "", "", ""])
        if kind == "toxic":
            w = text.split()
            for t in rnd.choices(["grobian", "lump", "wicht"], k=6):
                w.insert(rnd.randrange(len(w)), t)
            text = " ".join(w)
        elif kind == "copy" and rows:
            text = rnd.choice(rows)[1]
        elif kind == "near" and rows:
            text = rnd.choice(rows)[1] + " extra"
        elif kind == "bench":
            text += " " + rnd.choice(items)[1].upper()
        elif kind == "little":
            text = prose(900) + " " + rnd.choice(items)[1]
        elif kind == "pii":
            text += " a.b@c.example é +1 (555) 010-7788 and 10.0.0.1 4111 1111 1111 1111"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int("lump" in text or "wicht" in text or "grobian" in text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict((a, c) for a, _, c in labels), items


def test_stages_against_brute_force(spark, tmp_path):
    rows, toxic, items = made(spark, str(tmp_path))
    left = [(r[0], r[1]) for r in rows if not toxic.get(r[0])]
    comp = {d: c for d, _, c in groups(left)}
    left = [(d, t) for d, t in left if comp[d] == d]
    bad = {d for d, n, hit, _ in hits(left, items) if hit and 20 * hit >= n}
    assert 3 < len(bad) < len(left)
    want = {}
    for d, t in left:
        if d not in bad:
            at, out = 0, ""
            for kind, a, b in sorted(found(t), key=lambda s: s[1]):
                out += t[at:a] + f"[{kind}]"
                at = b
            want[d] = out + (t or "")[at:]
    with open(public_tokenizers.path(RANKS), "rb") as f:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    got = {r.doc_id: b"".join(tokens[k] for k in r.ids).decode() for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_empty_table(spark, tmp_path):
    made(spark, str(tmp_path / "full"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet")).where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path / "full"))
    assert docs.count() == 0


def test_one_document_of_each_group_stays(spark):
    """Rows that repeat id and text, copies without ids, an id with two near texts, and rows without words."""
    a, b, c, d = ("one two three four five six " + " ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (1, a), (1, a), (2, a), (None, b), (None, b), (3, c), (None, c), (4, d), (4, d + " more"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in cp.without_near_copies(spark, docs.repartition(3), "").collect()]
    assert len(left) == 7 and {r for r in left if r[1]} - {(4, d), (4, d + " more")} == {(1, a), (None, b), (3, c)}
    assert sum(i == 4 for i, _ in left) == 1 and left.count((5, "")) == 2 and (6, None) in left


def test_stage_names():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
