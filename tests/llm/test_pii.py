import hashlib
import random
import re

from locusmill.llm import pii
from locusmill.llm.queries import span_columns

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [
        (k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if holds(k, m[0])
    ]


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid string")
    return df, {r.doc_id: r for r in pii.find(df).collect()}


def test_random_texts(spark):
    rnd = random.Random(2)
    parts = ["a", "b_", ".", "..", "@", "+", "-", " ", "12", "255", "256", "007", "\U0001F600", "é", "x@y.z", "1.2.3.4", "+1 (23) 456-7890",
             "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "9", "\n", "%"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "a" * 100_000, "1" * 100_000, "1." * 30_000, "a.b@" * 20_000,
              "+" + "1 " * 40_000, "x@y." + "a." * 30_000, "4111 1111 1111 1111 " * 900]
    _, got = rows_of(spark, texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute(t), t[:80] if t else t
        assert [tuple(s) for s in got[i].spans][:len(got[i].base)] == [tuple(s) for s in got[i].base]


def test_contexts_find_new_identifiers(spark):
    texts = [f"Please call phone: +1 (555) 010-{1000 + i} today" for i in range(30)]
    texts += ["Please call phone: 555-0199-22 now", "The part number 555-0177-23 is gone"]
    texts += [f"The part number {i}77-0100-1{i} is gone" for i in range(10, 30)]
    _, got = rows_of(spark, texts)
    assert [tuple(s) for s in got[30].spans] == [("context", 19, 30)]
    assert not got[31].spans and not got[40].spans


def test_masked(spark):
    texts = ["é a@b.cd, 1.2.3.4!", "no", None, "+1.2.3.4 5555"]
    df, _ = rows_of(spark, texts)
    found = pii.find(df, keep=("doc_id", "text"))
    got = {r.doc_id: r.t for r in found.select("doc_id", pii.masked("text", "spans").alias("t")).collect()}
    assert got == {0: "é [email], [ip]!", 1: "no", 2: None, 3: "[phone]"}


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in span_columns(pii.find(docs)).collect()}
    total = 0
    for r in docs.collect():
        want = brute(r.text)
        total += len(want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
    assert total > 10
    assert pii.find(docs.where("false")).count() == 0


def brute_scores(edges, rounds, support, least):
    """edges: (pattern, value, kind or None, open). Scores of open values by the definition, one value at a time."""
    values = {}
    for p, v, _, _ in edges:
        values.setdefault(p, set()).add(v)
    kinds = {(p, v, k): 1.0 for p, v, k, _ in edges if k}
    score = {}
    for _ in range(rounds):
        known = dict(kinds)
        for p, v, k, is_open in edges:
            if is_open and not k:
                known |= {(p, v, kind): s for (w, kind), s in score.items() if w == v}
        fresh = {}
        for p, v, _, is_open in edges:
            for kind in {k for q, _, k in known if q == p} if is_open else ():
                others = [s for (q, w, k), s in known.items() if (q, k) == (p, kind) and w != v]
                if len(others) >= support:
                    got = sum(others) / (len(values[p]) - 1)
                    if got >= least:
                        fresh[v, kind] = max(got, fresh.get((v, kind), 0))
        score = fresh
    out = {}
    for (v, _), s in score.items():
        out[v] = max(s, out.get(v, 0))
    return out


def test_scores_against_brute_force(spark):
    rnd = random.Random(5)
    hexed = lambda n: "".join(rnd.choices("0123456789abcdef", k=n - 2)) + "a1"
    texts = []
    for i in range(160):
        lead = rnd.choice(["token is", "call", "mail to", "part number", "login", "the"])
        value = rnd.choice([hexed(40), f"u{i}@x.org", f"AB-{rnd.randint(1000, 1040)}", f"+49 30 {10000 + i}", f"id{rnd.randint(100000, 100030)}"])
        texts.append(f"Some {rnd.choice(['old', 'new'])} {lead} {value} {rnd.choice(['now', 'then', 'or'])} {rnd.choice(['', value])}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.extract(df)
    seeds = [(r.pattern, r.value, r.kind, False) for r in pii._contexts(rows, "seeds").collect()]
    others = [(r.pattern, r.value, "key" if re.search(pii.KEY, r.value) else None, True) for r in pii._contexts(rows, "candidates").collect()]
    some = 0
    for support, least in ((1, 0.3), (2, 0.5), (4, 0.6)):
        got = {r.value: round(r.score, 9) for r in pii.bootstrap(rows, 3, support, least).collect()}
        assert got == {v: round(s, 9) for v, s in brute_scores(seeds + others, 3, support, least).items()}
        some += len(got)
    assert some


def test_contexts_of_keys_find_other_forms(spark):
    rnd = random.Random(3)
    hexed = lambda n: "".join(rnd.choices("0123456789abcdef", k=n - 2)) + "a1"
    texts = [f'And so secret = "{hexed(40)}" it went' for _ in range(12)]
    long = "Zq9" * 100
    texts += ['Or secret = "pw-77-xy" it was', f'a secret = "{long}" it', f"commit {hexed(40)} alone", 'ids: "12-3456 78-9012" no']
    _, got = rows_of(spark, texts)
    assert all(len(got[i].spans) == 1 for i in range(14)), [got[i].spans for i in range(14)]
    assert tuple(got[12].spans[0]) == ("context", 13, 21) and got[13].spans[0].end - got[13].spans[0].start == 300
    assert not got[14].spans and not got[15].spans


def test_many_matches_in_one_text(spark):
    """Places, and tokens beside base spans, of a text with many thousand of both."""
    parts = [x for i in range(20_000) for x in (f"u{i}@m.org", f"id-{i:06d}")]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.extract(df).collect()[0]
    for spans in (row.seeds, row.candidates):
        assert len(spans) == 20_000
        assert all(text[s.start:s.end] == s.value for s in spans)
