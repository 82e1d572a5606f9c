import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from locusmill.llm import bpe
from locusmill.llm.queries import RANKS, bpe_digests

PATH = public_tokenizers.path(RANKS)
with open(PATH, "rb") as f:
    TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
ENCODER = bpe.Encoder(TABLE, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert ENCODER.encode(text) == OWN.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(" \n\tab'1\u00a0\u3000\x1c.", max_size=14))
def test_spaces(text):
    assert ENCODER.encode(text) == OWN.encode_ordinary(text)


@pytest.mark.parametrize("text", [
    "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, "Straße 123  ende\t", "<|endoftext|>", "é́" * 50, "\x1c\x1d x\x85y​  z",
    "zxqj" * 700, "١٢٣ ½ 中文字 " * 30, "it's we'll I'D", " " * 2000 + "x",
])
def test_cases(text):
    assert ENCODER.encode(text) == OWN.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "héllo  wörld " * 400, None), (None, "tie", "y"), (3, "tie", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = OWN.encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    assert bpe_digests(df.where("false")).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe_digests(docs).collect()}
    for r in docs.collect():
        ids = OWN.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_ids_beside_their_digests(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = ["one two three four five two one " * 5, None, "", "Ünï 中文 \n x", "a" * 300]
    checker = bpe.Checker(TABLE, public_tokenizers.PATTERN)
    for some in (texts, texts[:1], texts[3:], [], texts):
        want = [OWN.encode_ordinary(t or "") for t in some]
        assert checker.check([t or "" for t in some]) == [(",".join(map(str, ids)), (t or "").encode()) for ids, t in zip(want, some)]
    rows = [(k, t, "x", 5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = bpe.encode_checked(df, PATH, public_tokenizers.PATTERN, keep=("doc_id", "n_tokens"), ids="ids")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in got.collect():
        assert list(r["ids"]) == OWN.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r["ids"])


CHECKER = bpe.Checker(TABLE, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=6))
def test_many_texts_at_once(texts):
    want = [OWN.encode_ordinary(t) for t in texts]
    assert CHECKER.check(texts) == [(",".join(map(str, ids)), t.encode()) for ids, t in zip(want, texts)]


def test_pieces_in_step_are_pieces_alone():
    rnd = random.Random(1)
    for width in (2, 3, 7, 8, 9, 31, 64):
        some = [bytes(rnd.choice(b"aeinrst \xc3\xa9") for _ in range(rnd.randint(max(2, width // 2 + 1), width))) for _ in range(300)]
        some = [p for p in some if p not in TABLE]
        if some:
            assert bpe.merge_pieces(some, CHECKER.pairs) == [bpe.merge_piece(p, TABLE) for p in some]


def test_pair_ranks_are_seldom_searched(monkeypatch):
    rnd, searched = random.Random(2), []
    texts = [" ".join("".join(rnd.choice("aeinrsthßé") for _ in range(rnd.randint(5, 14))) for _ in range(200)) for _ in range(20)]
    checker, search = bpe.Checker(TABLE, public_tokenizers.PATTERN), bpe.np.searchsorted
    monkeypatch.setattr(bpe.np, "searchsorted", lambda a, v, *x, **y: searched.append(bpe.np.size(v)) or search(a, v, *x, **y))
    want = [OWN.encode_ordinary(t) for t in texts]
    assert checker.check(texts) == [(",".join(map(str, ids)), t.encode()) for ids, t in zip(want, texts)]
    assert 0 < sum(searched) < sum(map(len, texts)) / 10


def test_ranks_of_all_pairs_and_of_none():
    pairs, some = CHECKER.pairs, random.Random(3).sample(sorted(TABLE), 3000)
    both = [(TABLE[t[:k]], TABLE[t[k:]], TABLE[t]) for t in some for k in range(1, len(t)) if t[:k] in TABLE and t[k:] in TABLE]
    left, right, made = (bpe.np.array(x) for x in zip(*both))
    assert pairs.ranks(left, right).tolist() == made.tolist()
    for other in (-1, -2):
        assert (pairs.ranks(left, bpe.np.full(len(left), other)) == pairs.absent).all()
        assert (pairs.ranks(bpe.np.full(len(left), other), right) == pairs.absent).all()


def test_ranks_beyond_32_bits_of_leaves():
    wide = bpe.Checker({t: r << 12 for t, r in TABLE.items()}, public_tokenizers.PATTERN)
    text = "unbelievably straßenbahnhaltestellen, xqzjv" + "ab" * 29
    ids, back = wide.check([text])[0]
    assert [int(i) >> 12 for i in ids.split(",")] == OWN.encode_ordinary(text) and back == text.encode()


def test_texts_in_many_arrays(monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 3)
    monkeypatch.setattr(bpe, "IN_STEP", 64)
    texts = ["", "unbelievably straße xqzjv", "a", "xqzjv aqzjv bqzjv cqzjv " * 9, "", "Straße 中文zz"]
    want = [OWN.encode_ordinary(t) for t in texts]
    checker = bpe.Checker(TABLE, public_tokenizers.PATTERN)
    assert checker.check(texts) == [(",".join(map(str, ids)), t.encode()) for ids, t in zip(want, texts)]
    assert checker.check(["", ""]) == [("", b""), ("", b"")]


@pytest.mark.parametrize("text", ["\U0003d05c\ub000", "a\u0558b 1\U00011de0", " \U000323b0\u4e2d ''\ua7f1x", "\uffff\U0003d000 \u2019s"])
def test_characters_newer_than_tiktoken(text):
    ids = OWN.encode_ordinary(text)
    assert ENCODER.encode(text) == ids
    assert CHECKER.check([text]) == [(",".join(map(str, ids)), text.encode())]


def test_every_character_has_the_class_of_tiktoken():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bare = {bytes([b]): b for b in range(256)}
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        own, found = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=bare, special_tokens={}), bpe.finder(pattern)
        for start in range(0, len(every), 10_000):
            text = "".join(every[start:start + 10_000])
            assert "".join(found(text)).encode() == bytes(own.encode_ordinary(text))
