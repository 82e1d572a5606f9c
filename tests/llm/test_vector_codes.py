import math
import random

import numpy as np
import pytest

from locusmill.llm import vector_codes as vc

from .oracle import check

SCHEMA = "vec_id long, embedding array<double>, label int, row string, part int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), l) for i, v, l in kept]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[assign(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, chosen) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, v, l in kept:
        best = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), l))
    total = {}
    for _, _, e, l in out:
        total[l] = total.get(l, 0) + e
    return sorted([(i, c, e, total[l]) for i, c, e, l in out], key=str), books


def rows(spark, data, **kw):
    df = spark.createDataFrame([(i, v, l, "x", 7) for i, v, l in data], SCHEMA)
    coded, books = vc.compress(df, **kw)
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()], key=str), books.tolist()


@pytest.mark.parametrize("parts,entries,rounds", [(4, 5, 2), (16, 64, 2), (9, 3, 4), (4, 5, 0)])
def test_brute(spark, parts, entries, rounds):
    rnd = random.Random(parts)
    data = [(i, [rnd.gauss(0, 1) for _ in range(18)], rnd.choice([0, 1, None])) for i in rnd.sample(range(-50, 400), 130)]
    data += [(900 + i, data[3][1], 5) for i in range(60)]
    data += [(500, None, 1), (501, [1.0, None] * 9, 1), (502, [float("nan")] * 18, 1), (503, [float("inf")] * 18, None), (504, [], None)]
    data += [(505, [0.5] * 7, 2), (None, [1.0] * 18, 3), data[0], (data[1][0], [-0.001] * 18, 3)]
    assert rows(spark, data, parts=parts, entries=entries, rounds=rounds) == brute(data, parts, entries, rounds)


def test_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(vc, "OWNED", 16)
    rnd = random.Random(3)
    data = [(i, [0.25] * 16 if i % 3 == 0 else [rnd.random() for _ in range(16)], i % 3) for i in range(300)]
    assert rows(spark, data, parts=4, entries=8) == brute(data, 4, 8, 2)


def test_no_vectors(spark):
    assert rows(spark, []) == ([], [[]] * 16)
    assert rows(spark, [(1, None, 2)])[0] == []
    assert rows(spark, [(1, [], 2)])[0] == [(1, "00" * 16, 0, 0)]


def test_large_components(spark):
    got, books = rows(spark, [(1, [1e30, -1e30, 65536.0, 3.0], 1), (2, [1.0] * 4, 1)], parts=2, entries=1, rounds=0)
    assert books == [[[vc.LIMIT, -vc.LIMIT]], [[vc.LIMIT, 768]]]
    assert got[0] == (1, "0000", 0, got[1][2]) and got[1][2] == (vc.LIMIT - 256) ** 2 * 2 + (vc.LIMIT + 256) ** 2 + 512 ** 2


def test_nearest_is_exact_beyond_doubles():
    points = np.array([[vc.LIMIT] * 64, [-vc.LIMIT] * 64])
    book = np.array([[vc.LIMIT - 1] * 64, [-vc.LIMIT] * 64])
    assert [x.tolist() for x in vc.nearest(points, book)] == [[0, 1], [64, 0]]


def test_sql(spark):
    check(spark, "op11_vector_codes")
