import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from locusmill.llm import toxicity as tox
from locusmill.llm.queries import op6_weak_toxicity, toxic_columns


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 7, 123456, -3, None]], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", tox.held_out().alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in got}


def made(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "ein", "und"]) for _ in range(rnd.randint(5, 60))]
        y = int(rnd.random() < 0.3)
        if y:
            words += rnd.choices(["grobian", "lump", "wicht"], k=3) if i % 2 else [f"schuft{k}" for k in rnd.choices("abcdef", k=4)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, y))
    rows += [(n, None, None), (n + 1, "", "x"), (None, "lump wicht grobian", "x"), (0, rows[0][1], "x"), (n + 2, "lorem " * 50_000, "x")]
    labels += [(n + 5, 0, 1), (None, 1, 1), (1, 1, None)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    model = tox.fit(docs, labels)
    rows = toxic_columns(tox.score(docs, model)).join(labels.drop("quality"), "doc_id", "left").collect()
    assert len(rows) >= docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = [r for r in rows if r.held_out and r.toxic is not None]
    assert len(kept) > 80 and np.mean([r.predicted == r.toxic for r in kept]) > 0.97
    by_id = {r.doc_id: r.predicted for r in rows}
    assert by_id[None] == 1 and by_id[600] == by_id[601] == by_id[602] == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = made(spark, 200)
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tox.fit(docs, labels), tox.fit(docs, turned)
    assert a.number == b.number and np.allclose(a.count_weight, b.count_weight)


def test_empty(spark):
    docs, labels = made(spark, 20)
    model = tox.fit(docs, labels.where("false"))
    assert all(r.predicted == 0 for r in toxic_columns(tox.score(docs, model)).collect())
    assert tox.score(docs.where("false"), tox.fit(docs.where("false"), labels)).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op6_weak_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    wrong_clean = sum(r.predicted and not r.toxic for r in rows)
    assert wrong_clean <= 0.03 * sum(not r.toxic for r in rows)
