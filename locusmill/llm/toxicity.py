"""Toxicity by weak supervision.

Candidate signals are words and word beginnings of the texts. Those that lean to the toxic side of the labelled sample
become voters: a lexicon voter fires on one occurrence, a pattern voter on a share of the words. A generative label
model estimates by EM, anchored by the sample, each voter's firing rates for both classes and the voters' correlations, which
discount the votes of voters that say the same. Its posteriors are the labels on which a linear classifier over all
signals is trained; the classifier scores every whole text.

The sample of labelled rows is bounded by ``sample_rows`` (about that many, chosen by a hash of the id); everything on
the driver has the sample's rows times ``signals`` columns at most. Scoring sees all rows, without a shuffle.

Cases: null and empty texts get the score of no signals; labels that are null are left out, rows that repeat count each
time; ids that are null or without a label are scored and not learnt from; without any toxic label nothing fires and
all scores are near 0; texts are read whole; empty tables give no rows; columns not in ``keep`` are left out.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import staged
from .arrow import map_slices

#: Lengths in characters of the word beginnings that are signals.
BEGINNINGS = range(3, 8)
REMEMBERED = 150_000
_SPLIT = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def signals_of(word: bytes) -> list[str]:
    """A word's signals: itself after '=', and its beginnings."""
    w = word.decode()
    return ["=" + w] + [w[:k] for k in BEGINNINGS if len(w) > k]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """signal numbers; weights of log counts and of log shares; the constant."""

    number: dict[str, int]
    count_weight: np.ndarray
    share_weight: np.ndarray
    constant: float

    def score(self, counts: Counter, n_words: int) -> float:
        total = self.constant
        for k, n in counts.items():
            total += self.count_weight[k] * np.log1p(n) + self.share_weight[k] * np.log1p(100 * n / n_words)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


class Counted(dict):
    """Words and the numbers of their signals, filled as they are met."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = tuple(self.number[s] for s in signals_of(word) if s in self.number)
        return got

    def count(self, text: str) -> tuple[Counter, int]:
        words = words_of(text)
        out: Counter = Counter()
        for word, n in Counter(words).items():
            for k in self[word]:
                out[k] += n
        return out, len(words)


def _leaning(sample: DataFrame, signals: int) -> list[str]:
    """The signals that lean most to toxic documents: by documents, times the log odds."""

    def run(part: pa.RecordBatch) -> list:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        toxic = part.column(part.schema.get_field_index("toxic")).to_pylist()
        for text, y in zip(part.column(part.schema.get_field_index("text")).to_pylist(), toxic):
            found[y].update({s for w in set(words_of(text or "")) for s in signals_of(w)})
        names = [*(found[0] | found[1])]
        return [names, [found[1][s] for s in names], [found[0][s] for s in names]]

    made = StructType([StructField("signal", StringType()), StructField("n1", LongType()), StructField("n0", LongType())])

    def batches(parts):
        from .arrow import slices

        for part in slices(parts, "text", 1 << 24):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(run(part), (pa.string(), pa.int64(), pa.int64()))], names=made.names
            )

    size = sample.agg(F.sum("toxic").alias("a"), F.count("toxic").alias("n")).first()
    n1, n0 = size["a"] or 0, size["n"] - (size["a"] or 0)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1)))
    best = (
        sample.select("text", "toxic").mapInArrow(batches, made)
        .groupBy("signal").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where((F.col("n1") >= 3) & (odds > 1))
        .withColumn("lean", F.col("n1") * odds)
        .orderBy(F.desc("lean"), "signal").limit(signals)
    )
    return sorted(r["signal"] for r in best.collect())


def _matrix(sample: DataFrame, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each signal, word counts and labels of the sample's rows."""
    added = StructType([
        StructField("at", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType())),
        StructField("n_words", LongType()),
    ])

    def run(part: pa.RecordBatch) -> list:
        counted = Counted(number)
        got = [counted.count(t or "") for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        return [[list(c) for c, _ in got], [list(c.values()) for c, _ in got], [n for _, n in got]]

    rows = sorted(
        map_slices(sample, run, added, "text", ["toxic"]).collect(), key=lambda r: (r["n_words"], r["toxic"], sorted(zip(r["at"], r["counts"])))
    )
    counts = np.zeros((len(rows), len(number)), np.float32)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = r["counts"]
    return counts, np.array([max(1, r["n_words"]) for r in rows], np.float32), np.array([r["toxic"] for r in rows])


def voters(counts: np.ndarray, words: np.ndarray, toxic: np.ndarray, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Votes (rows by voters) and each voter's share of toxic rows in the labelled sample.

    A signal votes on one occurrence, on two, and on one word in a hundred; a voter must be right at least seven times in
    ten, and one that fires on the same rows as a better one is left out.
    """
    fired, right = [], []
    share = 100 * counts / words[:, None]
    for votes in (counts >= 1, counts >= 2, share >= 1):
        n, good = votes.sum(0), votes[toxic == 1].sum(0)
        exact = (good + 1) / (n + 2)
        for k in np.flatnonzero((n >= 4) & (exact >= 0.7)):
            fired.append(votes[:, k])
            right.append((exact[k], int(n[k])))
    order = sorted(range(len(fired)), key=lambda k: (-right[k][0] * right[k][1], k))
    kept: list[int] = []
    for k in order:
        if len(kept) == most:
            break
        same = any(
            (fired[k] & fired[j]).sum() > 0.9 * (fired[k] | fired[j]).sum() for j in kept
        )
        if not same:
            kept.append(k)
    if not kept:
        return np.zeros((len(toxic), 0), np.float32), np.zeros(0)
    return np.array([fired[k] for k in kept], np.float32).T, np.array([right[k][0] for k in kept])


def label_model(votes: np.ndarray, exact: np.ndarray, toxic: np.ndarray, trust: float = 0.8, rounds: int = 60) -> np.ndarray:
    """Posterior of the toxic class for each row, by EM over the votes; ``exact`` is where it starts.

    The sample's labels anchor the classes: a row's share in the rates is ``trust`` its label and for the rest its
    posterior, which is made of votes alone.
    Each voter has a firing rate per class. Correlation above one half within a class lowers their weight: one of
    w perfectly correlated voters counts 1 / w.
    """
    rows, m = votes.shape
    if not m:
        return np.zeros(rows)
    post = 1 - np.exp(votes @ np.log1p(-np.clip(exact, 0.01, 0.99)))
    weight = np.ones(m)
    for step in range(rounds):
        held = trust * toxic + (1 - trust) * post
        mass = np.array([1 - held, held])
        prior = np.clip((mass.sum(1) + 1) / (rows + 2), 1e-4, 1)
        rate = (mass @ votes + np.array([[0.01], [0.5]])) / (mass.sum(1)[:, None] + 1)
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        if step % 10 == 0:
            tied = np.zeros((m, m))
            for c in (0, 1):
                left = votes - rate[c]
                spread = (left * mass[c][:, None]).T @ left
                scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
                tied += prior[c] / prior.sum() * np.maximum(spread / scale[:, None] / scale[None, :], 0)
            np.fill_diagonal(tied, 0)
            weight = 1 / (1 + np.where(tied > 0.5, tied, 0).sum(1))
        for_one = weight * (np.log(rate[1]) - np.log(rate[0]))
        for_none = weight * (np.log1p(-rate[1]) - np.log1p(-rate[0]))
        logit = np.log(prior[1]) - np.log(prior[0]) + votes @ for_one + (1 - votes) @ for_none
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _regression(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient."""
    rows, m = x.shape
    scale = np.maximum(x.std(0), 1e-3)
    z = (x / scale).astype(np.float32)
    w, b = np.zeros(m), -2.0
    ahead, ahead_b, t = w.copy(), b, 1.0
    step = 4.0 / max(1.0, _largest(z))
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead.astype(np.float32) + ahead_b, -40, 40)))
        gap = (p - target) / rows
        new = ahead - step * (z.T @ gap.astype(np.float32) + ridge * ahead)
        new_b = ahead_b - step * gap.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w / scale, float(b) if rows else -5.0


def _largest(z: np.ndarray) -> float:
    """The largest eigenvalue of the second moments, by power iteration."""
    v = np.ones(z.shape[1], np.float32)
    top = 1.0
    for _ in range(20):
        u = z.T @ (z @ v) / max(1, len(z))
        top = float(np.linalg.norm(u))
        if not top:
            return 1.0
        v = u / top
    return top + 1.0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    sample_rows: int = 20_000,
    signals: int = 256,
) -> Model:
    """Learn from labelled rows that are not held out. labels: doc_id, toxic."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(F.col("id").isNotNull() & ~held_out("id"))
    part = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = staged(own.join(F.broadcast(chosen), "id").select("id", "text", "toxic"))  # bounded by sample_rows
    names = _leaning(sample, signals)
    number = {s: k for k, s in enumerate(names)}
    counts, words, toxic = _matrix(sample, number)
    votes, exact = voters(counts, words, toxic)
    target = label_model(votes, exact, toxic)
    x = np.hstack([np.log1p(counts), np.log1p(100 * counts / words[:, None])])
    w, b = _regression(x, target)
    return Model(number, w[:len(names)], w[len(names):], b)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` beside each whole text's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> list:
        own = shared.value
        counted = own.__dict__.setdefault("_counted", Counted(own.number))
        return [[own.score(*counted.count(t or "")) for t in part.column(part.schema.get_field_index(text)).to_pylist()]]

    kept = [c for c in keep if c != "score"]
    source = docs.select(*dict.fromkeys([*kept, text]))
    return map_slices(source, run, StructType([StructField("score", DoubleType())]), text, kept)
