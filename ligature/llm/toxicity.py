"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are a word's stems: the whole word and its prefixes of 3 to 5 letters. Their log-odds
between toxic and clean training texts are shrunk by an informative Dirichlet prior, proportional
to the token's share in both classes, and kept where they exceed ODDS with z above SIGNIFICANT. A
word scores the strongest of its kept tokens; every other word costs DRIFT, so that chance gives
negative sums. One linear scan finds all maximal scoring segments of a text. A segment of score S
in a text of n words has the extreme-value (Gumbel) chance 1 - exp(-K n exp(-lambda S)) under the
word scores of clean training texts; K and lambda are fitted to their best segments. The evidence
of a text, the sum of -log chance over its significant segments, and that of its best one go
through a logistic calibration fitted on training rows.

The model is fitted on at most SAMPLE labelled rows, those of least hash of doc_id; every row is
scored over its whole text. Null and empty texts have no evidence and get the calibrated lowest
score. Without labelled rows of both classes the score is 0 everywhere. Repeated texts train once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced, whole_text, written

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
PRIOR, ODDS, SIGNIFICANT, LEAST = 20.0, 1.5, 4.0, 4
DRIFT, THRESHOLD = 0.25, 0.3
_WORD = regex.compile(r"[\p{L}\p{N}]+")
STEMS = (3, 4, 5)


@lru_cache(50_000)
def tokens(word: str) -> tuple[str, ...]:
    return (f"{word}$", *(word[:n] for n in STEMS if len(word) >= n))


def segments(scores: np.ndarray, places: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose positive scores stand at
    ``places`` and which costs ``drift`` everywhere else; linear time in the positive scores."""
    kept: list[list] = []  # [first, last, total before, total after, index of the nearest kept segment with less before]
    total, previous = 0.0, -1
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (place - previous - 1)
        previous = place
        new = [place, place, total, total + score, -1]
        total += score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass
class Model:
    odds: dict[str, float]
    k: float = 1.0
    decay: float = 1.0
    weights: tuple[float, ...] = ()

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal scoring segments by word position."""
        look, memory, places, scores = self.odds.get, self._memory, [], []
        words = _WORD.findall(text.lower())
        for i, w in enumerate(words):
            if (s := memory.get(w)) is None:
                found = [o for t in tokens(w) if (o := look(t)) is not None]
                s = max(found, key=abs) if found else 0.0
                if len(memory) > 100_000:
                    memory.clear()
                memory[w] = s
            if s > 0:
                places.append(i)
                scores.append(s)
        return len(words), segments(np.array(scores), np.array(places, np.int64), DRIFT)

    def __post_init__(self):
        self._memory: dict[str, float] = {}

    def chance(self, n: int, score: float) -> float:
        """-log of the chance that a clean text of n words has a segment of this score."""
        x = self.k * max(n, 1) * math.exp(-self.decay * score)
        return -math.log(max(-math.expm1(-x), 1e-300))

    def evidence(self, n: int, strengths: list[float]) -> list[float]:
        """Of a text's segments: the best and the summed -log chance, and how dense significant ones are."""
        strong = [c for c in strengths if c > 1.0]
        return [math.log1p(max(strengths, default=0.0)), math.log1p(sum(strong)), math.log1p(100 * len(strong) / max(n, 1))]

    def score_of(self, n: int, strengths: list[float]) -> float:
        if not self.weights:
            return 0.0
        x = self.weights[-1] + sum(w * v for w, v in zip(self.weights, self.evidence(n, strengths), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def score(self, text: str) -> float:
        n, found = self.passages(text)
        return self.score_of(n, [self.chance(n, s) for _, _, s in found])

    def rated(self, text: str) -> list[float]:
        n, found = self.passages(text)
        return self.evidence(n, [self.chance(n, s) for _, _, s in found])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Weights and intercept by Newton's method."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * len(x) * np.eye(len(w)) / 100, x.T @ (y - p) - ridge * len(x) * w / 100)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def token_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds, shrunk by a Dirichlet prior, of tokens by texts that hold them; the significant ones."""
    out, share = {}, toxic / (toxic + clean)
    for token, (a, b) in counts.items():
        if a + b < LEAST:
            continue
        # the prior adds texts in which the token is as frequent in both classes
        prior = PRIOR * (a + b) / (toxic + clean)
        pa_, pb = prior * share + 0.05, prior * (1 - share) + 0.05
        odds = math.log((a + pa_) / (toxic + PRIOR * share - a)) - math.log((b + pb) / (clean + PRIOR * (1 - share) - b))
        if abs(odds) > ODDS and abs(odds) / math.sqrt(1 / (a + pa_) + 1 / (b + pb)) > SIGNIFICANT:
            out[token] = odds
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic of the training fold: labelled rows whose crc32(doc_id as text) mod 4 isn't 2."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids and labels: a bounded broadcast, so that no other text is moved
    return docs.select("doc_id", whole_text()).join(F.broadcast(known), "doc_id").select("text", "toxic")


_ROWS = "half int, toxic int, text string"


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The training rows, written: half (by hash, calibration sees texts that its tokens don't come
    from), toxic, text. Repeated texts come once, toxic if any is."""
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = training_rows(docs, labels, sample).repartition(spread, "text").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    return written(rows.select((F.crc32("text") % 2).cast("int").alias("half"), "toxic", "text"), "training")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each token: toxic and clean ones of each half, batch by batch."""
    for batch in sliced(batches):
        counts: dict[str, list[int]] = {}
        for half, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for t in {t for w in set(_WORD.findall(text.as_py().lower())) for t in tokens(w)}:
                counts.setdefault(t, [0, 0, 0, 0])[2 * half + 1 - y] += 1
        columns = list(zip(*counts.values(), strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["token", "t0", "c0", "t1", "c1"])


def _significant(totals: list[int]):
    """Of counted tokens those significant in either half or in both, with their log-odds in each."""
    t0, c0, t1, c1 = totals

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            odds = [token_odds({r[0]: (r[1], r[2]) for r in rows}, t0, c0), token_odds({r[0]: (r[3], r[4]) for r in rows}, t1, c1), token_odds({r[0]: (r[1] + r[3], r[2] + r[4]) for r in rows}, t0 + t1, c0 + c1)]
            kept = sorted(set().union(*odds))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), *(pa.array([o.get(t) for t in kept], pa.float64()) for o in odds)], names=["token", "o0", "o1", "both"])

    return choose


def _rated(halves: list[Model], best_only: bool):
    """Of each training row, by the tokens of the other half: toxic and its words and best segment, or
    its evidence."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(m.odds, m.k, m.decay) for m in halves]
        for batch in sliced(batches):
            out = []
            for half, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                model = models[1 - half]
                if best_only:
                    n, found = model.passages(text.as_py())
                    out.append((y, float(max(n, 1)), max((s for _, _, s in found), default=0.0), 0.0))
                else:
                    out.append((y, *model.rated(text.as_py())))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=["toxic", "a", "b", "c"])

    return rate


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample. Tokens are counted and rows rated by all tasks; significant
    tokens and three numbers a sampled row reach the driver."""
    rows = _training(docs, labels, sample)
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    totals = [sizes.get(k, 0) for k in ((0, 1), (0, 0), (1, 1), (1, 0))]
    if not all(totals):
        return Model({})
    counts = rows.mapInArrow(_counted, "token string, t0 long, c0 long, t1 long, c1 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))
    enough = counts.where(F.col("t0") + F.col("c0") + F.col("t1") + F.col("c1") >= LEAST)
    kept = enough.mapInArrow(_significant(totals), "token string, o0 double, o1 double, both double").collect()
    halves = [Model({r.token: r[c] for r in kept if r[c] is not None}) for c in ("o0", "o1")]
    # Gumbel fit: log(-log P(best < s)) falls linearly in s, given log n
    best = rows.where("toxic = 0").mapInArrow(_rated(halves, True), "toxic int, a double, b double, c double").collect()
    n, s = np.array(sorted((r.a, r.b) for r in best), float).T
    order = np.argsort(s, kind="stable")
    above = 1 - (np.arange(len(s)) + 0.5) / len(s)
    tail = order[above < 0.2] if (above < 0.2).sum() > 10 else order
    x, p = s[tail], np.log(np.maximum(above[np.argsort(order)][tail], 1e-9))
    decay = float(np.clip(-np.polyfit(x, p, 1)[0], 0.2, 2.0)) if np.ptp(x) > 0 else 1.0
    k = float(np.exp(np.mean(p + decay * x)) / n.mean())
    for m in halves:
        m.k, m.decay = k, decay
    ev = np.array(sorted((r.a, r.b, r.c, r.toxic) for r in rows.mapInArrow(_rated(halves, False), "toxic int, a double, b double, c double").collect()))
    return Model({r.token: r.both for r in kept if r.both is not None}, k, decay, logistic(ev[:, :3], ev[:, 3]))


def untoxic(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, all their columns as they are; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.odds, model.k, model.decay, model.weights))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([model.score(t.as_py() or "") < least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, passages (first word, last word, score, -log chance)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.odds, model.k, model.decay, model.weights))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("strength", pa.float64())]))
        for batch in sliced(batches):
            scores, found = [], []
            for text in batch.column(1):
                text = text.as_py()
                n, seg = model.passages(text)
                strength = [model.chance(n, s) for _, _, s in seg]
                scores.append(model.score_of(n, strength))
                found.append([{"first": a, "last": b, "score": s, "strength": c} for (a, b, s), c in zip(seg, strength, strict=True) if c > 1.0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long"), whole_text()).mapInArrow(rate, "doc_id long, score double, passages array<struct<first: long, last: long, score: double, strength: double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity(docs, trained(docs, read(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
