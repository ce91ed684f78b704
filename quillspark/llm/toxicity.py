"""Toxic passages as maximum-scoring segments, judged by extreme-value statistics.

Tokens are words; a word is known by itself and by its first four to six letters,
each hashed into a table of fixed size.  Training counts, per class, in how many
documents each feature occurs, and turns the counts into log-odds with a
Dirichlet prior (a flat part and one in proportion to the feature's overall
rate) and their z-scores.  A token scores the log-odds of its most significant
feature where that is significant and positive, and a small penalty otherwise.

One linear scan (Ruzzo and Tompa) finds all maximal segments of a document.
Under the clean model the number of segments that score ``S`` or more among
``n`` tokens is Poisson with mean ``K n exp(-lambda S)`` (Karlin and Altschul);
lambda and K come from clean training documents.  A document's evidence is the
sum of ``-ln E`` over its significant segments, and a logistic curve fitted on
training documents turns it into a score.

Null and empty texts have no segment and get the score of no evidence.  Texts
are scanned whole.  Repeated rows score alike; null labels are not learnt from,
and without any labels every document gets score 0.  An empty table gives no rows;
extra columns are passed on, but one named like the output is replaced by it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import is_held_out, materialize, table, text_or_empty
from quillspark.llm.samples import SAMPLE_ROWS, labelled_sample, without_near_copies

BUCKETS = 1 << 20
STEMS = (4, 5, 6)
FLAT_PRIOR, RATE_PRIOR = 0.5, 100.0
#: A feature counts as toxic from this z-score and these log-odds on.
MIN_Z, MIN_VALUE = 4.5, 2.5
#: One training document in so many is kept from the counts and calibrates the segments.
CALIBRATION = 3
PENALTY = 0.5
THRESHOLD = 0.7
MEMO_ENTRIES, MEMO_CHARS = 200_000, 40
EDGES = re.compile(r"^\W+|\W+$")


def features(unit: str) -> list[int]:
    """Buckets of a white-space unit: the word without outer punctuation, and its stems."""
    word = EDGES.sub("", unit).lower()
    if not word:
        return []
    keys = [f"w{word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]
    return [zlib.crc32(k.encode()) & (BUCKETS - 1) for k in keys]


def maximal_segments(at: list[int], scores: list[float], penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` in linear time.

    ``at`` and ``scores`` are the tokens with positive scores; every token
    between them scores ``-penalty``.
    """
    # Each candidate: first, last, total before it, total at its end, and the last earlier one with a lower total before it.
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for place, score in zip(at, scores, strict=True):
        total -= penalty * (place - last - 1)
        last = place
        first, before = place, total
        total += score
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, place, before, total, j))
                break
            first, before = kept[j][0], kept[j][2]
            after = kept[j][4]
            del kept[j:]
            j = after
    return [(a, b, end - start) for a, b, start, end, _ in kept]


@dataclass
class ToxicityModel:
    """Token scores by bucket (``value``, chosen by ``weight``), the null's lambda and K, and the curve."""

    value: np.ndarray
    weight: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)
    trained: bool = True
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def token_score(self, unit: str) -> float:
        best = max(features(unit), key=lambda b: self.weight[b], default=-1)
        return float(self.value[best]) if best >= 0 and self.weight[best] >= MIN_Z else -PENALTY

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and maximal segments by token places."""
        memo, units = self.memo, text.split()
        found = [*map(memo.get, units)]
        if None in found:
            for i, unit in enumerate(units):
                if found[i] is None:
                    score = memo.get(unit)
                    if score is None:
                        score = self.token_score(unit)
                        if len(unit) < MEMO_CHARS:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[unit] = score
                    found[i] = score
        scores = np.array(found, dtype=np.float64)
        at = np.flatnonzero(scores > 0)
        return len(units), maximal_segments(at.tolist(), scores[at].tolist(), PENALTY)

    def evidence(self, tokens: int, segments: list[tuple[int, int, float]]) -> float:
        """Sum of ``-ln E`` over segments that are significant (E below 1)."""
        room = math.log(self.scale * max(tokens, 1))
        return sum(max(0.0, self.rate * s - room) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * math.log1p(evidence))))) if self.trained else 0.0


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, list[int]] = {}
    for batch in batches:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            seen: set[int] = set()
            for unit in set(text.as_py().split()):
                if (own := memo.get(unit)) is None:
                    own = features(unit)
                    if len(unit) < MEMO_CHARS:
                        if len(memo) > MEMO_ENTRIES:
                            memo.clear()
                        memo[unit] = own
                seen.update(own)
            counts[label, list(seen)] += 1
        bucket = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts[0, bucket]), pa.array(counts[1, bucket])], ["bucket", "clean", "toxic"])


def log_odds(clean: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features under a Dirichlet prior, and z-scores of their being toxic.

    ``share`` is the toxic share of the documents.  The z-score is the signed root
    of the likelihood ratio, which holds for small counts too.
    """
    n = clean + toxic
    prior = FLAT_PRIOR + RATE_PRIOR * n / max(1, n.sum())
    c, t = clean + prior, toxic + prior
    value = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.nan_to_num(toxic * np.log(toxic / (n * share))) + np.nan_to_num(clean * np.log(clean / (n * (1 - share))))
    return value, np.sign(toxic - n * share) * np.sqrt(2 * np.maximum(part, 0))


def null_rate(positive: dict[float, int], tokens: int) -> float:
    """Lambda: the positive root of ``E[exp(lambda * score)] = 1`` under the clean token frequencies."""
    share = {s: (n + 0.5) / (tokens + 1) for s, n in positive.items()} or {1.0: 0.5 / (tokens + 1)}
    rest = max(1e-9, 1 - sum(share.values()))
    mean = lambda x: rest * math.exp(-PENALTY * x) + sum(p * math.exp(min(700.0, s * x)) for s, p in share.items())
    low, high = 1e-6, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(low, 0.05)


def fit_curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve over ``log(1 + evidence)``, by Newton steps with a weak ridge."""
    x = np.column_stack([np.ones(len(label)), np.log1p(evidence)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (label - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit_toxicity(sample: DataFrame) -> ToxicityModel:
    """Fit on ``(text, label)`` rows; what reaches the driver is bounded by the table of buckets and the sample.

    Near copies count once.  A third of the rows, picked by a hash of the text,
    calibrates; the others are counted.
    """
    spark = sample.sparkSession
    sample = materialize(without_near_copies(sample), "toxicity-sample")
    fold = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    sample = sample.select("text", F.col("label").cast("int").alias("label"), fold.alias("fold"))
    counted = sample.where("not fold")
    docs = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}
    counts = counted.mapInArrow(_count_features, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counts.toArrow()
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket = found["bucket"].to_numpy()
    clean[bucket], toxic[bucket] = found["clean"].to_numpy(), found["toxic"].to_numpy()
    value, weight = log_odds(clean, toxic, docs.get(1, 0.5) / max(1, docs.get(1, 0.5) + docs.get(0, 0.5)))
    model = ToxicityModel(value.astype(np.float32), np.where(value >= MIN_VALUE, weight, 0).astype(np.float32))
    shared = spark.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.scan(text.as_py()) for text in batch.column("text")]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s for _, _, s in found] for _, found in rows], kind)], ["label", "tokens", "segments"])

    seen = sample.where("fold").mapInArrow(scanned, "label int, tokens bigint, segments array<double>").toArrow().to_pylist()
    if not {0, 1} <= {r["label"] for r in seen} & set(docs):
        model.trained = False
        return model
    tokens = sum(r["tokens"] for r in seen if not r["label"])
    chance = [s for r in seen if not r["label"] for s in r["segments"]]
    positive: dict[float, int] = {}
    for s in chance:
        positive[round(s, 1)] = positive.get(round(s, 1), 0) + 1
    least = float(value[(value >= MIN_VALUE) & (weight >= MIN_Z)].min(initial=20.0))
    model.rate = null_rate(positive or {least: 0}, tokens)
    model.scale = (len(chance) + 0.5) / (tokens + 1) * math.exp(model.rate * least)
    evidence = np.array([model.evidence(r["tokens"], [(0, 0, s) for s in r["segments"]]) for r in seen])
    model.curve = fit_curve(evidence, np.array([r["label"] for r in seen], dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Add ``out_col``: a struct of ``score``, ``predicted`` and the significant ``passages`` (token places and E-values)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))])
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        m, scores, passages = shared.value, [], []
        for text in texts:
            n, segments = m.scan(text.as_py())
            scores.append(m.score(m.evidence(n, segments)))
            room = math.log(m.scale * max(n, 1))
            tried = [(a, b, s, math.exp(min(50.0, room - m.rate * s))) for a, b, s in segments]
            passages.append([{"first": a, "last": b, "score": s, "e_value": e} for a, b, s, e in tried if e < 1])
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, arrow)], ["score", "passages"])

    found = docs.withColumn(out_col, judge(text_or_empty(text_col)))
    score = F.col(f"`{out_col}`.score")
    return found.withColumn(out_col, F.struct(score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col(f"`{out_col}`.passages").alias("passages")))


def trained_model(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    return fit_toxicity(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("toxic"), rows))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = score_toxicity(docs, trained_model(spark, sf_dir))
    return judged.select("doc_id", is_held_out().alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.passages").alias("passages"))
