"""Document quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds ``t_1 < t_2 < ...`` cut the latent score, so that
``P(grade >= k) = sigmoid(w.x - t_k)``.  Selection reads the expected grade and a
tail probability.

Features are words, shapes of words (letter case, digits, punctuation), pairs of
neighbouring shapes, and immediate repetitions, hashed into a table of fixed size;
their values are ``log(1 + count)``, scaled to unit length.  Fitting mixes
parameters: in each round tasks refine the weights on their own rows and the
driver averages the results, whose size and number are fixed.

Null and empty texts have no features and are judged by the thresholds alone.
Repeated rows are judged alike; rows without labels are not learnt from; with
fewer than two grades every document is kept.  An empty table gives no rows; extra
columns are passed on, but one named like the output is replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import is_held_out, materialize, table, text_or_empty
from quillspark.llm.samples import SAMPLE_ROWS, labelled_sample

BUCKETS = 1 << 16
#: Tasks that refine weights, rounds of averaging, and passes of a task over its rows in a round.
TASKS, ROUNDS, PASSES = 6, 4, 2
STEP, RIDGE = 0.5, 1e-6
#: Kept: documents whose probability of this grade or better is at least this.
KEEP_GRADE, KEEP_CHANCE = 1, 0.5
MEMO_ENTRIES, MEMO_CHARS = 200_000, 40


def shape(unit: str) -> str:
    """A word's form, whole: runs of capitals as ``A``, other letters ``a``, digits ``0``; the rest as it stands."""
    out: list[str] = []
    for c in unit:
        mark = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if mark not in "Aa0" or not out or out[-1] != mark:
            out.append(mark)
    return "".join(out)


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) & (BUCKETS - 1)


class Featurizer:
    """Sparse features of a text; remembers the two buckets of units it has met."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        memo, units = self.memo, text.split()
        if not units:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
        found = [*map(memo.get, units)]
        if None in found:
            for i, unit in enumerate(units):
                if found[i] is None:
                    both = memo.get(unit)
                    if both is None:
                        both = _bucket("w" + unit.lower()) << 32 | _bucket("s" + shape(unit))
                        if len(unit) < MEMO_CHARS:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[unit] = both
                    found[i] = both
        both = np.array(found, dtype=np.int64)
        word, form = both >> 32, both & 0xFFFFFFFF
        pair = (form[:-1] * 31 + form[1:] * 17 + 7) & (BUCKETS - 1)
        same = int((word[1:] == word[:-1]).sum())
        again = np.full(same, _bucket(f"again{10 * same // len(units)}"))  # told apart by their share of the text
        seen, count = np.unique(np.concatenate([word, form, pair, again]), return_counts=True)
        value = np.log1p(count)
        return seen.astype(np.int32), (value / np.sqrt((value**2).sum())).astype(np.float32)


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; ``grades`` are the ratings, lowest first."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    featurize: Featurizer = field(default_factory=Featurizer)

    def tails(self, latent: float) -> np.ndarray:
        """P(grade is above the k-th) for each k but the highest."""
        return 1 / (1 + np.exp(-np.clip(latent - self.thresholds, -50, 50)))

    def latent(self, text: str) -> float:
        at, value = self.featurize(text)
        return float(self.weights[at] @ value)


def refine(weights: np.ndarray, thresholds: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], passes: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the cumulative-link likelihood of ``(rank, buckets, values)`` rows."""
    w, t, k = weights.copy(), thresholds.copy(), len(thresholds)
    gw, gt = np.full(len(w), 1e-4), np.full(k, 1e-4)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for _ in range(passes):
        for rank, at, value in rows:
            z = w[at] @ value
            above = sigmoid(z - t[rank - 1]) if rank else 1.0
            beyond = sigmoid(z - t[rank]) if rank < k else 0.0
            # d log(above - beyond) / dz = 1 - above - beyond
            slope = 1.0 - above - beyond
            share = max(above - beyond, 1e-9)
            g = slope * value - RIDGE * w[at]
            gw[at] += g * g
            w[at] += step * g / np.sqrt(gw[at])
            for j, d in ((rank - 1, -above * (1 - above) / share), (rank, beyond * (1 - beyond) / share)):
                if 0 <= j < k:
                    gt[j] += d * d
                    t[j] += step * d / np.sqrt(gt[j])
            t = np.maximum.accumulate(t + np.arange(k) * 1e-6)
    return w, t


def _round(state: Broadcast, rank: dict[int, int], number: int) -> Callable[[pa.Table], pa.Table]:
    """One task's part of a round: its rows' refinement of the shared weights."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hash", "ascending"), ("label", "ascending")])  # the shuffle's order must not count
        labels, ats, values = group["label"].to_pylist(), group["at"].combine_chunks(), group["value"].combine_chunks()
        own = [(rank[g], a.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for g, a, v in zip(labels, ats, values, strict=True)]
        order = np.random.default_rng(number).permutation(len(own))
        w, t = refine(*state.value, [own[i] for i in order], PASSES, STEP / (1 + number))
        return pa.table({"rows": pa.array([len(own)], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "t": pa.array([t.tolist()], pa.list_(pa.float64()))})

    return work


def fit_quality(sample: DataFrame) -> OrdinalModel:
    """Fit on ``(text, label)`` rows with integer grades as labels."""
    spark = sample.sparkSession
    featurize = Featurizer()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [featurize(t.as_py()) for t in batch.column("text")]
            kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "part", "hash")), pa.array([a for a, _ in rows], kinds[0]), pa.array([v for _, v in rows], kinds[1])], ["label", "part", "hash", "at", "value"])

    # A row's task is fixed by its text, so every run and every lost task sees the same rows.
    parted = sample.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("text").alias("hash")).withColumn("part", F.pmod("hash", F.lit(TASKS)).cast("int"))
    rows = materialize(parted.mapInArrow(extract, "label int, part int, hash bigint, at array<int>, value array<float>"), "quality-features")
    grades = sorted(r["label"] for r in rows.select("label").distinct().collect())
    n = max(1, len(grades) - 1)
    model = OrdinalModel(np.zeros(BUCKETS), np.linspace(-1, 1, n) if n > 1 else np.zeros(1), grades, featurize)
    if len(grades) < 2:
        model.thresholds = np.full(1, -50.0)
        return model
    rank = {g: i for i, g in enumerate(grades)}
    for number in range(ROUNDS):
        work = _round(spark.sparkContext.broadcast((model.weights, model.thresholds)), rank, number)
        done = rows.groupBy("part").applyInArrow(work, "rows bigint, w binary, t array<double>").toArrow().to_pylist()
        share = np.array([r["rows"] for r in done], dtype=float) / sum(r["rows"] for r in done)
        model.weights = sum(s * np.frombuffer(r["w"], dtype=np.float32).astype(np.float64) for s, r in zip(share, done, strict=True))
        model.thresholds = np.maximum.accumulate(sum(s * np.array(r["t"]) for s, r in zip(share, done, strict=True)))
    return model


def grade_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Add ``out_col``: a struct of ``expected_grade`` and ``tails``, P(grade >= k) for every grade but the lowest."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(kind)
    def grade(texts: pa.Array) -> pa.Array:
        m = shared.value
        steps = np.diff(m.grades) if len(m.grades) > 1 else np.zeros(1)
        base = m.grades[0] if m.grades else 0
        tails = [m.tails(m.latent(t.as_py())) for t in texts]
        return pa.StructArray.from_arrays([pa.array([base + float(steps @ t) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))], ["expected_grade", "tails"])

    return docs.withColumn(out_col, grade(text_or_empty(text_col)))


def is_kept(quality: str = "quality", grade: int = KEEP_GRADE, chance: float = KEEP_CHANCE) -> Column:
    """Whether the tail probability of ``grade`` (by rank, 1 for the second lowest) is high enough."""
    return F.coalesce(F.get(F.col(f"`{quality}`.tails"), F.lit(grade - 1)) >= chance, F.lit(True))


def rating() -> Column:
    """The graded rating in ``labels``: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)


def trained_model(spark: SparkSession, sf_dir: str, rows: int = SAMPLE_ROWS // 2) -> OrdinalModel:
    return fit_quality(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rating(), rows))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = grade_quality(docs, trained_model(spark, sf_dir))
    return graded.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "quality.expected_grade",
        F.get("quality.tails", F.lit(KEEP_GRADE - 1)).alias("score"),
        is_kept().alias("kept"),
        is_kept().cast("int").alias("predicted"),
    )
