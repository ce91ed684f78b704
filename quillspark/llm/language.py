"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of one to ``LONGEST`` code points is an n-gram, whose
polynomial hash falls into one of ``2 ** bits`` buckets.  Training counts n-grams by
language over every labelled row: tasks add up vectors, Spark sums them.  The matrix
of smoothed log-probabilities is broadcast; it has ``MATRIX_CELLS`` entries at most,
as ``bits`` shrinks with the number of languages (more than 65,536 are an error).
Scoring looks the n-grams of a text up in the matrix and adds, in numpy; texts are cut
into windows that overlap by ``LONGEST - 1`` code points, so long ones are counted
whole in bounded memory.

The prediction is the language of the largest posterior (the first by name on ties)
and the score that posterior.  Null texts and texts without a letter are ``und`` with
score 0, as is every text if nothing was learnt.  Rows without a language, or without
an id, are not learnt from; repeated rows count each.  An empty table gives no rows.
Columns of the input are kept, also ones named like those used here, but one named
like the output is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import table

#: Longest n-gram, hash bits at most, and entries of the matrix at most (64 MB).
LONGEST, BITS, MATRIX_CELLS = 4, 16, 1 << 24
#: Count added to every bucket.
SMOOTHING = 0.5
#: Code points that are hashed at a time.
WINDOW = 1 << 18
UNKNOWN = "und"
#: Multipliers of the polynomial and of the final mix.
STEP, MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def windows(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Code points of a text in lower case, and how many of the first are known already, window by window."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes), WINDOW):
        yield codes[max(0, at - LONGEST + 1) : at + WINDOW].astype(np.uint64), min(at, LONGEST - 1)


def buckets(text: str, bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, each once."""
    shift = np.uint64(64 - bits)
    for codes, known in windows(text):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] + np.uint64(n)) * STEP + codes[n - 1 :]
            new = h[max(0, known - n + 1) :]  # those that end after what is known
            yield (new * MIX >> shift).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(rows: DataFrame, lang: str, text: str, bits: int) -> DataFrame:
    """``(lang, bucket, n)`` over all rows; a task sends on one vector for each language it meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = waiting.setdefault(name, [])
                for found in buckets(value.as_py(), bits):
                    held.append(found)
                if sum(map(len, held)) > WINDOW:
                    add(totals, name, waiting.pop(name))
        for name in [*waiting]:
            add(totals, name, waiting.pop(name))
        for name, vector in totals.items():
            at = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(vector[at])], ["lang", "bucket", "n"])

    def add(totals: dict[str, np.ndarray], name: str, found: list[np.ndarray]) -> None:
        if found:
            vector = np.bincount(np.concatenate(found), minlength=1 << bits)
            totals[name] = totals[name] + vector if name in totals else vector

    known = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Log-probabilities ``(buckets, languages)`` and log-priors; languages by name."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        total = self.prior.copy()
        for found in buckets(text, self.bits):
            total += self.matrix[found].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def fit_languages(rows: DataFrame, lang: str = "lang", text: str = "text", bits: int | None = None) -> LanguageModel:
    """Fit on all ``rows`` with a language and a text; the driver gets at most ``MATRIX_CELLS`` counts."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()
    sizes = sorted((r["lang"], r["n"]) for r in sizes)
    names = [name for name, _ in sizes]
    if len(names) > MATRIX_CELLS >> 8:
        raise ValueError(f"{len(names)} languages are more than {MATRIX_CELLS >> 8}")
    if not names:
        return LanguageModel([], np.empty(0), np.empty((0, 0), dtype=np.float32), 1)
    bits = bits or min(BITS, int(np.log2(MATRIX_CELLS // len(names))))
    found = ngram_counts(rows, lang, text, bits).toArrow()
    at = {name: i for i, name in enumerate(names)}
    counts = np.zeros((1 << bits, len(names)))
    counts[found["bucket"].to_numpy(), [at[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    counts += SMOOTHING
    docs = np.array([n for _, n in sizes], dtype=np.float64)
    return LanguageModel(names, np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32), bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Add ``out_col``: a struct of ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [m.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([name for name, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out_col, predict(F.col(f"`{text_col}`").cast("string")))


def is_held_out(id_col: str = "doc_id") -> Column:
    """The split of the language labels: crc32 of the id as text, modulo 4, equals 2 (null ids are held out)."""
    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(part == 2, F.lit(True))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~is_held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "language.lang_pred", "language.score")
