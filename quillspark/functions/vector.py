"""Vector functions: distances, similarity, and the hashing embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.batches import pieces

SIMILARITY_FLOOR = 0.35
#: Bytes of words that are hashed together, at most.
WORD = 64


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def similarity_from_distance(distance: Column) -> Column:
    """Cosine similarity of unit vectors from their L2 distance."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def _hashes(words: list[str]) -> np.ndarray:
    """FNV-1a-32 of words, a byte of all of them at a time, the longest first; very long ones alone."""
    coded = sorted(((word.encode(), i) for i, word in enumerate(words)), key=lambda x: -len(x[0]))
    found, sizes = np.empty(len(words), dtype=np.int64), np.array([len(word) for word, _ in coded], dtype=np.int64)
    alone = int(np.count_nonzero(sizes > WORD))
    for word, i in coded[:alone]:
        h = 0x811C9DC5
        for byte in word:
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        found[i] = h
    sizes, data = sizes[alone:], np.frombuffer(b"".join(word for word, _ in coded[alone:]), dtype=np.uint8)
    starts, h = np.cumsum(sizes) - sizes, np.full(len(sizes), 0x811C9DC5, dtype=np.uint32)
    for at in range(sizes.max(initial=0)):
        n = np.searchsorted(-sizes, -at)  # words longer than ``at``
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * np.uint32(0x01000193)
    found[[i for _, i in coded[alone:]]] = h
    return found


def hash_embedder(dims: int = 1024) -> Callable[[Column], Column]:
    """Bag of lower-case words, each at its FNV-1a-32 bucket, scaled to unit length.

    Vectors are made for a few texts at a time and leave at once, as numbers of Arrow;
    the different words of these texts are hashed together.
    """

    def one(places: np.ndarray) -> np.ndarray:
        v = np.bincount(places, minlength=dims).astype(np.float32)
        size = np.sqrt((v.astype(np.float64) ** 2).sum())
        return v / np.float32(size) if size else v

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in pieces(texts):
                words = [(text.as_py() or "").lower().split() for text in texts[part]]
                different = [*dict.fromkeys(w for text in words for w in text)]
                bucket = dict(zip(different, (_hashes(different) % dims).tolist(), strict=True))
                vectors = [one(np.fromiter(map(bucket.__getitem__, text), dtype=np.int64, count=len(text))) for text in words]
                yield pa.ListArray.from_arrays(np.arange(0, dims * len(vectors) + 1, dims, dtype=np.int32), pa.array(np.concatenate(vectors)))

    return embed
