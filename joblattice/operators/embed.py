"""Listing text to unit vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T

from joblattice.functions.once import once_per_row
from joblattice.schema import EMBEDDING_DIMS

VECTOR = T.ArrayType(T.FloatType())
_TOKEN = re.compile("[a-z0-9]+")


@lru_cache(maxsize=200_000)
def _hash(token: str) -> int:
    return int.from_bytes(md5(token.encode()).digest()[:4], "big")


def hash_vector(text: str, dims: int) -> np.ndarray:
    """Token counts hashed into ``dims`` buckets, scaled to unit length."""
    buckets = np.array([*map(_hash, _TOKEN.findall(text.lower()))], dtype="int64") % dims
    counts = np.bincount(buckets, minlength=dims).astype("float64")
    length = np.sqrt((counts * counts).sum())
    return counts / length if length else counts


def hash_embed(text: Column, dims: int = EMBEDDING_DIMS) -> Column:
    """Built-in embedding that needs no model."""

    @once_per_row(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t or "", dims).astype("float32"))

    return embed(text)


def embed_with(
    text: Column,
    load_model: Callable[[], Callable[[list], object]],
    dims: int = EMBEDDING_DIMS,
    batch_size: int = 32,
) -> Column:
    """Vectors of a model given as a loader of a function list[str] -> list of vectors.

    The model is loaded once per task and called in batches; vectors are scaled to unit
    length, and a vector of another width fails the job.
    """

    @once_per_row(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            values = texts.fillna("").tolist()
            vectors: list[np.ndarray] = []
            for start in range(0, len(values), batch_size):
                for vector in model(values[start : start + batch_size]):
                    array = np.asarray(vector, dtype="float64")
                    if array.shape != (dims,):
                        raise ValueError(f"the model gave {array.size} dimensions, not {dims}")
                    length = np.linalg.norm(array)
                    vectors.append((array / length if length else array).astype("float32"))
            yield pd.Series(vectors, dtype="object")

    return embed(text)
