"""Embedding by a provider: checked inputs and outputs, bounded batches, and back-fill of what is missing.

A provider turns texts into vectors. It is made on each executor by a factory, so nothing of it is shipped but
how to make it; its answers are checked before a row leaves the task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a unit vector's length may be from 1.
TOLERANCE = 1e-3


class EmbeddingError(ValueError):
    """An input or an answer that breaks the contract."""


@dataclass(frozen=True)
class Space:
    """What makes vectors comparable: provider, model, dimensions, and whether they have length 1."""

    provider: str
    model: str
    dimensions: int
    unit: bool = True

    @property
    def key(self) -> str:
        return hashlib.sha256("\x1f".join((self.provider, self.model, str(self.dimensions), str(self.unit))).encode()).hexdigest()


@dataclass(frozen=True)
class Limits:
    items: int = 64
    batch_bytes: int = 1 << 20
    item_bytes: int = 1 << 18


Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def batches(texts: Sequence[str], limits: Limits) -> Iterator[list[str]]:
    """The texts in order, so many and so many bytes at a time; an item that alone is too large is an error."""
    held: list[str] = []
    size = 0
    for text in texts:
        own = len(text.encode())
        if own > limits.item_bytes:
            raise EmbeddingError(f"a text of {own} bytes exceeds {limits.item_bytes}")
        if held and (len(held) >= limits.items or size + own > limits.batch_bytes):
            yield held
            held, size = [], 0
        held.append(text)
        size += own
    if held:
        yield held


def checked(vectors: Sequence[Sequence[float]], count: int, space: Space) -> list[list[float]]:
    if len(vectors) != count:
        raise EmbeddingError(f"{len(vectors)} vectors for {count} texts")
    out = [[float(x) for x in v] for v in vectors]
    for v in out:
        if len(v) != space.dimensions:
            raise EmbeddingError("a vector has the wrong dimensions")
        if not all(map(math.isfinite, v)):
            raise EmbeddingError("a vector holds a value that is not finite")
        if space.unit and abs(math.sqrt(sum(x * x for x in v)) - 1) > TOLERANCE:
            raise EmbeddingError("a vector is not of length 1")
    return out


def embed(rows: DataFrame, make: Callable[[], Provider], space: Space, limits: Limits = Limits(), id_col: str = "id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(id_col, space_key, text_hash, vector) of rows with a text; null texts have none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for part in parts:
            texts = part.column("text").to_pylist()
            vectors = [v for some in batches(texts, limits) for v in checked(provider(some), len(some), space)]
            hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([space.key] * len(texts)), pa.array(hashes, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], [id_col, "space_key", "text_hash", "vector"])

    told = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return told.mapInArrow(run, f"{id_col} {told.schema['id'].dataType.simpleString()}, space_key string, text_hash string, vector array<double>")


def back_fill(rows: DataFrame, stored: DataFrame, make: Callable[[], Provider], space: Space, limits: Limits = Limits(), id_col: str = "id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The stored vectors (id_col, space_key, text_hash, vector) of this space whose text is unchanged, and new
    ones for the other rows. Only those are sent to the provider; vectors of rows that are gone are dropped."""
    now = rows.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.sha2(F.col(text_col), 256).alias("text_hash"))
    ours = stored.where(F.col("space_key") == space.key)
    kept = ours.join(now.select(id_col, "text_hash"), [id_col, "text_hash"], "left_semi").select(id_col, "space_key", "text_hash", "vector")
    missing = now.join(ours.select(id_col, "text_hash"), [id_col, "text_hash"], "left_anti")
    return kept.unionByName(embed(missing, make, space, limits, id_col, text_col))
