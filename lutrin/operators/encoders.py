"""Encoders of texts to vectors behind one protocol.

HashedWords is a stand-in without a model: signed word hashes, deterministic, no claim to meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.functions.text import tokens


class Encoder(Protocol):
    def encode(self, batch: list[list[str]]) -> np.ndarray:
        """Row vectors of tokenised texts; of the texts themselves if the encoder has `whole` set."""


class HashedWords:
    def __init__(self, dim: int = 64):
        self.dim, self.of = dim, {}

    def encode(self, batch: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(batch), self.dim), np.float32)
        for i, words in enumerate(batch):
            for w in words:
                if (at := self.of.get(w)) is None:
                    h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                    at = self.of[w] = (int.from_bytes(h[:4], "big") % self.dim, 1 if h[4] & 1 else -1)
                    if len(self.of) > 500_000:
                        self.of.clear()
                out[i, at[0]] += at[1]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class SentenceModel:
    """A public sentence-embedding model by the optional sentence_transformers package, loaded once a worker."""

    whole = True
    _loaded: dict = {}

    def __init__(self, name: str, batch: int = 64):
        self.name, self.batch = name, batch

    def encode(self, batch: list[str]) -> np.ndarray:
        if (model := self._loaded.get(self.name)) is None:
            from sentence_transformers import SentenceTransformer

            model = self._loaded[self.name] = SentenceTransformer(self.name)
        return np.asarray(model.encode(batch, batch_size=self.batch, normalize_embeddings=True), np.float32)


def encoder(name: str) -> Encoder:
    """The encoder of a setting: `hashed-words`, or the name of a sentence model."""
    return HashedWords() if name == "hashed-words" else SentenceModel(name)


def encode(rows: DataFrame, key: str, text: str, encoder: Encoder) -> DataFrame:
    """(key, embedding) of unit length, one Arrow batch at a time; null and empty texts give zero vectors."""

    whole = getattr(encoder, "whole", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = encoder.encode([w or ("" if whole else []) for w in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, (F.col(text) if whole else tokens(F.col(text))).alias("w")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")
