"""Encoder hook (C1, C2, C3): text -> unit-length embedding, per Arrow batch.

The caller supplies an *encoder factory*: a picklable callable returning a
function ``list[str] -> numpy array (n, dim)``. It is called once per Python
worker (the model is created once, not once per batch), and the rows are
scored batch by batch with ``mapInPandas``; rows of the output are
L2-normalised (a zero vector stays zero).

:class:`HashingEncoder` is a small deterministic stand-in (signed feature
hashing of the analysed tokens) for environments without a model.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship_package

_WORKER_ENCODERS: dict = {}


def encoder_key(factory):
    """Identity of an encoder by content: its declared ``cache_key`` with its
    class, or a digest of its pickled form (an object's address may be reused
    by another one)."""
    declared = getattr(factory, "cache_key", None)
    if declared is not None:
        return type(factory).__qualname__, declared
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _encoder(factory, key):
    # Tasks unpickle their own copy of the factory: one encoder per key
    # serves every task of the worker.
    enc = _WORKER_ENCODERS.get(key)
    if enc is None:
        enc = factory()
        _WORKER_ENCODERS[key] = enc
    return enc


def normalize_rows(mat: np.ndarray) -> np.ndarray:
    norms = np.sqrt((mat.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    safe = np.where(norms > 0, norms, 1.0)
    return (mat / safe).astype(np.float32)


def encode(df: DataFrame, factory, text_col: str = "text", key: str = "doc_id",
           normalize: bool = True) -> DataFrame:
    """``(key, embedding array<float>)`` for every row of ``df``."""
    ship_package(df.sparkSession)
    key_type = dict(df.dtypes)[key]
    identity = encoder_key(factory)

    def run(batches):
        enc = _encoder(factory, identity)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            mat = np.asarray(enc(texts), dtype=np.float32).reshape(len(texts), -1)
            if normalize:
                mat = normalize_rows(mat)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "embedding": list(mat)})

    schema = f"{key} {key_type}, embedding array<float>"
    return df.select(key, F.col(text_col)).mapInPandas(run, schema)


class HashingEncoder:
    """Factory of a signed feature-hashing encoder over lower-cased ASCII word
    tokens: of a token's MD5, the first eight hex digits pick the component
    and the ninth the sign. The whole batch is hashed once per distinct token
    and summed by numpy."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.cache_key = ("hashing", dim)

    def __call__(self):
        import re

        word = re.compile(r"[a-z0-9]+")
        dim = self.dim

        def run(texts):
            tokens = [word.findall(t.lower()) for t in texts]
            known = {}
            for t in {t for row in tokens for t in row}:
                h = hashlib.md5(t.encode("ascii")).hexdigest()
                known[t] = (int(h[:8], 16) % dim, 1.0 if int(h[8], 16) >= 8 else -1.0)
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for i, row in enumerate(tokens):
                if row:
                    at, sign = zip(*map(known.__getitem__, row))
                    out[i] = np.bincount(at, weights=sign, minlength=dim)
            return out

        return run
