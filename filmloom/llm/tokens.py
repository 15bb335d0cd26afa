"""Token counts and hashed token vectors by a public byte-level BPE vocabulary, read from a file given as a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions.bpe import encoding

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIMENSIONS = 4


@lru_cache(maxsize=2)
def directions(n: int, seed: int = 17) -> np.ndarray:
    """A fixed random direction in few dimensions for every hash bucket of a token."""
    return np.random.default_rng(seed).standard_normal((n, DIMENSIONS)).astype(np.float32)


def measure(documents: DataFrame, columns: list[str], path: str = VOCABULARY, vectors: bool = False) -> DataFrame:
    """documents' columns with n_tokens and, if asked, v0..v3: the text's hashed token vector in few dimensions.

    NULL and empty texts have 0 tokens and the zero vector. Texts are read whole. The text itself is not carried along.
    """
    kinds = dict(documents.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["n_tokens long"] + [f"v{k} float" for k in range(DIMENSIONS)] * vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        table = directions(1 << 16)
        for pdf in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in pdf["text"]]
            out = pdf[columns].copy()
            out["n_tokens"] = np.array([len(i) for i in ids], dtype=np.int64)
            if vectors:
                v = np.zeros((len(ids), DIMENSIONS), dtype=np.float32)
                for k, i in enumerate(ids):
                    if i:
                        counts = np.bincount(np.asarray(i) & 0xFFFF)
                        used = np.flatnonzero(counts)
                        w = np.log1p(counts[used]).astype(np.float32)
                        v[k] = w @ table[used] / np.sqrt(float(w @ w))
                for k in range(DIMENSIONS):
                    out[f"v{k}"] = v[:, k]
            yield out

    return documents.select(*dict.fromkeys([*columns, "text"])).mapInPandas(run, schema)


def fingerprint(text: str = "text"):
    """128 bits that tell texts apart."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))
