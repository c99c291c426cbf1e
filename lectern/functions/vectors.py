"""Vectors of texts without a model, and distances between vectors."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions.text import LATIN, once, text_or_empty


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def normalised(v: Column, digits: int = 8) -> Column:
    """Of unit length, rounded; a vector of no length stays."""
    def scaled(x: Column) -> Column:
        return F.when(x["n"] > 0, F.transform(x["v"], lambda c: F.round(c / x["n"], digits))).otherwise(x["v"].cast("array<double>"))

    return once(F.struct(v.alias("v"), norm(v).alias("n")), scaled)


def distance_score(cosine_distance: Column) -> Column:
    """1 at no distance, 0 from a right angle on."""
    return F.round(1 - F.least(cosine_distance, F.lit(1.0)), 6)


def hash_embedding(text: Column, dimensions: int = 16) -> Column:
    """Bytes of the text's SHA-256 as shares of 255, over and over."""
    digest = F.sha2(text_or_empty(text), 256)
    byte = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    return F.transform(byte, lambda b: F.round(b / 255, 6))


def lexical_embedding(text: Column, dimensions: int = 256) -> Column:
    """Signed counts of tokens in buckets by BLAKE2b, of unit length; a text without tokens counts as one token.

    Spark has no BLAKE2b, so this is a batched function. Blank texts give zeros.
    """
    dimensions = max(32, dimensions)
    seen: dict[str, tuple[int, float]] = {}

    def place(term: str) -> tuple[int, float]:
        if term not in seen:
            if len(seen) > 100_000:
                seen.clear()
            d = hashlib.blake2b(term.encode(), digest_size=8).digest()
            seen[term] = int.from_bytes(d[:4], "big") % dimensions, 1.0 - 2.0 * (d[4] % 2)
        return seen[term]

    latin, ideographs = re.compile(LATIN), re.compile("[\u4e00-\u9fff]+")

    def terms(text: str) -> list[str]:
        low = text.lower()
        runs = ideographs.findall(low)
        found = latin.findall(low) + [r[i:i + 2] for r in runs for i in range(max(len(r) - 1, 1))]
        return found or [low.strip()] * bool(low.strip())

    @F.pandas_udf(ArrayType(DoubleType()))
    def vector(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            v = np.zeros(dimensions)
            for t in terms(text):
                i, sign = place(t)
                v[i] += sign
            size = np.sqrt((v * v).sum())
            return np.round(v / size, 8) if size else v

        return texts.map(one)

    return vector(text_or_empty(text))
