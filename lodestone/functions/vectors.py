"""Vector expressions: norms, distances, normalisation, blending and codecs, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)) if len(vector) else F.array().cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ, a component's bit being set where it is positive."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when((x > 0) != (y > 0), 1.0).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)


def distance(kind: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "l2": squared_l2, "hamming": hamming}[kind](a, b)


def _with(value: Column, use) -> Column:
    """``use(value)`` with value computed once a row, not once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """As vectors are indexed: the norm is at least TINY."""
    return _with(F.greatest(norm(v), F.lit(TINY)), lambda n: F.transform(doubles(v), lambda x: x / n))


def normalize_l2(v: Column) -> Column:
    """The codec's form: a vector shorter than TINY stays as it is."""
    return _with(norm(v), lambda n: F.when(n < TINY, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n)))


def is_finite(v: Column) -> Column:
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def blend(v: Column, target: Column, alpha: float) -> Column:
    return F.zip_with(doubles(v), doubles(target), lambda x, y: x * (1 - alpha) + y * alpha)


def int8_encode(v: Column) -> Column:
    """round(127 x), halves to even, clipped to a signed byte."""
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x * 127).cast("int"))).cast("tinyint"))


def int8_decode(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def bit_encode(v: Column) -> Column:
    """Bytes as an array of ints, the first component in the highest bit; the last byte is padded with zeros."""
    bits = F.transform(doubles(v), lambda x: F.when(x > 0, 1).otherwise(0))
    padded = F.concat(bits, F.array_repeat(F.lit(0), (F.lit(8) - F.size(bits) % 8) % 8))
    octet = lambda i: F.aggregate(F.slice(padded, i * 8 + 1, F.lit(8)), F.lit(0), lambda acc, b: acc * 2 + b)
    return F.when(F.size(bits) > 0, F.transform(F.sequence(F.lit(0), (F.size(padded) / 8).cast("int") - 1), octet)).otherwise(F.array().cast("array<int>"))


def bit_decode(octets: Column, dim: int) -> Column:
    """Components as 1 or -1."""
    bit = lambda i: F.floor(F.element_at(octets, (F.floor(i / 8) + 1).cast("int")) / F.pow(F.lit(2.0), 7 - i % 8)) % 2
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(bit(i) == 1, 1.0).otherwise(-1.0))


def half_round_trip(v: Column) -> Column:
    """Vectors as they come back from half precision; Spark has no such type."""

    @F.pandas_udf("array<float>")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return run(v)


def half_encode(v: Column) -> Column:
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f2").tobytes())

    return run(v)


def hash_embedder(dim: int):
    """A deterministic embedder for tests and offline use: token hashes as signed counts, normalised. text -> array<float>."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_embedding(t or "", dim))

    return embed


def hash_embedding(text: str, dim: int) -> list[float]:
    import zlib

    v = np.zeros(dim, np.float32)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    size = float(np.linalg.norm(v))
    return (v / size if size > TINY else v).tolist()
