"""Anchor-point covering for problem 5, complete but with work that grows with the square of the rows.

A text's fingerprint is the parity sketch of its word bag in blocks of 23 bits. The anchors of a block are the 4,096
words of the perfect binary Golay code, whose covering radius is 3. Two texts of likeness `least` differ in at most
(1 - least) / (1 + least) of both their words, so in some block in at most that many bits over the number of blocks.
Texts are taken in bands of length, each with so many blocks that this threshold is 3 at most (5 for 39 words).
Each block is at home at its nearest anchor and is replicated to every anchor within radius plus threshold; homes meet
replicas per anchor, whole fingerprints are compared, survivors are verified on the word bags.

Kept for small tables and to measure against (see the README); likeness.alike_within serves p5_found.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered
from .likeness import LIKENESS, sketch, verified

BITS, RADIUS, THRESHOLD = 23, 3, 3
#: Words of the longest texts of the first band.
FIRST = 39
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@cache
def code() -> np.ndarray:
    """The 4,096 code words: all multiples of the generator."""
    out = np.zeros(1 << 12, np.int64)
    for k in range(12):
        out ^= np.where(np.arange(1 << 12) >> k & 1, GENERATOR << k, 0)
    return out


def nearest(block: np.ndarray, radius: int) -> list[np.ndarray]:
    """Anchors within the radius of each block value."""
    far = np.bitwise_count(block[:, None] ^ code()[None, :])
    return [np.flatnonzero(row <= radius) for row in far]


def block_parity(tokens: str, block: int, blocks: int) -> Column:
    return F.expr(
        f"aggregate({tokens}, 0L, (s, x) -> CASE WHEN pmod(x, {blocks * BITS}) div {BITS} = {block} "
        f"THEN s ^ shiftleft(1L, cast(pmod(x, {blocks * BITS}) % {BITS} AS int)) ELSE s END)"
    )


def bands(longest: int, least: float) -> list[tuple[int, int]]:
    """(fewest, most) words of the bands: two texts that can be alike share the band of the longer one."""
    out, low, high = [], 0, FIRST
    while low < longest:
        out.append((int(least * low), high))
        low, high = high, int(high / least) + 1
    return out


def covered_pairs(df: DataFrame, id_col: str, text: Column, least: float = LIKENESS) -> DataFrame:
    """(a, b, likeness), a < b: all pairs of ids alike by at least `least`."""
    rows = sketch(df, id_col, text).select("id", "tokens", "words")
    bags = rows.select(F.col("id").alias("rep"), numbered("tokens").alias("bag"))
    pairs = None
    for low, high in bands(rows.agg(F.max("words")).first()[0] or 1, least):
        one = _band(rows.where(F.col("words").between(low, high)), high, least)
        pairs = one if pairs is None else pairs.unionByName(one)
    return verified(pairs.distinct(), bags, bags, least)


def _band(rows: DataFrame, most_words: int, least: float) -> DataFrame:
    """(a, b): pairs whose fingerprints are near enough, texts of at most most_words words."""
    differ = int((1 - least) / (1 + least) * 2 * most_words + 1e-9)
    n = differ // (THRESHOLD + 1) + 1
    coded = rows.select("id", "words", *[block_parity("tokens", k, n).alias(f"b{k}") for k in range(n)])
    blocks = coded.select("*", F.posexplode(F.array(*[f"b{k}" for k in range(n)])).alias("block", "bits"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def home(bits: pd.Series) -> pd.Series:
        return pd.Series([a[:1].astype("int32") for a in nearest(bits.to_numpy(), RADIUS)], dtype="object")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reach(bits: pd.Series) -> pd.Series:
        return pd.Series([a.astype("int32") for a in nearest(bits.to_numpy(), RADIUS + differ // n)], dtype="object")

    l, r = blocks.withColumn("anchor", F.explode(home("bits"))).alias("l"), blocks.withColumn("anchor", F.explode(reach("bits"))).alias("r")  # noqa: E741
    bits = sum((F.expr(f"bit_count(l.b{k} ^ r.b{k})") for k in range(n)), F.lit(0))
    close = bits <= (F.col("l.words") + F.col("r.words")) * ((1 - least) / (1 + least)) + 1e-9
    met = l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.anchor") == F.col("r.anchor")) & (F.col("l.id") != F.col("r.id")) & close)
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))
