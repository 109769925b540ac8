"""Shared column expressions and staging for the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, stage, unstage

__all__ = ["HOT_KEYS", "HOT_ROWS", "SALTS", "numbered", "parity", "scratch_dir", "segments", "stage", "table", "unstage", "windows", "word_hashes", "words"]

#: Groups of more rows than this are looked up through a broadcast of the largest groups.
HOT_ROWS = 5_000
#: A broadcast of hot groups never holds more keys than this, whatever the size of the data.
HOT_KEYS = 1_024
#: Parts that the rows of one hot group are spread over.
SALTS = 64
#: Letters and digits of Unicode 14 to 15.1, which the regular expressions of Java 17 take for marks.
LATER = (
    "870-887 889-88e 8b5-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 "
    "10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 "
    "10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 "
    "11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb "
    "1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb "
    "1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af"
)
#: Runs of anything else. Letters and digits fail at the first of the two classes and marks of ASCII pass at the start of
#: the second, so the long list is only walked for other marks.
MARKS = r"[[^\p{L}\p{N}]&&[\x00-\x7f[^" + "".join("-".join(rf"\x{{{c}}}" for c in part.split("-")) for part in LATER.split()) + "]]]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; empty array for null or wordless text. Lower case is one letter for one:
    a capital İ stays one letter (not i and a mark, which would part its word), and a final ς is the σ that it is elsewhere."""
    low = F.replace(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), F.lit("ς"), F.lit("σ"))
    flat = F.trim(F.regexp_replace(low, MARKS, " "))
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_hashes(words_col: str) -> Column:
    return F.expr(f"transform({words_col}, w -> xxhash64(w))")


def windows(tokens: str, size: int) -> Column:
    """Hashes of all runs of `size` consecutive tokens; empty where the text is shorter."""
    return F.expr(
        f"CASE WHEN size({tokens}) < {size} THEN cast(array() AS array<bigint>) ELSE "
        f"transform(sequence(1, size({tokens}) - {size - 1}), i -> xxhash64({size}, slice({tokens}, i, {size}))) END"
    )


def segments(tokens: str, size: int) -> Column:
    """Hashes of disjoint runs of `size` tokens that cover the text; the last run is moved back to end with it."""
    return F.expr(
        f"CASE WHEN size({tokens}) < {size} THEN cast(array() AS array<bigint>) ELSE "
        f"transform(sequence(0, cast(ceil(size({tokens}) / {size}.0) AS int) - 1), "
        f"i -> xxhash64({size}, slice({tokens}, least(i * {size}, size({tokens}) - {size}) + 1, {size}))) END"
    )


def parity(tokens: str, half: int) -> Column:
    """One half of a 128-bit parity sketch: every token flips the bit that its hash names.

    Two token bags that differ in d tokens (counted with repeats) differ in at most d bits, so a bound
    on the bags is a bound on the sketches and comparing sketches first loses no pair.
    """
    return F.expr(
        f"aggregate({tokens}, 0L, (s, x) -> CASE WHEN (x & 64L) = {64 * half}L "
        f"THEN s ^ shiftleft(1L, cast(x & 63L AS int)) ELSE s END)"
    )


def numbered(tokens: str) -> Column:
    """Token hashes made distinct by the ordinal of each repeat, so a bag becomes a set. The outer
    one-element array binds the sorted tokens to a variable, so they are sorted once for a row."""
    return F.expr(
        f"element_at(transform(array(sort_array({tokens})), s -> transform(s, (x, i) -> xxhash64(x, i - array_position(s, x)))), 1)"
    )
