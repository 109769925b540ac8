"""Problem 8: a mixture of sources by target weights.

Sizes are tokens of a public tokenizer. Shares are met by capped water-filling: a source that would have
to repeat more than its cap is clamped at the cap and its missing weight goes to the other sources in
proportion, until all fit. Each document then comes floor(r) times and, for the fractional part, once
more if its seeded draw falls under a threshold that is set on the token sums of the draws, so the
reached shares are those asked for up to one bin of the draws.

Documents without a target source, and null or empty texts (no tokens), take no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Draws are summed in so many bins per source; the threshold is exact to one bin.
BINS = 4_096


def token_counts(texts: DataFrame, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds tokens: the number of tokens of text_col, 0 for null."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield pd.Series([len(code.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return texts.withColumn("tokens", count(F.col(text_col)))


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    cap: int
    tokens: int
    repeats: float


def fill(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | str | None = None) -> list[Share]:
    """Repeats of each source. targets: (source, share, cap). total: tokens of the mixture, by default as many as the
    sources hold, or "met": the most for which every share can be met; never more than the caps allow."""
    live = {s: (w, c) for s, w, c in targets if tokens.get(s, 0) > 0 and w > 0}
    most = sum(c * tokens[s] for s, (_, c) in live.items())
    weights = sum(w for w, _ in live.values())
    met = min((c * tokens[s] * weights / w for s, (w, c) in live.items()), default=0.0)
    size = min(float(sum(tokens[s] for s in live) if total is None else met if total == "met" else total), float(most))
    amount: dict[str, float] = {}
    while live:
        weight = sum(w for w, _ in live.values())
        left = size - sum(amount.values())
        over = [s for s, (w, c) in live.items() if left * w / weight > c * tokens[s] + 1e-9]
        for s in over or list(live):
            w, c = live[s]
            amount[s] = float(c * tokens[s]) if over else left * w / weight
        if not over:
            break
        for s in over:
            del live[s]
    return [Share(s, w, c, tokens.get(s, 0), amount.get(s, 0.0) / tokens[s] if tokens.get(s) else 0.0) for s, w, c in targets]


def draw(seed: int, key: str) -> Column:
    """Uniform bin of a document, from its id alone: the same at any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BINS))


def mixture(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: list[tuple[str, float, int]], seed: int = 42, total: float | str | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[Share]]:
    """(id, source, tokens, copy) of the mixture, and the plan. targets is a list of bounded size.

    total: tokens of the mixture (see fill)."""
    names = [t[0] for t in targets]
    sized = stage(
        token_counts(docs.where(F.col(source_col).isin(names)), text_col, tokenizer)
        .select(F.col(id_col), F.col(source_col).alias("source"), "tokens", draw(seed, id_col).alias("bin")).where("tokens > 0"),
        "sized",
    )
    # sources x BINS sums, whatever the number of documents
    sums: dict[str, list[int]] = {s: [0] * BINS for s in names}
    for r in sized.groupBy("source", "bin").agg(F.sum("tokens").alias("n")).collect():
        sums[r["source"]][r["bin"]] = r["n"]
    tokens = {s: sum(b) for s, b in sums.items()}
    plan = fill(targets, tokens, total)
    copies = F.lit(0)
    for p in plan:
        whole, part = int(p.repeats + 1e-12), (p.repeats - int(p.repeats + 1e-12)) * p.tokens
        cut, run = 0, 0.0
        while cut < BINS and run + sums[p.source][cut] / 2 < part:
            run += sums[p.source][cut]
            cut += 1
        copies = F.when(F.col("source") == p.source, F.lit(whole) + F.when(F.col("bin") < cut, 1).otherwise(0)).otherwise(copies)
    out = (
        sized.withColumn("n", copies).where("n > 0")
        .select(id_col, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    )
    return out, plan


def reached(mixed: DataFrame, plan: list[Share]) -> DataFrame:
    """(source, target_share, max_repeats, repeats, tokens, share): the shares that the mixture reached."""
    spark = mixed.sparkSession
    rows = spark.createDataFrame([(p.source, p.target, p.cap, p.repeats) for p in plan], "source string, target_share double, max_repeats int, repeats double")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    # as many rows as sources
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return (
        rows.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .select("source", "target_share", "max_repeats", "repeats", "tokens", F.round(F.try_divide("tokens", total), 6).alias("share"))
    )
