"""Batches, splits, orders and task rows of training and inference sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .augment import draw
from .normalize import with_task

#: Rows of a block of consecutive numbers, about; blocks at most; accuracy of the quantiles that bound them.
BLOCK, BLOCKS, ACCURACY = 100_000, 1_024, 20_000


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `row`, the place of each row in the order of a column, from 0 (nulls first, ties in any order), without
    one task that sees all rows: quantiles of the column bound blocks of about equally many rows, however sparse its
    values; blocks are counted, their starts summed, and rows numbered within."""
    many = min(BLOCKS, df.count() // BLOCK + 1)
    bounds = df.agg(F.percentile_approx(order, [k / many for k in range(1, many)], ACCURACY)).first()[0] if many > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    keyed = df.withColumn("_block", F.when(F.col(order).isNull(), 0).otherwise(block))
    counts = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    # at most BLOCKS rows
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return keyed.withColumn("_w", within).join(F.broadcast(starts), "_block").withColumn("row", F.col("_start") + F.col("_w")).drop("_block", "_w", "_start")


def batches(df: DataFrame, order: str, value: str, size: int = 32, once: bool = False) -> DataFrame:
    """(batch, items): chunks of `size` values in the order of a column; a chunk is bounded by its size. once: each
    value only at its first place."""
    if once:
        df = df.groupBy(value).agg(F.min(order).alias(order))
    rows = numbered(df, order)
    return (
        rows.groupBy(F.floor(F.col("row") / size).alias("batch"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))
    )


def split(key: Column, valid: float = 0.1, seed: int = 19) -> Column:
    """'train' or 'valid' by a seeded draw on the key; the same at any partitioning."""
    return F.when(draw(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), "split") < int(valid * 2**32), "valid").otherwise("train")


def shuffle_key(key: Column, seed: int, task: str) -> Column:
    """Sort key of a seeded shuffle, one order per task."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(task), key.cast("string")))


def task_rows(df: DataFrame, id_col: str, input_col: str, detected_col: str, corrected_col: str) -> DataFrame:
    """(id, task, input, label): one detection row for each row, one correction row where there is a correction."""
    detect = df.select(id_col, F.lit("detection").alias("task"), with_task(F.col(input_col), "detection").alias("input"), F.col(detected_col).alias("label"))
    correct = df.where(F.col(corrected_col).isNotNull()).select(id_col, F.lit("correction").alias("task"), with_task(F.col(detected_col), "correction").alias("input"), F.col(corrected_col).alias("label"))
    return detect.unionAll(correct)


def encoded(rows: DataFrame, vocabulary: str, most: int = 128, text_cols: tuple[str, str] = ("input", "label")) -> DataFrame:
    """rows with input_ids and labels: token ids of a tokenizer file, cut to `most` ids. Null text has null ids."""

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        t = _tokenizer(vocabulary)
        t.encode_special_tokens = True
        out = t.encode_batch(text.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([None if x is None else e.ids[:most] for x, e in zip(text, out)], dtype="object")

    return rows.select("*", ids(F.col(text_cols[0])).alias("input_ids"), ids(F.col(text_cols[1])).alias("labels"))


def decoded(rows: DataFrame, vocabulary: str, ids_col: str, out: str = "text") -> DataFrame:
    """rows with the text of a column of token ids; null ids have null text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        t = _tokenizer(vocabulary)
        some = [i for i, x in enumerate(ids) if x is not None]
        found = dict(zip(some, t.decode_batch([[int(k) for k in ids.iloc[i]] for i in some], skip_special_tokens=False)))
        return pd.Series([found.get(i) for i in range(len(ids))], dtype="object")

    return rows.withColumn(out, text(F.col(ids_col)))


def special_tokens(vocabulary: str, wanted: tuple[str, ...]) -> list[str]:
    """The wanted special tokens that a tokenizer file lacks, in their order."""
    known = _tokenizer(vocabulary).get_vocab(with_added_tokens=True)
    return [t for t in dict.fromkeys(wanted) if t not in known]


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    if vocabulary not in _loaded:
        _loaded[vocabulary] = Tokenizer.from_file(vocabulary)
    return _loaded[vocabulary]


_loaded: dict = {}


def step_sizes(rows: int, batch: int, epochs: int) -> tuple[int, int]:
    """(logging steps, saving steps) of a training run: a hundredth of an epoch, a tenth of the run."""
    from math import ceil

    per = ceil(rows / batch)
    return ceil(per * 0.01), ceil(per * epochs * 0.1)


def queue_page(df: DataFrame, most: int = 16) -> DataFrame:
    """The next pending requests: without a prediction, in the order of their number, at most `most` (top-k)."""
    return df.where(F.col("prediction").isNull()).orderBy(F.col("id").cast("bigint"), "queued_at").limit(most)
