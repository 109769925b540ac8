"""Keyboard (telex) forms of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .normalize import WORD_CHAR, mapping, pieces

DASHED = "-" + WORD_CHAR


def dashed(word: Column) -> Column:
    """Every letter in keyboard form, tones behind a dash."""
    table = mapping(K.TELEX)
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(table[c], c)), "")


def dashed_text(text: Column) -> Column:
    """dashed for a whole sentence: one native replacement per letter of the table, whose results hold no letter of
    the table themselves."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), K.TELEX.items(), text)


def paired(word: Column) -> Column:
    """Only the letter pair ươ in keyboard form."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), K.TELEX_PAIRS.items(), word)


def _bind(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def _tone(word: Column) -> Column:
    return F.regexp_extract(word, DASHED, 0)


def _tone_last(word: Column) -> Column:
    t = _tone(word)
    return F.when(t == "", word).otherwise(F.concat(F.replace(word, t, F.lit("")), F.substring(t, 2, 1)))


def encode(word: Column) -> Column:
    """Keyboard form with the first tone letter at the end."""
    return _bind(dashed(word), _tone_last)


def swaps(word: Column) -> Column:
    """Other typing orders of a keyboard form: w last, and the first doubled letter completed at the end,
    each also before a final tone letter."""

    def of(w: Column) -> Column:
        last = F.right(w, F.lit(1))
        tone = last.isin(*K.TELEX_TONES)
        no_w = F.replace(w, F.lit("w"), F.lit(""))
        one_w = F.length(w) - F.length(no_w) == 1
        run = F.regexp_extract(w, r"((.)\2+)", 1)
        head = F.substring(run, 1, 1)
        short = F.when(run != "", F.replace(w, run, head))
        cut = lambda c: F.left(c, F.length(c) - 1)
        found = F.array(
            F.when(one_w, F.concat(no_w, F.lit("w"))),
            F.when(one_w & tone, F.concat(cut(no_w), F.lit("w"), last)),
            F.when((run != "") & tone, F.concat(cut(short), head, last)),
            F.when(run != "", F.concat(short, head)),
        )
        return F.filter(found, lambda x: x.isNotNull())

    return _bind(word, of)


def variants(word: Column) -> Column:
    """All typing variants of a word, distinct and sorted."""

    def both(w: Column) -> Column:
        t = _tone(w)
        return F.when(t == "", F.array(w)).otherwise(F.array(F.replace(w, t, F.right(t, F.lit(1))), _tone_last(w)))

    forms = F.concat(_bind(dashed(word), both), _bind(paired(word), both))
    return _bind(forms, lambda fs: F.array_sort(F.array_distinct(F.concat(fs, F.flatten(F.transform(fs, swaps))))))


def lookup_words(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, most: int = 500_000) -> DataFrame:
    """df with `corrected`: words found in dictionary (telex, word) replaced; one closing punctuation mark is put
    aside for the look-up and is restored on a hit only, as the established behaviour has it.

    The dictionary goes to the executors as a broadcast if it has at most `most` entries, else by a shuffle join. The
    words of a row are put together again by its id, which must be unique.
    """
    word = F.when(F.right("w", F.lit(1)).isin(*K.PUNCTUATION), F.left("w", F.length("w") - 1)).otherwise(F.col("w"))
    mark = F.when(F.right("w", F.lit(1)).isin(*K.PUNCTUATION), F.right("w", F.lit(1))).otherwise(F.lit(""))
    long = df.select(id_col, F.posexplode(pieces(F.col(text_col))).alias("pos", "w")).select(id_col, "pos", word.alias("telex"), mark.alias("mark"))
    entries = dictionary.select("telex", F.col("word").alias("hit"))
    if entries.limit(most + 1).count() <= most:
        entries = F.broadcast(entries)
    found = long.join(entries, "telex", "left").select(id_col, "pos", F.coalesce(F.concat("hit", "mark"), "telex").alias("out"))
    texts = found.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), " ").alias("corrected"))
    return df.join(texts, id_col, "left").withColumn("corrected", F.when(F.col(text_col).isNotNull(), F.coalesce("corrected", F.lit(""))))
