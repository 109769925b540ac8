"""Correction of sentences end to end, and the assembly of training sets.

The neural detector and corrector are pluggable DataFrame functions. The defaults use the corpus dictionaries:
a word that the vocabulary lacks is tagged, and tagged words are corrected from their neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import normalize as N
from ..operators import tagging as T
from ..operators import telex, vocabulary
from ..operators.filters import unprocessed

#: (rows, id column, text column) -> rows (id column, out)
Stage = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Dictionaries:
    """Tables that correction reads: words (word, n), telex (telex, word), bigrams (see vocabulary)."""

    words: DataFrame
    telex: DataFrame
    bigrams: DataFrame


@dataclass(frozen=True)
class Settings:
    revert: float = 0.7
    match: float = 0.5
    least: float = vocabulary.LEAST
    known: int = 2


def build(df: DataFrame, text_col: str, least: int = 2) -> Dictionaries:
    words = vocabulary.corpus_words(df, text_col)
    return Dictionaries(words, vocabulary.telex_dictionary(words, least), vocabulary.bigram_dictionary(df, text_col, least))


def dictionary_detector(words: DataFrame, least: int = 2) -> Stage:
    """Tags words of letters that occur fewer than `least` times in the corpus."""

    def run(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        long = rows.select(id_col, F.posexplode(N.pieces(F.col(text_col))).alias("pos", "w")).withColumn("k", F.lower(F.regexp_replace("w", r"[^\p{L}]+", "")))
        known = words.where(F.col("n") >= least).select(F.col("word").alias("k"), F.lit(True).alias("known"))
        wrong = F.col("known").isNull() & F.col("w").rlike(r"^[^\p{N}]*\p{L}[^\p{N}]*$")
        marked = long.join(known, "k", "left").withColumn("out", F.when(wrong, F.concat(F.lit("<error> "), "w", F.lit(" </error>"))).otherwise(F.col("w")))
        return marked.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), " ").alias("out"))

    return run


def keep_corrector(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Leaves what the dictionaries left: the tagged words as they are, without tags."""
    return rows.select(id_col, N.untagged(F.col(text_col)).alias("out"))


#: Texts in, texts out; as many.
Generate = Callable[[list[str]], list[str]]


def model_stage(load: Callable[[], Generate], batch: int = 16, task: str | None = None) -> Stage:
    """A neural detector or corrector as a stage: load() runs once in each task and gives the generating function, which
    gets at most `batch` texts at once. load must be importable or picklable; it loads from a path that workers reach.
    task: its prefix is put before every text. Null texts stay null. One narrow stage over Arrow batches."""

    def run(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        def generated(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            generate = load()
            for part in parts:
                some = [i for i, t in enumerate(part["text"]) if t is not None]
                texts = [part["text"].iloc[i] for i in some]
                made = [x for k in range(0, len(texts), batch) for x in generate(texts[k : k + batch])]
                found = dict(zip(some, made, strict=True))
                yield pd.DataFrame({id_col: part[id_col], "out": pd.Series([found.get(i) for i in range(len(part))], index=part.index, dtype="object")})

        text = F.col(text_col) if task is None else N.with_task(F.col(text_col), task)
        return rows.select(id_col, text.alias("text")).mapInPandas(generated, f"{id_col} {dict(rows.dtypes)[id_col]}, out string")

    return run


def reverted(tagged: Column, corrected: Column, most: float) -> Column:
    """The untagged input where the tags per output word exceed `most`; an empty output reverts, too."""
    tags = (F.length(tagged) - F.length(F.replace(tagged, F.lit(K.ERROR), F.lit("")))) / len(K.ERROR)
    n = F.size(N.pieces(corrected))
    return F.when((n == 0) | (tags > most * n), N.untagged(tagged)).otherwise(corrected)


def correct(df: DataFrame, id_col: str, text_col: str, d: Dictionaries, detector: Stage | None = None, corrector: Stage | None = None, settings: Settings = Settings()) -> DataFrame:
    """(id, original, corrected, edits). id must be unique. Formulas, notations and empty texts come out
    unchanged; null texts are dropped."""
    detector, corrector = detector or dictionary_detector(d.words, settings.known), corrector or keep_corrector
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(F.array(N.prepare(F.col(text_col)))).alias("original"))
    base = base.withColumn("skip", unprocessed(F.col("original")))
    todo = base.where(~F.col("skip")).select(id_col, N.pre_correct(F.col("original")).alias("pre"))
    typed = telex.lookup_words(todo, id_col, "pre", d.telex).select(id_col, F.col("corrected").alias("typed"))
    detected = detector(typed, id_col, "typed").select(id_col, F.col("out").alias("detected"))
    vocab = vocabulary.correct_tagged(detected, id_col, "detected", d.bigrams, settings.least).select(
        id_col, N.squeeze(N.untag_exceptions(F.col("retagged")), keep_double=False).alias("tagged")
    )
    model = corrector(vocab, id_col, "tagged").select(id_col, F.col("out").alias("model"))
    gated = vocab.join(model, id_col).select(
        id_col, T.gated(F.col("tagged"), reverted(F.col("tagged"), F.coalesce("model", F.lit("")), settings.revert), settings.match).alias("fixed")
    )
    out = base.join(gated, id_col, "left").select(
        id_col, "original", F.when(F.col("skip"), F.col("original")).otherwise(N.restore_unknown(F.coalesce("fixed", "original"), F.col("original"))).alias("corrected")
    )
    same = F.array().cast(T.EDIT)
    return out.select(id_col, "original", "corrected", F.when(F.col("corrected") != F.col("original"), T.word_edits(N.drop_punctuation(F.col("original")), F.col("corrected"))).otherwise(same).alias("edits"))
