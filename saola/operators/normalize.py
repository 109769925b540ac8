"""Cleaning and normalising of sentences. Null in, null out, for every expression."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .filters import FORMULA, ROMAN, SPACE, strip

REPEATABLE = "".join(c for c in K.WORD_LETTERS if c not in K.KEPT_REPEATS)
WORD_CHAR = r"[\p{L}\p{N}_]"


def mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def pieces(text: Column) -> Column:
    """Words between runs of white space, without empty ones."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def clean_line(text: Column) -> Column:
    return strip(F.replace(text, F.lit("\n"), F.lit("")))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def drop_punctuation(text: Column) -> Column:
    """Without ASCII punctuation other than < > /, with single spaces."""
    gone = "".join(c for c in K.PUNCTUATION if c not in K.KEPT_PUNCTUATION)
    return single_spaces(F.translate(text, gone, ""))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, "“–”", '"-"')


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; the JVM functions have no normaliser."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def repeat_runs(word: Column, limit: int) -> Column:
    """Runs of more than `limit` equal word characters."""
    return F.regexp_extract_all(word, F.lit(rf"(({WORD_CHAR})\2{{{limit},}})"), F.lit(1))


def words_with_repeats(text: Column, limit: int) -> Column:
    """array<struct<word, word_index, repeat_chars>> of the words between single spaces that hold a run."""
    found = F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("word"), i.alias("word_index"), repeat_runs(w, limit).alias("repeat_chars")))
    return F.filter(found, lambda x: (F.size(x["repeat_chars"]) > 0) & ~x["word"].isin(K.ERROR, K.END_ERROR, K.EXCEPTION))


def _plain_word(w: Column) -> Column:
    return ~w.rlike(ROMAN) & ~w.rlike(FORMULA)


def squeeze_word(word: Column, keep_double: bool = True) -> Column:
    """One word without repeated letters: all but a, o, e, d collapse to one, what repeats still is cut to two
    characters (to one with keep_double=False). Roman numerals, formulas and special tokens stay.

    The word runs through one-element arrays, so each step sees the value of the step before once."""
    limit = 2 if keep_double else 1
    cut = F.regexp_replace
    first = lambda w: F.when(_plain_word(w) & ~w.isin(K.ERROR, K.END_ERROR, K.EXCEPTION), cut(w, rf"([{REPEATABLE}])\1+", "$1")).otherwise(w)
    second = lambda w: F.when(_plain_word(w) & ~w.isin(K.ERROR, K.END_ERROR, K.EXCEPTION), cut(w, rf"({WORD_CHAR})\1{{{limit},}}", "$1" * limit)).otherwise(w)
    return F.transform(F.transform(F.array(word), first), second)[0]


def squeeze(text: Column, keep_double: bool = True) -> Column:
    """Sentence form of squeeze_word, joined by single spaces."""
    limit = 2 if keep_double else 1
    special = lambda w: w.isin(K.ERROR, K.END_ERROR, K.EXCEPTION)
    first = F.transform(
        pieces(text), lambda w: F.when(_plain_word(w) & ~special(w), F.regexp_replace(w, rf"([{REPEATABLE}])\1+", "$1")).otherwise(w)
    )
    second = F.transform(
        first, lambda w: F.when(_plain_word(w) & ~special(w), F.regexp_replace(w, rf"({WORD_CHAR})\1{{{limit},}}", "$1" * limit)).otherwise(w)
    )
    return F.array_join(second, " ")


def clean_detection(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("<pad>"), F.lit("")), F.lit("</s>"), F.lit("")))


def untagged(text: Column) -> Column:
    """Without error tags, single-spaced and stripped."""
    return strip(single_spaces(F.regexp_replace(text, "</?error>", "")))


def untag_exceptions(text: Column) -> Column:
    """Removes the tags around formulas and Roman numerals. Tags at the ends of a text have one neighbour only."""
    words = pieces(text)
    special = lambda w: w.isin(K.ERROR, K.END_ERROR, K.EXCEPTION)
    exception = lambda w: F.coalesce(~special(w) & (w.rlike(ROMAN) | w.rlike(FORMULA)), F.lit(False))
    kept = F.transform(
        F.array(words),
        lambda ws: F.filter(
            ws,
            lambda w, i: ~(((w == K.ERROR) & exception(F.get(ws, i + 1))) | ((w == K.END_ERROR) & exception(F.get(ws, i - 1)))),
        ),
    )[0]
    return F.array_join(kept, " ")


def join_adjacent_errors(text: Column) -> Column:
    return F.replace(text, F.lit(" </error> <error> "), F.lit(" "))


def clean_sentence(text: Column) -> Column:
    """Cleaning before errors are added: two expansions, some marks dropped, spaces collapsed."""
    out = F.replace(F.replace(text, F.lit("ntn"), F.lit("như thế nào")), F.lit("đ/nghĩa"), F.lit("định nghĩa"))
    return strip(F.regexp_replace(F.translate(out, "–':;", "-"), " {2,}", " "))


def expand_acronyms(text: Column, multiple: bool = False) -> Column:
    """Abbreviations written out: whole words, or (multiple) substrings in table order."""
    if multiple:
        return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), K.MULTIPLE_ACRONYMS.items(), text)
    table = mapping(K.SINGLE_ACRONYMS)
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(table[w], w)), " ")


def pre_correct(text: Column) -> Column:
    """Punctuation out, abbreviations out, repeats out."""
    return squeeze(expand_acronyms(drop_punctuation(text)))


def prepare(text: Column, normalized: bool = False) -> Column:
    """Inference normalisation: NFKC (unless it is normalized already), repeats, spaces, quotes."""
    return strip(plain_quotes(single_spaces(squeeze(text if normalized else nfkc(text)))))


def fold(text: Column, compat: bool = False) -> Column:
    """Base letters of lower-case Vietnamese text. compat keeps a known oddity of the usual table: a letters come
    out as 'ad', toned i and y stay."""
    table = {c: "d" if c == "đ" else p for p, family in K.SHAPES.items() for c in [*family, *(t for b in family for t in K.ADD_TONE.get(b, []))]}
    if compat:
        a = {c for b in K.SHAPES["a"] for c in (b, *K.ADD_TONE[b])}
        return F.regexp_replace(F.translate(text, "".join(table), "".join("\u0001" if c in a else v for c, v in table.items())), "\u0001", "ad")
    table |= {c: b for b in "iy" for c in K.ADD_TONE[b]}
    return F.translate(text, "".join(table), "".join(table.values()))


def restore_unknown(text: Column, original: Column) -> Column:
    """The original where the output holds an unknown token."""
    return F.when(text.contains("<unk>"), original).otherwise(text)


def with_task(text: Column, task: str) -> Column:
    """Task prefix of a training or inference row: 'detection' or 'correction'."""
    return F.concat(F.lit(f"{task}: "), text)
