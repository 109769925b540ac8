"""Predicates over sentences and words. All are native expressions; patterns avoid engine-specific classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

SPACE = r"[\s\p{Z}]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: A letter next to a digit or @, two ASCII capitals in one word, an inner bracket, comma or dash, or cooh.
FORMULA = r"[A-Za-z][\p{Nd}@]|[\p{Nd}@][A-Za-z]|[A-Z][\p{L}\p{N}_]*[A-Z]|[^\s\p{Z}][(),-][^\s\p{Z}]|cooh"
ROMAN = "^[xivXIVl]*$"
NOTATION = r"[=+*^%\[\]]"
QUOTING = '[/“"”]'


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def has_url(text: Column) -> Column:
    return text.contains("http")


def too_short(text: Column, least: int = 5) -> Column:
    """Fewer than `least` pieces between single spaces; empty pieces count."""
    return F.size(F.split(text, " ")) < least


def unaccented(text: Column) -> Column:
    """True where the text has no letter beyond ASCII."""
    return ~text.rlike(r"[^\x00-\x7F]")


def punctuated(text: Column, most: int = 5) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, ASCII_PUNCTUATION, "")) > most


def rejected(text: Column) -> Column:
    """Lines that are unfit for a training corpus."""
    return has_url(text) | too_short(text) | unaccented(text) | punctuated(text) | text.rlike(QUOTING)


def filter_corpus(df: DataFrame, text_col: str) -> DataFrame:
    """Rows of df with a fit text, which comes out stripped. Null texts are dropped."""
    return df.where(F.col(text_col).isNotNull() & ~rejected(F.col(text_col))).withColumn(text_col, strip(F.col(text_col)))


def is_roman(word: Column) -> Column:
    """Only letters of Roman numerals (or the look-alike l); the empty word counts."""
    return word.rlike(ROMAN)


def has_notation(text: Column) -> Column:
    return text.rlike(NOTATION)


def has_formula(text: Column) -> Column:
    return text.rlike(FORMULA)


def is_special(word: Column) -> Column:
    return word.isin(K.ERROR, K.END_ERROR, K.EXCEPTION)


def has_unknown(text: Column) -> Column:
    return text.contains("<unk>")


def has_adjacent_errors(text: Column) -> Column:
    return F.lower(text).contains("</error> <error>")


def starts_with_error(text: Column) -> Column:
    return text.startswith(K.ERROR)


def ends_with_error(text: Column) -> Column:
    return text.endswith(K.END_ERROR)


def has_error(text: Column) -> Column:
    return text.contains(K.ERROR)


Detector = Callable[[Column], Column]


def unprocessed(text: Column, detectors: Sequence[Detector] = (has_formula, has_notation)) -> Column:
    """True for texts that correction leaves alone: any detector fires, or the text is empty."""
    out = text == ""
    for d in detectors:
        out = out | d(text)
    return out


def split_unprocessed(df: DataFrame, text_col: str, detectors: Sequence[Detector] = (has_formula, has_notation)) -> tuple[DataFrame, DataFrame]:
    """(processable rows, untouched rows); nulls are in neither."""
    flagged = df.where(F.col(text_col).isNotNull())
    return flagged.where(~unprocessed(F.col(text_col), detectors)), flagged.where(unprocessed(F.col(text_col), detectors))


def changed_edits(edits: Column) -> Column:
    """Edits (structs with origin and corrected) that change something."""
    return F.filter(edits, lambda e: e["origin"] != e["corrected"])
