"""Problem 6: text that looks right but holds other characters than it seems to.

Text is brought to one form in three steps: ignorable characters go, spaces become ordinary ones and
compatibility forms of letters, digits and marks become plain (NFKC per character, then NFC); each word
that still holds a letter from outside the Latin and Vietnamese alphabets becomes a lattice of
look-alike letters, and the Viterbi path under a character bigram model of Vietnamese is taken. Symbols
that look like nothing else, and emoji with their joiners, stay.

Null and empty texts need no change. A garbled text (see encoding) is no case and is restored, not
normalised.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import letters, repair, suspicious

#: Look-alikes that neither compatibility normalization nor the character's name gives (fixed values).
SHAPES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "ɗ": "d", "е": "e", "є": "e", "ε": "e", "ғ": "f",
    "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ı": "i", "ɩ": "i", "ι": "i", "ɪ": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "ⅼ": "l",
    "м": "m", "η": "n", "ո": "n", "п": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "τ": "t", "υ": "u", "ս": "u", "ц": "u", "ν": "v", "ѵ": "v", "ʋ": "v", "ԝ": "w", "ω": "w", "ѡ": "w", "х": "x", "χ": "x",
    "у": "y", "γ": "y", "ү": "y", "ᴢ": "z", "ζ": "z", "ӑ": "ă", "ѐ": "è", "й": "n",
}
CAPITALS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "В": "B", "Н": "H", "У": "Y", "Ү": "Y", "Т": "T", "М": "M", "Ѕ": "S", "Ԁ": "D", "П": "N", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ",
}
#: Letters that may be read in more than one way.
ALSO = {"υ": "uv", "ν": "vn", "η": "nh", "п": "n", "ӏ": "li", "ι": "il", "у": "yu", "н": "hn", "в": "bv", "т": "tm", "и": "u", "γ": "yv"}
#: Log score that a reading other than the nearest shape must make up for.
RARER = 3.0
IGNORABLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0}


@cache
def ignorable(c: str) -> bool:
    return ord(c) in IGNORABLE or unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F


@cache
def symbol(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or 0x1F000 <= ord(c) <= 0x1FAFF


@cache
def foreign(c: str) -> bool:
    """A letter that is neither Latin nor Vietnamese by its base."""
    if not unicodedata.category(c).startswith("L"):
        return False
    base = unicodedata.normalize("NFD", c)[0]
    return not (base.isascii() or c in "đĐªºßæÆøØœŒðþÞłŁħŋ")


@cache
def standing(c: str) -> bool:
    """A Greek letter that may stand alone as a symbol: it looks like no Latin capital."""
    return 0x370 <= ord(c) <= 0x3FF and c not in "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"


@cache
def compatible(c: str) -> str:
    """Plain form of a letter, digit, mark or space of unusual width or style; other characters stay."""
    cat = unicodedata.category(c)
    if cat == "Zs":
        return " "
    if c in "  \x85":
        return "\n"
    wide = 0xFF01 <= ord(c) <= 0xFFEE or 0xFE50 <= ord(c) <= 0xFE6B
    styled = cat in ("Lu", "Ll", "Nd", "Nl") and (0x2160 <= ord(c) <= 0x217F or 0x1D400 <= ord(c) <= 0x1D7FF or cat == "Nd")
    if (wide or styled) and not c.isascii():
        plain = unicodedata.normalize("NFKC", c)
        if cat == "Nl":
            return plain
        return str(unicodedata.digit(c)) if cat == "Nd" else plain
    return c


@cache
def readings(c: str) -> str:
    """Letters that c may stand for, in its case."""
    if c in CAPITALS:
        return CAPITALS[c]
    low = c.lower()
    found = ALSO.get(low) or SHAPES.get(low) or SHAPES.get(c) or ""
    if not found:
        plain = unicodedata.normalize("NFKC", c)
        name = unicodedata.name(c, "").split()
        if plain.isascii() and plain.isalpha():
            found = plain.lower()
        elif name and len(name[-1]) == 1:
            found = name[-1].lower()
    return (found.upper() if c.isupper() else found) or c


def bigram_model(texts: Iterable[str]) -> dict[str, dict[str, float]]:
    """Log scores of letter pairs within words (base letters without tones), with add-one smoothing."""
    count: dict[str, Counter] = defaultdict(Counter)
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            bare = "^" + "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) + "$"
            for a, b in zip(bare, bare[1:]):
                count[a][b] += 1
    return {a: {b: math.log((n + 1) / (sum(c.values()) + 40)) for b, n in c.items()} for a, c in count.items()}


def _score(model: dict, a: str, b: str) -> float:
    return model.get(a.lower(), {}).get(b.lower(), -7.0)


def word_path(word: str, model: dict) -> str:
    """Viterbi path through the look-alike lattice of a decomposed word."""
    chars = unicodedata.normalize("NFD", word)
    # states: last base letter -> (score, text so far)
    states: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for c in chars:
        if unicodedata.combining(c):
            states = {k: (s, t + c) for k, (s, t) in states.items()}
            continue
        options = readings(c) if foreign(c) else c
        states = {
            o: max(((s + _score(model, k, o) - RARER * (i > 0), t + o) for k, (s, t) in states.items()), key=lambda x: x[0])
            for i, o in enumerate(options)
        }
    end = max(((s + _score(model, k, "$"), t) for k, (s, t) in states.items()), key=lambda x: x[0])
    return unicodedata.normalize("NFC", end[1])


TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def plain(text: str | None, model: dict) -> tuple[bool, str | None]:
    """(needed a change, text in the consistent form)."""
    if not text or text.isascii():
        return False, text
    out: list[str] = []
    changed = False
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
            continue
        if ignorable(c):
            # variation selectors and joiners belong to the symbol before them
            if i and (symbol(text[i - 1]) or i > 1 and ignorable(text[i - 1]) and symbol(text[i - 2])) and (ord(c) in (0x200D, 0xFE0E, 0xFE0F) or ord(c) > 0xE0000):
                out.append(c)
            else:
                changed = True
            continue
        p = compatible(c)
        changed |= p != c
        out.append(p)
    flat = "".join(out)
    composed = unicodedata.normalize("NFC", flat)
    changed |= composed != flat
    usual = set(letters())
    if any(not c.isascii() and c not in usual and foreign(c) for c in composed):
        parts, at = [], 0
        for m in TOKEN.finditer(composed):
            w = m.group()
            odd = [c for c in w if foreign(c)]
            if not odd or all(standing(c) for c in w):
                continue
            best = word_path(w, model)
            changed |= best != w
            parts += [composed[at : m.start()], best]
            at = m.end()
        composed = "".join(parts) + composed[at:]
    stray = re.search(r"[A-Za-zÀ-ỹ][̀-ͯ]", composed)
    return bool(changed or stray), composed


def consistent(df: DataFrame, text_col: str, samples: list[str]) -> DataFrame:
    """The rows of df that need another form, with plain_text, which replaces a column of its name; garbled rows are
    left out.

    samples: Vietnamese texts of bounded size that the letter model is trained on.
    """
    model = bigram_model(samples)
    df = df.drop("plain_text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            forms = [form if changed and not repair(t)[0] else None for t in part[text_col] for changed, form in [plain(t, model)]]
            part["plain_text"] = pd.Series(forms, index=part.index, dtype="object")
            yield part[[f is not None for f in forms]]

    out = T.StructType([*df.schema.fields, T.StructField("plain_text", T.StringType())])
    return df.where(suspicious(F.col(text_col))).mapInPandas(run, out)
