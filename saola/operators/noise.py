"""The older sentence-level noise, as native folds over letters with seeded draws.

A word has a rate, which falls to FALL of itself with every hit. Every draw is a function of the row, the word, the
letter and the purpose, so a sentence comes out the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .augment import SPAN, bind, draw, pick, swap_ends, unit
from .normalize import fold, mapping

#: What is left of a word's rate after a hit; chance that a step looks at one more letter or makes one more edit.
FALL, MORE = 0.7, 0.2
#: Edits of one word at most: more than this many in a row have a chance of about 1e-11.
EDITS = 16
#: Share of the rows that lose all accents instead.
BARE = 0.06

_TONED = {c: (b, K.TELEX_TONES[k]) for b, cs in K.ADD_TONE.items() for k, c in enumerate(cs)}
_TONES_OF = {c: [b, *cs] for b, cs in K.ADD_TONE.items() for c in (b, *cs)}
_SHAPES_OF = {c: [x for x in family if x != c] for family in K.SHAPES.values() for c in family}


def _lists(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _state(word: Column, rate: Column) -> Column:
    return F.struct(word.alias("w"), rate.cast("double").alias("rate"))


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _at(key: Column, i: Column) -> Column:
    return F.concat_ws("|", key, i.cast("string"))


def _gate(h: Column, n: int) -> Column:
    """The n-th of the four draws in [0, 1) that a word's md5 holds."""
    return F.conv(F.substring(h, 8 * n + 1, 8), 16, 10).cast("bigint") / SPAN


def keyboard(s: Column, key: Column, ratio: float = 0.1) -> Column:
    """Toned letters lose the tone, which is typed at the end; shaped letters come as pairs of keys."""
    known, bases, tones = (F.lit("".join(x)) for x in (_TONED, (b for b, _ in _TONED.values()), (t for _, t in _TONED.values())))
    shaping, shape = F.lit("".join(K.TELEX_SHAPES)), mapping(K.TELEX_SHAPES)
    start = F.struct(F.lit("").alias("head"), F.lit("").alias("tail"), s["rate"].alias("rate"))

    def step(a: Column, x: Column) -> Column:
        c, fall = x["c"], (a["rate"] * FALL).alias("rate")
        toned = F.struct(F.concat(a["head"], F.substring(bases, x["toned"], F.lit(1))).alias("head"), F.concat(a["tail"], F.substring(tones, x["toned"], F.lit(1))).alias("tail"), fall)
        shaped = F.struct(F.concat(a["head"], shape[c]).alias("head"), a["tail"], fall)
        plain = F.struct(F.concat(a["head"], c).alias("head"), a["tail"], a["rate"])
        return F.when((x["toned"] > 0) & (x["chance"] < ratio * a["rate"]), toned).when(x["shaped"] & (x["chance"] < ratio), shaped).otherwise(plain)

    # only letters that can change are drawn for
    open_to = lambda c: F.struct(F.instr(known, c).alias("toned"), (F.instr(shaping, c) > 0).alias("shaped"))
    drawn = lambda c, i, o: F.struct(c.alias("c"), o["toned"], o["shaped"], F.when((o["toned"] > 0) | o["shaped"], unit(_at(key, i), "keys")).alias("chance"))
    placed = F.transform(_letters(s["w"]), lambda c, i: bind(open_to(c), lambda o: drawn(c, i, o)))
    return bind(F.aggregate(placed, start, step), lambda a: _state(F.concat(a["head"], a["tail"]), a["rate"]))


def redrawn(s: Column, key: Column, chance: Column, table: dict[str, list[str]], purpose: str, ratio: float = 0.1) -> Column:
    """The first letters of a word become another of their row in the table; mostly only the first letter is looked at."""
    options = _lists(table)

    def of(letters: Column) -> Column:
        ends = F.array_position(F.transform(letters, lambda c, i: unit(_at(key, i), f"{purpose} more") > MORE), True)
        seen = F.when(ends > 0, ends).otherwise(F.size(letters))
        hits = F.transform(letters, lambda c, i: (i < seen) & options[c].isNotNull())
        new = F.transform(letters, lambda c, i: F.when((i < seen) & options[c].isNotNull(), pick(options[c], _at(key, i), purpose)).otherwise(c))
        return _state(F.array_join(new, ""), s["rate"] * F.pow(F.lit(FALL), F.size(F.filter(hits, lambda h: h))))

    return F.when(chance < ratio * s["rate"], bind(_letters(s["w"]), of)).otherwise(s)


def mistyped(s: Column, key: Column, chance: Column, ratio: float = 0.05) -> Column:
    """Letters replaced, added or lost; one in five edits is followed by another, a loss never. The last letter of the
    alphabet is never drawn, as the established behaviour has it."""
    alphabet = F.array(*map(F.lit, K.ALPHABET[:-1]))

    def edit(a: Column, n: Column) -> Column:
        k = _at(key, n)
        place = F.pmod(draw(k, "place"), F.size(a["cells"])).cast("int")
        kind, letter = F.pmod(draw(k, "kind"), F.lit(3)), pick(alphabet, k, "letter")
        lost = (kind == 1) & (F.length(F.array_join(a["cells"], "")) > 1)
        cells = F.transform(a["cells"], lambda c, i: F.when(i != place, c).when(lost, "").when(kind == 0, letter).otherwise(F.concat(c, letter)))
        done = F.struct(cells.alias("cells"), F.when(lost, a["rate"]).otherwise(a["rate"] * FALL).alias("rate"), (~lost & (unit(k, "again") <= MORE)).alias("live"))
        return F.when(a["live"], done).otherwise(a)

    start = F.struct(_letters(s["w"]).alias("cells"), s["rate"].alias("rate"), F.lit(True).alias("live"))
    edited = bind(F.aggregate(F.sequence(F.lit(1), F.lit(EDITS)), start, edit), lambda a: _state(F.array_join(a["cells"], ""), a["rate"]))
    return F.when((F.length(s["w"]) > 1) & (chance < ratio * s["rate"]), edited).otherwise(s)


def noisy_word(word: Column, rate: Column, key: Column) -> Column:
    """Keyboard, tone, shape and letter noise on one word."""

    def of(h: Column) -> Column:
        typed = bind(_state(word, rate), lambda s: keyboard(s, key))
        toned = bind(typed, lambda s: redrawn(s, key, _gate(h, 0), _TONES_OF, "retone"))
        shaped = bind(toned, lambda s: redrawn(s, key, _gate(h, 1), _SHAPES_OF, "reshape"))
        return bind(shaped, lambda s: mistyped(s, key, _gate(h, 2)))["w"]

    return bind(F.md5(key), of)


def noisy_sentence(df: DataFrame, id_col: str, text_col: str, seed: int = 42) -> DataFrame:
    """(id, noisy): six rows in a hundred lose all accents; the words of the others pass the steps of noisy_word, with
    rate 0 where their ends would be swapped (the swapped text itself is not kept). Null gives null. One narrow stage."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))
    text = F.col(text_col)

    def of(rates: Column) -> Column:
        word = lambda w, i: bind(F.concat_ws("|", key, F.lit("noise"), i.cast("string")), lambda k: noisy_word(w, F.get(rates, i), k))
        return F.array_join(F.transform(F.split(text, " "), word), " ")

    return df.select(id_col, F.when(unit(key, "bare") < BARE, fold(text, compat=True)).otherwise(F.when(text.isNotNull(), bind(swap_ends(text, key)["rates"], of))).alias("noisy"))
