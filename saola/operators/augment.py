"""Synthetic spelling errors. Every random choice is a pure function of (key, purpose), so a row comes out the
same at any partitioning and in any engine; key names the seed, the row and the word.

Word operators return struct<word, errors>. A null word gives null, an empty word stays empty."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .normalize import clean_sentence, mapping
from .tagging import tag_errors
from .telex import variants

SPAN = 4294967296.0
ShapeP = 0.4
WordError = Callable[[Column, Column], Column]


def draw(key: Column, purpose: str) -> Column:
    """A whole number in [0, 2^32)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(purpose))), 1, 8), 16, 10).cast("bigint")


def unit(key: Column, purpose: str) -> Column:
    return draw(key, purpose) / SPAN


def pick(options: Column, key: Column, purpose: str) -> Column:
    return F.element_at(options, (F.pmod(draw(key, purpose), F.size(options)) + 1).cast("int"))


def result(word: Column, errors: Column) -> Column:
    return F.struct(word.alias("word"), errors.cast("int").alias("errors"))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def _table(table: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _last_spots(word: Column, letters: str) -> Column:
    """0-based last positions of the distinct given letters of a word, in order."""
    chars = F.split(word, "")
    at = F.transform(chars, lambda c, i: F.when((F.instr(F.lit(letters), c) > 0) & (c != "") & ~F.substring(word, i + 2, 1_000_000).contains(c), i))
    return F.filter(at, lambda i: i.isNotNull())


def _replace_at(word: Column, spots: Column, new: Callable[[Column, Column], Column]) -> Column:
    """The letters at the given positions replaced by new(letter, position)."""
    return F.array_join(F.transform(F.split(word, ""), lambda c, i: F.when(F.array_contains(spots, i), new(c, i)).otherwise(c)), "")


def drop_shapes(word: Column, key: Column) -> Column:
    """Breves, hats, horns and bars lost: a random non-empty choice of the eligible letters, each with chance 0.4.

    The first hit comes from its exact distribution given that there is one; later letters are independent."""
    table = mapping(K.DROP_SHAPE)

    def of(spots: Column) -> Column:
        n = F.size(spots)
        first = F.floor(F.ln(F.lit(1.0) - unit(key, "shape") * (1 - F.pow(F.lit(1 - ShapeP), n))) / F.ln(F.lit(1 - ShapeP)))
        hits = F.filter(spots, lambda s, j: (j == first) | ((j > first) & (unit(F.concat_ws("|", key, j), "shape") < ShapeP)))
        return bind(hits, lambda h: result(_replace_at(word, h, lambda c, i: table[c]), F.size(h)))

    return bind(_last_spots(word, "".join(K.DROP_SHAPE)), lambda s: F.when(F.size(s) == 0, result(word, F.lit(0))).otherwise(of(s)))


def drop_tones(word: Column, key: Column | None = None) -> Column:
    """Tones lost at the last occurrence of each distinct toned letter; not random."""
    table = mapping(K.DROP_TONE)
    return bind(_last_spots(word, "".join(K.DROP_TONE)), lambda s: result(_replace_at(word, s, lambda c, i: table[c]), F.size(s)))


def add_tones(word: Column, key: Column) -> Column:
    """A random tone on the last occurrence of each distinct toneless vowel."""
    table = _table(K.ADD_TONE)
    return bind(_last_spots(word, K.VOWELS), lambda s: result(_replace_at(word, s, lambda c, i: pick(table[c], F.concat_ws("|", key, i), "tone")), F.size(s)))


def delete_letters(word: Column, key: Column, n: int = 1) -> Column:
    """n random letters lost; words of n letters or fewer stay."""

    def once(w: Column, k: int) -> Column:
        return bind(F.pmod(draw(key, f"delete{k}"), F.length(w)).cast("int"), lambda p: F.concat(F.substring(w, F.lit(1), p), F.substring(w, p + 2, F.length(w))))

    out = word
    for k in range(n):
        out = bind(out, partial(once, k=k))
    return F.when(F.length(word) <= n, result(word, F.lit(0))).otherwise(result(out, F.lit(n)))


def insert_letters(word: Column, key: Column, n: int = 1) -> Column:
    """n random letters added, each behind a random letter, so never at the head."""
    letters = F.array(*map(F.lit, K.ALPHABET))

    def once(w: Column, k: int) -> Column:
        place = (F.pmod(draw(key, f"place{k}"), F.length(w)) + 1).cast("int")
        return bind(place, lambda p: F.concat(F.substring(w, F.lit(1), p), pick(letters, key, f"letter{k}"), F.substring(w, p + 1, F.length(w))))

    out = word
    for k in range(n):
        out = bind(out, partial(once, k=k))
    return F.when(F.length(word) == 0, result(word, F.lit(0))).otherwise(result(out, F.lit(n)))


def misspell_head(word: Column, key: Column) -> Column:
    """Head consonant confused. A two-letter head changes wherever the pair occurs, a one-letter head only first."""
    table = _table(K.MISSPELT_HEADS)
    two, one = F.left(word, F.lit(2)), F.left(word, F.lit(1))
    # a one-letter word reads as its own two-letter head and takes the first branch with the same table entry
    return (
        F.when(table[two].isNotNull(), result(F.replace(word, two, pick(table[two], key, "head")), F.lit(1)))
        .when(table[one].isNotNull(), result(F.concat(pick(table[one], key, "head"), F.substring(word, 2, 1_000_000)), F.lit(1)))
        .otherwise(result(word, F.lit(0)))
    )


def misspell_tail(word: Column, key: Column) -> Column:
    """Tail consonant confused, the longest ending first; without one, a head letter of the tail table changes."""
    table = _table(K.MISSPELT_TAILS)
    out = None
    for k in (3, 2, 1):
        end = F.right(word, F.lit(k))
        hit = result(F.concat(F.left(word, F.greatest(F.length(word) - k, F.lit(0))), pick(table[end], key, "tail")), F.lit(1))
        test = table[end].isNotNull() & (end != "")
        out = F.when(test, hit) if out is None else out.when(test, hit)
    head = F.left(word, F.lit(1))
    return out.when(table[head].isNotNull() & (head != ""), result(F.concat(pick(table[head], key, "tail"), F.substring(word, 2, 1_000_000)), F.lit(1))).otherwise(result(word, F.lit(0)))


def misspell_vowel(word: Column, key: Column | None = None) -> Column:
    """The first matching vowel group of the table, wherever it occurs; not random."""
    out = None
    for k, v in K.MISSPELT_VOWELS.items():
        hit = result(F.replace(word, F.lit(k), F.lit(v)), F.lit(1))
        out = F.when(word.contains(k), hit) if out is None else out.when(word.contains(k), hit)
    return out.otherwise(result(word, F.lit(0)))


def telex_error(word: Column, key: Column) -> Column:
    """One of the other keyboard forms of the word."""

    def of(all_forms: Column) -> Column:
        others = F.filter(all_forms, lambda v: (v != word) | (F.size(all_forms) == 1))
        return bind(pick(others, key, "telex"), lambda w: result(w, (w != word).cast("int")))

    return bind(variants(word), of)


def chain(*functions: WordError) -> WordError:
    """Several word errors after one another; error counts add up."""

    def run(word: Column, key: Column) -> Column:
        def add(x: Column, k: int) -> Column:
            return bind(functions[k](x["word"], F.concat_ws("|", key, F.lit(f"step{k}"))), lambda y: result(y["word"], x["errors"] + y["errors"]))

        out = result(word, F.lit(0))
        for k in range(len(functions)):
            out = bind(out, partial(add, k=k))
        return out

    return run


MAIN: tuple[WordError, ...] = (
    chain(drop_shapes, drop_tones), chain(telex_error, delete_letters), chain(telex_error, insert_letters),
    drop_shapes, drop_tones, misspell_tail, misspell_head,
)
SECONDARY: tuple[WordError, ...] = (delete_letters, insert_letters, add_tones)


def ranked(n: Column, key: Column) -> Column:
    """A seeded order of the positions 0..n-1."""
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(draw(F.concat_ws("|", key, i), "rank").alias("d"), i.cast("int").alias("i")))
    return F.transform(F.array_sort(drawn), lambda x: x["i"])


def controlled_errors(sentence: Column, key: Column, ratio: Column, choices: Column, shares: Column, functions: Sequence[WordError]) -> Column:
    """Errors in a share `ratio` of the words. choices: indexes into functions, shares: the part of the error words
    that each choice gets; consecutive parts of a seeded order of the positions go to the choices in turn."""
    words = F.split(sentence, " ")
    total = F.ceil(F.least(ratio, F.lit(1.0)) * F.size(words)).cast("int")

    def mutate(w: Column, f: Column, k: Column) -> Column:
        out = None
        for j, fn in enumerate(functions):
            new = fn(w, k)["word"]
            out = F.when(f == j, new) if out is None else out.when(f == j, new)
        return out.otherwise(w)

    def of(state: Column) -> Column:
        # ends[j]: number of error words given to the first j + 1 choices
        ends = F.transform(shares, lambda s, j: F.aggregate(F.slice(shares, F.lit(1), j + 1), F.lit(0), lambda a, x: a + F.ceil(x * state["total"]).cast("int")))
        return bind(
            ends,
            lambda e: F.array_join(
                F.transform(
                    state["words"],
                    lambda w, i: bind(
                        F.array_position(state["order"], i.cast("int")).cast("int") - 1,
                        lambda rank: F.when(
                            rank < F.least(state["total"], F.element_at(e, -1)),
                            mutate(w, F.get(choices, F.size(F.filter(e, lambda x: x <= rank))), F.concat_ws("|", key, i)),
                        ).otherwise(w),
                    ),
                ),
                " ",
            ),
        )

    return bind(F.struct(words.alias("words"), total.alias("total"), ranked(F.size(words), key).alias("order")), of)


def error_plan(key: Column) -> Column:
    """struct<ratio, choices, shares> of a row: a share of about a fifth of the words; one to three main and one or
    two secondary errors, with repeats; each secondary error gets a fifth, the main errors the rest."""
    # Box-Muller; values of one and below are drawn anew from U(1, 6)
    normal = 2 + F.sqrt(-2 * F.ln(1 - unit(key, "normal1"))) * F.cos(2 * 3.141592653589793 * unit(key, "normal2"))
    size = F.round(F.when(normal > 1, normal).otherwise(1 + 5 * unit(key, "uniform")), 6)
    main, second = (F.pmod(draw(key, "mains"), F.lit(3)) + 1).cast("int"), (F.pmod(draw(key, "seconds"), F.lit(2)) + 1).cast("int")
    chosen = F.concat(
        F.transform(F.sequence(F.lit(1), main), lambda i: F.pmod(draw(F.concat_ws("|", key, i), "main"), F.lit(len(MAIN))).cast("int")),
        F.transform(F.sequence(F.lit(1), second), lambda i: (len(MAIN) + F.pmod(draw(F.concat_ws("|", key, i), "second"), F.lit(len(SECONDARY)))).cast("int")),
    )
    shares = F.concat(
        F.transform(F.sequence(F.lit(1), main), lambda i: F.round((1 - 0.2 * second) / main, 6)),
        F.transform(F.sequence(F.lit(1), second), lambda i: F.lit(0.2).cast("double")),
    )
    return F.struct((size / 10).alias("ratio"), chosen.alias("choices"), shares.alias("shares"))


def training_rows(df: DataFrame, id_col: str, text_col: str, seed: int = 42) -> DataFrame:
    """(id, corrected, input_text, detected, new_target): clean sentences with synthetic errors and their tags.

    One narrow stage: no shuffle, whatever the size. Rows whose cleaned sentence is empty or null are dropped."""
    # the one-row explodes keep each step's value from being copied into the next expression
    key = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))
    rows = (
        df.select(F.col(id_col), clean_sentence(F.col(text_col)).alias("corrected")).where("corrected <> ''")
        .select(id_col, "corrected", key.alias("_key"), F.explode(F.array(error_plan(key))).alias("_p"))
    )
    made = controlled_errors(F.col("corrected"), F.col("_key"), F.col("_p.ratio"), F.col("_p.choices"), F.col("_p.shares"), (*MAIN, *SECONDARY))
    noisy = rows.select(id_col, "corrected", F.explode(F.array(made)).alias("input_text"))
    return noisy.select(id_col, "corrected", "input_text", F.explode(F.array(tag_errors(F.col("corrected"), F.col("input_text")))).alias("_t")).select(
        id_col, "corrected", "input_text", F.col("_t.detected").alias("detected"), F.col("_t.target").alias("new_target")
    )


def chat_words(text: Column, key: Column, chance: float = 0.35) -> Column:
    """Common words in chat spelling, each with the given chance."""
    table = mapping(K.CHAT)
    words = F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(table[w].isNotNull() & (unit(F.concat_ws("|", key, i), "chat") < chance), table[w]).otherwise(w)), " ")


def swap_ends(text: Column, key: Column, chance: float = 0.1) -> Column:
    """struct<text, rates>: head d, v and tail t, c confused, each with the given chance; a word that was hit has
    rate 0, others 1."""

    def of(w: Column, i: Column) -> Column:
        k = F.concat_ws("|", key, i)
        head, tail = F.left(w, F.lit(1)), F.right(w, F.lit(1))
        h = F.when(head.isin(*K.HEAD_SWAPS) & (unit(k, "head") < chance), mapping(K.HEAD_SWAPS)[head])
        t = F.when((F.length(w) > 1) & tail.isin(*K.TAIL_SWAPS) & (unit(k, "tail") < chance), mapping(K.TAIL_SWAPS)[tail])
        # a one-letter t or c is its own head and tail
        t = F.coalesce(t, F.when((F.length(w) == 1) & tail.isin(*K.TAIL_SWAPS) & (unit(k, "tail") < chance), mapping(K.TAIL_SWAPS)[tail]))
        mid = F.substring(w, 2, 1_000_000)
        body = F.when(F.length(w) > 1, F.left(mid, F.length(mid) - 1)).otherwise(F.lit(""))
        end = F.when(F.length(w) > 1, F.coalesce(t, tail)).otherwise(F.lit(""))
        start = F.when(F.length(w) > 1, F.coalesce(h, head)).otherwise(F.coalesce(h, t, head))
        return F.struct(F.concat(start, body, end).alias("w"), F.when(h.isNotNull() | t.isNotNull(), 0.0).otherwise(1.0).alias("r"))

    return bind(F.transform(F.split(text, " "), of), lambda a: F.struct(F.array_join(F.transform(a, lambda x: x["w"]), " ").alias("text"), F.transform(a, lambda x: x["r"]).alias("rates")))
