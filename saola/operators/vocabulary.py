"""Dictionaries built from a corpus, and correction of tagged words by them.

Groups are pairs of neighbouring words. Candidates are scored once per distinct group, whatever the number of
sentences that hold it, and joined back.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .filters import strip
from .normalize import pieces, single_spaces
from .telex import encode

#: Least likeness of a candidate.
LEAST = 0.87
#: Most letters deleted from a word to meet another.
DEEP = 2


def corpus_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): lower-case words of letters of a corpus with their counts."""
    words = F.explode(F.split(F.regexp_replace(F.lower(text_col), r"[^\p{L}\s]+", " "), r"\s+"))
    return df.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def telex_dictionary(words: DataFrame, least: int = 2) -> DataFrame:
    """(telex, word): keyboard forms of the words that occur at least `least` times; of words with one form the
    most frequent, ties by text. Forms that are words of the corpus themselves are left out, so correct text stays."""
    known = words.where(F.col("n") >= least).select("word", "n", encode(F.col("word")).alias("telex")).where("telex <> word")
    best = known.groupBy("telex").agg(F.min(F.struct((-F.col("n")).alias("m"), "word"))["word"].alias("word"))
    return best.join(words.select(F.col("word").alias("telex")), "telex", "left_anti")


def bigram_dictionary(df: DataFrame, text_col: str, least: int = 2) -> DataFrame:
    """(left_word, right_word, left_telex, right_telex, n, ord): neighbouring words of a corpus that occur together at
    least `least` times; ord ranks pairs of one keyboard form by frequency."""
    words = F.split(strip(F.regexp_replace(F.lower(text_col), r"[^\p{L}\s]+", " ")), r"\s+")
    pairs = F.explode(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("l"), b.alias("r"))))
    counted = (
        df.where(F.size(words) >= 2).select(pairs.alias("p")).select("p.l", "p.r").where("l <> '' AND r <> ''")
        .groupBy("l", "r").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    )
    coded = counted.select(F.col("l").alias("left_word"), F.col("r").alias("right_word"), encode(F.col("l")).alias("left_telex"), encode(F.col("r")).alias("right_telex"), "n")
    # pairs of one keyboard form are spellings of one pair: a handful
    order = Window.partitionBy("left_telex", "right_telex").orderBy(F.desc("n"), "left_word", "right_word")
    return coded.withColumn("ord", F.row_number().over(order))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one whole-number step per letter of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised indel likeness: twice the common subsequence over both lengths; 1 for two empty words, null for
    null. A fold of native array functions gives the same at about a hundred times the cost."""
    return pd.Series([None if x is None or y is None else round(2 * common_length(x, y) / (len(x) + len(y)), 6) if x or y else 1.0 for x, y in zip(a, b)], dtype="float64")


def deletions(word: Column, most: Column) -> Column:
    """The word and what is left of it after up to `most` (0 to 3) letters are deleted. Two words within an indel
    distance d share one of these for most >= d."""

    def drop(ws: Column) -> Column:
        one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, (i - 1).cast("int")), F.substring(w, (i + 1).cast("int"), F.lit(1_000_000))))
        return F.array_distinct(F.concat(ws, F.flatten(F.transform(F.filter(ws, lambda w: F.length(w) > 0), one))))

    start = F.array(word)
    return F.aggregate(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), start, lambda acc, k: F.when(k == 0, acc).otherwise(drop(acc)))


def _loss(least: float) -> float:
    """Share of its letters that a string can lose at most on the way to one that reaches the likeness: x lost and y
    gained are at most (1 - least) of both lengths n and n - x + y, so (2 - least) x <= 2 (1 - least) n."""
    return 2 * (1 - least) / (2 - least)


def letter_parity(text: Column) -> Column:
    """A bit for each ASCII letter and sign that occurs an odd number of times (others share the rest): an indel
    flips one bit, so the bits in which two strings differ are a lower bound of their indel distance."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"),
        lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(61)))),
    )


def similar_words(wrong: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, score): words a of wrong(a) and b of right(b) with a likeness of at least `least`, complete for any
    length; no pair of all words is formed. Words that lose at most DEEP letters (up to 13 letters at 0.87) meet on
    shared deletions; pairs with a longer word meet on its segments."""
    long = math.ceil((DEEP + 1 - 1e-9) / max(_loss(least), 1e-6))
    # n letters allow 2 (1 - least) n indels to a word that isn't longer: one more segment than that, one is whole there
    size = max(1, int(long / (2 * (1 - least) * long + 1)))
    offered = math.ceil(least / (2 - least) * long - 1e-9)
    none = F.array().cast("array<struct<kind: int, key: string, at: int>>")

    def parts(c: Column, kind: int, step: int, shortest: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)), F.lit(step))
        found = F.transform(at, lambda i: F.struct(F.lit(kind).alias("kind"), F.substring(c, i, F.lit(size)).alias("key"), i.alias("at")))
        return F.when(F.length(c) >= max(shortest, size), found).otherwise(none)

    def keyed(df: DataFrame, name: str, whole: int) -> DataFrame:
        """Kind 0: deletions; kind `whole`: disjoint segments; kind 3 - `whole`: what the other side's segments may meet."""
        c = F.col(name)
        most = F.floor(_loss(least) * F.length(c) + 1e-9).cast("int")
        lost = F.when(F.length(c) < long, F.transform(deletions(c, most), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("key"), F.lit(0).alias("at")))).otherwise(none)
        keys = F.concat(lost, parts(c, whole, size, long), parts(c, 3 - whole, 1, offered))
        once = df.select(name).where(c.isNotNull()).distinct().withColumn(f"p{name}", letter_parity(c))
        return once.select(name, f"p{name}", F.explode(keys).alias("k")).select(name, f"p{name}", "k.kind", "k.key", F.col("k.at").alias(f"at_{name}"))

    # exact bounds on shift, lengths and letters before any string is compared
    indels = (1 - least) * (F.length("a") + F.length("b")) + 1e-9
    apart = F.greatest(F.abs(F.length("a") - F.length("b")), F.abs(F.col("at_a") - F.col("at_b")), F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))))
    # a broadcast would be chosen by the size before the keys are made
    met = keyed(wrong, "a", 1).hint("merge").join(keyed(right, "b", 2).hint("merge"), ["kind", "key"])
    return met.where(apart <= indels).select("a", "b").distinct().withColumn("score", likeness("a", "b")).where(F.col("score") >= least)


def word_groups(tagged: Column) -> Column:
    """array<struct<left_word, right_word, side>> of a tagged sentence. Each tagged word (the first of its tag) gives a
    group with the word before and one with the word after; side names the correct word, 'none' if both are tagged.
    The first word has no word before it."""
    words = pieces(tagged)
    tag = lambda w: w.isin(K.ERROR, K.END_ERROR)

    return F.when(F.size(words) > 0, F.transform(F.array(words), lambda ws: _groups(ws, tag))[0])


def _groups(ws: Column, tag) -> Column:
    flagged = F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("i"), ((i > 0) & (F.get(ws, F.greatest(i - 1, F.lit(0))) == K.ERROR)).alias("e")))
    none = F.array().cast("array<struct<left_word: string, right_word: string, side: string>>")

    def around(ks: Column, k: Column, j: Column) -> Column:
        before, after = F.get(ks, F.greatest(j - 1, F.lit(0))), F.get(ks, j + 1)
        left = F.struct(before["w"].alias("left_word"), k["w"].alias("right_word"), F.when(k["i"] - before["i"] == 3, "none").otherwise("left").alias("side"))
        right = F.struct(k["w"].alias("left_word"), after["w"].alias("right_word"), F.when(after["i"] - k["i"] == 3, "none").otherwise("right").alias("side"))
        found = F.concat(F.when(j > 0, F.array(left)).otherwise(none), F.when(after.isNotNull(), F.array(right)).otherwise(none))
        return F.when(k["e"], found).otherwise(none)

    kept = F.filter(flagged, lambda x: ~tag(x["w"]))
    return F.transform(F.array(kept), lambda ks: F.flatten(F.transform(ks, lambda k, j: around(ks, k, j))))[0]


def group_candidates(groups: DataFrame, bigrams: DataFrame, least: float = LEAST) -> DataFrame:
    """Best dictionary pair of each distinct group: (left_word, right_word, side, left_new, right_new, score).

    One correct side: the pair must hold the correct word, the other word is scored by keyboard form. Both sides
    wrong: the pairs joined by a sign are scored, and meet as joined forms: the sign may stand elsewhere."""
    g = groups.distinct().select("left_word", "right_word", "side", encode(F.col("left_word")).alias("lt"), encode(F.col("right_word")).alias("rt"))
    d = bigrams.where("ord = 1").select(F.col("left_word").alias("left_new"), F.col("right_word").alias("right_new"), "left_telex", "right_telex", F.col("n").alias("freq"))
    wrong = g.where("side = 'right'").select(F.col("lt").alias("a")).union(g.where("side = 'left'").select(F.col("rt").alias("a")))
    near = similar_words(wrong, d.select(F.col("left_telex").alias("b")).union(d.select(F.col("right_telex").alias("b"))), least)
    right = (
        g.where("side = 'right'").join(near.withColumnRenamed("a", "lt").withColumnRenamed("b", "left_telex"), "lt")
        .join(d.withColumn("right_word", F.col("right_new")), ["left_telex", "right_word"])
    )
    left = (
        g.where("side = 'left'").join(near.withColumnRenamed("a", "rt").withColumnRenamed("b", "right_telex"), "rt")
        .join(d.withColumn("left_word", F.col("left_new")), ["right_telex", "left_word"])
    )
    both = g.where("side = 'none'").withColumn("a", F.concat_ws("_", "lt", "rt"))
    want = d.withColumn("b", F.concat_ws("_", "left_telex", "right_telex"))
    none = both.join(similar_words(both.select("a"), want.select("b"), least), "a").join(want, "b")
    cols = ["left_word", "right_word", "side", "left_new", "right_new", "freq", "score"]
    scored = right.select(*cols).unionByName(left.select(*cols)).unionByName(none.select(*cols)).where(F.col("score") >= least)
    best = scored.groupBy("left_word", "right_word", "side").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("freq")).alias("f"), "left_new", "right_new")).alias("b"))
    return best.select("left_word", "right_word", "side", F.col("b.left_new").alias("left_new"), F.col("b.right_new").alias("right_new"), (-F.col("b.s")).alias("score"))


def correct_tagged(df: DataFrame, id_col: str, tagged_col: str, bigrams: DataFrame, least: float = LEAST) -> DataFrame:
    """df with `retagged`: tagged words that the dictionary knows in their neighbourhood are replaced and lose
    their tags, token by token. Of a word's groups the one with the better score decides. Ids must be unique."""
    base = df.select(id_col, single_spaces(F.col(tagged_col)).alias("_t"))
    long = base.select(id_col, F.posexplode(word_groups(F.col("_t"))).alias("gp", "g")).select(id_col, "gp", "g.*")
    best = group_candidates(long.select("left_word", "right_word", "side"), bigrams, least).where("left_new <> left_word OR right_new <> right_word")
    hits = long.join(best, ["left_word", "right_word", "side"]).select(
        id_col,
        F.explode(F.array(
            F.struct(F.col("left_word").alias("old"), F.col("left_new").alias("new"), "score"),
            F.struct(F.col("right_word").alias("old"), F.col("right_new").alias("new"), "score"),
        )).alias("x"),
    ).where("x.old <> x.new")
    chosen = hits.groupBy(id_col, F.col("x.old").alias("old")).agg(F.min(F.struct((-F.col("x.score")).alias("s"), F.col("x.new").alias("new")))["new"].alias("new"))
    maps = chosen.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("old", "new")))).alias("_m"))
    units = F.regexp_extract_all(F.concat(F.col("_t"), F.lit(" ")), F.lit("(<error> [^ ]+ </error>|[^ ]+) "), F.lit(1))
    fixed = F.array_join(F.transform(units, lambda u: F.when(u.startswith(K.ERROR + " "), F.coalesce(F.col("_m")[F.regexp_replace(u, "</?error>| ", "")], u)).otherwise(u)), " ")
    done = base.join(maps, id_col, "left").select(id_col, F.when(F.col("_m").isNull(), F.col("_t")).otherwise(fixed).alias("retagged"))
    return df.join(done, id_col, "left")
