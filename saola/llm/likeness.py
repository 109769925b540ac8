"""Problems 3 and 5: pairs of texts whose words are alike.

Likeness of two texts is the number of words in common (with repeats) over the words in either. Both joins give pairs of
classes of equal texts and the rows of each class (Alike); only `rows` expands them to pairs of rows. Their steps:

1. texts with the same words in the same order become one class, so copies never meet each other;
2. the words of a class are put in one order for all texts, rare words first. Two alike texts of n and m words share
   t / (1 + t) * (n + m) words or more, so the first k words that they share stand among the first words of both (see
   `Keys`). Each class sends a 128-bit parity fingerprint to its single words there, and where a word is shared by very
   many classes to its pairs, triples and so on of words instead, so no key is capped and no pair is lost;
3. fingerprints that meet at a key are compared: likeness t bounds the differing words by (1 - t) / (1 + t) of all
   words, which bounds the differing bits, so this step is exact;
4. surviving pairs are verified on the whole word bags.

Every step is complete: all pairs that reach the likeness are found, wherever their words stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, parity, stage, unstage, word_hashes, words
from .copies import form_record, is_form

LIKENESS = 0.6
#: A key of more classes than this is extended by a further word. The number is estimated on one class of SAMPLE, which
#: decides about the plan and never about the result.
HOT_ANCHOR, SAMPLE = 20_000, 16
#: Words whose order is known to all tasks, and words of a key at most.
RANKED, DEPTH = 65_536, 8
#: Keys are joined in passes of about so many classes, one after another, so that the keys of one pass only are on disk.
PASS_CLASSES, PASSES = 250_000, 4
#: Cells of the dynamic programming that are held at once, and keys.
CELLS, MADE = 4_000_000, 1_000_000


@dataclass(frozen=True)
class Alike:
    """pairs (a, b, likeness) of class representatives, and the rows (rep, id) of the classes that have a pair."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame

    def rows(self) -> DataFrame:
        """(left_key, right_key, likeness): the pairs of rows; the best likeness where rows hold several texts."""
        return (
            self.pairs.join(self.left.select(F.col("rep").alias("a"), F.col("id").alias("left_key")), "a")
            .join(self.right.select(F.col("rep").alias("b"), F.col("id").alias("right_key")), "b")
            .groupBy("left_key", "right_key").agg(F.max("likeness").alias("likeness"))
        )


def sketch(df: DataFrame, id_col: str, text: Column, copy_root: bool = False) -> DataFrame:
    """id, word hashes in order, their number, the fingerprint and the class of every text with words. copy_root: texts
    that are the same but for formatting (see copies) have the same root, others are classes of their own."""
    out = (
        df.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("id", "text", words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
    )
    # the leaf of a text that is no form is its words without spaces
    root = F.when(is_form("text"), F.xxhash64(form_record("text"))).otherwise(F.xxhash64(F.array_join("words", ""))) if copy_root else F.lit(0).cast("bigint")
    return out.select("id", word_hashes("words").alias("tokens"), root.alias("root")).select(
        "id", "tokens", "root", F.size("tokens").alias("words"), parity("tokens", 0).alias("f0"), parity("tokens", 1).alias("f1"),
        F.xxhash64("tokens").alias("c0"), F.xxhash64(F.lit("second"), "tokens").alias("c1"),
    )


CLASS = ("c0", "c1", "root")


def classes(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """One row for each distinct word sequence (and root), under a number of its own, its bag in the order of `order`; to
    be staged, which fixes the numbers. Numbers that count up take less room in a shuffle than hashes."""
    firsts = rows.groupBy(*CLASS).agg(F.first("tokens").alias("tokens"), F.first("words").alias("words"), F.first("f0").alias("f0"), F.first("f1").alias("f1"))
    bags = firsts.select(*CLASS, "words", "f0", "f1", numbered("tokens").alias("bag"))
    return bags.mapInArrow(in_order(order), bags.schema).withColumn("rep", F.monotonically_increasing_id())


def frequent_words(rows: DataFrame) -> np.ndarray:
    """The most frequent words (numbered within their text), the most frequent one first, at most RANKED, by the estimate
    of a sample."""
    some = rows.where(F.pmod("c0", F.lit(SAMPLE)) == 0).select(F.explode(numbered("tokens")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return np.array([r["w"] for r in some.where("n > 1").orderBy(F.desc("n"), "w").limit(RANKED).collect()], np.int64)


def cut_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists and the length of each."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def joined_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def in_order(order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that puts the words of bags in one order: words that `order` doesn't name, then the named ones from the
    last to the first."""
    by = np.argsort(order)
    known = order[by]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat, n = cut_lists(part.column("bag"))
            late = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                late = np.where(known[at] == flat, len(known) - by[at], 0)
            bag = joined_lists(flat[np.lexsort((flat, late, np.repeat(np.arange(len(n)), n)))], n)
            yield pa.RecordBatch.from_arrays([bag if name == "bag" else part.column(name) for name in part.schema.names], names=part.schema.names)

    return run


@dataclass(frozen=True)
class Keys:
    """The keys of texts whose bags are in one order.

    A text of n words whose partner has m words shares c = t / (1 + t) * (n + m) or more with it, so the k-th word that
    they share has c - k others behind it and is one of the first n - c + k of either. Shared words are met in the same
    order on both sides; so the tuple of the first k of them is a key of both if each text gives all its tuples whose
    j-th word is among the first n - c + j. A tuple in `hot[k - 1]` is replaced by its extensions by one word, and by a
    key of its own for partners that needn't share more than k. c is taken for the partner with which it is least:
    `longer` where the partners have n words or more, else 0.6 n or more."""

    least: float
    hot: tuple[np.ndarray, ...] = ()
    longer: bool = False
    #: keys of as many words as there are hot lists, and one more, only
    last: bool = False
    part: int = 0
    parts: int = 1

    def of(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the texts of n words each, and their number for each text."""
        bags, starts = flat.view(np.uint64), np.cumsum(n) - n
        partner = n if self.longer else np.ceil(n * self.least - 1e-9)
        common = np.maximum(np.ceil((n + partner) * (self.least / (1 + self.least)) - 1e-9).astype(np.int64), 1)
        keys, texts = [], []

        def give(key: np.ndarray, text: np.ndarray) -> None:
            if self.parts > 1:
                mine = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.parts) == self.part
                key, text = key[mine], text[mine]
            keys.append(key)
            texts.append(text)

        def grow(text: np.ndarray, place: np.ndarray, key: np.ndarray | None, k: int) -> None:
            """The tuples of k words that extend those of k - 1 words whose last one stands at `place`."""
            most = np.maximum(np.minimum(n[text] - common[text] + k, n[text]) - place - 1, 0)
            if (total := int(most.sum())) > MADE and len(text) > 1:
                half = len(text) // 2
                for cut in (slice(None, half), slice(half, None)):
                    grow(text[cut], place[cut], None if key is None else key[cut], k)
                return
            of = np.repeat(np.arange(len(text)), most)
            text, place = text[of], place[of] + 1 + np.arange(total) - np.repeat(np.cumsum(most) - most, most)
            word = bags[starts[text] + place]
            key = word if key is None else longer_key(key[of], word)
            if k <= len(self.hot):
                hot = self.hot[k - 1]
                among = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                if not self.last:
                    give(key[~among], text[~among])
                    ends = among & (common[text] <= k)
                    give(longer_key(key[ends], np.uint64(k)), text[ends])
                if among.any():
                    grow(text[among], place[among], key[among], k + 1)
            else:
                give(key, text)

        grow(np.arange(len(n)), np.full(len(n), -1), None, 1)
        key, text = np.concatenate(keys) if keys else bags[:0], np.concatenate(texts) if texts else starts[:0]
        return key[np.argsort(text, kind="stable")].view(np.int64), np.bincount(text, minlength=len(n))

    def at(self, reps: DataFrame) -> DataFrame:
        """(rep, words, f0, f1, anchor): the fingerprints at their keys."""

        @F.arrow_udf("array<bigint>")
        def run(bags: pa.Array) -> pa.Array:
            return joined_lists(*self.of(*cut_lists(bags)))

        return reps.select("rep", "words", "f0", "f1", F.explode(run("bag")).alias("anchor"))


def longer_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word


def hot_keys(reps: DataFrame, least: float) -> tuple[np.ndarray, ...]:
    """By number of words the keys of more than HOT_ANCHOR classes, by the estimate of a sample; HOT_ANCHOR bounds their
    number by a small part of the keys."""
    some, hot = reps.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0), ()
    while len(hot) < DEPTH:
        counts = Keys(least, hot, last=True).at(some).groupBy("anchor").agg(F.count("*").alias("n"))
        found = np.array([r["anchor"] for r in counts.where(F.col("n") * SAMPLE > HOT_ANCHOR).select("anchor").collect()], np.int64)
        if not len(found):
            break
        hot += (np.sort(found.view(np.uint64)),)
    return hot


def met(left: DataFrame, right: DataFrame, lkeys: Keys, rkeys: Keys, condition: Column) -> DataFrame:
    """Pairs (a, b) of classes whose fingerprints at a key meet the condition on l and r; staged, one pass after another."""
    parts = max(1, min(PASSES, left.count() // PASS_CLASSES))
    passes = []
    for part in range(parts):
        l, r = (replace(keys, part=part, parts=parts).at(reps).alias(side) for keys, reps, side in ((lkeys, left, "l"), (rkeys, right, "r")))
        pairs = l.join(r, (F.col("l.anchor") == F.col("r.anchor")) & condition).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
        passes.append(stage(pairs.distinct(), "met"))
    return reduce(DataFrame.unionByName, passes).distinct()


def near(a: str, b: str, least: float) -> Column:
    """Exact necessary condition on lengths and fingerprints for a likeness of at least `least`."""
    # doubles throughout, since decimals cost many times the rest; fingerprints first, as they tell most pairs apart
    bits = f"bit_count({a}.f0 ^ {b}.f0) + bit_count({a}.f1 ^ {b}.f1) <= ({a}.words + {b}.words) * {(1 - least) / (1 + least)!r}D + 1e-9D"
    return F.expr(f"{bits} AND least({a}.words, {b}.words) >= {least!r}D * greatest({a}.words, {b}.words) - 1e-9D")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose likeness over the whole texts reaches `least`."""
    return (
        pairs.join(left.select(F.col("rep").alias("a"), F.col("bag").alias("ba")), "a")
        .join(right.select(F.col("rep").alias("b"), F.col("bag").alias("bb")), "b")
        .select("a", "b", (F.size("ba") + F.size("bb")).alias("total"), F.size(F.array_intersect("ba", "bb")).alias("common"))
        .where(F.col("common") * (1 + least) >= F.col("total") * least - 1e-9)
        .select("a", "b", (F.col("common") / (F.col("total") - F.col("common"))).alias("likeness"))
    )


def banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Are the words of a[k] turned into those of b[k] by at most most[k] words that are lost or gained? Dynamic
    programming over the diagonals within most[k] of the main one, many pairs at a time."""
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(n - m) <= most)
    live = live[np.lexsort((n[live], most[live]))]
    while len(live):
        size = int(max(1, CELLS // (n[live[0]] + 2 * most[live[0]] + 2)))
        part, live = live[:size], live[size:]
        cut = int(np.searchsorted(np.cumsum(np.maximum.accumulate(n[part] + 2 * most[part] + 2)), CELLS, side="right"))
        part, live = part[: max(1, cut)], np.concatenate([part[max(1, cut) :], live])
        w, rows, far = int(most[part].max()), int(n[part].max()), np.int32(1 << 29)
        left, right = np.ones((len(part), max(rows, 1)), np.int64), np.full((len(part), rows + max(int(m[part].max()), 1) + 2 * w + 1), 2, np.int64)
        for r, k in enumerate(part):
            left[r, : n[k]] = a[k]
            right[r, w : w + m[k]] = b[k]
        place = np.arange(2 * w + 1, dtype=np.int32)
        row = np.where(place >= w, place - w, far)[None, :].repeat(len(part), 0).astype(np.int32)
        done = np.full(len(part), far, np.int32)
        at = np.clip(m[part] - n[part] + w, 0, 2 * w)
        for i in range(rows + 1):
            if i:
                equal = right[:, i - 1 : i + 2 * w] == left[:, i - 1 : i]
                new = row + np.where(equal, np.int32(0), np.int32(2))
                np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
                new[:, : max(0, w - i)] = far
                row = np.minimum.accumulate(new - place, axis=1) + place
            ends = n[part] == i
            done[ends] = row[ends, at[ends]]
        out[part] = done <= most[part]
    return out


def members(rows: DataFrame, reps: DataFrame, ends: DataFrame) -> DataFrame:
    """(rep, id): the rows of the classes whose representative is in ends(rep)."""
    named = reps.select("rep", *CLASS).join(ends.distinct(), "rep")
    return rows.select("id", *CLASS).join(named, list(CLASS)).select("rep", "id").distinct()


def alike_within(df: DataFrame, id_col: str, text: Column, least: float = LIKENESS) -> Alike:
    """Pairs of classes of one table that are alike and not the same text.

    Texts that differ only in formatting (see copies) are no pairs. Null and wordless texts match nothing. Two texts of
    one class of words but different roots (a form and a sentence) are classes of their own."""
    rows = stage(sketch(df, id_col, text, copy_root=True), "rows")
    reps = stage(classes(rows, frequent_words(rows)), "classes")
    hot = hot_keys(reps, least)
    # the left side has the shorter text of a pair
    size = F.expr("l.words < r.words OR (l.words = r.words AND l.rep < r.rep)")
    pairs = met(reps, reps, Keys(least, hot, longer=True), Keys(least, hot), near("l", "r", least) & size)
    roots = reps.select("rep", "root")
    alike = (
        verified(pairs, reps, reps, least)
        .join(roots.select(F.col("rep").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("rep").alias("b"), F.col("root").alias("rb")), "b")
        .where("ra <> rb").drop("ra", "rb")
    )
    heads = stage(alike, "alike")
    of = stage(members(rows, reps, heads.select(F.col("a").alias("rep")).union(heads.select(F.col("b").alias("rep")))), "members")
    return Alike(heads, of, of)


def alike_across(left: DataFrame, left_id: str, left_text: Column, right: DataFrame, right_id: str, right_texts: list[Column], least: float = LIKENESS) -> Alike:
    """Pairs of a class of the left table and a class of any of the texts of the right one that are alike."""
    lrows = stage(sketch(left, left_id, left_text), "left")
    both = None
    for text in right_texts:
        one = sketch(right, right_id, text)
        both = one if both is None else both.unionByName(one)
    rrows = stage(both, "right")
    order = frequent_words(lrows)
    lreps, rreps = stage(classes(lrows, order), "left_classes"), stage(classes(rrows, order), "right_classes")
    keys = Keys(least, hot_keys(lreps, least))
    heads = stage(verified(met(lreps, rreps, keys, keys, near("l", "r", least)), lreps, rreps, least), "alike")
    return Alike(heads, members(lrows, lreps, heads.select(F.col("a").alias("rep"))), members(rrows, rreps, heads.select(F.col("b").alias("rep"))))


def linked_groups(alike: Alike) -> DataFrame:
    """(id, group_id, links): the rows that have a pair within a table, the smallest id that they are linked with over
    any number of pairs, and the rows in their pairs. Labels of classes spread along the links and along labels already
    found until none changes; every round is a staged table, nothing is collected, and pairs of rows aren't formed."""
    both = alike.pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stage(both.union(both.select("v", "u")).distinct(), "edges")
    sizes = alike.left.groupBy(F.col("rep").alias("v")).agg(F.count("*").alias("n"))
    labels = stage(edges.join(sizes, "v").groupBy("u").agg(F.least("u", F.min("v")).alias("label"), F.sum("n").alias("links")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        far = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        spread = stage(
            labels.join(near, "u").join(far, "label", "left").select("u", "links", F.col("label").alias("old"), F.least("label", "near", "far").alias("label")), "spread"
        )
        unstage(labels)
        labels = spread
        if spread.where("old <> label").limit(1).count() == 0:
            break
    rows = alike.left.join(labels.select(F.col("u").alias("rep"), "label", "links"), "rep")
    firsts = rows.groupBy("label").agg(F.min("id").alias("group_id"))
    return rows.join(firsts, "label").groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))
