"""Problem 7: held-out passages inside corpus documents.

Words are compared in lower case without accents. A document holds an item if at least LEAST consecutive
words of its passage stand in it, where scattered words may be misspelt and spaces may differ.

Method: a set join on shingles of SHINGLE words. Misspelt words part the exact ones into runs; as RIGHT of the
held words are exact, a held stretch has a window of LEAST words that shares OVERLAP pairs of neighbouring words
with the document (e exact of n words leave at least 2 e - n - 1 pairs: 7 of 20 words; longer stretches are covered
by windows, of which one has 5 or more). A window is found through its rarest pairs, all but OVERLAP - 1. Hits bring
the positions in document and passage; those with HINT words that agree on their diagonal or beside it within LEAST
words go on (a stretch with several words split or joined can fall short of it). Each document and item is then
verified whole, by aligning the passage with the words around the hits (the positional bound) and looking for LEAST
held words in a row.

Texts are numbered by the items' words once and staged; the shingles of the items are counted in the whole corpus, so
rare means rare there. The items are a stated query set: they come to the driver in blocks of BLOCK words, each compared
with every document without a shuffle. Null and empty texts hold nothing, items shorter than LEAST are never held.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vocabulary import common_length
from .common import stage

#: Words in a row that make a leak, words of a shingle, shingles that a window must share, words compared
#: beyond a hit, share of held words that must be right, likeness of a misspelt stretch.
LEAST, SHINGLE, OVERLAP, MARGIN, RIGHT, MISSPELT = 20, 2, 5, 12, 0.7, 0.6
#: Words that must agree within LEAST words that hold a hit before the texts are aligned.
HINT = 11
#: Item words that go to the workers at once; spellings that a task remembers.
BLOCK, SPELLINGS = 500_000, 500_000
#: Hits whose surroundings are compared at once.
HITS = 50_000


def fold(word: str) -> str:
    """A word without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower().replace("đ", "d")) if not unicodedata.combining(c))


#: Characters that stand inside words without being letters.
INSIDE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
WORD = re.compile(r"[^\W_]+")


def bare_words(text: str | None) -> list[str]:
    """Words of a text in lower case, their letters composed; fold takes off the accents."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", INSIDE.sub("", text) if INSIDE.search(text) else text)
    return WORD.findall(text.lower())


class Vocabulary:
    """Numbers of the folded words of the items; other words are -1. Up to SPELLINGS spellings are remembered."""

    def __init__(self, words: dict[str, int]):
        self.words, self.seen, self.flat = words, {}, {}

    def numbers(self, words: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > SPELLINGS:
            seen.clear()
        out = [seen.get(w) for w in words]
        if None in out:
            known = self.words
            for k, n in enumerate(out):
                if n is None:
                    w = words[k]
                    out[k] = seen[w] = known.get(fold(w), -1)
        return out

    def folded(self, words: list[str]) -> list[str]:
        flat = self.flat
        if len(flat) > SPELLINGS:
            flat.clear()
        return [flat.get(w) or flat.setdefault(w, fold(w)) for w in words]


def shingles(numbers: np.ndarray, size: int) -> np.ndarray:
    """The pair of words from each position as one number, -1 where one of them is no item word."""
    a, b = numbers[:-1], numbers[1:]
    return np.where((a >= 0) & (b >= 0), a * np.int64(size) + b, np.int64(-1))


def prefix_shingles(items: list[np.ndarray], rarity: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """shingle -> [(item index, position)] for the shingles that some window needs to look up: all but the OVERLAP - 1
    that are the most frequent in the corpus."""
    per = LEAST - SHINGLE + 1
    table: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for k, item in enumerate(items):
        hs = item.tolist()
        rank = [(rarity.get(h, 0), h, p) for p, h in enumerate(hs)]
        for a in range(len(hs) - per + 1):
            for _, h, p in sorted(rank[a : a + per])[: per - OVERLAP + 1]:
                table[h].add((k, p))
    return {h: sorted(v) for h, v in table.items()}


def _extend(passage: list[str], doc: list[str], i: int, j: int, step: int) -> tuple[int, int, int]:
    """(held words, exact words, doc words) of the walk from passage[i], doc[j] in one direction. Where the words
    differ, the walk goes on behind up to three words on either side if what lies between is a misspelling."""
    held = exact = 0
    n, m = len(passage), len(doc)
    start = j

    def word(ws: list[str], k: int) -> str | None:
        return ws[k] if 0 <= k < len(ws) else None

    while 0 <= i < n and 0 <= j < m:
        if passage[i] == doc[j]:
            held, exact, i, j = held + 1, exact + 1, i + step, j + step
            continue
        for a, b in _GAPS:
            w = word(passage, i + a * step)
            if w is None or w != word(doc, j + b * step):
                continue
            after = word(passage, i + (a + 1) * step)
            if after is not None and after != word(doc, j + (b + 1) * step) and len(w) < 4:
                continue
            x, y = "".join(passage[min(i, i + (a - 1) * step) :][:a]) if a else "", "".join(doc[min(j, j + (b - 1) * step) :][:b]) if b else ""
            if 2 * common_length(x, y) >= MISSPELT * (len(x) + len(y)):
                held, i, j = held + a, i + a * step, j + b * step
                break
        else:
            break
    return held, exact, abs(j - start)


#: Passage and document words between two agreeing words, fewest first.
_GAPS = sorted(((a, b) for a in range(4) for b in range(4) if a and b), key=lambda g: (g[0] + g[1], abs(g[0] - g[1])))


def longest_held(doc: list[str], passage: list[str], spots: list[tuple[int, int]]) -> int:
    """Most passage words in a row that stand in doc, at least RIGHT of them exactly. spots: (doc, passage) positions
    of shared shingles; those inside a run that is known aren't walked again."""
    best, done = 0, []
    for p, q in sorted(spots):
        if any(a <= p < b and abs(p - q - s) <= MARGIN for a, b, s in done):
            continue
        right, back = _extend(passage, doc, q, p, 1), _extend(passage, doc, q - 1, p - 1, -1)
        held, exact = right[0] + back[0], right[1] + back[1]
        done.append((p - back[2], p + right[2], p - q))
        if held >= LEAST and exact >= RIGHT * held:
            best = max(best, held)
    return best


@dataclass(frozen=True)
class Block:
    """Items that are looked up at once, as (id, folded words), and the numbers of their words."""

    items: list[tuple[object, list[str]]]
    words: dict[str, int]

    @staticmethod
    def of(items: list[tuple[object, list[str]]]) -> Block:
        return Block(items, {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))})

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.words[w] for w in words], np.int64)


def blocks(items: DataFrame) -> Iterator[Block]:
    """Blocks of at most BLOCK words (one item at least) of items(i, text), one at a time on the driver."""
    held: list[tuple[object, list[str]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = [fold(w) for w in bare_words(row["text"])]
        if len(words) < LEAST:
            continue
        if held and size + len(words) > BLOCK:
            yield Block.of(held)
            held, size = [], 0
        held.append((row["i"], words))
        size += len(words)
    if held:
        yield Block.of(held)


def leaked(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, passage_col: str) -> DataFrame:
    """(doc_id, item_id, words): documents with the items they hold and the longest held run of words."""
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}, words int"
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text_col).alias("w")).where("w <> ''")
    queries = items.select(F.col(item_id).alias("i"), F.col(passage_col).alias("text")).where("text IS NOT NULL").distinct()
    out = None
    for block in blocks(queries):
        numbered = stage(texts.mapInArrow(_numberer(block.words), f"d {kinds[0]}, w string, n array<smallint>" if len(block.words) < 32_000 else f"d {kinds[0]}, w string, n array<int>"), "numbered")
        # as many rows as the block has shingles
        counts = numbered.select("n").mapInArrow(_counter(block), "shingle bigint, many bigint").groupBy("shingle").agg(F.sum("many").alias("many"))
        rarity = {r["shingle"]: r["many"] for r in counts.collect()}
        one = numbered.mapInArrow(_finder(block, rarity), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _numberer(words: dict[str, int]):
    """Texts with the number of each word."""
    kind = pa.int16() if len(words) < 32_000 else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1):
                flat += vocabulary.numbers(bare_words(text.as_py()))
                ends.append(len(flat))
            n = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32), pa.int32()).cast(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["d", "w", "n"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists with a -1 behind each list, and where each list starts."""
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(starts[-1]), -1, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out, starts[:-1]


def _counter(block: Block):
    """How often each shingle of the items stands in the texts of a task."""
    size = len(block.words)
    keys = np.unique(np.concatenate([shingles(block.numbers(ws), size) for _, ws in block.items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(len(keys), np.int64)
        for batch in batches:
            flat, _ = _flat(batch.column(0))
            if len(flat) > 1:
                got = shingles(flat, size)
                got = got[got >= 0]
                where = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                many += np.bincount(where[keys[where] == got], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(many)], ["shingle", "many"])

    return run


def _finder(block: Block, rarity: dict[int, int]):
    size = len(block.words)
    numbers = [block.numbers(ws) for _, ws in block.items]
    table = prefix_shingles([shingles(h, size) for h in numbers], rarity)
    keys = np.array(sorted(table), np.int64)
    counts = np.array([len(table[int(k)]) for k in keys], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    spots = np.array([x for k in keys for x in table[int(k)]], np.int64).reshape(-1, 2)
    names, passages = [x[0] for x in block.items], [x[1] for x in block.items]
    # all passages in one array, apart by a gap that equals no word
    gap = np.full(2 * LEAST + 4, -2, np.int64)
    base, parts, at = [], [gap], len(gap)
    for h in numbers:
        base.append(at)
        parts += [h, gap]
        at += len(h) + len(gap)
    flat_items, base = np.concatenate(parts).astype(np.int32), np.array(base, np.int64)

    def near(doc: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Most words that agree within LEAST words that hold the hit, on its diagonal or one beside it."""
        last = len(doc) - 1
        sums = np.zeros((2 * LEAST, len(p)), np.int8)
        before, here = doc[np.clip(p - LEAST, 0, last)], doc[np.clip(p + 1 - LEAST, 0, last)]
        for k, t in enumerate(range(1 - LEAST, LEAST)):
            after = doc[np.clip(p + t + 1, 0, last)]
            mine = flat_items[q + t]
            np.add(sums[k], (before == mine) | (here == mine) | (after == mine), out=sums[k + 1])
            before, here = here, after
        return (sums[LEAST:] - sums[:LEAST]).max(axis=0, initial=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary({})
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            flat, first = _flat(batch.column(2))
            found: tuple[list, list, list] = ([], [], [])
            if len(flat) > 1:
                got = shingles(flat, size)
                hit = np.flatnonzero(got >= 0)
                where = np.minimum(np.searchsorted(keys, got[hit]), len(keys) - 1)
                same = keys[where] == got[hit]
                hit, where = hit[same], where[same]
                small = flat.astype(np.int32)
                # a common pair stands at many places: a bounded number of hits at a time
                ends = np.cumsum(counts[where])
                cuts = np.searchsorted(ends, np.arange(HITS, ends[-1], HITS)) if len(hit) else []
                kept = [(np.zeros(0, np.int64),) * 3]
                for some, k in zip(np.split(hit, cuts), np.split(where, cuts)):
                    many = counts[k]
                    p = np.repeat(some, many)
                    s = np.repeat(starts[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    item, q = spots[s, 0], spots[s, 1]
                    good = near(small, p, base[item] + q) >= HINT
                    kept.append((p[good], item[good], q[good]))
                p, item, q = (np.concatenate(x) for x in zip(*kept))
                row = np.searchsorted(first, p, side="right") - 1
                todo: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for r, i, a, b in zip(row.tolist(), item.tolist(), (p - first[row]).tolist(), q.tolist()):
                    todo[r, i].append((a, b))
                words: tuple[int, list[str]] = (-1, [])
                for (r, i), hits in todo.items():
                    if r != words[0]:
                        words = r, vocabulary.folded(bare_words(texts[r].as_py()))
                    if n := longest_held(words[1], passages[i], hits):
                        found[0].append(ids[r].as_py())
                        found[1].append(names[i])
                        found[2].append(n)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], batch.schema.field(0).type), pa.array(found[1]), pa.array(found[2], pa.int32())], ["d", "i", "n"])

    return run
