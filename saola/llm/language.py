"""Problem 9: the language of a document and of its segments, by rank-order n-gram profiles.

A language's profile is its most frequent n-grams (2 or 3 characters within words, word ends marked) in
order of frequency. A segment gets the language with the least out-of-place distance between its own
ranked n-grams and the profile; the confidence is the distance gap to the next language. Sentences are
the segments; a clause of a sentence is one of its own where it is clearly of another language. Vietnamese has a second profile without accents.

Texts are read whole. Null, empty and wordless texts have no segments and no language.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("vi", "en", "fr", "de", "id", "es")
#: N-grams of a profile; words that a segment must have to stand alone; share that makes a language count.
PROFILE, LEAST_WORDS, SHARE = 400, 4, 0.1
#: Other spellings of the codes (fixed values).
CODES = {"vie": "vi", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "ind": "id", "in": "id", "spa": "es"}

#: Sentence ends and clause ends.
CUT = re.compile(r"(?P<s>(?:[.!?…;]+[\"”»)]*(?=\s|$)|[\n\r\t|]|\s[-–—/•*]+\s)+)|[,:](?=\s)")
#: Gap to its sentence's language that a clause needs to stand apart.
APART = 0.15
#: Words that are compared at once, and spellings that a task remembers; they bound its memory.
CHUNK, SPELLINGS = 60_000, 200_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [*(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d")) if not unicodedata.combining(c))


class Profiles:
    """Rank table of all profile n-grams: row = n-gram, column = profile."""

    def __init__(self, texts: list[tuple[str, str]]):
        """texts: (language, text) samples of bounded size."""
        counts: dict[tuple[str, bool], Counter] = {}
        for lang, text in texts:
            low = unicodedata.normalize("NFC", (text or "").lower())
            for bare in (False, True) if lang == "vi" else (False,):
                c = counts.setdefault((lang, bare), Counter())
                for w in WORD.findall(_bare(low) if bare else low):
                    c.update(grams(w))
        self.names = [lang for lang, _ in sorted(counts)]
        tops = [[g for g, _ in sorted(counts[k].items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for k in sorted(counts)]
        self.ids = {g: i for i, g in enumerate(sorted({g for top in tops for g in top}))}
        # an absent n-gram ranks so low that its distance is the greatest, PROFILE, from any place
        self.rank = np.full((len(self.ids), len(tops)), 3 * PROFILE, np.int16)
        for j, top in enumerate(tops):
            for r, g in enumerate(top):
                self.rank[self.ids[g], j] = r
        self.langs = sorted(set(self.names))
        self.cache: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def word(self, word: str) -> int:
        """Index of a word in the table of its known n-grams; n-grams of no profile are equally far from all."""
        k = self.cache.get(word)
        if k is None:
            k = self.cache[word] = len(self.rows)
            self.rows.append(np.array([self.ids[g] for g in grams(word) if g in self.ids], np.int32))
        return k

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.size) != len(self.rows):
            self.size = np.array([len(r) for r in self.rows], np.int64)
            self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
            self.flat = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int32)
        return self.flat, self.start, self.size

    def distances(self, words: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
        """(n, languages) mean out-of-place distances; segment: the segment of each word, ascending."""
        flat, start, size = self.table()
        sizes = size[words]
        at = np.repeat(start[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        key = np.repeat(segment, sizes) * len(self.ids) + flat[at]
        key.sort()
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(lead, len(key)))
        seg, gram = np.divmod(key[lead], len(self.ids))
        order = np.lexsort((-count, seg))
        gram = gram[order]
        first = np.searchsorted(seg, np.arange(n))
        many = np.append(first[1:], len(seg)) - first
        place = np.arange(len(seg)) - first[seg]
        # a segment has fewer n-grams than a profile: its places are stretched over half the profile's
        place = np.minimum(place * np.maximum(1, PROFILE // (2 * np.maximum(1, many)))[seg], PROFILE).astype(np.int16)
        out = self.rank[gram]
        out -= place[:, None]
        np.abs(out, out=out)
        np.minimum(out, PROFILE, out=out)
        sums = np.zeros((n, out.shape[1]), np.int64)
        has = many > 0
        if len(seg):
            sums[has] = np.add.reduceat(out, first[has], axis=0, dtype=np.int64)
        mean = np.where(has[:, None], sums / np.maximum(1, many)[:, None], PROFILE)
        return np.stack([mean[:, [i for i, x in enumerate(self.names) if x == lang]].min(axis=1) for lang in self.langs], axis=1)

    def judge(self, clauses: list[list[str]], sentence: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(language, confidence) of each clause; sentence: the sentence of each, ascending."""
        if len(self.rows) > SPELLINGS:
            self.cache, self.rows, self.size = {}, [], np.zeros(0, np.int64)
        n, size = len(clauses), np.array([len(c) for c in clauses])
        cache, word = self.cache, self.word
        index = np.fromiter((k if (k := cache.get(w)) is not None else word(w) for c in clauses for w in c), np.int64, int(size.sum()))
        dist = np.concatenate([
            self.distances(index[a:b], np.repeat(np.arange(y - x), size[x:y]), y - x)
            for x, y, a, b in self._chunks(size)
        ])
        of = np.array(sentence)
        of = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))
        total = np.zeros((of[-1] + 1, dist.shape[1]))
        np.add.at(total, of, dist * size[:, None])
        whole = total.argmin(axis=1)[of]
        best, rows = dist.argmin(axis=1), np.arange(n)
        apart = (dist[rows, whole] - dist[rows, best]) / np.maximum(dist[rows, whole], 1e-9) >= APART
        lang = np.where(apart & (size >= LEAST_WORDS), best, whole)
        mine = dist[rows, lang].copy()
        dist[rows, lang] = np.inf
        return lang, np.clip((dist.min(axis=1) - mine) / np.maximum(dist.min(axis=1), 1e-9), 0, 1)

    @staticmethod
    def _chunks(size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        ends = np.cumsum(size)
        x = a = 0
        while x < len(size):
            y = max(x + 1, int(np.searchsorted(ends, a + CHUNK, side="right")))
            yield x, y, a, int(ends[y - 1])
            x, a = y, int(ends[y - 1])


def cut(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, words, ends a sentence) of the clauses of a text. A piece of few words joins the
    clauses of its sentence; a sentence of few words joins the one before."""
    out: list[list] = []
    at = 0
    ends = [*((m.end(), m.lastgroup is not None) for m in CUT.finditer(text)), (len(text), True)]
    for end, last in ends:
        found = WORD.findall(text, at, end)
        if not found:
            continue
        short = len(found) < LEAST_WORDS or out and len(out[-1][2]) < LEAST_WORDS
        if out and not out[-1][3] and short:
            out[-1][1:] = [end, out[-1][2] + found, last]
        else:
            out.append([at, end, found, last])
        if len(out) > 1 and last and len(out[-1][2]) < LEAST_WORDS:
            few = out.pop()
            out[-1][1:] = [few[1], out[-1][2] + few[2], True]
        at = end
    return [tuple(x) for x in out]


def segments(df: DataFrame, id_col: str, text_col: str, texts: list[tuple[str, str]]) -> DataFrame:
    """(id, start, end, words, lang, confidence): the segments of every text, neighbours of one language joined;
    none where there are no samples."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, start int, end int, words int, lang string, confidence double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Profiles(texts)
        for part in parts:
            ids, spans, clauses, sentence = [], [], [], []
            for key, text in zip(part[id_col], part[text_col]):
                if not text:
                    continue
                low = text.lower()
                if not low.isascii():
                    low = unicodedata.normalize("NFC", low)
                new = True
                for a, b, found, last in cut(low):
                    ids.append(key)
                    spans.append((a, b))
                    clauses.append(found)
                    sentence.append(sentence[-1] + new if sentence else 0)
                    new = last
            if not ids or not p.langs:
                continue
            lang, sure = p.judge(clauses, sentence)
            size = np.array([len(c) for c in clauses])
            frame = pd.DataFrame({"id": ids, "start": [a for a, _ in spans], "end": [b for _, b in spans], "words": size, "k": lang, "sure": sure * size})
            new = (frame["id"].ne(frame["id"].shift()) | frame["k"].ne(frame["k"].shift())).cumsum()
            g = frame.groupby(new, sort=False).agg(id=("id", "first"), start=("start", "first"), end=("end", "last"), words=("words", "sum"), k=("k", "first"), sure=("sure", "sum"))
            yield pd.DataFrame({
                id_col: g["id"], "start": g["start"], "end": g["end"], "words": g["words"],
                "lang": pd.Series([p.langs[k] for k in g["k"]], index=g.index, dtype="object"), "confidence": g["sure"] / g["words"],
            })

    return df.select(id_col, text_col).mapInPandas(run, schema)


def label_code(lang: Column) -> Column:
    """The two-letter code that a label names, or null."""
    low = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for k in LANGS for x in (k, k)], *[F.lit(x) for k, v in CODES.items() for x in (k, v)])
    foreign = F.when(F.length(low) == 2, low)
    return F.coalesce(known[low], F.when(~low.isin("un", "xx", "zz", "na", "no"), foreign))


def documents(df: DataFrame, id_col: str, text_col: str, texts: list[tuple[str, str]]) -> DataFrame:
    """(id, lang, share, confidence, main): one row for each language with a tenth of the words or more."""
    per = segments(df, id_col, text_col, texts).groupBy(id_col, "lang").agg(F.sum("words").alias("n"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    # at most one row for each of six languages: the window of a document is small
    of = Window.partitionBy(id_col)
    return (
        per.withColumn("share", F.col("n") / F.sum("n").over(of))
        .withColumn("main", F.row_number().over(of.orderBy(F.desc("n"), "lang")) == 1)
        .where((F.col("share") >= SHARE) | F.col("main"))
        .select(id_col, "lang", "share", "confidence", "main")
    )
