"""Problem 4: text that was decoded with the wrong character encoding.

For every pair (encoding that wrote the bytes, encoding that read them) and every Vietnamese letter and
typographic mark, the garbled sequence is computed once. A multi-pattern automaton finds the sequences
in a text and only matched spans are replaced, so mixed correct text stays as it is.

Multi-byte garbling (UTF-8 read as a one-byte code page, once or twice) leaves sequences that ordinary
text never has, so one match is enough. One-byte Vietnamese encodings leave single letters that also
occur in typing errors; these need two words that read as Vietnamese syllables only once decoded.
Characters that were lost (U+FFFD, C1 controls) mark a text as garbled, too; such spans stay as they are.

Null and empty texts aren't garbled and come out unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TONES = "̣̀́̃̉"
BASES = "aăâeêioôơuưy"
#: Read as these one-byte code pages, UTF-8 bytes give the garbled forms.
READ_AS = ("cp1252", "latin-1", "cp1258", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254")
PAIRS = [*READ_AS, *(f"{c} twice" for c in READ_AS)]
MARKS = "“”‘’–—…•→€™©®°²³½×÷≥≤≠"

# The byte values of TCVN 5712 (as read in cp1252), in the order of TCVN_LETTERS.
TCVN_LETTERS = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵĂÂĐÊÔƠƯ"
TCVN_READ = "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô\xadõøö÷ùúýûüþ¡¢§£¤¥¦"
# VISCII (RFC 1456) as read in latin-1; letters that agree with latin-1 are left out.
VISCII_LETTERS = "ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộơớờởỡợụủũưứừửữựỳỷỹỵđ"
VISCII_READ = "Õä¤¥¦ç§¡¢ÆÇ£©ë¨ª«¬\xad®ïî¸÷ö¯°±²µ½¾¶·Þþøüûßñ×Øæ\xfaÏÖÛÜð"
# VNI tone and shape marks as read in cp1252, per tone (none, grave, acute, tilde, hook, dot).
VNI_PLAIN, VNI_CIRCUMFLEX, VNI_BREVE = ("", "ø", "ù", "õ", "û", "ï"), ("â", "à", "á", "ã", "å", "ä"), ("ê", "è", "é", "ü", "ú", "ë")
VNI_I, VNI_SINGLE = ("i", "ì", "í", "ó", "æ", "ò"), {"ơ": "ô", "ư": "ö", "đ": "ñ"}


@cache
def letters() -> list[str]:
    """Vietnamese letters beyond ASCII in both cases."""
    low = [unicodedata.normalize("NFC", b + t) for b in BASES for t in ("", *TONES)]
    low = [c for c in low if ord(c) > 127] + ["đ"]
    return low + [c.upper() for c in low]


def _read(data: bytes, code: str, lost: str) -> str | None:
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(code))
        except UnicodeDecodeError:
            if lost == "skip":
                return None
            out.append(chr(b) if lost == "c1" else "�")
    return "".join(out)


def _twice(text: str | None, code: str) -> str | None:
    if text is None:
        return None
    try:
        data = b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(code) for c in text)
        return _read("".join(c if ord(c) < 128 else "".join(map(chr, c.encode("utf-8"))) for c in text).encode("latin-1"), code, "c1") if data else None
    except UnicodeError:
        return None


@cache
def multibyte() -> dict[str, dict[str, str | None]]:
    """garbled sequence -> {pair: original, or None where several originals give the same sequence}."""
    table: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
    for c in letters() + list(MARKS):
        for code in READ_AS:
            for lost in ("c1", "fffd"):
                if (g := _read(c.encode("utf-8"), code, lost)) and g != c:
                    table[g][code].add(c)
                if code in ("cp1252", "latin-1", "cp1254") and (g2 := _twice(g, code)):
                    table[g2][code + " twice"].add(c)
    return {g: {k: next(iter(v)) if len(v) == 1 else None for k, v in pairs.items()} for g, pairs in table.items() if len(g) > 1}


def _weak(g: str) -> bool:
    """Could stand in ordinary or disguised text: only Vietnamese or ASCII letters, spaces and invisible characters."""
    alphabet = set(letters())
    return all(ord(c) < 128 or c in alphabet or c in "\xa0\xad" for c in g)


@cache
def legacy() -> dict[str, dict[str, str]]:
    """pair -> {garbled letter sequence: letter} of the one-byte Vietnamese encodings."""
    vni: dict[str, str] = {}
    for b in BASES:
        for k, t in enumerate(("", "̀", "́", "̃", "̉", "̣")):
            c = unicodedata.normalize("NFC", b + t)
            if ord(c) < 128:
                continue
            if b in "âêô":
                g = {"â": "a", "ê": "e", "ô": "o"}[b] + VNI_CIRCUMFLEX[k]
            elif b == "ă":
                g = "a" + VNI_BREVE[k]
            elif b == "i":
                g = VNI_I[k]
            else:
                g = VNI_SINGLE.get(b, b) + VNI_PLAIN[k]
            vni[g] = c
            vni[g.upper()] = c.upper()
    vni |= {"ñ": "đ", "Ñ": "Đ"}
    tones = {"̀": "Ì", "́": "ì", "̃": "Þ", "̉": "Ò", "̣": "ò"}
    bases = {"ă": "ã", "ơ": "õ", "ư": "ý", "đ": "ð"}
    win: dict[str, str] = {}
    for b in BASES + "đ":
        for up in (str, str.upper):
            g = up(bases.get(b, b))
            if g != up(b):
                win[g] = up(b)
            if b != "đ":
                win |= {g + m: unicodedata.normalize("NFC", up(b) + t) for t, m in tones.items()}
    tcvn = dict(zip(TCVN_READ, TCVN_LETTERS))
    viscii = dict(zip(VISCII_READ, VISCII_LETTERS))
    return {"vni": vni, "cp1258 bytes": win, "tcvn3": tcvn, "viscii": viscii}


@cache
def automaton():
    """Aho-Corasick automaton over all multi-byte garbled sequences."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, pairs in multibyte().items():
        a.add_word(g, (g, pairs, _weak(g)))
    a.make_automaton()
    return a


NUCLEI = (
    "a ă â e ê i o ô ơ u ư y ai ao au ay âu ây eo êu ia iê iu oa oă oe oi ôi ơi oo ua uâ uê ui uô uơ ưa ươ ưi ưu uy yê "
    "iêu yêu oai oao oay oeo uây uôi ươi ươu uya uyê uyu uau uao uai"
).split()
SYLLABLE = re.compile(
    f"(?:b|ch?|d|đ|gh?|gi|h|kh?|l|m|ngh?|nh?|ph?|qu?|r|s|th?|tr|v|x)?(?:{'|'.join(sorted(NUCLEI, key=len, reverse=True))})(?:ch?|m|ng?|nh|p|t)?"
)
WORD = re.compile(r"[^\s.,;:!?()\"'/\-]+")


@lru_cache(200_000)
def syllable(word: str) -> bool:
    """Has the shape of a Vietnamese syllable with a letter beyond ASCII."""
    if word.isascii() or not (word.islower() or word.isupper() or word[1:].islower()):
        return False
    flat = unicodedata.normalize("NFD", word.lower())
    tones = sum(c in TONES for c in flat)
    base = unicodedata.normalize("NFC", "".join(c for c in flat if c not in TONES))
    return tones <= 1 and bool(SYLLABLE.fullmatch(base))


@cache
def _legacy_patterns() -> dict[str, re.Pattern]:
    return {k: re.compile("|".join(map(re.escape, sorted(t, key=len, reverse=True)))) for k, t in legacy().items()}


def _decode_legacy(text: str) -> tuple[str, str] | None:
    best: tuple[int, str, str] | None = None
    usual = set(letters())
    for pair, table in legacy().items():
        pattern = _legacy_patterns()[pair]
        hits, strange, out, at = 0, 0, [], 0
        for m in WORD.finditer(text):
            w = m.group()
            if not w.isascii() and re.search("[A-Za-z]", w) and not syllable(w):
                d = pattern.sub(lambda x: table[x.group()], w)
                if d != w and syllable(d):
                    hits += 1
                    strange += any(c in table and c not in usual and c != "\xad" for c in w) or bool(re.search(r"[a-zà-ỹ][ÌÒÞ]", w))
                    out += [text[at : m.start()], d]
                    at = m.end()
        if hits >= 2 and strange >= 1 and (best is None or hits > best[0]):
            best = hits, pair, "".join(out) + text[at:]
    return best and best[1:]


def _restore(text: str, pair: str, found: list[tuple]) -> str:
    """The matched spans of one pair replaced, the longest at a place first."""
    out, at = [], 0
    for start, end, g, pairs, _ in sorted((f for f in found if pair in f[3]), key=lambda f: (f[0], -f[1])):
        if start >= at and pairs[pair]:
            out += [text[at:start], pairs[pair]]
            at = end
    return "".join(out) + text[at:]


def repair(text: str | None) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text or None, pairs). Parts that were garbled in different ways are restored one after
    another, the pair that explains most first; every step leaves a shorter text, so they end."""
    if not text or text.isascii():
        return False, None, None
    fixed, used = text, []
    while True:
        found = [(end - len(g) + 1, end + 1, g, pairs, weak) for end, (g, pairs, weak) in automaton().iter(fixed)]
        if not any(not f[4] for f in found):
            break
        score: dict[str, int] = defaultdict(int)
        for _, _, g, pairs, _ in found:
            for p, c in pairs.items():
                score[p] += len(g) * (2 if c else 1)
        # pairs whose spans can't be restored change nothing
        steps = ((p, _restore(fixed, p, found)) for p in sorted(score, key=lambda p: (-score[p], PAIRS.index(p))))
        pair, better = next(((p, t) for p, t in steps if t != fixed), (None, fixed))
        if pair is None:
            used = used or [max(score, key=lambda p: (score[p], -PAIRS.index(p)))]
            break
        used, fixed = [*used, pair], better
    if used:
        return True, fixed if fixed != text else None, " + ".join(used)
    if "�" in text or re.search("[\x80-\x9f]", text):
        return True, None, "lost"
    if hit := _decode_legacy(text):
        return True, hit[1], hit[0]
    return False, None, None


#: Characters of ordinary Vietnamese text; a text of only these is neither garbled nor disguised, unless
#: its letters stand in an order that only a one-byte encoding gives.
ORDINARY = r"\t\n\r -~À-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ"


def suspicious(text: Column) -> Column:
    """Cheap test in the JVM that every garbled or disguised text passes."""
    return text.rlike(f"[^{ORDINARY}]|[a-zâêôõýã][ÌÒ]|[aeouyâêôõýã]ì|[aeuyâêôõýã]ò")


def repaired(df: DataFrame, text_col: str) -> DataFrame:
    """The rows of df whose text is garbled, with restored (null where nothing can be restored) and pair, which replace
    columns of their names."""
    df = df.drop("restored", "pair")
    schema = df.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [repair(t) for t in part[text_col]]
            part["restored"] = pd.Series([g[1] for g in got], index=part.index, dtype="object")
            part["pair"] = pd.Series([g[2] for g in got], index=part.index, dtype="object")
            yield part[[g[0] for g in got]]

    out = T.StructType([*schema.fields, T.StructField("restored", T.StringType()), T.StructField("pair", T.StringType())])
    return df.where(suspicious(F.col(text_col))).mapInPandas(run, out)
