"""Labelled documents for the quality rules, made from clean sentences by seeded templates.

Prose comes as it is and in the ways in which prose stays prose: misspelt, unaccented, in capitals,
wrapped, numbered, garbled, disguised, with a formula, a link or an emoji. Forms are fields with phrases
for names. Lists, tables and junk are drawn from a few free parameters (marks, joints, kinds of
characters, numbers of cells), not from templates of any known kind of junk.
"""

from __future__ import annotations

import random
import re
import string
import unicodedata

from .encoding import legacy, multibyte

#: Documents made for each label.
PER_LABEL = 1_500


def _bare(text: str) -> str:
    flat = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in flat if not unicodedata.combining(c))


def _wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for w in text.split(" "):
        if line and len(line) + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def _misspell(text: str, r: random.Random) -> str:
    out = []
    for w in text.split(" "):
        if len(w) > 2 and r.random() < 0.35:
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("sfrxjwaeo") + w[k:], _bare(w), w + r.choice("sfrxj")])
        out.append(w)
    return " ".join(out)


def _garble(text: str, r: random.Random, inverse: dict[str, dict[str, str]]) -> str:
    table = inverse[r.choice(sorted(inverse))]
    words = text.split(" ")
    a, b = (0, len(words)) if r.random() < 0.6 else sorted(r.sample(range(len(words) + 1), 2))
    return " ".join("".join(table.get(c, c) for c in w) if a <= k < b else w for k, w in enumerate(words))


def _prose(s: list[str], r: random.Random, inverse: dict) -> str:
    text = r.choice(s) if r.random() < 0.6 else r.choice([" ", "\n", ". "]).join(r.sample(s, r.randint(2, 3)))
    for _ in range(r.choice([1, 1, 2, 2, 3])):
        text = _written(text, r, inverse)
    return text


def _written(text: str, r: random.Random, inverse: dict) -> str:
    """Prose in one of the ways in which it stays prose."""
    way = r.randrange(18)
    if way < 3:
        return text
    if way == 3:
        return _bare(text).lower()
    if way == 4:
        return text.upper()
    if way == 5:
        return _wrap(text, r.randint(24, 60))
    if way in (6, 7):
        return _misspell(text, r)
    if way == 8:
        return _garble(text, r, inverse)
    if way == 9:
        return unicodedata.normalize("NFD", text)
    if way == 10:
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in text)
    if way == 11:
        return f"{r.randint(1, 40)}{r.choice('.):')} " + text
    if way == 12:
        # a formula, a link or signs within a sentence
        k = r.randrange(len(text) + 1)
        return text[:k] + " " + r.choice([" ".join(_token(r, r.choice(KINDS)) for _ in range(3)), f"https://{_token(r, 'letters')}.org/{_token(r, 'mixed')}", "👍😀"]) + " " + text[k:]
    if way == 13:
        return f"{r.choice('-*+•')} {text}"
    if way == 14:
        return r.choice(["  ", " ", "\t ", "\t", "_", "__"]).join(text.split(" "))
    if way == 15:
        return _misspell(_wrap(text, r.randint(24, 60)), r).replace(",", r.choice([",", " ,", "...", " -"]))
    if way == 16:
        mark = "".join(r.choice("\"'()[]*>~-“”«»") for _ in range(r.randint(1, 4)))
        return f"{mark}{text}{mark[::-1]}"
    return _misspell(_bare(text), r) if r.random() < 0.5 else _misspell(text.upper(), r)


def _form(s: list[str], r: random.Random) -> str:
    """Named fields, one of them mostly a sentence."""
    eq, part = r.choice([": ", ":", "=", " = "]), r.choice(["\n", "; ", ";", " | "])
    case = r.choice([str.lower, str.lower, str.upper, str.capitalize])
    clean = lambda t: re.sub(r"[;|:=\n]", " ", t)
    n = r.randint(3, 8)
    values = [_phrase(s, r) for _ in range(n)]
    if r.random() < 0.7:
        values[r.randrange(n)] = r.choice(s)
    return part.join(f"{case(clean(_phrase(s, r, 3)))}{eq}{clean(v)}" for v in values)


def _phrase(s: list[str], r: random.Random, most: int = 5, least: int = 1) -> str:
    w = r.choice(s).strip(".").replace(",", "").split(" ")
    n = min(len(w), r.randint(least, most))
    k = r.randrange(len(w) - n + 1)
    return " ".join(w[k : k + n])


SIGNS = string.punctuation
KINDS = ("letters", "digits", "signs", "mixed", "one")
ALPHABETS = {"letters": string.ascii_lowercase, "digits": string.digits, "mixed": string.ascii_letters + string.digits}


def _token(r: random.Random, kind: str, most: int = 10) -> str:
    """A random string of one kind of character."""
    n = r.randint(1, most)
    if kind == "one":
        return r.choice(string.ascii_letters + SIGNS) * n
    if kind == "signs":
        return "".join(r.choice(SIGNS) for _ in range(min(n, 4)))
    return "".join(r.choice(ALPHABETS[kind]) for _ in range(n))


def _list(s: list[str], r: random.Random) -> str:
    """Short items, each with a mark or a number or neither, in lines or in a row; or items that lead to a number."""
    n, sign = r.randint(3, 16), r.choice(SIGNS)
    least, most = r.choice([(1, 3), (1, 4), (1, 6), (2, 6), (4, 8), (5, 9)])
    shape = r.random()
    if shape < 0.3:
        least, most = r.choice([(1, 3), (1, 5)])
        lead = f"{_phrase(s, r, 3)}: " if r.random() < 0.3 else ""
        return lead + r.choice([f"{sign} ", f" {sign} ", ", ", "; "]).join(_phrase(s, r, most, least) for _ in range(n + 3))
    if shape < 0.5:
        gap = r.choice([" " * r.randint(2, 6), "\t", f" {r.choice('.-_…') * r.randint(1, 10)} "])
        items = [f"{_phrase(s, r, 7)}{gap}{r.randint(1, 10 ** r.randint(1, 4))}" for _ in range(n)]
    else:
        mark = r.choice([lambda k: f"{sign} ", lambda k: f"{k}{sign} ", lambda k: f"{k}. ", lambda k: f"{sign}{k} ", lambda k: ""])
        if mark(1) == "":
            most = min(most, 5)
        items = [mark(k + 1) + _phrase(s, r, most, min(least, most)) for k in range(n)]
    text = "\n".join(items)
    return r.choice([text, text, text, _bare(text), text.upper()])


def _table(s: list[str], r: random.Random) -> str:
    """Rows of equally many cells: numbers, short texts or nothing; some with a line of headings or rules."""
    sep = r.choice([r.choice("|;,\t/"), f" {r.choice('|;/')} ", " " * r.randint(2, 5), "\t"])
    cols = r.randint(2, 7)
    number = lambda: r.choice([f"{r.uniform(0, 10 ** r.randint(1, 3)):.{r.randint(1, 2)}f}", str(r.randint(0, 10 ** r.randint(1, 4)))])
    kinds = [r.choice(["text", "number", "number"]) for _ in range(cols)]
    cell = lambda kind: "" if r.random() < 0.03 else number() if kind == "number" else _phrase(s, r, 3)
    rows = [[cell(k) for k in kinds] for _ in range(r.randint(3, 14))]
    if r.random() < 0.6:
        rows.insert(0, [_phrase(s, r, 2) for _ in range(cols)])
    lines = [sep.join(x) for x in rows]
    if r.random() < 0.15:
        lines.insert(1, r.choice("-=_+") * r.randint(6, 40))
    return "\n".join(lines)


def _junk(s: list[str], r: random.Random) -> str:
    """Strings that no one reads: random tokens of a few kinds with random joints, numbers, unbroken strings, wrapped
    tokens and things said over and over."""
    shape = r.randrange(6)
    if shape == 0:
        return _token(r, r.choice(["letters", "digits", "mixed", "mixed", "one"]), 200) + _token(r, "mixed", 40)
    if shape == 1:
        short = r.choice([_token(r, r.choice(KINDS), 4), _phrase(s, r, 2), _phrase(s, r, 6, 3), r.choice(s)])
        return r.choice([" ", "", "\n", ", "]).join([short] * r.randint(4, 30))
    if shape == 2:
        return r.choice([" ", ", ", "\n", "; "]).join(_token(r, "digits", r.choice([2, 4, 8])) for _ in range(r.randint(10, 60)))
    if shape == 3:
        return " ".join(_token(r, "letters", 13) for _ in range(r.randint(4, 40)))
    kinds = r.sample(KINDS, r.randint(1, 3))
    joints = [r.choice([" ", "\n", r.choice(SIGNS), r.choice(SIGNS) * 2, r.choice(SIGNS) + " "]) for _ in range(r.randint(1, 4))]
    ends = r.choice(["", "", "<>", "{}", "[]", '""', "()"])
    out = []
    for k in range(r.randint(8, 70)):
        t = _token(r, r.choice(kinds), r.choice([3, 8, 14])) if r.random() < 0.9 else _phrase(s, r, 1)
        out.append((ends[0] + t + ends[1] if ends and r.random() < 0.6 else t) + joints[k % len(joints)])
    return "".join(out)


def labelled(sentences: list[str], seed: int = 11, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """(text, label) rows, 3 * per_label of prose and per_label each of form, list, table and junk."""
    r = random.Random(seed)
    s = sorted({x for x in sentences if x and len(x.split(" ")) >= 8 and "\n" not in x})
    if not s:
        return []
    inverse: dict[str, dict[str, str]] = {}
    for g, pairs in sorted(multibyte().items()):
        for p, c in pairs.items():
            if c:
                inverse.setdefault(p, {})[c] = g
    for p, table in legacy().items():
        inverse[p] = {c: g for g, c in table.items()}
    inverse = {p: t for p, t in inverse.items() if p in ("cp1252", "cp1252 twice", "latin-1", "cp1258", "mac_roman", "cp437", "tcvn3", "vni", "cp1258 bytes")}
    made = {"form": _form, "list": _list, "table": _table, "junk": _junk}
    return [(_prose(s, r, inverse), "prose") for _ in range(3 * per_label)] + [(make(s, r), k) for k, make in made.items() for _ in range(per_label)]
