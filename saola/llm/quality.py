"""Problem 1: quality figures of a text, and whether it is prose, a list, a table or junk.

Figures are native column expressions. An ordered rule list is induced by incremental reduced-error
pruning on labelled documents (grow a rule on two thirds by information gain, prune it on the rest,
stop when a pruned rule errs on half of what it covers), its thresholds are exported to a SQL CASE, and
that CASE labels every row natively.

A null text has null figures and label; an empty text has zero figures and the label 'empty'.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import letters

#: Common words of this rank or less count as function words.
FUNCTION_RANK = 45
FEATURES = (
    "words", "mean_word_len", "symbol_ratio", "digit_ratio", "other_ratio", "lines", "words_per_line", "end_punct_share", "bullet_share",
    "delimiters_per_word", "commas_per_word", "fields", "field_share", "mixed_per_word", "common_share", "function_share", "syllable_share", "distinct_share",
)


def fold_letters() -> tuple[str, str]:
    """Vietnamese letters and their ASCII bases, for translate."""
    import unicodedata

    source = [c for c in letters() if c.islower()]
    flat = ["d" if c == "đ" else unicodedata.normalize("NFD", c)[0] for c in source]
    return "".join(source), "".join(flat)


def folded(text: Column) -> Column:
    source, flat = fold_letters()
    return F.translate(F.lower(text), source, flat)


def quality(df: DataFrame, text_col: str, common: list[str], function: list[str]) -> DataFrame:
    """df with the figures of FEATURES, which replace columns of their names (names that begin with _ are
    dropped, too). common, function: accent-folded word lists of bounded size."""
    keep = [c for c in df.columns if c not in FEATURES and not c.startswith("_")]
    quoted = lambda ws: ", ".join("'" + w.replace("'", "") + "'" for w in sorted(set(ws)) or [""])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    syllable = "^[bcdfghjklmnpqrstvwxz]{0,3}[aeiouy]{1,3}(ng|nh|ch|[cmnpt])?$"
    bullet = r"^\\s*([-*+•·–>#]|\\(?[0-9]{1,3}[.)/:]|[a-zA-Z][.)])\\s"
    step = (
        df.withColumn("_t", F.regexp_replace(text_col, r"[\p{M}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", ""))
        .withColumn("_t", F.regexp_replace("_t", "_+", " "))
        .withColumn("_lines", F.expr(r"filter(split(_t, '[\\r\\n]+'), l -> trim(l) <> '')"))
        .withColumn("_words", F.split(F.trim(F.regexp_replace(folded(F.col("_t")), r"[^\p{L}\p{N}]+", " ")), " "))
        .withColumn("_words", F.expr("filter(_words, w -> w <> '')"))
        .withColumn("_n", F.size("_words")).withColumn("_l", F.size("_lines"))
        .withColumn("_tokens", F.expr(r"size(filter(split(_t, '[\\p{Z}\\s]+'), w -> w <> ''))"))
        .withColumn("_chars", F.expr(r"length(regexp_replace(_t, '[\\p{Z}\\s]+', ''))"))
        .withColumn("_sym", F.expr(r"length(_t) - length(regexp_replace(_t, '[!-/:-@\\[-`{-~]+', ''))"))
        .withColumn("_dig", F.expr("length(_t) - length(regexp_replace(_t, '[0-9]+', ''))"))
        .withColumn("_oth", F.expr(r"length(_t) - length(regexp_replace(_t, '[^\\x00-\\x7F\\p{L}\\p{Z}]+', ''))"))
        .withColumn("_del", F.expr(r"regexp_count(_t, '[|;\\t]|\\S {2,}\\S|\\.{4,}|,(?=\\S)')"))
        .withColumn("_com2", F.expr("regexp_count(_t, '[,;] | [/-] ')"))
        .withColumn("_parts", F.expr(r"filter(split(_t, '[;|\\r\\n]+'), l -> trim(l) <> '')"))
        .withColumn("_fields", F.expr(r"size(filter(_parts, l -> l rlike '^\\s*\\p{L}[\\p{L} ]*[:=](?!//)'))")).withColumn("_parts", F.size("_parts"))
        .withColumn("_mix", F.expr("regexp_count(_t, '[A-Za-z][0-9]|[0-9][A-Za-z]')"))
        .withColumn("_end", F.expr(r"size(filter(_lines, l -> l rlike '[.!?…,;:)”\"]\\s*$'))"))
        .withColumn("_bul", F.expr(f"size(filter(_lines, l -> l rlike '{bullet}'))"))
        .withColumn("_com", F.expr(f"size(filter(_words, w -> w IN ({quoted(common)})))"))
        .withColumn("_fun", F.expr(f"size(filter(_words, w -> w IN ({quoted(function)})))"))
        .withColumn("_syl", F.expr(f"size(filter(_words, w -> w rlike '{syllable}'))"))
        .withColumn("_dis", F.size(F.array_distinct("_words")))
    )
    out = {
        "words": F.col("_n"), "mean_word_len": ratio("_chars", "_tokens"), "symbol_ratio": ratio("_sym", "_chars"), "digit_ratio": ratio("_dig", "_chars"),
        "other_ratio": ratio("_oth", "_chars"), "lines": F.col("_l"), "words_per_line": ratio("_n", "_l"), "end_punct_share": ratio("_end", "_l"),
        "bullet_share": ratio("_bul", "_l"), "delimiters_per_word": ratio("_del", "_tokens"), "commas_per_word": ratio("_com2", "_n"), "fields": F.col("_fields"), "field_share": ratio("_fields", "_parts"), "mixed_per_word": ratio("_mix", "_tokens"),
        "common_share": ratio("_com", "_n"), "function_share": ratio("_fun", "_n"), "syllable_share": ratio("_syl", "_n"), "distinct_share": ratio("_dis", "_n"),
    }
    figures = F.struct(*[F.when(F.col(text_col).isNotNull(), c.cast("double")).alias(k) for k, c in out.items()])
    # the one-row explode keeps the optimizer from copying the figures into every later test of them
    return step.select(*keep, F.explode(F.array(figures)).alias("_f")).select(*keep, *[F.col("_f")[k].alias(k) for k in FEATURES])


@dataclass(frozen=True)
class Rule:
    label: str
    tests: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.tests:
            hit &= x[f] <= t if op == "<=" else x[f] > t
        return hit

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.tests)


def _grow(x: dict[str, np.ndarray], pos: np.ndarray, label: str) -> Rule:
    tests: list[tuple[str, str, float]] = []
    live = np.ones(len(pos), bool)
    while (live & ~pos).any() and len(tests) < 8:
        p0, n0 = (live & pos).sum(), (live & ~pos).sum()
        base = math.log2(p0 / (p0 + n0))
        best: tuple[float, tuple[str, str, float]] | None = None
        for f in sorted(x):
            v, y = x[f][live], pos[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            cp = np.cumsum(y)[cut]
            cn = cut + 1 - cp
            for op, p, n in (("<=", cp, cn), (">", p0 - cp, n0 - cn)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0] + 1e-9:
                    best = float(gain[k]), (f, op, float(round((v[cut[k]] + v[cut[k] + 1]) / 2, 6)))
        if best is None or best[0] <= 1e-9 or best[1] in tests:
            break
        tests.append(best[1])
        f, op, t = best[1]
        live &= x[f] <= t if op == "<=" else x[f] > t
    return Rule(label, tuple(tests))


def _prune(rule: Rule, x: dict[str, np.ndarray], pos: np.ndarray) -> tuple[Rule, float]:
    """The prefix of the rule's tests of the best worth (p - n) / (p + n) on the pruning rows; its precision there."""
    best, worth, precision = rule, -2.0, 0.0
    for k in range(len(rule.tests), 0, -1):
        r = Rule(rule.label, rule.tests[:k])
        hit = r.covers(x)
        p, n = (hit & pos).sum(), (hit & ~pos).sum()
        if p + n and (p - n) / (p + n) >= worth:
            best, worth, precision = r, (p - n) / (p + n), p / (p + n)
    return best, precision


def induce(x: dict[str, np.ndarray], y: np.ndarray, order: list[str], seed: int = 7) -> list[Rule]:
    """Ordered rules for the labels in `order`; rows that no rule covers have the label that isn't in it."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    live = np.ones(len(y), bool)
    for label in order:
        while (live & (y == label)).any():
            rows = np.flatnonzero(live)
            draw = rng.random(len(rows)) < 2 / 3
            grow, prune = rows[draw], rows[~draw]
            if not (y[grow] == label).any():
                break
            rule = _grow({f: v[grow] for f, v in x.items()}, y[grow] == label, label)
            if not rule.tests:
                break
            rule, precision = _prune(rule, {f: v[prune] for f, v in x.items()}, y[prune] == label)
            if precision <= 0.5:
                break
            rules.append(rule)
            live &= ~rule.covers(x)
    return rules


def case_sql(rules: list[Rule], rest: str) -> str:
    """The rule list as a SQL CASE over the figures."""
    whens = " ".join(f"WHEN {r.sql()} THEN '{r.label}'" for r in rules)
    return f"CASE WHEN words IS NULL THEN NULL WHEN words = 0 AND symbol_ratio = 0 THEN 'empty' {whens} ELSE '{rest}' END"


def judged(rules: list[Rule], x: dict[str, np.ndarray], n: int, rest: str) -> np.ndarray:
    """The label of every row by the first rule that covers it."""
    out, live = np.full(n, rest, object), np.ones(n, bool)
    for r in rules:
        hit = live & r.covers(x)
        out[hit], live[hit] = r.label, False
    return out


def errors(rules: list[Rule], x: dict[str, np.ndarray], y: np.ndarray, rest: str = "prose", read: tuple[str, ...] = ("form",)) -> int:
    """Rows that the rules put on the wrong side of what is meant to be read: prose and forms."""
    meant = (rest, *read)
    return int((np.isin(judged(rules, x, len(y), rest), meant) != np.isin(y, meant)).sum())


#: Random splits into growing and pruning rows that are tried; the rule list with the fewest errors on rows that took no
#: part in either is kept.
SPLITS, HELD_OUT = 12, 0.25


def fit(samples: DataFrame, common: list[str], function: list[str]) -> list[Rule]:
    """Rules from labelled documents (text, label), a sample of bounded size."""
    rows = quality(samples, "text", common, function).select("label", *FEATURES).toPandas().sort_values(["label", *FEATURES])
    x = {f: rows[f].to_numpy(float) for f in FEATURES}
    y = rows["label"].to_numpy()
    out = np.random.default_rng(0).random(len(y)) < HELD_OUT
    seen, held = ({f: v[k] for f, v in x.items()} for k in (~out, out))
    tried = [induce(seen, y[~out], ["form", "junk", "table", "list"], seed) for seed in range(SPLITS)]
    return min(tried, key=lambda rules: (errors(rules, held, y[out]), len(rules)))
