"""DuckDB SQL that gives the same rows as the registered queries, built from the same tables and patterns."""

from __future__ import annotations

from ..functions import constants as K
from ..operators.filters import ASCII_PUNCTUATION, FORMULA, NOTATION, QUOTING, ROMAN, SPACE
from ..operators.normalize import REPEATABLE

W = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^{SPACE}+|{SPACE}+$", "")


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(SPACE + '+')}), lambda w: w <> '')"


def mapping(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def spaced(x: str) -> str:
    return sub(x, SPACE + "+", " ")


def bare(x: str) -> str:
    gone = "".join(c for c in K.PUNCTUATION if c not in K.KEPT_PUNCTUATION)
    return spaced(f"translate({x}, {q(gone)}, '')")


def formula(x: str) -> str:
    return hit(x, FORMULA)


def roman(x: str) -> str:
    return hit(x, ROMAN)


SPECIAL = f"({q(K.ERROR)}, {q(K.END_ERROR)}, {q(K.EXCEPTION)})"


def squeezed(word: str, keep_double: bool = True) -> str:
    """One word; letters are compared with those before them, as RE2 has no back references."""
    limit = 2 if keep_double else 1
    first = f"""array_to_string(list_filter(string_split({word}, ''), lambda c, i: i = 1 OR NOT contains({q(REPEATABLE)}, c) OR c <> string_split({word}, '')[i - 1]), '')"""
    x = f"(CASE WHEN {roman(word)} OR {formula(word)} OR {word} IN {SPECIAL} THEN {word} ELSE {first} END)"
    same = " AND ".join(f"string_split(y, '')[i - {k}] = c" for k in range(1, limit + 1))
    second = f"array_to_string(list_filter(string_split(y, ''), lambda c, i: NOT (i > {limit} AND {same} AND {hit('c', '^' + W + '$')})), '')"
    return f"list_transform([{x}], lambda y: CASE WHEN {roman('y')} OR {formula('y')} OR y IN {SPECIAL} THEN y ELSE {second} END)[1]"


def squeeze(x: str) -> str:
    return f"array_to_string(list_transform({pieces(x)}, lambda w: {squeezed('w')}), ' ')"


def acronyms(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: coalesce({mapping(K.SINGLE_ACRONYMS)}[w], w)), ' ')"


def many_acronyms(x: str) -> str:
    for k, v in K.MULTIPLE_ACRONYMS.items():
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


def dashed(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({mapping(K.TELEX)}[c], c)), '')"


def paired(x: str) -> str:
    for k, v in K.TELEX_PAIRS.items():
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


def tone(x: str) -> str:
    return f"regexp_extract({x}, {q('-' + W)})"


def tone_last(x: str) -> str:
    return f"(CASE WHEN {tone(x)} = '' THEN {x} ELSE replace({x}, {tone(x)}, '') || substr({tone(x)}, 2, 1) END)"


def coded(x: str) -> str:
    return f"list_transform([{dashed(x)}], lambda y: {tone_last('y')})[1]"


def variants(word: str) -> str:
    """CTE steps from w(word) to v(word, forms): the typing forms of each word, distinct and sorted."""
    both = lambda x: f"CASE WHEN {tone(x)} = '' THEN [{x}] ELSE [replace({x}, {tone(x)}, right({tone(x)}, 1)), {tone_last(x)}] END"
    no_w, short = "replace(f, 'w', '')", "replace(f, run, left(run, 1))"
    toned = f"contains({q(K.TELEX_TONES)}, right(f, 1)) AND f <> ''"
    cut = lambda x: f"left({x}, length({x}) - 1)"
    # RE2 has no back references: the first doubled letter is looked for by position, then extended
    start = "list_filter(range(1, length(f)), lambda i: substr(f, i, 1) = substr(f, i + 1, 1))[1]"
    size = f"len(list_filter(range({start}, length(f) + 1), lambda i: substr(f, {start}, i - {start} + 1) = repeat(substr(f, {start}, 1), i - {start} + 1)))"
    return f"""b AS (SELECT word, {dashed('word')} AS d, {paired('word')} AS p FROM {word})
            , f AS (SELECT word, unnest(list_concat({both('d')}, {both('p')})) AS f FROM b)
            , r AS (SELECT word, f, coalesce(substr(f, {start}, {size}), '') AS run FROM f)
            , x AS (SELECT word, unnest(list_filter([f, CASE WHEN length(f) - length({no_w}) = 1 THEN {no_w} || 'w' END, CASE WHEN length(f) - length({no_w}) = 1 AND {toned} THEN {cut(no_w)} || 'w' || right(f, 1) END,
                CASE WHEN run <> '' AND {toned} THEN {cut(short)} || left(run, 1) || right(f, 1) END, CASE WHEN run <> '' THEN {short} || left(run, 1) END], lambda y: y IS NOT NULL)) AS v FROM r)
            , v AS (SELECT word, list_sort(list_distinct(list(v))) AS forms FROM x GROUP BY word)"""


def draw(key: str, purpose: str) -> str:
    return f"CAST('0x' || substr(md5({key} || {q('|' + purpose)}), 1, 8) AS BIGINT)"


def unit(key: str, purpose: str) -> str:
    return f"({draw(key, purpose)} / 4294967296.0)"


def pick(options: str, key: str, purpose: str) -> str:
    return f"({options})[{draw(key, purpose)} % len({options}) + 1]"


def lists(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: [{', '.join(map(q, v))}]" for k, v in table.items()) + "}"


def words(column: str) -> str:
    return f"SELECT DISTINCT word FROM (SELECT unnest({pieces(column)}) AS word FROM training_data)"


def last_spots(letters: str) -> str:
    """1-based last positions of the distinct given letters of `word`."""
    return f"list_filter(range(1, length(word) + 1), lambda i: contains({q(letters)}, substr(word, i, 1)) AND NOT contains(substr(word, i + 1), substr(word, i, 1)))"


def replaced(spots: str, new: str) -> str:
    """word with the letters c at the spots i (1-based) replaced by `new`."""
    return f"array_to_string(list_transform(string_split(word, ''), lambda c, i: CASE WHEN list_contains({spots}, i) THEN {new} ELSE c END), '')"


def folded(x: str, compat: bool) -> str:
    table = {c: "d" if c == "đ" else p for p, family in K.SHAPES.items() for c in [*family, *(t for b in family for t in K.ADD_TONE.get(b, []))]}
    if compat:
        a = [c for c, p in table.items() if p == "a"]
        rest = {c: p for c, p in table.items() if p != "a"}
        return f"replace(translate(translate({x}, {q(''.join(rest))}, {q(''.join(rest.values()))}), {q(''.join(a))}, {q(chr(1) * len(a))}), {q(chr(1))}, 'ad')"
    table |= {c: b for b in "iy" for c in K.ADD_TONE[b]}
    return f"translate({x}, {q(''.join(table))}, {q(''.join(table.values()))})"


def gate(d: str, c: str) -> str:
    key = lambda w: f"replace({dashed(w)}, '-', '')"
    letters = lambda w: f"list_distinct(list_filter(string_split({key(w)}, ''), lambda x: x <> ''))"
    rate = f"len(list_intersect({letters('w')}, {letters(f'{c}[i]')})) / length({key(f'{c}[i]')})"
    return f"CASE WHEN len({d}) = len({c}) THEN array_to_string(list_transform({d}, lambda w, i: CASE WHEN length({c}[i]) > 0 AND {rate} >= 0.5 THEN {c}[i] ELSE w END), ' ') ELSE array_to_string({d}, ' ') END"


def training() -> str:
    """Training rows: the plan of each row, its words with their functions, and each function over its words."""
    k = "('42|' || row_id)"
    cleaned = strip(sub("translate(replace(replace(corrected, 'ntn', 'như thế nào'), 'đ/nghĩa', 'định nghĩa'), '–'':;', '-')", " {2,}", " "))
    normal = f"(2 + sqrt(-2 * ln(1 - {unit(k, 'normal1')})) * cos(2 * 3.141592653589793 * {unit(k, 'normal2')}))"
    heads, tails = lists(K.MISSPELT_HEADS), lists(K.MISSPELT_TAILS)
    ends = [f"WHEN {tails}[right(word, {n})] IS NOT NULL THEN left(word, greatest(length(word) - {n}, 0)) || {pick(f'{tails}[right(word, {n})]', 'k', 'tail')}" for n in (3, 2, 1)]
    tail = f"CASE {' '.join(ends)} WHEN {tails}[left(word, 1)] IS NOT NULL THEN {pick(f'{tails}[left(word, 1)]', 'k', 'tail')} || substr(word, 2) ELSE word END"
    head = (
        f"CASE WHEN {heads}[left(word, 2)] IS NOT NULL THEN replace(word, left(word, 2), {pick(f'{heads}[left(word, 2)]', 'k', 'head')}) "
        f"WHEN {heads}[left(word, 1)] IS NOT NULL THEN {pick(f'{heads}[left(word, 1)]', 'k', 'head')} || substr(word, 2) ELSE word END"
    )
    delete = lambda w, key: f"CASE WHEN length({w}) <= 1 THEN {w} ELSE left({w}, {draw(key, 'delete0')} % length({w})) || substr({w}, {draw(key, 'delete0')} % length({w}) + 2) END"
    insert = lambda w, key: f"left({w}, {draw(key, 'place0')} % length({w}) + 1) || substr({q(K.ALPHABET)}, {draw(key, 'letter0')} % {len(K.ALPHABET)} + 1, 1) || substr({w}, {draw(key, 'place0')} % length({w}) + 2)"
    step = lambda n: f"(k || '|step{n}')"

    def shapes(table: str, name: str, key: str) -> str:
        spots = last_spots("".join(K.DROP_SHAPE))
        first = f"floor(ln(1.0 - {unit(key, 'shape')} * (1 - pow(0.6, len(sh)))) / ln(0.6))"
        hits = f"list_filter(sh, lambda x, j: (j - 1) = fi OR ((j - 1) > fi AND {unit(f"({key} || '|' || (j - 1))", 'shape')} < 0.4))"
        return f"""{name}s AS (SELECT *, {spots} AS sh FROM {table}), {name}f AS (SELECT *, CASE WHEN len(sh) > 0 THEN {first} END AS fi FROM {name}s)
            , {name}h AS (SELECT *, {hits} AS hs FROM {name}f), {name} AS (SELECT row_id, pos, k, {replaced('hs', f'{mapping(K.DROP_SHAPE)}[c]')} AS word FROM {name}h)"""

    def tones(table: str, name: str) -> str:
        return f"{name}s AS (SELECT *, {last_spots(''.join(K.DROP_TONE))} AS tn FROM {table}), {name} AS (SELECT row_id, pos, k, {replaced('tn', f'{mapping(K.DROP_TONE)}[c]')} AS word FROM {name}s)"

    of = lambda n: f"(SELECT row_id, pos, k, word FROM e WHERE f = {n})"
    typed = f"""SELECT e.row_id, e.pos, e.k, e.f, {pick('list_filter(v.forms, lambda y: y <> e.word OR len(v.forms) = 1)', step(0).replace('k', 'e.k', 1), 'telex')} AS word FROM e JOIN v ON v.word = e.word WHERE e.f IN (1, 2)"""
    return f"""WITH c AS (SELECT row_id, {cleaned} AS corrected FROM training_data), a AS (SELECT *, {k} AS rk FROM c WHERE corrected <> '')
        , p AS (SELECT *, string_split(corrected, ' ') AS ws, round(CASE WHEN {normal} > 1 THEN {normal} ELSE 1 + 5 * {unit(k, 'uniform')} END, 6) / 10 AS ratio,
            {draw('rk', 'mains')} % 3 + 1 AS m, {draw('rk', 'seconds')} % 2 + 1 AS s FROM a)
        , g AS (SELECT *, CAST(ceil(least(ratio, 1.0) * len(ws)) AS INT) AS total,
            list_concat(list_transform(range(1, m + 1), lambda i: {draw("(rk || '|' || i)", 'main')} % 7), list_transform(range(1, s + 1), lambda i: 7 + {draw("(rk || '|' || i)", 'second')} % 3)) AS choices,
            list_concat(list_transform(range(1, m + 1), lambda i: round((1 - CAST(0.2 AS DOUBLE) * s) / m, 6)), list_transform(range(1, s + 1), lambda i: CAST(0.2 AS DOUBLE))) AS shares FROM p)
        , d AS (SELECT *, list_transform(range(1, len(shares) + 1), lambda j: list_sum(list_transform(shares[1:j], lambda x: CAST(ceil(x * total) AS INT)))) AS ends FROM g)
        , w AS (SELECT row_id, rk, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos, total, choices, ends FROM d)
        , r AS (SELECT *, rk || '|' || pos AS k, row_number() OVER (PARTITION BY row_id ORDER BY {draw("(rk || '|' || pos)", 'rank')}, pos) - 1 AS rank FROM w)
        , e AS (SELECT row_id, pos, k, word, CASE WHEN rank < least(total, ends[-1]) THEN choices[len(list_filter(ends, lambda x: x <= rank)) + 1] END AS f FROM r)
        , tw AS (SELECT DISTINCT word FROM e WHERE f IN (1, 2)), {variants('tw').replace('b AS', 'vb AS', 1).replace('FROM b)', 'FROM vb)').replace(' f AS (SELECT word, unnest', ' vf AS (SELECT word, unnest', 1).replace('FROM f)', 'FROM vf)').replace(', r AS (SELECT word, f', ', vr AS (SELECT word, f', 1).replace('FROM r)', 'FROM vr)').replace(', x AS', ', vx AS', 1).replace('FROM x GROUP', 'FROM vx GROUP')}
        , t AS ({typed})
        , {shapes(of(0), 's0', step(0))}, {tones('s0', 't0')}, {shapes(of(3), 's3', 'k')}, {tones(of(4), 't4')}
        , a9 AS (SELECT *, {last_spots(K.VOWELS)} AS vw FROM {of(9)})
        , n AS (SELECT row_id, pos, word FROM t0 UNION ALL SELECT row_id, pos, {delete('word', step(1))} FROM t WHERE f = 1 UNION ALL SELECT row_id, pos, {insert('word', step(1))} FROM t WHERE f = 2
            UNION ALL SELECT row_id, pos, word FROM s3 UNION ALL SELECT row_id, pos, word FROM t4 UNION ALL SELECT row_id, pos, {tail} FROM {of(5)} UNION ALL SELECT row_id, pos, {head} FROM {of(6)}
            UNION ALL SELECT row_id, pos, {delete('word', 'k')} FROM {of(7)} UNION ALL SELECT row_id, pos, {insert('word', 'k')} FROM {of(8)}
            UNION ALL SELECT row_id, pos, {replaced('vw', pick(f'{lists(K.ADD_TONE)}[c]', "(k || '|' || (i - 1))", 'tone'))} FROM a9 UNION ALL SELECT row_id, pos, word FROM e WHERE f IS NULL)
        , i AS (SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS input_text FROM n GROUP BY row_id)
        , o AS (SELECT a.row_id, a.corrected, i.input_text, {pieces('a.corrected')} AS o, {pieces('i.input_text')} AS n FROM a JOIN i USING (row_id))
        , y AS (SELECT *, list_filter(o, lambda w, i: coalesce(w <> n[i], true)) AS x FROM o)
        SELECT row_id, corrected, input_text, array_to_string(list_transform(o, lambda w, i: CASE WHEN coalesce(w <> n[i], true) THEN '<error> ' || n[i] || ' </error>' ELSE w END), ' ') AS detected,
        CASE WHEN len(x) = 0 THEN '<non_error>' ELSE array_to_string(x, ' <corrected> ') END AS new_target FROM y"""


def oracles() -> dict[str, str]:
    c = "input_text"
    rejected = lambda x: f"(contains({x}, 'http') OR len(string_split({x}, ' ')) < 5 OR NOT {hit(x, chr(91) + '^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} OR length({x}) - length({sub(x, ASCII_PUNCTUATION, '')}) > 5 OR {hit(x, QUOTING)})"
    wide = r"[^\x00-\x7F]"
    rank = mapping({k: f"{i:03d}" for i, k in enumerate(K.SINGLE_ACRONYMS)})
    exception = lambda w: f"coalesce({w} NOT IN {SPECIAL} AND ({roman(w)} OR {formula(w)}), false)"
    lower_letters = lambda x: sub(f"lower({x})", r"[^\p{L}\s]+", " ")
    vocabulary = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({lower_letters('corrected')}, '\\s+')) AS word FROM training_data) WHERE word <> '' GROUP BY word"
    telex = f"""WITH v AS ({vocabulary}), k AS (SELECT word, n, {coded('word')} AS telex FROM v WHERE n >= 2)
        , b AS (SELECT telex, min(struct_pack(m := -n, word := word)).word AS word FROM k WHERE telex <> word GROUP BY telex)
        SELECT telex, word FROM b WHERE telex NOT IN (SELECT word FROM v)"""
    bigrams = f"""WITH t AS (SELECT regexp_split_to_array({strip(lower_letters('corrected'))}, '\\s+') AS ws FROM training_data WHERE corrected IS NOT NULL)
        , p AS (SELECT unnest(list_transform(ws[:-2], lambda w, i: struct_pack(l := w, r := ws[i + 1]))) AS x FROM t WHERE len(ws) >= 2)
        , n AS (SELECT x.l AS l, x.r AS r, count(*) AS n FROM p WHERE x.l <> '' AND x.r <> '' GROUP BY ALL HAVING count(*) >= 2)
        , s AS (SELECT l AS left_word, r AS right_word, {coded('l')} AS left_telex, {coded('r')} AS right_telex, n FROM n)
        SELECT *, row_number() OVER (PARTITION BY left_telex, right_telex ORDER BY n DESC, left_word, right_word) AS ord FROM s"""
    parts = "regexp_split_to_array(detected, '</?error>')"
    spans = f"""list_transform(list_filter(range(1, len({parts}) + 1), lambda i: i % 2 = 0 AND i < len({parts})), lambda i: struct_pack(
        s := coalesce(list_sum(list_transform({parts}[1:i - 1], lambda x: length(x))), 0) - (i - 2), w := {strip(f'{parts}[i]')}))"""
    head = f"CASE WHEN starts_with(detected, '<error>') OR NOT contains(lower(detected), ' <error>') THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_extract(detected, '(?i)^(.*?) <error>', 1), ' ') END"
    tail = f"CASE WHEN ends_with(detected, '</error>') OR NOT contains(detected, '</error> ') THEN CAST([] AS VARCHAR[]) ELSE string_split({strip(chr(114) + 'egexp_extract(detected, ' + q('^.*</error> (.*)$') + ', 1)')}, ' ') END"
    heads, tails = lists(K.MISSPELT_HEADS), lists(K.MISSPELT_TAILS)
    key = "('42|' || word)"
    vowel = "CASE " + " ".join(f"WHEN contains(word, {q(k)}) THEN replace(word, {q(k)}, {q(v)})" for k, v in K.MISSPELT_VOWELS.items()) + " ELSE word END"
    vowel_n = "CASE WHEN " + " OR ".join(f"contains(word, {q(k)})" for k in K.MISSPELT_VOWELS) + " THEN 1 ELSE 0 END"
    tail_at = lambda k: f"{tails}[right(word, {k})] IS NOT NULL"
    tail_new = lambda k: f"left(word, greatest(length(word) - {k}, 0)) || {pick(f'{tails}[right(word, {k})]', key, 'tail')}"
    expansions = "[" + ", ".join(
        f"{{'short': {q(k)}, 'long': {q(v)}, 'many': {many}}}" for t, many in ((K.MULTIPLE_ACRONYMS, True), (K.SINGLE_ACRONYMS, False)) for k, v in t.items()
    ) + "]"
    return {
        "filter_corpus": f"SELECT doc_id, {strip('text')} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE NOT {rejected('text')}",
        "flag_predicates": f"""SELECT row_id, contains({c}, 'http') AS url, len(string_split({c}, ' ')) < 5 AS short, NOT {hit(c, wide)} AS plain,
            length({c}) - length({sub(c, ASCII_PUNCTUATION, '')}) > 5 AS marks, {rejected(c)} AS rejected, {formula(c)} AS formula, {hit(c, NOTATION)} AS notation,
            contains({c}, '<unk>') AS unknown, contains(detected, '<error>') AS tagged, contains(lower(detected), '</error> <error>') AS adjacent,
            starts_with(detected, '<error>') AS starts, ends_with(detected, '</error>') AS ends FROM training_data WHERE {c} IS NOT NULL""",
        "word_flags": f"SELECT word, {roman('word')} AS roman, {formula('word')} AS formula, {hit('word', NOTATION)} AS notation, word IN {SPECIAL} AS special FROM ({words('detected')})",
        "unprocessed_rows": f"SELECT log_id, {c}, ({c} = '' OR {formula(c)} OR {hit(c, NOTATION)}) AS untouched FROM log_items WHERE {c} IS NOT NULL",
        "clean_lines": f"SELECT log_id, {strip(f'replace({c}, chr(10), {q(str())})')} AS line, {spaced(c)} AS spaced, {bare(c)} AS bare, translate({c}, '“–”', '\"-\"') AS quotes FROM log_items WHERE {c} IS NOT NULL",
        "squeeze_words": f"SELECT word, {squeezed('word')} AS two, {squeezed('word', False)} AS one FROM ({words(c)})",
        "detection_cleanup": f"""SELECT row_id, {strip("replace(replace('<pad>' || detected || '</s><pad>', '<pad>', ''), '</s>', '')")} AS cleaned,
            {strip(spaced(sub('detected', '</?error>', '')))} AS untagged, replace(detected, ' </error> <error> ', ' ') AS joined FROM training_data WHERE detected IS NOT NULL""",
        "untag_exceptions": f"""SELECT row_id, array_to_string(list_filter(ws, lambda w, i: NOT ((w = '<error>' AND {exception('ws[i + 1]')}) OR (w = '</error>' AND i > 1 AND {exception('ws[i - 1]')}))), ' ') AS kept
            FROM (SELECT row_id, {pieces('detected')} AS ws FROM training_data WHERE detected IS NOT NULL)""",
        "clean_sentences": f"""SELECT doc_id, {strip(sub("translate(replace(replace(text, 'ntn', 'như thế nào'), 'đ/nghĩa', 'định nghĩa'), '–'':;', '-')", ' {2,}', ' '))} AS cleaned FROM documents""",
        "expand_acronyms": f"SELECT log_id, {acronyms(c)} AS single, {many_acronyms(c)} AS multiple FROM log_items WHERE {c} IS NOT NULL",
        "pre_correct": f"SELECT row_id, {squeeze(acronyms(bare(c)))} AS fixed FROM training_data WHERE {c} IS NOT NULL",
        "fold_letters": f"SELECT row_id, {folded('lower(corrected)', False)} AS plain, {folded('lower(corrected)', True)} AS compat FROM training_data WHERE corrected IS NOT NULL",
        "telex_words": f"SELECT word, {dashed('word')} AS dashed, {paired('word')} AS paired, {coded('word')} AS coded FROM ({words('corrected')})",
        "telex_variants": f"WITH w AS ({words('corrected')}), {variants('w')} SELECT word, array_to_string(forms, ' ') AS forms FROM v",
        "telex_errors": f"""WITH w AS ({words('corrected')}), {variants('w')}
            , o AS (SELECT word, list_filter(forms, lambda y: y <> word OR len(forms) = 1) AS fs FROM v)
            , e AS (SELECT word, {pick('fs', key, 'telex')} AS typed, {pick('fs', f"({key} || '|step0')", 'telex')} AS step FROM o)
            SELECT word, typed, CAST(typed <> word AS INT) AS typed_n, CASE WHEN length(step) <= 1 THEN step ELSE left(step, {draw(f"({key} || '|step1')", 'delete0')} % length(step)) || substr(step, {draw(f"({key} || '|step1')", 'delete0')} % length(step) + 2) END AS chained,
            CAST(step <> word AS INT) + CASE WHEN length(step) <= 1 THEN 0 ELSE 1 END AS chained_n FROM e""",
        "retagged": f"""WITH p AS (SELECT row_id, {spaced('detected')} AS t, regexp_extract_all({spaced('detected')} || ' ', '((?:<error> )*[^ ]+ (?:</error> )*)', 1) AS u, {pieces('corrected')} AS a FROM training_data WHERE detected IS NOT NULL AND corrected IS NOT NULL)
            SELECT row_id, CASE WHEN len(u) = len(a) THEN array_to_string(list_transform(u, lambda x, i: CASE WHEN {strip(sub('x', '</?error>', ''))} <> a[i] THEN a[i] ELSE {strip('x')} END), ' ') ELSE t END AS retagged FROM p""",
        "repeat_runs": f"""WITH l AS (SELECT row_id, unnest(string_split({c}, ' ')) AS word, generate_subscripts(string_split({c}, ' '), 1) - 1 AS word_index FROM training_data WHERE {c} IS NOT NULL)
            , s AS (SELECT *, list_filter(range(1, length(word)), lambda i: substr(word, i, 1) = substr(word, i + 1, 1) AND {hit('substr(word, i, 1)', '^' + W + '$')} AND (i = 1 OR substr(word, i - 1, 1) <> substr(word, i, 1))) AS st FROM l WHERE word NOT IN {SPECIAL})
            SELECT row_id, word, word_index, array_to_string(list_transform(st, lambda i: substr(word, i, len(list_filter(range(i, length(word) + 1), lambda j: substr(word, i, j - i + 1) = repeat(substr(word, i, 1), j - i + 1))))), ' ') AS runs FROM s WHERE len(st) > 0""",
        "training_rows": training(),
        "telex_dictionary": telex,
        "telex_lookup": f"""WITH d AS ({telex}), l AS (SELECT row_id, unnest({pieces(c)}) AS w, generate_subscripts({pieces(c)}, 1) AS pos FROM training_data WHERE {c} IS NOT NULL)
            , s AS (SELECT row_id, pos, CASE WHEN contains({q(K.PUNCTUATION)}, right(w, 1)) THEN left(w, length(w) - 1) ELSE w END AS telex, CASE WHEN contains({q(K.PUNCTUATION)}, right(w, 1)) THEN right(w, 1) ELSE '' END AS mark FROM l)
            , f AS (SELECT row_id, string_agg(coalesce(d.word || mark, s.telex), ' ' ORDER BY pos) AS corrected FROM s LEFT JOIN d USING (telex) GROUP BY row_id)
            SELECT t.row_id, coalesce(f.corrected, '') AS corrected FROM training_data t LEFT JOIN f USING (row_id) WHERE t.{c} IS NOT NULL""",
        "bigram_dictionary": bigrams,
        "word_errors": f"""WITH w AS ({words('corrected')})
            , s AS (SELECT word, {last_spots(''.join(K.DROP_SHAPE))} AS sh, {last_spots(''.join(K.DROP_TONE))} AS tn, {last_spots(K.VOWELS)} AS vw FROM w)
            , f AS (SELECT *, CASE WHEN len(sh) > 0 THEN floor(ln(1.0 - {unit(key, 'shape')} * (1 - pow(0.6, len(sh)))) / ln(0.6)) END AS first FROM s)
            , h AS (SELECT *, list_filter(sh, lambda x, j: (j - 1) = first OR ((j - 1) > first AND {unit(f"({key} || '|' || (j - 1))", 'shape')} < 0.4)) AS hits FROM f)
            SELECT word, {replaced('hits', f'{mapping(K.DROP_SHAPE)}[c]')} AS shapes, len(hits) AS shapes_n, {replaced('tn', f'{mapping(K.DROP_TONE)}[c]')} AS tones, len(tn) AS tones_n,
            {replaced('vw', pick(f'{lists(K.ADD_TONE)}[c]', f"({key} || '|' || (i - 1))", 'tone'))} AS toned, len(vw) AS toned_n,
            CASE WHEN length(word) <= 1 THEN word ELSE left(word, {draw(key, 'delete0')} % length(word)) || substr(word, {draw(key, 'delete0')} % length(word) + 2) END AS deleted, CASE WHEN length(word) <= 1 THEN 0 ELSE 1 END AS deleted_n,
            left(word, {draw(key, 'place0')} % length(word) + 1) || substr({q(K.ALPHABET)}, {draw(key, 'letter0')} % {len(K.ALPHABET)} + 1, 1) || substr(word, {draw(key, 'place0')} % length(word) + 2) AS inserted, 1 AS inserted_n,
            CASE WHEN {heads}[left(word, 2)] IS NOT NULL THEN replace(word, left(word, 2), {pick(f'{heads}[left(word, 2)]', key, 'head')}) WHEN {heads}[left(word, 1)] IS NOT NULL THEN {pick(f'{heads}[left(word, 1)]', key, 'head')} || substr(word, 2) ELSE word END AS head,
            CASE WHEN {heads}[left(word, 2)] IS NOT NULL OR {heads}[left(word, 1)] IS NOT NULL THEN 1 ELSE 0 END AS head_n,
            CASE WHEN {tail_at(3)} THEN {tail_new(3)} WHEN {tail_at(2)} THEN {tail_new(2)} WHEN {tail_at(1)} THEN {tail_new(1)} WHEN {tails}[left(word, 1)] IS NOT NULL THEN {pick(f'{tails}[left(word, 1)]', key, 'tail')} || substr(word, 2) ELSE word END AS tail,
            CASE WHEN {tail_at(3)} OR {tail_at(2)} OR {tail_at(1)} OR {tails}[left(word, 1)] IS NOT NULL THEN 1 ELSE 0 END AS tail_n,
            {vowel} AS vowel, {vowel_n} AS vowel_n FROM h""",
        "chat_words": f"""SELECT row_id, array_to_string(list_transform({pieces('corrected')}, lambda w, i: CASE WHEN {mapping(K.CHAT)}[w] IS NOT NULL AND {unit("('42|' || row_id || '|' || (i - 1))", 'chat')} < 0.35 THEN {mapping(K.CHAT)}[w] ELSE w END), ' ') AS chat
            FROM training_data WHERE corrected IS NOT NULL""",
        "swap_ends": f"""WITH p AS (SELECT row_id, string_split(corrected, ' ') AS ws FROM training_data WHERE corrected IS NOT NULL)
            , h AS (SELECT row_id, list_transform(ws, lambda w, i: struct_pack(w := w,
                h := CASE WHEN {unit("('42|' || row_id || '|' || (i - 1))", 'head')} < 0.1 THEN {mapping(K.HEAD_SWAPS)}[left(w, 1)] END,
                t := CASE WHEN {unit("('42|' || row_id || '|' || (i - 1))", 'tail')} < 0.1 THEN {mapping(K.TAIL_SWAPS)}[right(w, 1)] END)) AS xs FROM p)
            SELECT row_id, array_to_string(list_transform(xs, lambda x: CASE WHEN length(x.w) > 1 THEN coalesce(x.h, left(x.w, 1)) || substr(x.w, 2, length(x.w) - 2) || coalesce(x.t, right(x.w, 1)) ELSE coalesce(x.h, x.t, x.w) END), ' ') AS text,
            len(list_filter(xs, lambda x: x.h IS NOT NULL OR x.t IS NOT NULL)) AS hit FROM h""",
        "error_tagging": f"""WITH p AS (SELECT row_id, {pieces('corrected')} AS o, {pieces(c)} AS n FROM training_data WHERE corrected IS NOT NULL AND {c} IS NOT NULL)
            , r AS (SELECT *, list_filter(o, lambda w, i: coalesce(w <> n[i], true)) AS x FROM p)
            SELECT row_id, array_to_string(list_transform(o, lambda w, i: CASE WHEN coalesce(w <> n[i], true) THEN '<error> ' || n[i] || ' </error>' ELSE w END), ' ') AS tagged,
            CASE WHEN len(x) = 0 THEN '<non_error>' ELSE array_to_string(x, ' <corrected> ') END AS target FROM r""",
        "tag_parts": f"""WITH p AS (SELECT row_id, detected, corrected, {head} AS hd, {tail} AS tl, {spans} AS sp, list_transform(regexp_extract_all(detected, '(?i)</error>?(.*?) <error>', 1), lambda x: {strip('x')}) AS bt FROM training_data WHERE detected IS NOT NULL)
            SELECT row_id, array_to_string(hd, '|') AS head, array_to_string(tl, '|') AS tail, array_to_string(regexp_extract_all(detected, '(?i)<error> (.*?) </error>', 1), '|') AS errors,
            array_to_string(CASE WHEN len(bt) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(array_to_string(bt, ' '), ' ') END, '|') AS between,
            array_to_string(list_transform(sp, lambda s: s.s || '-' || (s.s + length(s.w))), '|') AS spans, sp[1].s AS first_start,
            array_to_string({pieces('corrected')}[len(hd) + 1:greatest(len({pieces('corrected')}) - len(tl), len(hd))], '|') AS middle FROM p""",
        "match_gate": f"WITH p AS (SELECT row_id, {pieces(sub('detected', '</?error>', ''))} AS d, {pieces('corrected')} AS c FROM training_data WHERE detected IS NOT NULL AND corrected IS NOT NULL) SELECT row_id, {gate('d', 'c')} AS gated FROM p",
        "matching_rates": """SELECT org_word, corrected, CASE WHEN length(corrected) > 0 THEN round(len(list_intersect(list_distinct(string_split(org_word, '')), list_distinct(string_split(corrected, '')))) / length(corrected), 6) END AS rate
            FROM (SELECT DISTINCT org_word, corrected FROM correction_edits)""",
        "acronym_edits": f"""WITH p AS (SELECT DISTINCT log_id, {c} FROM log_items WHERE {c} IS NOT NULL)
            , l AS (SELECT log_id, {c} AS t, unnest({pieces(c)}) AS w, generate_subscripts({pieces(c)}, 1) - 1 AS pos FROM p)
            SELECT log_id, row_number() OVER (PARTITION BY log_id, t ORDER BY {rank}[w], pos) - 1 AS ord, w AS org_word, {mapping(K.SINGLE_ACRONYMS)}[w] AS corrected, pos AS org_word_position, pos + len(string_split({mapping(K.SINGLE_ACRONYMS)}[w], ' ')) AS next
            FROM l WHERE {rank}[w] IS NOT NULL""",
        "suggestions": """WITH d AS (SELECT DISTINCT id, org_word_position, org_word, corrected FROM correction_edits)
            SELECT id, count(*) FILTER (org_word <> corrected) AS n, coalesce(string_agg(concat_ws('>', org_word_position, org_word, corrected), '|' ORDER BY org_word_position, org_word, corrected) FILTER (org_word <> corrected), '') AS edits FROM d GROUP BY id""",
        "error_rates": "SELECT eval_id, round((length(detection_target) - length(replace(detection_target, '<error>', ''))) / 7 / len(string_split(error_sentence, ' ')), 6) AS rate FROM evaluation_data WHERE error_sentence IS NOT NULL",
        "word_groups": f"""WITH l AS (SELECT row_id, unnest({pieces('detected')}) AS w, generate_subscripts({pieces('detected')}, 1) AS i FROM training_data WHERE detected IS NOT NULL)
            , e AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY row_id ORDER BY i) = '<error>', false) AS e FROM l)
            , k AS (SELECT *, lag(w) OVER s AS pw, i - lag(i) OVER s AS pd, lead(w) OVER s AS nw, lead(i) OVER s - i AS nd FROM e WHERE w NOT IN ('<error>', '</error>') WINDOW s AS (PARTITION BY row_id ORDER BY i))
            SELECT row_id, pw AS left_word, w AS right_word, CASE WHEN pd = 3 THEN 'none' ELSE 'left' END AS side FROM k WHERE e AND pw IS NOT NULL
            UNION ALL SELECT row_id, w, nw, CASE WHEN nd = 3 THEN 'none' ELSE 'right' END FROM k WHERE e AND nw IS NOT NULL""",
        "tag_counts": "SELECT error_type, error_pct, sum(len(regexp_extract_all(detection_target, '(<error>.+?</error>)', 1))) AS tags, count(*) AS n FROM evaluation_data GROUP BY ALL",
        "batches": "SELECT row // 32 AS batch, count(*) AS n, md5(string_agg(text, '|' ORDER BY row)) AS digest FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row, coalesce(corrected, '') AS text FROM training_data) GROUP BY 1",
        "splits": f"SELECT row_id, CASE WHEN {draw(chr(40) + q('19|') + ' || row_id)', 'split')} < {int(0.1 * 2**32)} THEN 'valid' ELSE 'train' END AS part FROM training_data",
        "shuffle_keys": "SELECT row_id, md5('19|detection|' || row_id) AS detect_key, md5('19|correction|' || row_id) AS correct_key FROM training_data",
        "task_rows": """SELECT row_id, 'detection' AS task, 'detection: ' || input_text AS input, detected AS label FROM training_data
            UNION ALL SELECT row_id, 'correction', 'correction: ' || detected, corrected FROM training_data WHERE corrected IS NOT NULL""",
        "queue_page": "SELECT id, content FROM request_items WHERE prediction IS NULL ORDER BY CAST(id AS BIGINT), queued_at LIMIT 16",
        "event_counts": "SELECT strftime(date_trunc('hour', logged_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS start, client_id, count(*) AS n FROM log_items WHERE logged_at IS NOT NULL GROUP BY ALL",
        "word_edits": f"""WITH p AS (SELECT id, o, c, list_filter(list_transform(o, lambda w, i: {{'rank': {rank}[w], 'at': i - 1, 'w': w}}), lambda x: x.rank IS NOT NULL) AS ks
              FROM (SELECT id, {pieces('content')} AS o, {pieces('prediction')} AS c FROM (SELECT DISTINCT id, content, prediction FROM request_items WHERE prediction IS NOT NULL AND content IS NOT NULL)))
            , a AS (SELECT id, o, c, list_transform(list_sort(ks), lambda x: {{'w': x.w, 'n': {mapping(K.SINGLE_ACRONYMS)}[x.w], 'at': x.at, 'next': x.at + len(string_split({mapping(K.SINGLE_ACRONYMS)}[x.w], ' '))}}) AS ks FROM p)
            , walked AS (SELECT *, list_reduce(list_transform(range(0, len(o)), lambda k: {{'cursor': k, 'hits': CAST([] AS BIGINT[]), 'news': CAST([] AS VARCHAR[])}}),
                lambda s, x: CASE WHEN s.cursor >= len(c) THEN s WHEN len(list_filter(ks, lambda y: y.at = x.cursor)) > 0 THEN {{'cursor': list_filter(ks, lambda y: y.at = x.cursor)[1].next, 'hits': s.hits, 'news': s.news}}
                  WHEN o[x.cursor + 1] <> c[s.cursor + 1] THEN {{'cursor': s.cursor + 1, 'hits': list_append(s.hits, x.cursor), 'news': list_append(s.news, c[s.cursor + 1])}} ELSE {{'cursor': s.cursor + 1, 'hits': s.hits, 'news': s.news}} END,
                {{'cursor': CAST(0 AS BIGINT), 'hits': CAST([] AS BIGINT[]), 'news': CAST([] AS VARCHAR[])}}) AS s FROM a)
            SELECT id, e.a AS org_word, e.b AS corrected, CAST(e.i AS INT) AS org_word_position FROM (SELECT id, unnest(CASE WHEN len(o) = len(c)
              THEN list_filter(list_transform(o, lambda w, i: {{'a': w, 'b': c[i], 'i': i - 1}}), lambda e: e.a <> e.b)
              ELSE list_concat(list_transform(ks, lambda x: {{'a': x.w, 'b': x.n, 'i': x.at}}), list_transform(s.hits, lambda h, k: {{'a': o[h + 1], 'b': s.news[k], 'i': h}})) END) AS e FROM walked)""",
        "tagged_expansions": f"""WITH p AS (SELECT DISTINCT log_id, {c} AS t FROM log_items WHERE {c} IS NOT NULL)
            , x AS (SELECT log_id, t, {acronyms(many_acronyms('t'))} AS d FROM p)
            , k AS (SELECT *, list_filter(list_transform({expansions}, lambda e: {{'text': '', 'short': e.short, 'long': e.long, 'n': CASE WHEN e.many THEN len(string_split(t, e.short)) - 1 ELSE len(list_filter(string_split(t, ' '), lambda w: w = e.short)) END}}), lambda e: e.n > 0) AS es FROM x)
            SELECT log_id, CASE WHEN len(es) = 0 THEN d ELSE list_reduce(es, lambda a, e: {{'text': replace(array_to_string(string_split(a.text, e.long)[1:e.n + 1], chr(7)), chr(7), '<error> ' || e.short || ' </error>')
                || CASE WHEN len(string_split(a.text, e.long)) > e.n + 1 THEN e.long || replace(array_to_string(string_split(a.text, e.long)[e.n + 2:], chr(7)), chr(7), e.long) ELSE '' END, 'short': e.short, 'long': e.long, 'n': e.n}},
              {{'text': d, 'short': '', 'long': '', 'n': CAST(0 AS BIGINT)}}).text END AS tagged FROM k""",
        "queue_stream": f"SELECT id, {squeeze(acronyms(bare('content')))} AS prediction, 1 AS finish FROM (SELECT id, min(content) AS content FROM request_items WHERE prediction IS NULL GROUP BY id)",
        "queue_snapshot": f"""WITH asked AS (SELECT id, min(content) AS content, max(prediction) AS before, bool_or(prediction IS NULL) AS waits FROM request_items GROUP BY id)
            SELECT id, content, coalesce(CASE WHEN waits THEN {squeeze(acronyms(bare('content')))} END, before) AS prediction, CASE WHEN waits OR before IS NOT NULL THEN 1 ELSE 0 END AS finish FROM asked""",
        "queue_remaining": "SELECT id, content FROM request_items WHERE id NOT IN (SELECT id FROM request_items WHERE finish = 1)",
        "batches_once": "SELECT row // 32 AS batch, count(*) AS n, md5(string_agg(text, '|' ORDER BY row)) AS digest FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row, text FROM (SELECT coalesce(corrected, '') AS text, min(row_id) AS row_id FROM training_data GROUP BY 1)) GROUP BY 1",
        "text_files": f"SELECT text, count(*) AS n FROM (SELECT {strip('text')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) WHERE NOT {rejected('text')}) GROUP BY text",
        "arranged_spans": f"""WITH p AS (SELECT row_id, corrected, CASE WHEN contains(lower(detected), '</error> <error>') THEN replace(detected, ' </error> <error> ', ' ') ELSE detected END AS detected FROM training_data
              WHERE corrected <> '' AND contains(detected, '<error>') AND len(string_split(detected, ' ')) <> len(string_split(corrected, ' ')))
            , m AS (SELECT row_id, {head} AS hd, {tail} AS tl, {spans} AS sp, string_split(corrected, ' ') AS ws, list_transform(regexp_extract_all(detected, '(?i)</error>?(.*?) <error>', 1), lambda x: {strip('x')}) AS bt FROM p)
            , t AS (SELECT row_id, sp, ws[len(hd) + 1:greatest(len(ws) - len(tl), len(hd))] AS todo, CASE WHEN len(bt) = 0 THEN [] ELSE string_split(array_to_string(bt, ' '), ' ') END AS marks FROM m)
            , f AS (SELECT *, list_reduce(list_transform(todo, lambda w: {{'w': w, 'span': 0, 'mark': 0, 'heap': 0, 'open': 0, 'heaps': CAST([] AS INT[]), 'words': CAST([] AS VARCHAR[]), 'closed': CAST([] AS INT[]), 'taken': CAST([] AS INT[])}}),
                lambda s, x: CASE WHEN NOT contains(marks[s.mark + 1], x.w)
                  THEN {{'w': '', 'span': s.span, 'mark': s.mark, 'heap': s.heap, 'open': 1, 'heaps': list_append(s.heaps, s.heap), 'words': list_append(s.words, x.w), 'closed': s.closed, 'taken': s.taken}}
                  ELSE {{'w': '', 'span': s.span + s.open, 'mark': least(s.mark + 1, len(marks) - 1), 'heap': s.heap + s.open, 'open': 0, 'heaps': s.heaps, 'words': s.words,
                    'closed': list_concat(s.closed, list_filter([CASE WHEN s.open = 1 THEN s.span END, CASE WHEN s.mark = len(marks) - 1 THEN s.span + s.open END], lambda k: k < len(sp))),
                    'taken': list_concat(s.taken, list_transform(list_filter([CASE WHEN s.open = 1 THEN 0 END, CASE WHEN s.mark = len(marks) - 1 THEN s.open END], lambda k: s.span + k < len(sp)), lambda k: s.heap + k))}} END,
                {{'w': '', 'span': 0, 'mark': 0, 'heap': 0, 'open': 0, 'heaps': CAST([] AS INT[]), 'words': CAST([] AS VARCHAR[]), 'closed': CAST([] AS INT[]), 'taken': CAST([] AS INT[])}}) AS s FROM t)
            , o AS (SELECT row_id, unnest(CASE WHEN len(marks) > 0 THEN list_transform(s.closed, lambda k, i: {{'origin': sp[k + 1].w, 'corrected': array_to_string(list_filter(s.words, lambda w, n: s.heaps[n] = s.taken[i]), ' '), 'a': sp[k + 1].s, 'b': sp[k + 1].s + length(sp[k + 1].w)}})
                WHEN len(todo) > 0 AND len(sp) > 0 THEN [{{'origin': array_to_string(list_transform(sp, lambda x: x.w), ' '), 'corrected': array_to_string(todo, ' '), 'a': sp[1].s, 'b': sp[1].s + length(sp[1].w)}}] END) AS e FROM f)
            SELECT row_id, e.origin AS origin, e.corrected AS corrected, CAST(e.a AS INT) AS start, CAST(e.b AS INT) AS "end" FROM o""",
        "training_files": "SELECT nullif(corrected, '') AS corrected, nullif(input_text, '') AS input_text, nullif(detected, '') AS detected, nullif(new_target, '') AS new_target, count(*) AS n FROM training_data GROUP BY ALL",
        "evaluation_files": "SELECT nullif(error_sentence, '') AS error_sentence, nullif(detection_target, '') AS detection_target, nullif(correction_target, '') AS correction_target, error_type, count(*) AS n FROM evaluation_data WHERE error_type IS NOT NULL GROUP BY ALL",
    }
