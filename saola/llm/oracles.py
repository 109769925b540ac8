"""DuckDB SQL for the text queries that SQL can express on whole tables. The others are tested against brute force
on small fixtures."""

from __future__ import annotations

FIELD = "'^\\s*[^:=]+[:=]'"
KEEP = "'[^\\p{L}\\p{N}]+'"


def _records(table: str, key: str) -> str:
    """tbl, id, fs (fields of a form: name and value), leaf (any other text) of a table's input_text."""
    flat = f"regexp_replace(lower(input_text), {KEEP}, '', 'g')"
    name = f"regexp_replace(lower(regexp_extract(p, '^([^:=]*)[:=]', 1)), {KEEP}, '', 'g')"
    value = f"regexp_replace(lower(regexp_replace(p, '^[^:=]*[:=]', '')), {KEEP}, '', 'g')"
    return f"""SELECT '{table}' AS tbl, {key} AS id, CASE WHEN len(fs) >= 2 AND 2 * len(fs) > len(ps) AND regexp_matches(ps[1], {FIELD})
          AND regexp_matches(input_text, '[:=]') AND regexp_matches(input_text, '[;|\\n]')
        THEN list_sort(list_transform(ps, lambda p: {{'name': {name}, 'value': {value}}})) END AS form,
        CASE WHEN {flat} = '' THEN chr(1) || trim(input_text) ELSE {flat} END AS leaf
        FROM (SELECT *, list_filter(ps, lambda p: regexp_matches(p, {FIELD})) AS fs
              FROM (SELECT {key}, input_text, list_filter(regexp_split_to_array(input_text, '[;|\\r\\n]+'), lambda p: trim(p) <> '') AS ps FROM {table} WHERE input_text IS NOT NULL))"""


def _bag(name: str, rows: str) -> str:
    """CTE name(id, part, w, k, n): the words of rows(id, part, text), each with its ordinal among its equals and the number of words."""
    flat = f"trim(regexp_replace(lower(text), {KEEP}, ' ', 'g'))"
    return f"""{name} AS (SELECT id, part, w, row_number() OVER (PARTITION BY id, part, w) AS k, count(*) OVER (PARTITION BY id, part) AS n
            FROM (SELECT id, part, unnest(string_split({flat}, ' ')) AS w FROM ({rows}) WHERE text IS NOT NULL) WHERE w <> '')"""


def _alike(left: str, right: str, on: str) -> str:
    """(a, b): ids whose bags have a likeness of 0.6 or more."""
    return f"""SELECT DISTINCT a, b FROM (SELECT l.id AS a, r.id AS b, count(*) AS common, any_value(l.n + r.n) AS total FROM {left} l JOIN {right} r ON l.w = r.w AND l.k = r.k AND {on}
            GROUP BY l.id, l.part, r.id, r.part) WHERE 1.6 * common >= 0.6 * total - 1e-9"""


def oracles() -> dict[str, str]:
    # two texts are the same if their fields or their leaves are
    rows = f"""r AS (SELECT tbl, id, form, CASE WHEN form IS NULL THEN leaf END AS leaf
            FROM ({_records("training_data", "row_id")} UNION ALL {_records("log_items", "log_id")}))"""
    node = lambda x: f"md5(CASE WHEN {x} = '' THEN chr(1) ELSE {x} END)"
    field = f"md5(array_to_string(list_sort([md5('name=' || {node('f.name')}), md5('value=' || {node('f.value')})]), ''))"
    train = _bag("t", "SELECT DISTINCT row_id AS id, 1 AS part, corrected AS text FROM training_data")
    evals = _bag("e", "SELECT DISTINCT eval_id AS id, 1 AS part, correction_target AS text FROM evaluation_data UNION SELECT eval_id, 2, error_sentence FROM evaluation_data")
    crossing = f"{train}, {evals}, x AS ({_alike('t', 'e', 'true')})"
    return {
        "p3_found": f"WITH {crossing} SELECT a AS row_id, b AS eval_id FROM x",
        "p3_report": f"""WITH {crossing} SELECT split, source, count(*) AS pairs, count(DISTINCT b) AS eval_rows, count(DISTINCT a) AS train_rows
            FROM x JOIN (SELECT DISTINCT eval_id AS b, split, source FROM evaluation_data) USING (b) GROUP BY ALL""",
        "p2_found": f"""WITH {rows}, g AS (SELECT tbl, form, leaf, min(id) AS first_id FROM r GROUP BY ALL)
            SELECT DISTINCT r.tbl, g.first_id, r.id AS copy_id FROM r JOIN g
            ON r.tbl = g.tbl AND r.form IS NOT DISTINCT FROM g.form AND r.leaf IS NOT DISTINCT FROM g.leaf WHERE r.id <> g.first_id""",
        "p2_copies": f"""WITH {rows}
            SELECT tbl, CASE WHEN form IS NULL THEN md5(leaf) ELSE md5(array_to_string(list_sort(list_transform(form, lambda f: {field})), ',')) END AS root,
            min(id) AS first_id, count(DISTINCT id) AS copies FROM r GROUP BY tbl, form, leaf""",
    }
