"""Error tags, alignment and word differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K
from .filters import strip
from .normalize import clean_detection, mapping, pieces, single_spaces
from .telex import dashed_text

EDIT = "array<struct<org_word: string, corrected: string, org_word_position: int>>"
def _bind(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def tag_errors(original: Column, noisy: Column) -> Column:
    """struct<detected, target>: differing words of the noisy sentence tagged, and the original words in their
    place. A noisy sentence with fewer words gives null for the words that are missing."""

    def of(pair: Column) -> Column:
        differ = lambda o, n: F.coalesce(o != n, F.lit(True))
        tagged = F.transform(pair["o"], lambda o, i: F.when(differ(o, F.get(pair["n"], i)), F.concat(F.lit("<error> "), F.get(pair["n"], i), F.lit(" </error>"))).otherwise(o))
        right = F.filter(pair["o"], lambda o, i: differ(o, F.get(pair["n"], i)))
        return F.struct(F.array_join(tagged, " ").alias("detected"), F.when(F.size(right) == 0, K.NON_ERROR).otherwise(F.array_join(right, f" {K.CORRECTED} ")).alias("target"))

    return _bind(F.struct(pieces(original).alias("o"), pieces(noisy).alias("n")), of)


def shared_letters(a: Column, b: Column) -> Column:
    return F.array_intersect(F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != ""))


def matching_rate(wrong: Column, right: Column) -> Column:
    """Distinct shared letters over the length of the corrected word; null for an empty one."""
    return F.when(F.length(right) > 0, F.size(shared_letters(wrong, right)) / F.length(right))


def gated(detected: Column, corrected: Column, least: float = 0.5) -> Column:
    """Corrections that resemble what they replace: per word where the numbers of words agree, else none."""
    key = lambda t: F.split(F.replace(dashed_text(t), F.lit("-"), F.lit("")), " ")

    def of(p: Column) -> Column:
        chosen = F.transform(p["d"], lambda d, i: F.when(matching_rate(F.get(p["kd"], i), F.get(p["kc"], i)) >= least, F.get(p["c"], i)).otherwise(d))
        return F.array_join(F.when(F.size(p["d"]) == F.size(p["c"]), chosen).otherwise(p["d"]), " ")

    left, right = pieces(F.regexp_replace(clean_detection(detected), "</?error>", "")), pieces(clean_detection(corrected))
    texts = F.struct(left.alias("d"), right.alias("c"))
    # keyboard forms hold no space, so the words of a sentence keep their places
    keyed = _bind(texts, lambda p: F.struct(p["d"].alias("d"), p["c"].alias("c"), key(F.array_join(p["d"], " ")).alias("kd"), key(F.array_join(p["c"], " ")).alias("kc")))
    return _bind(keyed, of)


def acronym_edits(words: Column) -> Column:
    """Edits of the abbreviations among the words, in table order and then by position; next is the position of
    the following word after expansion."""
    rank = mapping({k: f"{i:03d}" for i, k in enumerate(K.SINGLE_ACRONYMS)})
    table = mapping(K.SINGLE_ACRONYMS)
    found = F.transform(words, lambda w, i: F.struct(rank[w].alias("rank"), i.cast("int").alias("at"), w.alias("w")))
    return F.transform(
        F.array_sort(F.filter(found, lambda x: x["rank"].isNotNull())),
        lambda x: F.struct(x["w"].alias("org_word"), table[x["w"]].alias("corrected"), x["at"].alias("org_word_position"), (x["at"] + F.size(F.split(table[x["w"]], " "))).alias("next")),
    )


def other_edits(corrected: Column, origin: Column, acronyms: Column) -> Column:
    """Cursor walk over the origin words: an abbreviation moves the cursor behind its expansion, a differing
    word is an edit; the walk ends with the corrected words."""
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(EDIT).alias("edits"))

    def step(state: Column, at: Column) -> Column:
        word, new = F.get(origin, at), F.get(corrected, state["cursor"])
        jump = F.get(F.filter(acronyms, lambda a: a["org_word_position"] == at), F.lit(0))["next"]
        edit = F.struct(word.alias("org_word"), new.alias("corrected"), at.alias("org_word_position"))
        moved = F.struct((state["cursor"] + 1).alias("cursor"), F.when(word != new, F.concat(state["edits"], F.array(edit))).otherwise(state["edits"]).alias("edits"))
        jumped = F.struct(jump.alias("cursor"), state["edits"].alias("edits"))
        return F.when(state["cursor"] >= F.size(corrected), state).when(jump.isNotNull(), jumped).otherwise(moved)

    positions = F.when(F.size(origin) > 0, F.sequence(F.lit(0), F.size(origin) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, step)["edits"]


def word_edits(origin: Column, corrected: Column) -> Column:
    """Edits between two sentences: by position where the numbers of words agree, else abbreviations first and
    then the walk of other_edits. An abbreviation is given once."""

    def of(p: Column) -> Column:
        same = F.filter(
            F.transform(p["o"], lambda w, i: F.struct(w.alias("org_word"), F.get(p["c"], i).alias("corrected"), i.cast("int").alias("org_word_position"))),
            lambda e: e["org_word"] != e["corrected"],
        )
        plain = lambda a: F.transform(a, lambda e: F.struct(e["org_word"].alias("org_word"), e["corrected"].alias("corrected"), e["org_word_position"].alias("org_word_position")))
        walk = _bind(acronym_edits(p["o"]), lambda a: F.concat(plain(a), other_edits(p["c"], p["o"], a)))
        return F.when(F.size(p["o"]) == F.size(p["c"]), same).otherwise(walk)

    return F.when(origin.isNotNull() & corrected.isNotNull(), _bind(F.struct(pieces(origin).alias("o"), pieces(corrected).alias("c")), of))


def _tagged_parts(tagged: Column) -> Column:
    """array<struct<start, w>> of the tagged words and their places in the untagged text."""
    parts = F.split(tagged, r"</?error>")
    # odd parts are tagged; each tag pair leaves two spaces fewer in the untagged text
    spans = F.transform(
        parts,
        lambda p, i: F.struct(
            (F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) - (i - 1)).cast("int").alias("start"),
            strip(p).alias("w"), i.alias("i"),
        ),
    )
    count = F.size(F.regexp_extract_all(tagged, F.lit("(<error>.*?</error>)"), F.lit(1)))
    return F.filter(spans, lambda s: (s["i"] % 2 == 1) & (s["i"] < 2 * count))


def error_spans(tagged: Column) -> Column:
    """array<struct<start, end>> of the tagged words in the untagged text, ends exclusive."""
    return F.transform(_tagged_parts(tagged), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["w"])).alias("end")))


def nth_span(spans: Column, n: Column | int) -> Column:
    """The n-th span from 0, null where there is none."""
    return F.get(spans, F.lit(n) if isinstance(n, int) else n)


def clean_head(tagged: Column) -> Column:
    """Words before the first tag; none for a text that starts with one or has none."""
    head = F.regexp_extract(tagged, r"(?i)^(.*?) <error>", 1)
    return F.when(tagged.startswith(K.ERROR) | ~F.lower(tagged).contains(" <error>"), F.array().cast("array<string>")).otherwise(F.split(head, " "))


def clean_tail(tagged: Column) -> Column:
    """Words after the last closing tag; none for a text that ends with it or has none."""
    tail = F.regexp_extract(tagged, r"^.*</error> (.*)$", 1)
    return F.when(tagged.endswith(K.END_ERROR) | ~tagged.contains("</error> "), F.array().cast("array<string>")).otherwise(F.split(strip(tail), " "))


def clean_ends(tagged: Column) -> Column:
    return F.struct(clean_head(tagged).alias("head"), clean_tail(tagged).alias("tail"))


def error_words(tagged: Column) -> Column:
    return F.regexp_extract_all(tagged, F.lit("(?i)<error> (.*?) </error>"), F.lit(1))


def words_between(tagged: Column) -> Column:
    """Words between a closing tag and the next opening one."""
    found = F.regexp_extract_all(tagged, F.lit("(?i)</error>?(.*?) <error>"), F.lit(1))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(F.transform(found, strip), " "), " "))


def middle(words: Column, head: Column, tail: Column) -> Column:
    """Words without as many as the clean ends hold."""
    return F.slice(words, F.size(head) + 1, F.greatest(F.size(words) - F.size(head) - F.size(tail), F.lit(0)))


def pair(origin: Column, corrected: Column) -> Column:
    return F.struct(origin.alias("origin"), corrected.alias("corrected"))


def error_rate(origin: Column, tagged: Column) -> Column:
    """Tags per word of the original."""
    return (F.length(tagged) - F.length(F.replace(tagged, F.lit(K.ERROR), F.lit("")))) / len(K.ERROR) / F.size(F.split(origin, " "))


SPANS = "array<struct<origin: string, corrected: string, start: int, end: int>>"


def arrange(corrected: Column, tagged: Column) -> Column:
    """array<struct<origin, corrected, start, end>>: the tagged spans with the corrected words that stand in their place.

    Nothing for a text without tags or with as many words as the correction. Neighbouring tags are one span. The words
    outside the tags are the landmarks: between the clean ends, a corrected word that occurs in the next landmark closes
    the span that is open, any other word joins it; behind the last landmark the span stays open to the end. Without
    landmarks all spans are one. A span beyond the tagged ones has no place and is left out."""
    merged = F.when(F.lower(tagged).contains("</error> <error>"), F.replace(tagged, F.lit(" </error> <error> "), F.lit(" "))).otherwise(tagged)

    def laid(p: Column) -> Column:
        todo = _bind(clean_ends(p["t"]), lambda ends: middle(F.split(p["c"], " "), ends["head"], ends["tail"]))
        found = F.struct(_tagged_parts(p["t"]).alias("spans"), words_between(p["t"]).alias("marks"), todo.alias("todo"))
        return _bind(found, lambda q: F.when(F.size(q["marks"]) > 0, _between_marks(q)).otherwise(_one_span(q)))

    some = corrected.isNotNull() & (corrected != "") & tagged.contains(K.ERROR) & (F.size(F.split(tagged, " ")) != F.size(F.split(corrected, " ")))
    return F.when(some, _bind(F.struct(merged.alias("t"), corrected.alias("c")), laid)).otherwise(F.array().cast(SPANS))


def _placed(origin: Column, words: Column, first: Column) -> Column:
    return F.struct(
        origin.alias("origin"), F.array_join(words, " ").alias("corrected"), first["start"].alias("start"), (first["start"] + F.length(first["w"])).alias("end"),
    )


def _one_span(q: Column) -> Column:
    whole = F.array(_placed(F.array_join(F.transform(q["spans"], lambda s: s["w"]), " "), q["todo"], F.get(q["spans"], F.lit(0))))
    return F.when((F.size(q["todo"]) > 0) & (F.size(q["spans"]) > 0), whole).otherwise(F.array().cast(SPANS))


def _between_marks(q: Column) -> Column:
    """Words are dealt to numbered heaps; a span takes the heap that was open when it closed, with what it gets later."""
    start = F.struct(
        F.lit(0).alias("span"), F.lit(0).alias("mark"), F.lit(0).alias("heap"), F.lit(False).alias("open"),
        F.array().cast("array<struct<heap: int, w: string>>").alias("words"), F.array().cast("array<struct<span: int, heap: int>>").alias("closed"),
    )
    spans, marks = F.size(q["spans"]), F.size(q["marks"])

    def close(closed: Column, span: Column, heap: Column, when: Column) -> Column:
        return F.when(when & (span < spans), F.concat(closed, F.array(F.struct(span.alias("span"), heap.alias("heap"))))).otherwise(closed)

    def step(s: Column, w: Column) -> Column:
        word = F.array(F.struct(s["heap"].alias("heap"), w.alias("w")))
        kept = F.struct(s["span"], s["mark"], s["heap"], F.lit(True).alias("open"), F.concat(s["words"], word).alias("words"), s["closed"])
        moved = s["open"].cast("int")
        last = s["mark"] == marks - 1
        done = close(close(s["closed"], s["span"], s["heap"], s["open"]), s["span"] + moved, s["heap"] + moved, last)
        passed = F.struct(
            (s["span"] + moved).alias("span"), F.when(last, s["mark"]).otherwise(s["mark"] + 1).alias("mark"), (s["heap"] + moved).alias("heap"),
            F.lit(False).alias("open"), s["words"], done.alias("closed"),
        )
        return F.when(F.contains(F.get(q["marks"], s["mark"]), w), passed).otherwise(kept)

    def spelled(s: Column) -> Column:
        words = lambda heap: F.transform(F.filter(s["words"], lambda x: x["heap"] == heap), lambda x: x["w"])
        return F.transform(s["closed"], lambda o: _bind(F.get(q["spans"], o["span"]), lambda first: _placed(first["w"], words(o["heap"]), first)))

    return _bind(F.aggregate(q["todo"], start, step), spelled)


def tag_expansions(origin: Column, detected: Column) -> Column:
    """For an abbreviation that occurs n times in the original, its first n expansions in the detected text become the
    tagged abbreviation. Table order; several-word abbreviations, counted anywhere, before words. Null origin: as it is."""
    entries = F.array(*[
        F.struct(F.lit(k).alias("short"), F.lit(v).alias("full"), F.lit(many).alias("many"))
        for table, many in ((K.MULTIPLE_ACRONYMS, True), (K.SINGLE_ACRONYMS, False)) for k, v in table.items()
    ])
    cut = lambda text, piece: F.split(text, F.concat(F.lit(r"\Q"), piece, F.lit(r"\E")))

    def counted(words: Column) -> Column:
        times = lambda e: F.when(e["many"], F.size(cut(origin, e["short"])) - 1).otherwise(F.size(F.filter(words, lambda w: w == e["short"])))
        found = F.transform(F.filter(entries, lambda e: origin.contains(e["short"])), lambda e: F.struct(e["short"], e["full"], times(e).alias("n")))
        return F.filter(found, lambda e: e["n"] > 0)

    def step(text: Column, e: Column) -> Column:
        tag = F.concat(F.lit(K.ERROR + " "), e["short"], F.lit(" " + K.END_ERROR))

        def put(parts: Column) -> Column:
            first, rest = F.slice(parts, F.lit(1), e["n"] + 1), F.slice(parts, e["n"] + 2, F.size(parts))
            join = lambda texts, by: F.call_function("array_join", texts, by)
            return F.concat(join(first, tag), F.when(F.size(rest) > 0, F.concat(e["full"], join(rest, e["full"]))).otherwise(F.lit("")))

        return _bind(cut(text, e["full"]), put)

    return F.when(origin.isNull() | detected.isNull(), detected).otherwise(F.aggregate(_bind(F.split(origin, " "), counted), detected, step))


def retag(tagged: Column, after: Column) -> Column:
    """A tagged sentence with the words of a corrected one: changed words take the new word and lose their tags,
    word by word; where the numbers of words differ the tagged sentence stays."""
    units = F.regexp_extract_all(F.concat(single_spaces(tagged), F.lit(" ")), F.lit(r"((?:<error> )*[^ ]+ (?:</error> )*)"), F.lit(1))

    def of(p: Column) -> Column:
        bare = lambda u: strip(F.regexp_replace(u, "</?error>", ""))
        new = F.transform(p["u"], lambda u, i: F.when(bare(u) != F.get(p["a"], i), F.get(p["a"], i)).otherwise(strip(u)))
        return F.when(F.size(p["u"]) == F.size(p["a"]), F.array_join(new, " ")).otherwise(single_spaces(tagged))

    return _bind(F.struct(units.alias("u"), pieces(after).alias("a")), of)


