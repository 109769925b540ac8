"""Behaviour of the correction operators on small cases, and against independent Python forms."""

import random
import re
import string
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saola.functions import constants as K
from saola.operators import augment as A
from saola.operators import batches as B
from saola.operators import evaluate as E
from saola.operators import filters as P
from saola.operators import normalize as N
from saola.operators import noise as Z
from saola.operators import tagging as T
from saola.operators import telex as X
from saola.operators import vocabulary as V

C = F.col("t")
# The established cases of span arrangement.
LONG = (
    "Sinh học phân tử là một phân ngành sinh học nhằm <error> nhiên </error> cứu <error> cơở </error> phân tử của các hoạt động sinh học bên trong và giữ "
    "các tế bào, bao gồm các quá trình <error> tong </error> hợp, <error> biêns </error> đổi, cơ <error> chees </error>, và các tương tác <error> phan </error> tử"
)
LONG_FIXED = (
    "Sinh học phân tử là một phân ngành sinh học nhằm nghiên cứu cơ cấu phân tử của các hoạt động sinh học bên trong và giữ các tế bào, bao gồm các quá trình "
    "tong hợp, biến đổi, cơ ches, và các tương tác phân tử"
)
SHORT, SHORT_FIXED = "<error> Co </error> quan cafe nào ngon <error> boo </error> <error> re </error> <error> ko </error>", "Cơ quan cafe nào ngon lành cả"


def texts(ask, values, *columns):
    return ask([(v,) for v in values], "t string", *columns)


def test_acronyms(ask):
    single = {"t là svtt của cty ftech": "t là sinh viên thực tập của công ty ftech", "nêu đ/nghĩa của ptrình": "nêu định nghĩa của phương trình", "hỉu chết liền": "hiểu chết liền"}
    assert [r[0] for r in texts(ask, single, N.expand_acronyms(C))] == list(single.values())
    multi = {"cái j z má": "cái gì vậy má", "đang ở mô đó": "đang ở đâu đó"}
    assert [r[0] for r in texts(ask, multi, N.expand_acronyms(C, multiple=True))] == list(multi.values())
    mix = {"m đang làm svtt ở mô đó?": "m đang làm sinh viên thực tập ở đâu đó?", "xg sống t khum ổn m ơi": "xương sống t không ổn m ơi", "bài nớ tìm bcnn dc k?": "bài đó tìm bội chung nhỏ nhất được không?"}
    assert [r[0] for r in texts(ask, mix, N.expand_acronyms(N.expand_acronyms(C, multiple=True)))] == list(mix.values())


def test_tag_tests(ask):
    got = texts(ask, ["Not have continue <error> error </error>", "Have <error> continue </error> <error> error </error>", "<error> Is </error> start", "x", None],
                P.has_adjacent_errors(C), P.starts_with_error(C), P.ends_with_error(C), P.has_error(C))
    assert got == [(False, False, True, True), (True, False, True, True), (False, True, False, True), (False, False, False, False), (None,) * 4]


def test_tag_parts(ask):
    got = texts(ask, ["<error> Is </error> start with error", "Not start with <error> error </error>", "Clean <error> ending </error> text", "none", ""], T.clean_head(C), T.clean_tail(C), T.error_words(C))
    assert got == [([], ["start", "with", "error"], ["Is"]), (["Not", "start", "with"], [], ["error"]), (["Clean"], ["text"], ["ending"]), ([], [], []), ([], [], [])]
    assert texts(ask, ["Error <error> in </error> remain <error> text </error>"], T.words_between(C)) == [(["remain"],)]
    assert texts(ask, ["Have <error> a </error> <error> b </error>"], N.join_adjacent_errors(C)) == [("Have <error> a b </error>",)]


def test_error_spans(ask):
    cases = {
        "Hôm qua em đi học": [], "Hôm <error> qua </error> em đi <error> học </error>": [(4, 7), (14, 17)],
        "<error> Hôm </error> qua em <error> đi </error> học <error> mẫu </error> giáo": [(0, 3), (11, 13), (18, 21)],
    }
    assert [[tuple(s) for s in r[0]] for r in texts(ask, cases, T.error_spans(C))] == list(cases.values())
    assert texts(ask, ["a <error> b </error>"], T.nth_span(T.error_spans(C), 3)) == [(None,)]


def test_arrange(ask):
    long = [("nhiên", "nghiên", 49, 54), ("cơở", "cơ cấu", 59, 62), ("tong", "tong", 149, 153), ("biêns", "biến", 159, 164)]
    short = [("Co", "Cơ", 0, 2), ("boo re ko", "lành cả", 22, 31)]
    got = ask([(LONG_FIXED, LONG), (SHORT_FIXED, SHORT), ("a b", "a b"), (None, "x"), ("", "")], "c string, t string", T.arrange(F.col("c"), C))
    assert [[tuple(s) for s in r[0]] for r in got] == [long, short, [], [], []]


def test_middle(ask):
    got = ask([(LONG_FIXED, LONG), (SHORT_FIXED, SHORT)], "c string, t string", T.middle(F.split("c", " "), T.clean_head(C), T.clean_tail(C)))
    assert got[0][0][0] == "nghiên" and got[0][0][-1] == "phân" and len(got[0][0]) == 35
    assert got[1][0] == SHORT_FIXED.split(" ")


def test_word_edits(ask):
    got = ask([("a b c", "a x c"), ("hỉu vd rồi", "hiểu ví dụ xong"), ("x", "x"), ("a b", ""), (None, "a")], "o string, c string", T.word_edits(F.col("o"), F.col("c")))
    assert [None if r[0] is None else [tuple(e) for e in r[0]] for r in got] == [
        [("b", "x", 1)], [("hỉu", "hiểu", 0), ("vd", "ví dụ", 1), ("rồi", "xong", 2)], [], [], None,
    ]


def test_tag_errors_and_gate(ask):
    got = ask([("a b c", "a x c"), ("a b", "a b"), ("a b c", "a b")], "o string, n string", T.tag_errors(F.col("o"), F.col("n")))
    assert [tuple(r[0]) for r in got] == [("a <error> x </error> c", "b"), ("a b", "<non_error>"), ("a b", "c")]
    got = ask([("<error> tuwf </error> cây", "từ cây"), ("a b", "x y z"), ("học", "xyz")], "d string, c string", T.gated(F.col("d"), F.col("c")))
    assert [r[0] for r in got] == ["từ cây", "a b", "học"]


def test_retag_and_expansions(ask):
    got = ask([("em <error> hoc </error> bài <error> x </error>", "em học bài x"), ("a <error> b </error>", "a")], "t string, a string", T.retag(C, F.col("a")))
    assert [r[0] for r in got] == ["em học bài <error> x </error>", "a <error> b </error>"]
    rows = [("ko biết ko", "không biết không và không"), (None, "a"), ("a", None), ("k? là j", "không là gì"), ("ko", "")]
    got = ask(rows, "o string, d string", T.tag_expansions(F.col("o"), F.col("d")))
    assert [r[0] for r in got] == ["<error> ko </error> biết <error> ko </error> và không", "a", None, "<error> k? </error> <error> là j </error>", ""]


def test_filter_corpus(spark):
    rows = ["một hai ba bốn năm sáu", "xem http://a b c d ê", "không đủ từ", "khong co dau gi ca day", "a, b, c, d, ê, f, g, h", 'có "nháy" kép ở đây đó', "  bỏ khoảng trắng hai đầu đi  ", None, ""]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(rows)], "id int, t string, text string")
    assert [tuple(r) for r in P.filter_corpus(df, "t").orderBy("id").collect()] == [(0, rows[0], "clash"), (6, "bỏ khoảng trắng hai đầu đi", "clash")]
    assert P.filter_corpus(df.limit(0), "t").count() == 0


def test_unprocessed(spark):
    df = spark.createDataFrame([(1, "H2O là nước"), (2, "một câu thường"), (3, ""), (4, None), (5, "a + b"), (6, "ABC")], "id int, t string")
    todo, left = P.split_unprocessed(df, "t")
    assert {r.id for r in todo.collect()} == {2} and {r.id for r in left.collect()} == {1, 3, 5, 6}
    todo, left = P.split_unprocessed(df, "t", [P.has_url])
    assert {r.id for r in left.collect()} == {3}


def is_formula(text):
    """Letter by letter: a digit or @ beside an ASCII letter, two ASCII capitals in one word, a mark inside, cooh."""
    digit = lambda c: c == "@" or c.isdecimal()
    letter = lambda c: c.isascii() and c.isalpha()
    beside = any(letter(a) and digit(b) or digit(a) and letter(b) for a, b in zip(text, text[1:]))
    capitals = any(sum(c.isascii() and c.isupper() for c in run) > 1 for run in re.split(r"\W", text))
    inside = any(m in "(),-" and not a.isspace() and not b.isspace() for a, m, b in zip(text, text[1:], text[2:]))
    return beside or capitals or inside or "cooh" in text


WORDS = st.text(alphabet="aabbcoodeeiivxXIlắểđĐ12@,-()cohAB<>", min_size=0, max_size=9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=30, max_size=60))
def test_formula_and_roman(ask, words):
    got = texts(ask, words, P.has_formula(C), P.is_roman(C), P.has_notation(C))
    assert got == [(is_formula(w), all(c in "xivXIVl" for c in w), any(c in w for c in "=+*^%[]")) for w in words]


def squeeze_spec(text, keep):
    limit, out = (2 if keep else 1), []
    plain = lambda w: w not in (K.ERROR, K.END_ERROR, K.EXCEPTION) and not is_formula(w) and not all(c in "xivXIVl" for c in w)
    for w in text.split():
        if plain(w):
            w = "".join(c for i, c in enumerate(w) if not i or c != w[i - 1] or c not in N.REPEATABLE)
        if plain(w):
            w = re.sub(r"(\w)\1{%d,}" % limit, lambda m: m.group(1) * limit, w)
        out.append(w)
    return " ".join(out)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=5).map(" ".join), min_size=20, max_size=40))
def test_squeeze(ask, rows):
    assert texts(ask, rows, N.squeeze(C), N.squeeze(C, False)) == [(squeeze_spec(t, True), squeeze_spec(t, False)) for t in rows]


def test_cleaning(ask):
    assert texts(ask, [" a\nb \t", None], N.clean_line(C), N.single_spaces(C)) == [("ab", " a b "), (None, None)]
    assert texts(ask, ["a.b,  </c> “x” – y"], N.drop_punctuation(C), N.plain_quotes(C)) == [("ab </c> “x” – y", 'a.b,  </c> "x" - y')]
    assert texts(ask, ["<pad>a</s><pad> "], N.clean_detection(C)) == [("a",)]
    assert texts(ask, ["<error> iv </error> a <error> H2O </error>", "iv", "<error> x"], N.untag_exceptions(C)) == [("iv a H2O",), ("iv",), ("x",)]
    assert texts(ask, ["a: b; 'c'  –  ntn"], N.clean_sentence(C)) == [("a b c - như thế nào",)]
    assert texts(ask, ["ﬁ ²  x "], N.prepare(C)) == [("fi 2 x",)]
    assert texts(ask, ["đường ăn íỷ"], N.fold(C), N.fold(C, True)) == [("duong an iy", "duong adn íỷ")]


def test_repeat_records(ask):
    got = texts(ask, ["thíchhh ok quaaa <error>", ""], N.words_with_repeats(C, 2))
    assert [[(x.word, x.word_index, x.repeat_chars) for x in r[0]] for r in got] == [[("thíchhh", 0, ["hhh"]), ("quaaa", 2, ["aaa"])], []]


def test_nulls_and_long_texts(ask):
    long = "được ngườiii " * 20_000
    for f in (N.squeeze, N.pre_correct, N.expand_acronyms, N.untag_exceptions, N.clean_sentence, N.fold, N.prepare, X.encode):
        got = texts(ask, [None, "", long], f(C))
        assert got[0][0] is None and got[1][0] == "" and len(got[2][0]) > 100_000, f


def test_telex(ask):
    forms = {
        "được": "dduwowcj dduwowjc duwowcdj duwowcjd duwowjcd đuocjw đuocwj đuojcw đuowcj đuowjc", "nghiêng": "nghieeng nghienge nghiêng",
        "từng": "tufngw tuwfng từng", "hoà": "hoaf hoà", "boot": "boot boto", "cows": "cosw cows", "ằng": "ằng", "a": "a", "": "",
    }
    assert [" ".join(r[0]) for r in texts(ask, forms, X.variants(C))] == list(forms.values())
    assert texts(ask, ["được", "từng", "quả"], X.encode(C)) == [("dduwowcj",), ("tuwfng",), ("quar",)]
    assert texts(ask, ["được ươ"], X.dashed(C), X.dashed_text(C), X.paired(C)) == [("dduwow-jc uwow", "dduwow-jc uwow", "đuow-jc uow")]


def test_lookup(spark):
    d = spark.createDataFrame([("hoir", "hỏi"), ("dduwowcj", "được")], "telex string, word string")
    df = spark.createDataFrame([(1, "em hoir, dduwowcj. x!"), (2, ""), (3, None)], "id int, t string")
    for most in (10, 0):  # broadcast and shuffle
        assert {r.id: r.corrected for r in X.lookup_words(df, "id", "t", d, most).collect()} == {1: "em hỏi, được. x", 2: "", 3: None}


def test_word_errors(spark):
    words = ["được", "nghiêng", "truyện", "gì", "quả", "c", "", "thuyền", "aaa"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words * 60)], "i int, w string")
    w, k = F.col("w"), F.concat_ws("|", F.lit("1"), F.col("i"))
    made = {"shape": A.drop_shapes, "tone": A.drop_tones, "add": A.add_tones, "del": A.delete_letters, "ins": A.insert_letters, "head": A.misspell_head, "tail": A.misspell_tail, "vowel": A.misspell_vowel, "telex": A.telex_error}
    one = df.select("w", X.variants(w).alias("forms"), *[f(w, k).alias(n) for n, f in made.items()]).collect()
    # the same at another partitioning
    two = df.repartition(7).select("i", *[f(w, k).alias(n) for n, f in made.items()]).orderBy("i").collect()
    assert [r["del"] for r in one] == [r["del"] for r in two] and [r["telex"] for r in one] == [r["telex"] for r in two]
    for r in one:
        assert r["tone"].word == "".join(K.DROP_TONE.get(c, c) if c not in r.w[i + 1 :] else c for i, c in enumerate(r.w))
        shaped = {c for c in r.w if c in K.DROP_SHAPE}
        assert (r["shape"].errors >= 1) == bool(shaped) and len(r["shape"].word) == len(r.w)
        assert len(r["del"].word) == max(len(r.w) - 1, min(len(r.w), 1)) and len(r["ins"].word) == len(r.w) + (r.w != "")
        assert r["ins"].word[:1] == r.w[:1] and r["telex"].word in r.forms
        assert r["head"].errors == (r.w[:2] in K.MISSPELT_HEADS or r.w[:1] in K.MISSPELT_HEADS)
    assert {r["del"].word for r in one if r.w == "gì"} == {"g", "ì"}


def test_controlled_errors(spark):
    df = spark.createDataFrame([(1, "một hai ba bốn năm sáu bảy tám chín mười")], "id int, t string")
    mark = lambda w, k: A.result(F.concat(w, F.lit("*")), F.lit(1))
    for ratio, hits in ((0.0, 0), (0.25, 3), (1.0, 10), (3.0, 10)):
        text = A.controlled_errors(C, F.lit("k"), F.lit(ratio), F.array(F.lit(0)), F.array(F.lit(1.0)), [mark])
        assert df.select(text.alias("x")).first().x.count("*") == hits
    two = lambda w, k: A.result(F.concat(w, F.lit("#")), F.lit(1))
    text = A.controlled_errors(C, F.lit("k"), F.lit(0.5), F.array(F.lit(0), F.lit(1)), F.array(F.lit(0.6), F.lit(0.4)), [mark, two])
    x = df.select(text.alias("x")).first().x
    assert (x.count("*"), x.count("#")) == (3, 2)


def test_training_rows(spark):
    rows = [(i, f"câu số {i} được viết ra để học sinh luyện tập chính tả") for i in range(200)] + [(900, None), (901, " ;: ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, t string, detected string")
    got = A.training_rows(df, "id", "t").collect()
    assert sorted(r.id for r in got) == list(range(200))
    again = {r.id: r.input_text for r in A.training_rows(df.repartition(5), "id", "t").collect()}
    assert all(again[r.id] == r.input_text for r in got)
    for r in got:
        assert len(r.corrected.split(" ")) == len(r.input_text.split(" "))
        assert (r.new_target == K.NON_ERROR) == (r.corrected == r.input_text)
        assert re.sub(" +", " ", r.detected.replace("<error>", "").replace("</error>", "")).strip() == r.input_text
    share = sum(a != b for r in got for a, b in zip(r.corrected.split(), r.input_text.split())) / sum(len(r.corrected.split()) for r in got)
    assert 0.1 < share < 0.4


def test_older_noise(spark):
    df = spark.createDataFrame([(i, "được rồi vậy thì tôi không biết gì") for i in range(300)] + [(500, ""), (501, None)], "id int, t string")
    got = {r.id: r.noisy for r in Z.noisy_sentence(df, "id", "t").collect()}
    assert got == {r.id: r.noisy for r in Z.noisy_sentence(df.repartition(3), "id", "t").collect()}
    assert got[500] == "" and got[501] is None and len({got[i] for i in range(300)}) > 50
    chat = df.select("id", A.chat_words(C, F.concat_ws("|", F.lit("1"), "id")).alias("x")).collect()
    assert any("hân" in (r.x or "") for r in chat) and any("không" in (r.x or "") for r in chat)
    ends = df.select(A.swap_ends(C, F.col("id").cast("string")).alias("s")).select("s.*").collect()
    assert any("bct" not in r.text and "biếc" in r.text for r in ends if r.text)


@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    assert V.common_length(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_similar_words_is_complete(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abdeghn") for _ in range(r.randint(2, 9))) for _ in range(120)]
    near = ["".join(c for c in w if r.random() > 0.08) + r.choice(["", "", "s"]) for w in base]
    a, b = spark.createDataFrame([(w,) for w in near], "a string"), spark.createDataFrame([(w,) for w in base], "b string")
    got = {(x.a, x.b) for x in V.similar_words(a, b, 0.87).collect()}
    want = {(x, y) for x in near for y in base if x + y and 2 * V.common_length(x, y) / (len(x) + len(y)) >= 0.87}
    assert got == want


def test_similar_words_is_complete_for_long_words(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abdeghnotu") for _ in range(r.randint(12, 45))) for _ in range(150)]
    # as many letters replaced, left out or put in as the likeness allows, and some more
    near = []
    for w in base:
        letters = list(w)
        for _ in range(r.randint(2, max(2, len(w) // 5))):
            at = r.randrange(len(letters))
            letters[at] = r.choice(["", letters[at] + "x", "y"])
        near.append("".join(letters))
    a, b = spark.createDataFrame([(w,) for w in [*near, None]], "a string"), spark.createDataFrame([(w,) for w in [*base, None]], "b string")
    for least in (0.87, 0.8):
        got = [(x.a, x.b) for x in V.similar_words(a, b, least).collect()]
        want = {(x, y) for x in near for y in base if 2 * V.common_length(x, y) / (len(x) + len(y)) >= least}
        assert set(got) == want and len(got) == len(want) > 30
        assert any(len(x) > 25 and len(x) + len(y) - 2 * V.common_length(x, y) > 6 for x, y in want)


def test_group_candidates_are_complete(spark):
    """Groups of two wrong words against brute force: letters replaced in both words, left out, put in, border moved."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("bcghklmnptv") for _ in range(r.randint(7, 10)))
    pairs = sorted({(word(), word()) for _ in range(60)})
    put = lambda w, c: (lambda i: w[:i] + c + w[i + 1 :])(r.randrange(1, len(w)))
    wrong = [x for a, b in pairs for x in ((put(a, "x"), put(b, "q")), (put(a, ""), put(b, "qx")), (put(put(a, "x"), "q"), b), (a[:-2], a[-2:] + b), (a + b[:2], b[2:]))]
    groups = spark.createDataFrame([(*x, "none") for x in wrong], "left_word string, right_word string, side string")
    grams = [(a, b, a, b, n + 2, 1) for n, (a, b) in enumerate(pairs)]
    bigrams = spark.createDataFrame(grams, "left_word string, right_word string, left_telex string, right_telex string, n bigint, ord int")
    keys = {(x.l, x.r): "_".join((x.a, x.b)) for x in groups.select(F.col("left_word").alias("l"), F.col("right_word").alias("r"), X.encode(F.col("left_word")).alias("a"), X.encode(F.col("right_word")).alias("b")).collect()}
    want = {}
    for g, x in keys.items():
        scored = [(-round(2 * V.common_length(x, f"{a}_{b}") / (len(x) + len(a) + len(b) + 1), 6), -n, a, b) for a, b, _, _, n, _ in grams]
        if min(scored)[0] <= -0.87:
            want[g] = min(scored)[2:]
    got = {(x.left_word, x.right_word): (x.left_new, x.right_new) for x in V.group_candidates(groups, bigrams).collect()}
    assert got == want and len(want) > 150


def test_word_groups(ask):
    got = texts(ask, ["Hôm <error> qua </error> em <error> đi </error> <error> hoc </error> mẫu", "<error> a </error> b", "x y", ""], V.word_groups(C))
    assert [[tuple(g) for g in r[0]] if r[0] else [] for r in got] == [
        [("Hôm", "qua", "left"), ("qua", "em", "right"), ("em", "đi", "left"), ("đi", "hoc", "none"), ("đi", "hoc", "none"), ("hoc", "mẫu", "right")], [("a", "b", "right")], [], [],
    ]


def test_vocabulary_correction(spark):
    corpus = spark.createDataFrame([(i, "em học bài toán khó") for i in range(5)] + [(9, "bạn đọc sách hay"), (10, "bạn đọc sách hay")], "id int, t string")
    words = V.corpus_words(corpus, "t")
    assert {r.telex: r.word for r in V.telex_dictionary(words).collect()}["hocj"] == "học"
    grams = V.bigram_dictionary(corpus, "t")
    df = spark.createDataFrame([(1, "em <error> hocj </error> bài"), (2, "<error> banj </error> <error> ddocj </error> sách"), (3, "không có tag"), (4, None), (5, "em <error> zzz </error> bài")], "id int, t string")
    got = {r.id: r.retagged for r in V.correct_tagged(df, "id", "t", grams).collect()}
    assert got == {1: "em học bài", 2: "bạn đọc sách", 3: "không có tag", 4: None, 5: "em <error> zzz </error> bài"}


def test_counters(ask):
    tag = lambda *ws: " ".join(f"<error> {w} </error>" for w in ws)
    cases = [
        (tag("a", "b"), tag("a", "b"), (2, 2, 2)), (tag("a", "b"), tag("b", "a"), (2, 2, 1)), (tag("a"), tag("a", "c", "d"), (3, 3, 1)), (tag("a", "b"), "a b", (2, 0, 0)),
        ("", "", (0, 0, 0)), (None, tag("a"), (1, 1, 0)), (tag("a"), tag("a", "a"), (2, 2, 2)),
    ]
    got = ask([c[:2] for c in cases], "t string, p string", E.count_errors(F.col("t"), F.col("p")))
    assert [tuple(r[0]) for r in got] == [c[2] for c in cases]
    rows = [
        ("em học bài", "em học bài", "em <error> hoc </error> bài", 1), ("a b c d", "a", "<error> a </error>", 0), (None, None, None, 0),
        ("em học tốt", "em học rất tốt", "em <error> hoc </error> <error> totj </error>", 2), ("a a b", "a c b", "a <error> x </error> b", 0), ("a a", "a a", "a <error> x </error>", 1),
    ]
    got = ask([r[:3] for r in rows], "c string, p string, d string", E.count_corrections(F.col("c"), F.col("p"), F.col("d")))
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_scores(spark):
    rows = [
        (0, "<error> a </error> b", "<error> a </error> b", "x b", "x b"), (0, "a <error> b </error>", "<error> a </error> b", "a y", "z b"),
        (1, "<error> a </error> <error> b </error>", "<error> a </error> b", "x y", "x b"), (0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "g int, dt string, dp string, ct string, cp string")
    got = {x.g: x for x in E.scores(df, "dt", "dp", "ct", "cp", ("g",)).collect()}
    assert (got[0].actual_errors, got[0].predicted_errors, got[0].true_detections) == (2, 2, 1)
    assert (got[0].detection_precision, got[0].detection_recall, got[0].detection_f1) == (0.5, 0.5, 0.5)
    assert (got[1].detection_precision, got[1].detection_recall) == (1.0, 0.5) and got[1].detection_f1 == pytest.approx(2 / 3, abs=1e-6)
    assert E.scores(df.limit(0), "dt", "dp", "ct", "cp").first().detection_f1 is None


def test_batches(spark):
    df = spark.createDataFrame([(i * 3, f"v{i}") for i in range(70)], "id bigint, v string").repartition(5)
    got = {r.batch: r["items"] for r in B.batches(df, "id", "v", 32).collect()}
    assert [len(got[k]) for k in sorted(got)] == [32, 32, 6] and got[0][0] == "v0" and got[2][-1] == "v69"
    assert B.batches(df.limit(0), "id", "v").count() == 0
    old = B.BLOCK
    B.BLOCK = 10
    try:
        assert {r.batch: r["items"] for r in B.batches(df, "id", "v", 32).collect()} == got
    finally:
        B.BLOCK = old


def test_tasks_and_splits(spark):
    df = spark.createDataFrame([(1, "in", "det", "cor"), (2, "in2", "det2", None)], "id int, i string, d string, c string")
    got = {(r.id, r.task, r.input, r.label) for r in B.task_rows(df, "id", "i", "d", "c").collect()}
    assert got == {(1, "detection", "detection: in", "det"), (2, "detection", "detection: in2", "det2"), (1, "correction", "correction: det", "cor")}
    share = spark.range(4000).where(B.split(F.col("id")) == "valid").count() / 4000
    assert 0.08 < share < 0.12
    assert B.step_sizes(1000, 16, 3) == (1, 19)


def test_letter_tables():
    for c, b in K.DROP_TONE.items():
        assert unicodedata.normalize("NFD", c)[0] == unicodedata.normalize("NFD", b)[0]
    assert len(K.TELEX) == 66 and len(K.DROP_SHAPE) == 37 and len(K.DROP_TONE) == 60 and set(string.ascii_letters) <= set(K.WORD_LETTERS)
