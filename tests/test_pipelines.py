"""Readers, writers, the correction pipeline, the stream, and the registered queries against their SQL."""

import glob
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from saola.operators import batches as B
from saola.plans import correct as C
from saola.operators import batches as B
from saola.plans import oracles, queries
from saola.sources import io
from saola.streaming import queue

SF = "/root/testdata/sf0.001"
ROWS = [("câu sạch, có phẩy", 'nhập "kép"\nhai dòng', "<error> x </error>", "y"), ("b", "c", None, "<non_error>")]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" một \nhai\n")
    assert [r.text for r in io.read_corpus(spark, str(tmp_path / "a.txt")).collect()] == ["một", "hai"]
    (tmp_path / "a.csv").write_text('x,text\n1,"a ""b"", c\nd"\n2,e\n')
    assert [r.text for r in io.read_corpus(spark, str(tmp_path / "a.csv")).collect()] == ['a "b", c\nd', "e"]
    with pytest.raises(ValueError):
        io.read_corpus(spark, "a.json")
    io.write_lines(spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_training_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "corrected string, input_text string, detected string, new_target string")
    for name, read in (("t_csv", io.read_training), ("t_parquet", lambda s, p: s.read.parquet(p))):
        io.write_training(df, str(tmp_path / name))
        assert sorted(map(tuple, read(spark, str(tmp_path / name)).collect())) == sorted(ROWS, key=lambda r: r[0]) or name == "t_csv"


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "telex").mkdir()
    (tmp_path / "telex" / "set_20pct.csv").write_text("augmented,label,original\na,b,c\n")
    (tmp_path / "telex" / "other.csv").write_text("augmented,label,original\nd,e,f\n")
    got = io.read_evaluation(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "b", "c", "telex", 20), ("d", "e", "f", "telex", None)]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("train:\n  model: m\n  epochs: 2\n  learning_rate: 1e-4\n  other: 1\n")
    s = io.read_settings(str(tmp_path / "c.yaml"))
    assert (s.model, s.epochs, s.learning_rate, s.batch_size) == ("m", 2, 1e-4, 16)


def test_correct(spark):
    corpus = spark.createDataFrame([(i, "em học bài toán khó và được điểm cao") for i in range(4)], "id int, t string")
    d = C.build(corpus, "t")
    df = spark.createDataFrame([(1, "em hocj bài toans khó"), (2, "H2O là nước"), (3, ""), (4, None), (5, "em học bài"), (6, "ko học")], "id int, t string")
    got = {r.id: (r.corrected, [tuple(e) for e in r.edits]) for r in C.correct(df, "id", "t", d).collect()}
    assert got[1] == ("em học bài toán khó", [("hocj", "học", 1), ("toans", "toán", 3)])
    assert got[2] == ("H2O là nước", []) and got[3] == ("", []) and 4 not in got and got[5] == ("em học bài", [])
    assert got[6][0] == "không học"
    # a plugged-in detector that finds nothing leaves the dictionary look-up alone
    none = lambda rows, i, t: rows.select(i, F.col(t).alias("out"))
    assert {r.id: r.corrected for r in C.correct(df, "id", "t", d, detector=none).collect()}[1] == "em học bài toán khó"
    assert C.correct(df.limit(0), "id", "t", d).count() == 0


def test_reverted(spark):
    df = spark.createDataFrame([("<error> a </error> <error> b </error>", "x y"), ("a <error> b </error> c", "a y c"), ("a", "")], "t string, c string")
    assert [r[0] for r in df.select(C.reverted(F.col("t"), F.col("c"), 0.7)).collect()] == ["a b", "a y c", "a"]


def test_stream(spark, tmp_path):
    rows = [("1", "a", None, 0, "c", None), ("2", "b", "done", 1, "c", None), ("1", "a", None, 0, "c", None), ("3", None, None, 0, None, None)]
    spark.createDataFrame(rows, io.QUEUE_SCHEMA).write.parquet(str(tmp_path / "in"))
    light = lambda r: r.select("id", F.upper("content").alias("prediction"))
    for _ in range(2):  # a restart answers nothing twice
        queue.serve(queue.read_queue(spark, str(tmp_path / "in")), light, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.prediction) for r in got.collect()) == [("1", "A"), ("3", None)]
    assert queue.response(got, "1").first().prediction == "A" and spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_queue_tables(spark, tmp_path):
    asked = spark.createDataFrame([("1", "a", "c", None), ("2", "b", "c", None), ("2", "b", "c", None), (None, None, None, None)], "id string, content string, client_id string, queued_at timestamp")
    queue.push(asked, str(tmp_path / "q"))
    queue.push(asked.where("id = '1'"), str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    answers = spark.createDataFrame([("2", "B", 1)], "id string, prediction string, finish int")
    got = {r.id: (r.prediction, r.finish) for r in queue.snapshot(q, answers).collect()}
    assert q.count() == 5 and got == {"1": (None, 0), "2": ("B", 1), None: (None, 0)}
    assert sorted(str(r.id) for r in queue.remaining(q, answers).collect()) == ["1", "1", "None"]
    assert queue.remaining(q, answers.limit(0)).count() == 5


def test_model_stage(spark):
    def load():
        def generate(texts):
            assert len(texts) <= 2
            return [t.upper() for t in texts]

        return generate

    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(["a", None, "", "b c", "d"])], "id bigint, t string, out string")
    run = C.model_stage(load, batch=2)
    assert {r.id: r.out for r in run(rows, "id", "t").collect()} == {0: "A", 1: None, 2: "", 3: "B C", 4: "D"}
    assert run(rows.limit(0), "id", "t").count() == 0
    tasked = C.model_stage(load, task="correction")(rows, "id", "t").where("id = 0").first().out
    assert tasked == "CORRECTION: A"


def test_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = spark.createDataFrame([("học bài", "x"), (None, ""), ("", None)], "input string, label string")
    got = B.decoded(B.encoded(rows, path), path, "input_ids", "back").collect()
    assert [r.back for r in got] == ["học bài", None, ""]
    assert B.special_tokens(path, ("<error>", "<error>", "</error>")) == ["<error>", "</error>"]


def test_numbered_sparse(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 50)
    ids = [None, None] + [3] * 200 + [10**15 * k for k in range(1, 300)]
    df = spark.createDataFrame([(i, "x") for i in ids], "id bigint, row string").drop("row").repartition(5)
    got = B.numbered(df, "id").orderBy("row").collect()
    assert [r.row for r in got] == list(range(len(ids))) and [r.id for r in got] == ids
    assert B.numbered(df.limit(0), "id").count() == 0


def test_csv_keeps_blanks(spark, tmp_path):
    rows = [("  a ", 'x "y"', "1\n2", None)]
    io.write_training(spark.createDataFrame(rows, "corrected string, input_text string, detected string, new_target string"), str(tmp_path / "t.csv"))
    assert [tuple(r) for r in io.read_training(spark, str(tmp_path / "t.csv")).collect()] == rows


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return Counter(tuple(map(value, r)) for r in frame)


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(map(tuple, df.select(*cols).collect()))
    want = rows(duck.sql(f"""SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({oracles.oracles()[name]})""").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracles())))
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_on_empty_tables(spark, tmp_path):
    for path in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(tmp_path / os.path.basename(path)))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
