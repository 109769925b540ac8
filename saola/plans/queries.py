"""Registered queries of the correction operators. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import batches as B
from ..operators import evaluate as E
from ..operators import filters as P
from ..operators import noise as Z
from ..operators import normalize as N
from ..operators import tagging as T
from ..operators import telex as X
from ..operators import vocabulary as V
from ..sources import io
from ..sources.scratch import forget, scratch_dir, stage
from ..streaming import queue
from . import correct as C

Query = Callable[[SparkSession, str], DataFrame]
SEED = "42"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _words(spark: SparkSession, sf: str, column: str = "input_text") -> DataFrame:
    """Distinct words of a training column."""
    return table(spark, sf, "training_data").select(F.explode(N.pieces(F.col(column))).alias("word")).distinct()


def filter_corpus(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return P.filter_corpus(lines, "text")


def flag_predicates(spark: SparkSession, sf: str) -> DataFrame:
    c, d = F.col("input_text"), F.col("detected")
    return table(spark, sf, "training_data").where(c.isNotNull()).select(
        "row_id", P.has_url(c).alias("url"), P.too_short(c).alias("short"), P.unaccented(c).alias("plain"), P.punctuated(c).alias("marks"), P.rejected(c).alias("rejected"),
        P.has_formula(c).alias("formula"), P.has_notation(c).alias("notation"), P.has_unknown(c).alias("unknown"), P.has_error(d).alias("tagged"),
        P.has_adjacent_errors(d).alias("adjacent"), P.starts_with_error(d).alias("starts"), P.ends_with_error(d).alias("ends"),
    )


def word_flags(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, sf, "detected").select("word", P.is_roman(w).alias("roman"), P.has_formula(w).alias("formula"), P.has_notation(w).alias("notation"), P.is_special(w).alias("special"))


def unprocessed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that correction leaves alone, beside the others, as they are merged again by key."""
    todo, left = P.split_unprocessed(table(spark, sf, "log_items").select("log_id", "input_text"), "input_text")
    return todo.withColumn("untouched", F.lit(False)).unionByName(left.withColumn("untouched", F.lit(True)))


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("input_text")
    return table(spark, sf, "log_items").where(c.isNotNull()).select("log_id", N.clean_line(c).alias("line"), N.single_spaces(c).alias("spaced"), N.drop_punctuation(c).alias("bare"), N.plain_quotes(c).alias("quotes"))


def squeeze_words(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, sf).select("word", N.squeeze_word(w).alias("two"), N.squeeze_word(w, keep_double=False).alias("one"))


def repeat_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("input_text IS NOT NULL")
    return rows.select("row_id", F.explode(N.words_with_repeats(F.col("input_text"), 1)).alias("r")).select("row_id", "r.word", "r.word_index", F.array_join("r.repeat_chars", " ").alias("runs"))


def detection_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    c = N.clean_detection(F.concat(F.lit("<pad>"), "detected", F.lit("</s><pad>")))
    return table(spark, sf, "training_data").where("detected IS NOT NULL").select("row_id", c.alias("cleaned"), N.untagged(F.col("detected")).alias("untagged"), N.join_adjacent_errors(F.col("detected")).alias("joined"))


def untag_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_data").where("detected IS NOT NULL").select("row_id", N.untag_exceptions(F.col("detected")).alias("kept"))


def clean_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", N.clean_sentence(F.col("text")).alias("cleaned"))


def expand_acronyms(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("input_text")
    return table(spark, sf, "log_items").where(c.isNotNull()).select("log_id", N.expand_acronyms(c).alias("single"), N.expand_acronyms(c, multiple=True).alias("multiple"))


def pre_correct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_data").where("input_text IS NOT NULL").select("row_id", N.pre_correct(F.col("input_text")).alias("fixed"))


def prepare(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "request_items").where("content IS NOT NULL").select("id", N.prepare(F.col("content")).alias("prepared"))


def fold_letters(spark: SparkSession, sf: str) -> DataFrame:
    c = F.lower("corrected")
    return table(spark, sf, "training_data").where("corrected IS NOT NULL").select("row_id", N.fold(c).alias("plain"), N.fold(c, compat=True).alias("compat"))


def telex_words(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    return _words(spark, sf, "corrected").select("word", X.dashed(w).alias("dashed"), X.paired(w).alias("paired"), X.encode(w).alias("coded"))


def telex_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf, "corrected").select("word", F.array_join(X.variants(F.col("word")), " ").alias("forms"))


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return V.corpus_words(table(spark, sf, "training_data"), "corrected")


def telex_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return V.telex_dictionary(_vocabulary(spark, sf))


def telex_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("input_text IS NOT NULL").select("row_id", "input_text")
    return X.lookup_words(rows, "row_id", "input_text", stage(telex_dictionary(spark, sf), "telex")).select("row_id", "corrected")


def bigram_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return V.bigram_dictionary(table(spark, sf, "training_data"), "corrected")


def word_errors(spark: SparkSession, sf: str) -> DataFrame:
    w, k = F.col("word"), F.concat_ws("|", F.lit(SEED), "word")
    made = {
        "shapes": A.drop_shapes, "tones": A.drop_tones, "toned": A.add_tones, "deleted": A.delete_letters, "inserted": A.insert_letters,
        "head": A.misspell_head, "tail": A.misspell_tail, "vowel": A.misspell_vowel,
    }
    rows = _words(spark, sf, "corrected").select("word", *[F.explode(F.array(f(w, k))).alias(n) if n == "shapes" else f(w, k).alias(n) for n, f in made.items()])
    return rows.select("word", *[x for n in made for x in (F.col(f"{n}.word").alias(n), F.col(f"{n}.errors").alias(f"{n}_n"))])


def telex_errors(spark: SparkSession, sf: str) -> DataFrame:
    w, k = F.col("word"), F.concat_ws("|", F.lit(SEED), "word")
    return _words(spark, sf, "corrected").select("word", A.telex_error(w, k).alias("e"), A.chain(A.telex_error, A.delete_letters)(w, k).alias("c")).select("word", F.col("e.word").alias("typed"), F.col("e.errors").alias("typed_n"), F.col("c.word").alias("chained"), F.col("c.errors").alias("chained_n"))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.training_rows(table(spark, sf, "training_data"), "row_id", "corrected")


def noisy_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return Z.noisy_sentence(table(spark, sf, "training_data").where("corrected IS NOT NULL"), "row_id", "corrected")


def chat_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_data").where("corrected IS NOT NULL").select("row_id", A.chat_words(F.col("corrected"), F.concat_ws("|", F.lit(SEED), "row_id")).alias("chat"))


def swap_ends(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("corrected IS NOT NULL")
    return rows.select("row_id", A.swap_ends(F.col("corrected"), F.concat_ws("|", F.lit(SEED), "row_id")).alias("s")).select("row_id", "s.text", F.size(F.filter("s.rates", lambda r: r == 0)).alias("hit"))


def error_tagging(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("corrected IS NOT NULL AND input_text IS NOT NULL")
    return rows.select("row_id", T.tag_errors(F.col("corrected"), F.col("input_text")).alias("t")).select("row_id", F.col("t.detected").alias("tagged"), F.col("t.target").alias("target"))


def tag_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("detected")
    join = lambda a: F.array_join(a, "|")
    spans = T.error_spans(c)
    return table(spark, sf, "training_data").where(c.isNotNull()).select(
        "row_id", join(T.clean_head(c)).alias("head"), join(T.clean_tail(c)).alias("tail"), join(T.error_words(c)).alias("errors"), join(T.words_between(c)).alias("between"),
        join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"]))).alias("spans"), T.nth_span(spans, 0)["start"].alias("first_start"),
        join(T.middle(N.pieces(F.col("corrected")), T.clean_head(c), T.clean_tail(c))).alias("middle"),
    )


def match_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("detected IS NOT NULL AND corrected IS NOT NULL")
    return rows.select("row_id", T.gated(F.col("detected"), F.col("corrected")).alias("gated"))


def matching_rates(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "correction_edits").select("org_word", "corrected").distinct()
    return pairs.select("org_word", "corrected", F.round(T.matching_rate(F.col("org_word"), F.col("corrected")), 6).alias("rate"))


def word_edits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "request_items").where("prediction IS NOT NULL").select("id", "content", "prediction").distinct()
    return rows.select("id", F.explode(T.word_edits(F.col("content"), F.col("prediction"))).alias("e")).select("id", "e.*")


def acronym_edits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "log_items").where("input_text IS NOT NULL").select("log_id", "input_text").distinct()
    return rows.select("log_id", F.posexplode(T.acronym_edits(N.pieces(F.col("input_text")))).alias("ord", "e")).select("log_id", "ord", "e.*")


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct edits of each request that change something, in order."""
    edits = table(spark, sf, "correction_edits").select("id", F.struct("org_word_position", F.col("org_word").alias("origin"), "corrected").alias("e"))
    kept = edits.groupBy("id").agg(P.changed_edits(F.array_sort(F.array_distinct(F.collect_list("e")))).alias("es"))
    return kept.select("id", F.size("es").alias("n"), F.array_join(F.transform("es", lambda e: F.concat_ws(">", e["org_word_position"], e["origin"], e["corrected"])), "|").alias("edits"))


def error_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evaluation_data").where("error_sentence IS NOT NULL")
    return rows.select("eval_id", F.round(T.error_rate(F.col("error_sentence"), F.col("detection_target")), 6).alias("rate"))


def arranged_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("detected IS NOT NULL AND corrected IS NOT NULL")
    return rows.select("row_id", F.explode(T.arrange(F.col("corrected"), F.col("detected"))).alias("s")).select("row_id", "s.*")


def tagged_expansions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "log_items").where("input_text IS NOT NULL").select("log_id", "input_text").distinct()
    c = F.col("input_text")
    return rows.select("log_id", T.tag_expansions(c, N.expand_acronyms(N.expand_acronyms(c, multiple=True))).alias("tagged"))


def retagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("detected IS NOT NULL AND corrected IS NOT NULL")
    return rows.select("row_id", T.retag(F.col("detected"), F.col("corrected")).alias("retagged"))


def word_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("detected IS NOT NULL")
    return rows.select("row_id", F.explode(V.word_groups(F.col("detected"))).alias("g")).select("row_id", "g.*")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return word_groups(spark, sf).select("left_word", "right_word", "side").distinct()


def similar_words(spark: SparkSession, sf: str) -> DataFrame:
    wrong = _groups(spark, sf).where("side = 'left'").select(X.encode(F.col("right_word")).alias("a"))
    return V.similar_words(wrong, _vocabulary(spark, sf).where("n >= 2").select(X.encode(F.col("word")).alias("b")))


def group_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return V.group_candidates(_groups(spark, sf), stage(bigram_dictionary(spark, sf), "bigrams"))


def correct_tagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").where("detected IS NOT NULL").select("row_id", "detected")
    return V.correct_tagged(rows, "row_id", "detected", stage(bigram_dictionary(spark, sf), "bigrams")).select("row_id", "retagged")


def _dictionaries(spark: SparkSession, sf: str) -> C.Dictionaries:
    d = C.build(table(spark, sf, "training_data"), "corrected")
    return C.Dictionaries(stage(d.words, "words"), stage(d.telex, "telex"), stage(d.bigrams, "bigrams"))


def correct_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over the queued requests, each id once."""
    todo = table(spark, sf, "request_items").where("content IS NOT NULL").groupBy("id").agg(F.min("content").alias("content"))
    done = C.correct(todo, "id", "content", _dictionaries(spark, sf))
    return done.select("id", "corrected", F.size("edits").alias("n_edits"))


def scores_by_error(spark: SparkSession, sf: str) -> DataFrame:
    """Detection and correction by the dictionaries against the evaluation set, per error type and percentage."""
    d = _dictionaries(spark, sf)
    rows = table(spark, sf, "evaluation_data").where("error_sentence IS NOT NULL")
    found = C.dictionary_detector(d.words)(rows.select("eval_id", "error_sentence"), "eval_id", "error_sentence").select("eval_id", F.col("out").alias("detected"))
    fixed = V.correct_tagged(found, "eval_id", "detected", d.bigrams).select("eval_id", "detected", N.untagged(F.col("retagged")).alias("fixed"))
    return E.scores(rows.join(fixed, "eval_id"), "detection_target", "detected", "correction_target", "fixed", ("error_type", "error_pct"))


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evaluation_data").groupBy("error_type", "error_pct").agg(F.sum(E.tag_count(F.col("detection_target"))).alias("tags"), F.count("*").alias("n"))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").select("row_id", F.coalesce("corrected", F.lit("")).alias("text"))
    made = B.batches(rows, "row_id", "text", 32)
    return made.select("batch", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_data").select("row_id", B.split(F.col("row_id")).alias("part"))


def shuffle_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "training_data").select("row_id", B.shuffle_key(F.col("row_id"), 19, "detection").alias("detect_key"), B.shuffle_key(F.col("row_id"), 19, "correction").alias("correct_key"))


def task_rows(spark: SparkSession, sf: str) -> DataFrame:
    return B.task_rows(table(spark, sf, "training_data"), "row_id", "input_text", "detected", "corrected")


def encoded_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.encoded(task_rows(spark, sf), "/opt/tokenizers/byte_bpe_50k.json")
    return rows.select("row_id", "task", F.size("input_ids").alias("n_input"), F.size("labels").alias("n_labels"))


def queue_page(spark: SparkSession, sf: str) -> DataFrame:
    return B.queue_page(table(spark, sf, "request_items")).select("id", "content")


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return queue.event_counts(table(spark, sf, "log_items").withColumn("logged_at", F.col("logged_at").cast("timestamp"))).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "client_id", "n")


def queue_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The queue served as a stream until it is empty: the answers by a light corrector."""
    root = f"{scratch_dir(spark)}/queue-{uuid.uuid4().hex}"
    light = lambda rows: rows.select("id", N.pre_correct(F.col("content")).alias("prediction"))
    table(spark, sf, "request_items").select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in io.QUEUE_SCHEMA.split(", ")]).write.parquet(f"{root}/in")
    forget(spark, root)
    queue.serve(queue.read_queue(spark, f"{root}/in"), light, f"{root}/out", f"{root}/checkpoint", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", "prediction", "finish")


def queue_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The queue with the answers of the stream put in."""
    asked = table(spark, sf, "request_items")
    return queue.snapshot(asked, queue_stream(spark, sf))


def queue_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """What is left in the queue when the finished requests are deleted."""
    asked = table(spark, sf, "request_items")
    return queue.remaining(asked, asked.where("finish = 1")).select("id", "content")


def batches_once(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "training_data").select("row_id", F.coalesce("corrected", F.lit("")).alias("text"))
    made = B.batches(rows, "row_id", "text", 32, once=True)
    return made.select("batch", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"))


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Clean corpus lines written as text and read again, with their number."""
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}/corpus.txt"
    io.write_lines(filter_corpus(spark, sf), path)
    forget(spark, path.rsplit("/", 1)[0])
    return io.read_corpus(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def training_files(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows written as CSV and read again; empty texts come back as nulls."""
    path = f"{scratch_dir(spark)}/training-{uuid.uuid4().hex}/rows.csv"
    io.write_training(table(spark, sf, "training_data"), path)
    forget(spark, path.rsplit("/", 1)[0])
    return io.read_training(spark, path).groupBy("corrected", "input_text", "detected", "new_target").agg(F.count("*").alias("n"))


def evaluation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows written as CSV folders per error type and read as one directory; the percentage isn't in the names."""
    root = f"{scratch_dir(spark)}/evaluation-{uuid.uuid4().hex}"
    rows = table(spark, sf, "evaluation_data").where("error_type IS NOT NULL").select(
        F.col("error_sentence").alias("augmented"), F.col("detection_target").alias("label"), F.col("correction_target").alias("original"), F.col("error_type").alias("kind"), "error_type"
    )
    io.write_csv(rows, root, by=("kind",))
    forget(spark, root)
    got = io.read_evaluation(spark, root).withColumn("error_type", F.regexp_replace("error_type", "^kind=", ""))
    return got.groupBy("error_sentence", "detection_target", "correction_target", "error_type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    """Public functions of this module that take a session and a directory."""
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in ("queries", "table")}
