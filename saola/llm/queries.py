"""Queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import copies, encoding, language, leaks, likeness, lookalike, mixture, quality, samples
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Clean sentences that the labelled documents of the quality rules are made from.
FIT_SENTENCES = 1_500


def _common(spark: SparkSession, sf: str) -> tuple[list[str], list[str]]:
    """Accent-folded common and function words of Vietnamese, from the fixed list of frequent words."""
    rows = table(spark, sf, "common_words").where("lang = 'vi'").select(quality.folded(F.col("word")).alias("w"), "freq_rank").collect()
    return [r["w"] for r in rows], [r["w"] for r in rows if r["freq_rank"] <= quality.FUNCTION_RANK]


def _rules(spark: SparkSession, sf: str) -> list[quality.Rule]:
    clean = table(spark, sf, "evaluation_data").where("correction_target IS NOT NULL").orderBy("eval_id").limit(FIT_SENTENCES).select("correction_target")
    # a fixed table of a few sentences stands beside them, so an empty evaluation set leaves something to learn from
    fixed = table(spark, sf, "lang_samples").where("lang = 'vi'").select("sample_text")
    sentences = [r[0] for r in clean.union(fixed).collect()]
    rows = spark.createDataFrame(samples.labelled(sentences), "text string, label string").repartition(8)
    return quality.fit(rows, *_common(spark, sf))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf, ("training_data", "row_id", "input_text"), ("log_items", "log_id", "input_text"))
    sql = quality.case_sql(_rules(spark, sf), "prose")
    return quality.quality(texts, "text", *_common(spark, sf)).withColumn("kind", F.expr(sql)).drop("text")


def p1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality figures and kind of every text, each id once."""
    return _judged(spark, sf).dropDuplicates(["tbl", "record_id"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("kind IN ('list', 'table', 'junk')").select("tbl", "record_id").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "training_data").select(F.lit("training_data").alias("tbl"), F.col("row_id").alias("id"), F.col("input_text").alias("text"))
    logs = table(spark, sf, "log_items").select(F.lit("log_items").alias("tbl"), F.col("log_id").alias("id"), F.col("input_text").alias("text"))
    return copies.copy_groups(train.unionByName(logs), "id", "text", "tbl").select(F.col("part").alias("tbl"), "first_id", "copy_id")


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each text of a table, with its root digest and its number of copies."""
    texts = _texts(spark, sf, ("training_data", "row_id", "input_text"), ("log_items", "log_id", "input_text")).withColumn("id", F.col("record_id").cast("bigint"))
    return copies.copy_counts(texts, "id", "text", "tbl").withColumnRenamed("part", "tbl")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    alike = likeness.alike_across(
        table(spark, sf, "training_data"), "row_id", F.col("corrected"),
        table(spark, sf, "evaluation_data"), "eval_id", [F.col("correction_target"), F.col("error_sentence")],
    )
    return alike.rows().select(F.col("left_key").alias("row_id"), F.col("right_key").alias("eval_id"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps per evaluation split and source: pairs, evaluation rows and training rows."""
    rows = table(spark, sf, "evaluation_data").select("eval_id", "split", "source").distinct()
    return p3_found(spark, sf).join(rows, "eval_id").groupBy("split", "source").agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_rows"), F.countDistinct("row_id").alias("train_rows"))


def typed(df: DataFrame) -> DataFrame:
    """The typed text of a training row: input_text, or detected without its tags."""
    return df.select("row_id", F.coalesce("input_text", F.regexp_replace("detected", "</?error>", "")).alias("text"))


def _near_copies(spark: SparkSession, sf: str) -> likeness.Alike:
    return likeness.alike_within(typed(table(spark, sf, "training_data")), "row_id", F.col("text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of rows, as asked; the operator itself gives pairs of classes and the rows of each."""
    a, b = F.col("left_key"), F.col("right_key")
    return _near_copies(spark, sf).rows().where(a != b).select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def _texts(spark: SparkSession, sf: str, *sources: tuple[str, str, str]) -> DataFrame:
    """(tbl, record_id, text) of the given (table, id column, text column)s."""
    parts = [
        table(spark, sf, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        for name, key, text in sources
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled records with their restored text, null where nothing can be restored."""
    texts = _texts(spark, sf, ("training_data", "row_id", "input_text"), ("log_items", "log_id", "input_text"), ("request_items", "id", "content"))
    return encoding.repaired(texts, "text").select("tbl", "record_id", "restored", "pair").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_repaired(spark, sf).select("tbl", "record_id").distinct()


def p6_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Records that weren't in the consistent form, with that form."""
    texts = _texts(spark, sf, ("training_data", "row_id", "input_text"), ("request_items", "id", "content"), ("evaluation_data", "eval_id", "error_sentence"))
    # both tables are fixed reference lists of a few hundred rows
    samples = [r[0] for r in table(spark, sf, "lang_samples").where("lang = 'vi'").select("sample_text").union(table(spark, sf, "common_words").where("lang = 'vi'").select("word")).collect()]
    return lookalike.consistent(texts, "text", samples).select("tbl", "record_id", "plain_text").distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_plain(spark, sf).select("tbl", "record_id").distinct()


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have near copies, with the group they fall in and their number of links."""
    return likeness.linked_groups(_near_copies(spark, sf)).withColumnRenamed("id", "row_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "heldout_items"), "item_id", "passage").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked, with the documents that hold them."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mix(spark: SparkSession, sf: str, total: str | None = None) -> tuple[DataFrame, list[mixture.Share]]:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf, "source_targets").orderBy("source").collect()]
    return mixture.mixture(table(spark, sf, "documents"), "doc_id", "text", "source", targets, total=total)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture as large as the corpus: small sources reach their caps, the others make up for them."""
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that p8_mixture reaches."""
    return mixture.reached(*_mix(spark, sf))


def p8_met_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the largest mixture that meets every target."""
    return mixture.reached(*_mix(spark, sf, "met"))


def _samples(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """Labelled samples of the languages: two fixed tables of a few hundred rows."""
    rows = table(spark, sf, "lang_samples").select("lang", "sample_text").union(table(spark, sf, "common_words").select("lang", "word"))
    return [(r[0], r[1]) for r in rows.collect()]


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return language.segments(table(spark, sf, "documents"), "doc_id", "text", _samples(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    per = language.documents(docs, "doc_id", "text", _samples(spark, sf)).withColumn("k", F.count("*").over(Window.partitionBy("doc_id")))
    main = per.withColumn("main_lang", F.max(F.when(F.col("main"), F.col("lang"))).over(Window.partitionBy("doc_id")))
    labels = docs.select("doc_id", language.label_code(F.col("lang")).alias("code"))
    return (
        main.join(labels, "doc_id")
        .where(F.col("code").isNull() | (F.col("code") != F.col("main_lang")) | (F.col("k") > 1))
        .where(F.col("share") >= language.SHARE).select("doc_id", "lang").distinct()
    )


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of every document with their share of its words and a confidence."""
    return language.documents(table(spark, sf, "documents"), "doc_id", "text", _samples(spark, sf))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
