"""Precision, recall and F1 of detection and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import clean_detection, drop_punctuation, pieces

SPAN = "(<error>.+?</error>)"


def _bind(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def count_errors(target: Column, predicted: Column) -> Column:
    """struct<actual, predicted, matched> of the tagged spans. A predicted span is looked for among the target spans
    from a mark on, which a match moves to its place counted from that mark, so a target may match twice, as the
    established count has it; surplus predictions count as actual errors."""
    spans = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SPAN), F.lit(1))

    def matched(p: Column) -> Column:
        def step(s: Column, span: Column) -> Column:
            at = F.array_position(F.slice(p["want"], s["mark"] + 1, F.size(p["want"])), span).cast("int")
            return F.when(at > 0, F.struct((at - 1).alias("mark"), (s["n"] + 1).alias("n"))).otherwise(s)

        n = F.aggregate(p["got"], F.struct(F.lit(0).alias("mark"), F.lit(0).alias("n")), step)["n"]
        return F.struct(F.greatest(F.size(p["want"]), F.size(p["got"])).alias("actual"), F.size(p["got"]).alias("predicted"), n.alias("matched"))

    return _bind(F.struct(spans(target).alias("want"), spans(predicted).alias("got")), matched)


def _times(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def _without(words: Column, gone: Column, other: Column) -> Column:
    """Words without the first occurrences that `gone` names, each as often as gone and other both hold it."""
    nth = lambda w, i: _times(F.slice(words, F.lit(1), i + 1), w)
    return F.filter(words, lambda w, i: nth(w, i) > F.least(_times(gone, w), _times(other, w)))


def count_corrections(correct: Column, predicted: Column, detected: Column, most_apart: int = 2) -> Column:
    """Corrected words that are right: words outside the tags leave both sentences as often as the right one holds
    them, the rest is compared word by word, or by all equal pairs where the numbers of words differ by at most
    `most_apart`."""
    bare = lambda c: drop_punctuation(F.coalesce(c, F.lit("")))
    texts = F.struct(pieces(bare(correct)).alias("want"), pieces(bare(predicted)).alias("got"), pieces(F.regexp_replace(bare(detected), SPAN, "")).alias("clean"))
    left = _bind(texts, lambda p: F.struct(_without(p["want"], p["clean"], p["want"]).alias("want"), _without(p["got"], p["clean"], p["want"]).alias("got")))

    def score(p: Column) -> Column:
        same = F.size(F.filter(F.zip_with(p["got"], p["want"], lambda a, b: a == b), lambda x: x))
        pairs = F.aggregate(p["got"], F.lit(0), lambda n, w: n + _times(p["want"], w))
        apart = F.abs(F.size(p["want"]) - F.size(p["got"]))
        return F.when(apart == 0, same).when(apart > most_apart, 0).otherwise(pairs)

    return _bind(left, score)


def tag_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("(<error>.+?</error>)"), F.lit(1)))


def scores(df: DataFrame, detection_target: str, detection_predict: str, correction_target: str, correction_predict: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro precision, recall and F1 of both tasks over all rows, or per group. Null texts count as empty, a
    ratio without a denominator is null."""
    detected = F.coalesce(clean_detection(F.col(detection_predict)), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(*by, count_errors(text(detection_target), detected).alias("e"), count_corrections(text(correction_target), text(correction_predict), detected).alias("right"))
    sums = rows.groupBy(*by).agg(
        F.sum("e.actual").alias("actual_errors"), F.sum("e.predicted").alias("predicted_errors"),
        F.sum("e.matched").alias("true_detections"), F.sum("right").alias("true_corrections"),
    )

    def task(name: str, true: str) -> list[Column]:
        p, r = F.try_divide(true, "predicted_errors"), F.try_divide(true, "actual_errors")
        return [F.round(p, 6).alias(f"{name}_precision"), F.round(r, 6).alias(f"{name}_recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias(f"{name}_f1")]

    return sums.select("*", *task("detection", "true_detections"), *task("correction", "true_corrections"))
