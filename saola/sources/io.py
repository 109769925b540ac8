"""Readers and writers for corpora, training sets, evaluation files, logs and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import clean_line

LOG_SCHEMA = "log_id bigint, client_id string, input_text string, predict_text string, logged_at timestamp, received_at timestamp, elapsed_time double"
QUEUE_SCHEMA = "id string, content string, prediction string, finish int, client_id string, queued_at timestamp"


def read_lines(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One row per line, cleaned."""
    return spark.read.text(path).select(clean_line(F.col("value")).alias(column))


def read_csv(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One column of a CSV file with header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(column)


def read_corpus(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """A corpus by the ending of its path: txt or csv."""
    if path.endswith("txt"):
        return read_lines(spark, path, column)
    if path.endswith("csv"):
        return read_csv(spark, path, column)
    raise ValueError("the corpus must be a txt or a csv file")


def write_lines(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    """One line per row."""
    df.select(column).write.mode(mode).text(path)


def write_training(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Training rows as CSV with header; a path ending in parquet gives Parquet."""
    rows = df.select("corrected", "input_text", "detected", "new_target")
    if path.endswith("parquet"):
        rows.write.mode(mode).parquet(path)
    else:
        write_csv(rows, path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """CSV with header that read_csv reads back as it was, blanks at the ends of texts included."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).partitionBy(*by).options(header=True, escape='"', **blanks).csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_evaluation(spark: SparkSession, directory: str) -> DataFrame:
    """All CSV files under directory/<error type>/, with error_type, the error percentage (the two digits nine
    places before the end of the file name, null for others) and the columns under their established names; no rows where
    there is no file."""
    names = {"augmented": "error_sentence", "label": "detection_target", "original": "correction_target"}
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{directory}/*/*.csv")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{v} string" for v in names.values()) + ", error_type string, error_pct int")
    path = F.col("_metadata.file_path")
    return df.select(
        *[F.col(k).alias(v) for k, v in names.items()],
        F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("error_type"),
        F.substring(path, -9, 2).try_cast("int").alias("error_pct"),
    )


@dataclass(frozen=True)
class TrainSettings:
    model: str = ""
    train_path: str = ""
    output_path: str = ""
    epochs: int = 3
    batch_size: int = 16
    max_length: int = 128
    learning_rate: float = 1e-5
    weight_decay: float = 0.01


def read_settings(path: str) -> TrainSettings:
    """Settings from a YAML mapping, possibly under 'train'; unknown keys are ignored."""
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    data = data.get("train", data)
    return TrainSettings(**{f.name: type(f.default)(data[f.name]) for f in fields(TrainSettings) if f.name in data})
