"""Streams of files: n-gram counts and document findings that follow a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngrams
from ..sources import dialects, trees


def text_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(path, text) of files as they arrive, each whole; at most ``most_files`` a batch."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files)
    return stream.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def count_stream(texts: DataFrame, alphabets: tuple[ngrams.Alphabet, ...]) -> DataFrame:
    """Running n-gram counts; the state is one sum for each context and symbol, so it is bounded by the alphabets."""
    return ngrams.learn(texts, "text", alphabets)


def node_stream(texts: DataFrame, loose: bool = False) -> DataFrame:
    """The node tables of documents as they arrive, keyed by path; no state."""
    return dialects.read_nodes(texts, "path", "text", loose)


def finding_stream(texts: DataFrame, schema: str, loose: bool = False) -> DataFrame:
    """(path, finding) of documents that break a schema; no state."""
    return texts.select("path", F.explode(trees.validation(F.col("text"), schema, loose)).alias("finding"))
