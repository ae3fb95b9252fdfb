"""Files as tables, through Spark's readers, so that any store that Spark opens will do.

Spark's readers skip files without a byte.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialects


def list_files(spark: SparkSession, folder: str, recurse: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, name, size, modified) of the files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recurse)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): each file whole."""
    return spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): each file whole."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def write_texts(df: DataFrame, text: str, folder: str) -> None:
    """One line for each row, in as many files as ``df`` has partitions."""
    df.select(F.col(text).alias("value")).write.text(folder)


def file_hashes(spark: SparkSession, folder: str, algorithm: str = "md5") -> DataFrame:
    """(path, digest), lower-case hexadecimal."""
    content = F.col("content")
    digest = F.md5(content) if algorithm == "md5" else F.sha2(content, 256)
    return read_bytes(spark, folder).select("path", digest.alias("digest"))


def same_contents(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(name, same) of files by their path below either folder; null where one side lacks it."""
    side = lambda folder, c: file_hashes(spark, folder, "sha256").select(F.regexp_replace("path", "^.*" + _quoted(folder.rstrip("/").removeprefix("file://")) + "/", "").alias("name"), F.coalesce("digest", F.lit("")).alias(c))
    both = side(left, "l").join(side(right, "r"), "name", "full")
    return both.select("name", (F.col("l") == F.col("r")).alias("same"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def find_on_path(spark: SparkSession, folders: list[str], name: str) -> str | None:
    """The first folder's file of this name."""
    jvm = spark.sparkContext._jvm
    for f in folders:
        where = jvm.org.apache.hadoop.fs.Path(f"{f.rstrip('/')}/{name}")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return where.toString()
    return None


def environment(spark: SparkSession) -> DataFrame:
    """(name, value) of the driver's environment."""
    return spark.createDataFrame(sorted(os.environ.items()), "name string, value string")


def is_inline(text: Column) -> Column:
    """Whether a setting holds its data itself: it has a brace, or the bracket of a section."""
    return F.contains(text, F.lit("{")) | F.contains(text, F.lit("["))


def read_data_or_file(df: DataFrame, key: str, setting: str, folder: str, loose: bool = True) -> DataFrame:
    """The node table of settings that are documents themselves or the names of files below ``folder``."""
    spark = df.sparkSession
    inline = df.where(is_inline(F.col(setting))).select(F.col(key).alias("doc_id"), F.col(setting).alias("text"))
    named = df.where(~is_inline(F.col(setting))).select(F.col(key).alias("doc_id"), F.col(setting).alias("name"))
    texts = read_texts(spark, folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "text")
    return dialects.read_nodes(inline.unionByName(named.join(texts, "name").select("doc_id", "text")), "doc_id", "text", loose)
