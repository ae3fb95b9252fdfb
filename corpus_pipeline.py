"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. Between stages rows are written as Parquet and read again.

Columns that a stage doesn't work on travel in one struct, so their names can't clash with its own. Null and
empty texts: the language stage drops them, as they have no letter; the others keep them. Very long texts are
worked whole. Rows that repeat with their id and text are one group of copies: one stays. Null ids are ids like
any other, last in order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandal.llm import langid, mixing, packing, secrets, similarity
from strandal.llm.base import columns_of, new_path, session_conf, stage, table

#: Rows of document ids that may be broadcast: 48 MB at most. Beyond that, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _carried(docs: DataFrame, *beside: str):
    """The columns of ``docs`` in one struct, and some of them beside it."""
    return docs.select(F.struct(*columns_of(docs)).alias("row"), *beside)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter have no identifiable language and go; a close lead is no reason, as short texts have few phrases."""
    samples = langid.learn(langid.training_rows(docs), "text", "lang", "doc_id")
    return langid.identify(_carried(docs, "text"), samples).where("_l_lang <> 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the smallest id stays.

    A document is known by its id and a hash of its text, so that different texts under one id are told apart.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), key.alias("key"))
    groups = similarity.similarity_groups(docs.select(key.alias("key"), "text"), key="key", k=5, percent=80)
    repeated = groups.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("key"))
    gone = stage(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "pipe-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # all parts of the key are compared null-safe
    parts = lambda df: df.select(F.col("key.none").alias("g_none"), F.coalesce(F.col("key.id").cast("string"), F.lit("")).alias("g_id"), F.col("key.hash").alias("g_hash"))
    same = (F.col("key.none") == F.col("g_none")) & (F.coalesce(F.col("key.id").cast("string"), F.lit("")) == F.col("g_id")) & (F.col("key.hash") == F.col("g_hash"))
    kept = rows.join(F.broadcast(parts(gone)) if few else parts(gone), same, "left_anti")
    repeated = stage(parts(repeated), "pipe-repeated")
    if repeated.limit(1).count():  # equal rows: the first of each kind stays
        again = F.broadcast(repeated) if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else repeated
        one = kept.join(again, same, "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        kept = kept.join(again, same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay."""
    clean = secrets.scan(_carried(docs, "text"), secrets.symbol_excess(docs), clean=True)
    count = F.length("_s_text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("row", F.col("row").withField("text", F.col("_s_text")).withField("n_chars", count)).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources' words come near their weights."""
    sized = stage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "pipe-mix")
    plan = mixing.plan_mix(sized, "size", "source", ["doc_id"])
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    copies = mixing.apply_mix(rows, plan, "source", ["doc_id"], "size").where("_m_copies > 0")
    return copies.select("row", F.explode(F.array_repeat(F.lit(True), F.col("_m_copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of a window each."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack", pack)]

#: The stages learn, hash and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{name}")
            with session_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
                docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
