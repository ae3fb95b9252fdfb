"""Canonical exact fingerprints of documents, in built-in expressions only.

A text is normalised (NFKC), case-folded and stripped of white-space differences; two seeded 64-bit
xxhashes of the result make a 128-bit bucket (the fingerprint), and within a bucket of several rows the
canonical bytes themselves are compared: ``first_id``, the smallest key of a row's class of equal texts,
and ``copies``, the rows of that class, tell texts apart that share a bucket. Spark has no normaliser among its SQL functions, so the ICU library that it
ships is called by ``java_method``, inside the JVM.

A null text counts as empty. Texts of white space alone are equal to the empty one. Repeated rows get
equal fingerprints. An empty table gives an empty result. Working columns carry an ``_f_`` prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import stage, table

BROADCAST_ROWS = 1_000_000  # of buckets: about 100 MB at most; beyond that, both sides are shuffled

_ICU = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, runs of white space to one space, none at the ends."""
    nfkc = lambda c: F.java_method(F.lit(_ICU[0]), F.lit("compose"), c, F.lit(True))
    fold = F.java_method(F.lit(_ICU[1]), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold), "[\\p{IsWhite_Space}]+", " "))


def digest(canon: Column) -> Column:
    """The 128-bit bucket of a canonical text, as 32 hex digits."""
    part = lambda n: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(n), canon, F.octet_length(canon)))), 16, "0")
    return F.concat(part(1), part(2))


def _behind_count(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(_f_digest, _f_canon, first_key, copies, _f_kinds) of each class of equal texts in buckets of two or more rows.

    Buckets are counted on digests alone; only rows of buckets with two or more bring their bytes,
    and they are grouped by those bytes, so a hash collision never joins two texts. Both groupings
    combine on the map side, so a third of all rows in one bucket costs one row per task.
    ``_f_kinds`` is the number of a bucket's classes; where it is 1, ``_f_canon`` is null.
    """
    hashed = df.select(F.col(key).alias("_f_key"), canonical(F.col(text)).alias("_f_canon")).withColumn("_f_digest", digest(F.col("_f_canon")))
    busy = stage(hashed.groupBy("_f_digest").agg(F.count("*").alias("_f_n")).where("_f_n > 1").select("_f_digest"), "fp-busy")
    rows = hashed.join(_behind_count(busy), "_f_digest", "left_semi")
    # a class: digest and bytes; the bytes are the map-side key's tail, so equal texts meet once per task
    found = rows.groupBy("_f_digest", "_f_canon").agg(F.min("_f_key").alias("first_key"), F.count("*").alias("copies"))
    # a bucket has one row here unless two texts collide
    found = found.withColumn("_f_kinds", F.count("*").over(Window.partitionBy("_f_digest")))
    return stage(found.withColumn("_f_canon", F.when(F.col("_f_kinds") > 1, F.col("_f_canon"))), "fp-classes")


def with_class(hashed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows that have ``_f_digest`` and ``_f_canon``, plus first_key and copies, without those two."""
    one, more = found.where("_f_kinds = 1").drop("_f_canon", "_f_kinds"), found.where("_f_kinds > 1").drop("_f_kinds")
    if more.limit(1).count():  # only then rows bring their bytes
        more = more.withColumnRenamed("first_key", "_f_first").withColumnRenamed("copies", "_f_copies")
        hashed = hashed.join(more, ["_f_digest", "_f_canon"], "left").drop("_f_canon")
    else:
        hashed = hashed.drop("_f_canon").withColumns({"_f_first": F.lit(None).cast(found.schema["first_key"].dataType), "_f_copies": F.lit(None).cast("long")})
    out = hashed.join(_behind_count(one), "_f_digest", "left")
    copies = F.coalesce("_f_copies", "copies", F.lit(1).cast("long"))
    # a text that occurs once is its own class
    first = F.when(F.coalesce("_f_copies", "copies").isNull(), F.col(key)).otherwise(F.coalesce("_f_first", "first_key"))
    return out.withColumns({"first_key": first, "copies": copies}).drop("_f_first", "_f_copies", "_f_digest")


def groups(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, first_key, copies) of every row whose canonical text occurs more than once."""
    hashed = df.select(F.col(key), canonical(F.col(text)).alias("_f_canon")).withColumn("_f_digest", digest(F.col("_f_canon")))
    return with_class(hashed, classes(df, key, text), key).where("copies > 1").select(key, "first_key", "copies")


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``_f_next``: the text of the row with the next smaller key (after the smallest: the largest's).

    Keys are cut into ranges at approximate quantiles, so that each range is sorted alone; the last
    row of a range takes its neighbour from a small table of the ranges' first rows. Equal keys are
    ordered by their text's hash; a null key comes last.
    """
    spark = df.sparkSession
    ranges = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []))
    cut = F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<long>")
    # descending order: range 0 has the largest keys
    place = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(cut, lambda x: x >= F.col(key))))
    df = df.withColumns({"_f_text": F.coalesce(F.col(text), F.lit("")), "_f_range": place}).withColumn("_f_tie", F.xxhash64("_f_text"))
    order = [F.col(key).desc_nulls_last(), F.col("_f_tie")]
    heads = df.groupBy("_f_range").agg(F.max_by("_f_text", F.struct(F.col(key), F.bitwise_not("_f_tie").alias("t"))).alias("_f_head"))
    # one row per range, of a number fixed by the session
    line = Window.partitionBy(F.lit(0)).orderBy("_f_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = Window.partitionBy(F.lit(0)).orderBy("_f_range")
    heads = heads.select("_f_range", F.coalesce(F.lead("_f_head").over(after), F.first("_f_head").over(line)).alias("_f_after"))
    df = df.withColumn("_f_lead", F.lead("_f_text").over(Window.partitionBy("_f_range").orderBy(*order)))
    last = df.where("_f_lead is null").join(heads, "_f_range").withColumn("_f_next", F.col("_f_after")).drop("_f_after")
    inner = df.where("_f_lead is not null").withColumn("_f_next", F.col("_f_lead"))
    drop = ["_f_text", "_f_range", "_f_tie", "_f_lead"]
    return inner.drop(*drop).unionByName(last.drop(*drop))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs, "doc_id", "text")
    df = with_next(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.col("_f_next"), F.lit(1), half))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("_a"), canonical(edited).alias("_b"), canonical(F.col("_f_next")).alias("_c"))
    df = df.withColumns({"fingerprint": digest(F.col("_a")), "edited_fingerprint": digest(F.col("_b")), "next_fingerprint": digest(F.col("_c"))})
    like = lambda other, canon: ((F.col("fingerprint") == F.col(other)) & (F.col("_a") == F.col(canon))).cast("double")
    df = df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint", "_b").alias("near_edited"), like("next_fingerprint", "_c").alias("near_next"), F.col("fingerprint").alias("_f_digest"), F.col("_a").alias("_f_canon"))
    return with_class(df, found, "doc_id").withColumnRenamed("first_key", "first_id")
